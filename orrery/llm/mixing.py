"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a target: its weight's share of the mix, at most ``cap`` times its size, the excess reshared by weight
until no target is above its cap. A document starts with target / size of its source as its copies; the integral part
is certain, the rest is a fractional copy. Two fractional copies are paired: words move from one to the other, at random
in a direction and by an amount that leave each one's expectation as it was, until one of them is integral. A pair's
words stay the same in sum, so a source takes its target but for the last fractional copy, which may be that of a long document.
What it leaves over or lacks is settled in change: a few documents of each order of size give or take a copy, from the longest
on, wherever that brings the source nearer to its target, so that what remains is less than a short document has.

Documents meet in cells: a cell is a source and a hash of the id, so that it doesn't depend on how the table is
partitioned and holds a bounded number of rows of the largest source. Each cell leaves one fractional copy at most; cells
are combined in a tree, GROUP of them at a time, down to one for each source. Random numbers are hashes of ids: reruns
agree. Rows of a repeated id are told apart by their sizes and their order within one id and size.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import materialize, shuffle_width, words_of

#: Rows of a cell, about, and cells combined at a time.
CELL, GROUP = 20_000, 16
#: Sources up to which their table is broadcast; a larger one is joined by a shuffle.
BROADCAST_SOURCES = 20_000
#: Rows of (id, size, place, copies) up to which they are broadcast, at some 60 bytes each.
BROADCAST_COPIES = 500_000
#: Documents of a source, direction and order of size that are offered as change.
CHANGE = 4
#: A fraction this close to an integer is that integer.
EPS = 1e-9


def size_of(text_col: str = "text"):
    """Words of a text; a null one has none."""
    return F.size(words_of(F.coalesce(F.col(text_col), F.lit("")))).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, weight, target) from rows of (source, size): a row for each source, null last.

    Weights repeat over the sources in order of code points. Only sums over sources come to the driver.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # One row for each source meets in this window.
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.array(*[F.lit(float(x)) for x in weights])
    rows = materialize(
        per.withColumn("at", F.row_number().over(order) - 1)
        .select("source", "source_size", F.get(w, F.col("at") % len(weights)).alias("weight"))
        .withColumn("cap", cap * F.col("source_size")),
        "sources",
    )
    total = share * float(rows.agg(F.sum("source_size")).first()[0] or 0)
    # Each round takes the sources that would exceed their caps out of the sharing; there are at most as many rounds as sources.
    rate = 0.0
    while True:
        full = F.col("cap") <= rate * F.col("weight")
        got = rows.agg(
            F.sum(F.when(full, F.col("cap"))).alias("filled"), F.sum(F.when(~full, F.col("weight"))).alias("open")
        ).first()
        if not got["open"]:
            break
        new = (total - (got["filled"] or 0.0)) / got["open"]
        if new <= rate:
            break
        rate = new
    return rows.select(
        "source", "source_size", "weight", F.least(F.col("cap"), F.lit(rate) * F.col("weight")).alias("target")
    )


def _uniform(*parts) -> float:
    return xxhash.xxh64_intdigest("|".join(map(str, parts)).encode(), 7) / 2**64


def pivot(a: tuple, b: tuple, u: float) -> tuple[tuple, tuple]:
    """Move words between two fractional copies (key, size, copies) until one of them is integral; it comes first."""
    (ka, sa, xa), (kb, sb, xb) = a, b
    up = min((1 - xa) * sa, xb * sb)  # words that a can gain from b
    down = min(xa * sa, (1 - xb) * sb)
    moved = up if u * (up + down) < down else -down
    xa, xb = xa + moved / sa, xb - moved / sb
    a, b = (ka, sa, xa), (kb, sb, xb)
    return (a, b) if min(xa, 1 - xa) <= min(xb, 1 - xb) else (b, a)


def _integral(x: float) -> bool:
    return x < EPS or x > 1 - EPS


FIELDS = "row long, source string, cell long, size long, whole long, part double"


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Combine the fractional copies of each run of rows of a (source, cell); at most one of a cell stays fractional."""
    at, held = None, None  # the cell, and the row in it that is fractional

    def settled(row: dict, x: float) -> dict:
        return row | {"whole": row["whole"] + (x > 0.5), "part": 0.0}

    for b in batches:
        out = []
        for row in b.to_pylist():
            cell = (row["source"], row["cell"])
            if cell != at:
                if held is not None:
                    out.append(held)
                at, held = cell, None
            if not row["size"] or _integral(row["part"]):
                out.append(settled(row, row["part"]))
            elif held is None:
                held = row
            else:
                u = _uniform(held["row"], row["row"])
                first, second = pivot((0, held["size"], held["part"]), (1, row["size"], row["part"]), u)
                both = (held, row)
                out.append(settled(both[first[0]], first[2]))
                held = both[second[0]] | {"part": second[2]}
                if _integral(second[2]):
                    out.append(settled(held, second[2]))
                    held = None
        yield pa.RecordBatch.from_pylist(out, schema=_arrow())
    if held is not None:
        yield pa.RecordBatch.from_pylist([held], schema=_arrow())


def _arrow() -> pa.Schema:
    kinds = {"row": pa.int64(), "source": pa.string(), "cell": pa.int64(), "size": pa.int64(), "whole": pa.int64(), "part": pa.float64()}
    return pa.schema(list(kinds.items()))


def _folded(rows: DataFrame, name: str) -> DataFrame:
    # The hash of a row orders a cell: the meeting partners are random, and the same in every run.
    dealt = rows.repartition(shuffle_width(rows.sparkSession), "source", "cell")
    return materialize(
        dealt.sortWithinPartitions("source", "cell", F.xxhash64("row"), "row").mapInArrow(_fold, FIELDS), name
    )


def mix(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5, cap: float = 2.0, size=None, text_col: str = "text",
) -> DataFrame:
    """(id, size, source_size, target, copies, taken, place) of every row; ``size`` is a column, the words of the text if
    None; place numbers the rows of one id and size in order of their sources.

    Null ids count like others. No document has more than ``cap`` copies, rounded up. An empty table gives no rows.
    """
    spark = docs.sparkSession
    sized = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), (size_of(text_col) if size is None else size).alias("size")
    )
    sized = materialize(sized, "sizes")
    per = targets(sized, weights, share, cap)
    few = per.count() <= BROADCAST_SOURCES
    known = per.select(F.col("source").alias("__source"), "source_size", "target")
    joined = sized.join(F.broadcast(known) if few else known, F.col("source").eqNullSafe(F.col("__source")))
    copies = F.col("target") / F.nullif(F.col("source_size"), F.lit(0))
    whole = F.floor(F.coalesce(copies, F.lit(0.0)) + EPS)
    # A row is told by its id, and rows of one id and size, which any order may number, by their place among them.
    repeats = Window.partitionBy("id", "size").orderBy("source")
    joined = joined.withColumn("place", F.row_number().over(repeats))
    rows = joined.select(
        "place",
        "id", "source", "size", "source_size", "target",
        whole.alias("whole"), F.greatest(F.coalesce(copies, F.lit(0.0)) - whole, F.lit(0.0)).alias("part"),
        F.xxhash64("id", "size", "place").alias("row"),
    )
    rows = materialize(rows, "rows")
    total = rows.count()
    # A power of GROUP of cells for each source, so that the largest source's cells hold about CELL rows.
    levels = 0
    while total > CELL * GROUP**levels:
        levels += 1
    left = rows.select("row", "source", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(GROUP**levels)).alias("cell"), "size", "whole", "part")
    done = None
    for k in range(levels + 1):
        if k:
            left = left.withColumn("cell", F.expr(f"cell div {GROUP}"))
        folded = _folded(left, "folded")
        now, left = folded.where("part = 0"), folded.where("part > 0")
        done = now if done is None else done.unionByName(now)
    # What is left is one fractional copy for each source; it is taken with its own chance.
    chance = F.pmod(F.xxhash64("row", F.lit(2)), F.lit(1 << 30)) / float(1 << 30)
    last = left.withColumn("whole", F.col("whole") + (chance < F.col("part")).cast("long")).withColumn("part", F.lit(0.0))
    taken = done.unionByName(last).select("row", F.col("whole").alias("copies"))
    made = materialize(rows.join(taken, "row").select("row", "id", "source", "size", "source_size", "target", "copies", "place"), "drawn")
    # A row of id and size is told by its own number; few documents change.
    moved = materialize(change(made, cap), "change")
    few = moved.count() <= BROADCAST_COPIES
    moved = moved.withColumnRenamed("row", "__row")
    settled = made.join(F.broadcast(moved) if few else moved, F.col("row") == F.col("__row"), "left")
    copies = F.col("copies") + F.coalesce(F.col("step"), F.lit(0))
    return settled.select(
        F.col("id").alias(id_col), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "place"
    )


def _give(table: pa.Table) -> pa.Table:
    """Which of a source's documents give or take a copy: from the longest on, where it brings the source nearer to its target."""
    rows = sorted(table.to_pylist(), key=lambda r: (-r["size"], r["step"], r["row"]))
    off, used, out = rows[0]["off"], set(), []
    for r in rows:
        if r["row"] not in used and abs(off - r["step"] * r["size"]) < abs(off):
            off -= r["step"] * r["size"]
            used.add(r["row"])
            out.append(r)
    return pa.table({"row": pa.array([r["row"] for r in out], pa.int64()), "step": pa.array([r["step"] for r in out], pa.int64())})


def change(made: DataFrame, cap: float) -> DataFrame:
    """(row, step): documents with a copy more or less, so that each source comes near its target.

    Of each source, direction and power of two of the size, CHANGE documents are offered, picked by a hash, which is all that a
    source's task gets.
    """
    per = made.groupBy("source").agg((F.max("target") - F.sum(F.col("copies") * F.col("size"))).alias("off")).where("off <> 0")
    steps = F.filter(
        F.array(F.when(F.col("copies") + 1 <= cap, F.lit(1).cast("long")), F.when(F.col("copies") >= 1, F.lit(-1).cast("long"))), lambda x: x.isNotNull()
    )
    offered = made.where("size > 0").select("row", "source", "size", F.explode(steps).alias("step"))
    offered = offered.withColumn("order", F.length(F.bin("size")))
    best = Window.partitionBy("source", "step", "order").orderBy(F.xxhash64("row", F.lit(3)), "row")
    some = offered.withColumn("at", F.row_number().over(best)).where(F.col("at") <= CHANGE)
    named = per.withColumnRenamed("source", "__source")
    asked = some.join(named, F.col("source").eqNullSafe(F.col("__source"))).select("row", "source", "size", "step", "off")
    return asked.groupBy("source").applyInArrow(_give, "row long, step long")


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **rules) -> DataFrame:
    """The rows of docs, each as often as the mix takes it.

    Texts move only if the table of copies is too large for a broadcast, or to number rows of a repeated id.
    """
    named = (
        docs.withColumn("__id", F.col(id_col))
        .withColumn("__size", size_of(text_col))
        .withColumn("__source", F.col(source_col).cast("string"))
    )
    copies = materialize(mix(docs, id_col, source_col, text_col=text_col, **rules), "copies")
    if copies.where("place > 1").limit(1).count():
        named = named.withColumn("__place", F.row_number().over(Window.partitionBy("__id", "__size").orderBy("__source")))
    else:
        named = named.withColumn("__place", F.lit(1))
    taken = copies.where("copies > 0").select(
        F.col(id_col).alias("__of"), F.col("size").alias("__of_size"), F.col("place").alias("__of_place"), F.col("copies").alias("__copies")
    )
    few = taken.count() <= BROADCAST_COPIES
    same = (
        F.col("__id").eqNullSafe(F.col("__of")) & (F.col("__size") == F.col("__of_size")) & (F.col("__place") == F.col("__of_place"))
    )
    repeated = named.join(F.broadcast(taken) if few else taken, same).withColumn(
        "__each", F.explode(F.array_repeat(F.lit(1), F.col("__copies").cast("int")))
    )
    return repeated.select(*[F.col(f"`{c}`") for c in docs.columns])
