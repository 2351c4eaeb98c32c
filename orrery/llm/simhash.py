"""SimHash fingerprints and near-duplicate groups by covering locality-sensitive hashing.

Fingerprint: a bit is 1 if it is set in over half of the XXH64 hashes of a text's word shingles. Links: fingerprints
that differ in at most ``radius`` bits. Each bit position i gets a non-zero vector m(i) of radius + 1 bits; table v,
for each non-zero v, keeps the positions with an odd <m(i), v>. The differing positions of a close pair put at most
radius equations on v, so that some v is zero at all of them: in that table the pair has the same key. No pair within
the radius is missed.

Equal fingerprints are one node, so exact copies never meet in pairs. The members of a bucket are compared within it,
and only the edges of a spanning forest leave it. A bucket of more than BUCKET fingerprints is dealt out anew by covering
tables over the positions that its own mask leaves free, again and again, until its size is bounded by the few positions
left: nothing is capped or dropped.

Null and empty texts have the fingerprint zero and link like any other. Rows of a repeated id each count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import LOWER, appended, materialize, shuffle_width, small_batches
from .components import components

BITS = 64
#: Buckets up to this size are compared within one task.
BUCKET = 4096
SEED = 42
#: Words of 64 bits in a wide fingerprint, and parts of its bits that are covered for PART_RADIUS each.
WIDE, PARTS, PART_RADIUS = 4, 10, 2
#: How often a large group is compared with one of its members before the rest is compared in blocks.
PIVOTS = 3
#: Sets and shingles of a candidate group that are compared within one task.
GROUP_SETS, GROUP_SHINGLES = 4096, 4_000_000
#: Ids to remove up to which they are broadcast.
BROADCAST_IDS = 500_000

_bits = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of each shingle of words; of all words if there are fewer, of nothing if there are none."""
    words = (text or "").encode().translate(LOWER).split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= shingle:
        return np.array([digest(joined, SEED)], np.uint64)
    lens = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lens + 1) - 1
    spans = zip((ends - lens)[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, n - shingle + 1)


def _majority(hashes: np.ndarray) -> np.uint64:
    """The bits that are set in over half of the hashes."""
    if not len(hashes):
        return np.uint64(0)
    lanes = hashes.view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(lanes[:, j], minlength=256) @ _bits for j in range(8)])
    return np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0]


def simhash(text: str | None, shingle: int = 3) -> int:
    """The unsigned 64-bit fingerprint of a text."""
    return int(_majority(shingle_hashes(text, shingle)))


def wide_simhash(text: str | None, shingle: int) -> list[np.uint64]:
    """WIDE fingerprints of 64 bits, from independent mixes of the shingles' hashes."""
    h, out = shingle_hashes(text, shingle), []
    for k in range(WIDE):
        x = h + np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1)
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        out.append(_majority(x ^ x >> np.uint64(31)))
    return out


def fingerprints(df: DataFrame, text_col: str = "text", shingle: int = 3, out_col: str = "fingerprint") -> DataFrame:
    """df with ``out_col`` long: the fingerprint's bits as a signed integer."""
    kept, schema = appended(df, [(out_col, T.LongType())])
    names = kept.columns
    source = df if text_col not in names else kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([simhash(t, shingle) for t in b.column(text_col).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(found)], names=[*names, out_col])

    return source.mapInArrow(run, schema)


def covering_masks(radius: int, positions: list[int]) -> list[int]:
    """A mask over the positions for each table: 2^(radius+1) - 1 of them."""
    size = (1 << (radius + 1)) - 1
    return [
        sum(1 << p for k, p in enumerate(positions) if ((k % size + 1) & v).bit_count() % 2) for v in range(1, size + 1)
    ]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def stars(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of the numbers 0 .. n-1 that the pairs (a, b) lead to, for each of them."""
    least = np.arange(n)
    while True:
        low = np.minimum(least[a], least[b])
        if not (least[a] != least[b]).any():
            return least
        np.minimum.at(least, least[a], low)
        np.minimum.at(least, least[b], low)
        while (up := least[least]).tobytes() != least.tobytes():
            least = up


def _edges_of(groups: np.ndarray, asks: np.ndarray, nodes: np.ndarray, bits: np.ndarray, radius: int) -> np.ndarray:
    """Edges that connect the rows of each run of equal ``groups`` as all pairs within the radius would.

    Pairs of which neither row ``asks`` are left out; those that ask come first in a run. All runs are compared at once,
    each row with the one at a distance of 1, 2, ... rows.
    """
    n, columns = len(nodes), [np.ascontiguousarray(bits[:, k]) for k in range(bits.shape[1])]
    last = np.r_[np.flatnonzero(groups[1:] != groups[:-1]), n - 1]
    end = np.repeat(last, np.diff(np.r_[-1, last]))  # the last row of each row's run
    at, far = np.flatnonzero(asks), 0
    a, b, held = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0

    def folded() -> tuple[np.ndarray, np.ndarray]:
        least = stars(n, np.concatenate(a), np.concatenate(b))
        own = np.flatnonzero(least != np.arange(n))
        return own, least[own]

    while True:
        far += 1
        at = at[at + far <= end[at]]
        if not len(at):
            break
        for s in range(0, len(at), 1 << 16):
            i, apart = at[s : s + (1 << 16)], 0
            for c in columns:
                apart = apart + np.bitwise_count(c[i] ^ c[i + far]).astype(np.uint16)
            near = i[apart <= radius]
            a.append(near)
            b.append(near + far)
            held += len(near)
        if held > 1 << 20:
            x, y = folded()
            a, b, held = [x], [y], 0
    x, y = folded()
    return np.stack([nodes[y], nodes[x]], axis=1)


def _compare(radius: int, words: list[str]):
    names = ["key", "asks", "node", *words]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.empty((0, len(names)), np.int64)

        def out(part: np.ndarray) -> pa.RecordBatch:
            bits = part[:, 3:].view(np.uint64)
            edges = _edges_of(part[:, 0], part[:, 1], part[:, 2], bits, radius)
            return pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], names=["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            rest = np.concatenate([rest, np.stack([b.column(n).to_numpy() for n in names], axis=1)])
            other = np.flatnonzero(rest[:, 0] != rest[-1, 0])
            if len(other):
                cut = int(other[-1]) + 1
                yield out(rest[:cut])
                rest = rest[cut:]
        if len(rest):
            yield out(rest)

    return run


def _compared(rows: DataFrame, radius: int, words: list[str]) -> DataFrame:
    """A table of edges (a, b) within each ``key``, of pairs of which one row ``asks``."""
    dealt = rows.repartition(shuffle_width(rows.sparkSession), "key").sortWithinPartitions("key", F.col("asks").desc())
    dealt = dealt.select("key", F.col("asks").cast("long").alias("asks"), "node", *words)
    return materialize(dealt.mapInArrow(_compare(radius, words), "a long, b long"), "links")


def links(
    distinct: DataFrame, radius: int, words: list[str], tables: list[list[tuple[int, ...]]], next_level, bucket: int = BUCKET
) -> DataFrame:
    """Edges (a, b) that connect the column ``node`` as all pairs within the radius that share a table's key would.

    ``words`` are the columns of a fingerprint. ``tables``: for each path, the masks of its tables, one for each word. A
    bucket of more than ``bucket`` rows goes on to the tables that next_level(masks) gives, or none if its size is bounded.
    Without next_level such a bucket is compared whole, by large_links.
    """
    rows = distinct.select("node", *words, F.lit(0).alias("at"))
    found = None
    while True:
        width = len(tables[0])
        flat = F.array(*[F.array(*[F.array(*[F.lit(_signed(m)) for m in masks]) for masks in per]) for per in tables])
        dealt = rows.select("node", *words, "at", F.posexplode(F.element_at(flat, F.col("at") + 1)).alias("v", "t")).select(
            (F.col("at") * width + F.col("v")).cast("int").alias("path"),
            "node", *words, *[F.col(w).bitwiseAND(F.get("t", F.lit(k))).alias(f"k{k}") for k, w in enumerate(words)],
        ).select("path", F.xxhash64("path", *[f"k{k}" for k in range(len(words))]).alias("key"), "node", *words)
        following = [next_level(*masks) for per in tables for masks in per] if next_level else None
        large = None
        if following is None or all(following):
            large = materialize(dealt.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > bucket), "buckets")
            large = None if large.isEmpty() else large.select("key")
        small = dealt if large is None else dealt.join(large, "key", "left_anti")
        edges = _compared(small.select("key", F.lit(True).alias("asks"), "node", *words), radius, words)
        found = edges if found is None else found.unionByName(edges)
        if large is None:
            return found
        rows = dealt.join(large, "key", "left_semi")
        if following is None:
            apart = sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"p.{w}"))) for w in words), F.lit(0))
            more = large_links(
                materialize(rows.select("key", "node", *words), "large"), words, apart, radius, bucket,
                lambda x: _compared(x, radius, words),
            )
            return found.unionByName(more)
        rows, tables = rows.select("node", *words, F.col("path").alias("at")), following


def large_links(rows: DataFrame, payload: list[str], apart, radius: float, bucket: int, compared, weight=None) -> DataFrame:
    """Edges (a, b) that connect the nodes of each ``key`` as all pairs at most ``radius`` apart would; keys may be very large.

    rows: (key, node, payload); ``apart`` is the distance of a row's payload from that of ``p``, a metric; compared(rows)
    gives the edges within (key) of pairs of which one row ``asks``. ``weight``: how much of a block a row takes, 1 if None.

    A key's members are first compared with one of them, which links a dense group in one pass. By the triangle inequality
    only a row at most twice the radius from that one can link to the linked ones, and only to those that are far enough
    out; such pairs are compared in blocks. All others go on, and what is left after PIVOTS rounds is compared in pairs of
    blocks.
    """
    spark, found = rows.sparkSession, None
    weight = F.lit(1) if weight is None else weight

    def add(edges: DataFrame) -> None:
        nonlocal found
        found = edges if found is None else found.unionByName(edges)

    for _ in range(PIVOTS):
        first = rows.groupBy("key").agg(F.min_by(F.struct("node", *payload), F.col("node")).alias("p"))
        # A row for each large key: broadcast by its bytes, else joined with a hot key split as a skewed one.
        seen = rows.join(materialize(first, "pivots"), "key").withColumn("apart", apart)
        seen = materialize(seen.select("key", "node", *payload, "apart", F.col("p.node").alias("pivot")), "seen")
        core = seen.where(F.col("apart") <= radius)
        add(core.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")))
        fringe = seen.where((F.col("apart") > radius) & (F.col("apart") <= 2 * radius))
        reach = fringe.groupBy("key").agg(F.min("apart").alias("__least"), F.sum(weight).alias("__weight"))
        # Members of the core that some row of the fringe can link to, in blocks against the fringe's blocks.
        met = core.join(reach, "key").where((F.col("apart") >= F.col("__least") - radius) & (F.col("node") != F.col("pivot")))
        cores = met.groupBy("key").agg(F.sum(weight).alias("__core"))
        pieces = lambda c: F.greatest(F.ceil(F.col(c) * 2 / bucket), F.lit(1)).cast("int")
        sizes = reach.join(cores, "key").select("key", pieces("__weight").alias("__f"), pieces("__core").alias("__c"))
        sizes = materialize(sizes, "sizes")
        own = lambda c: F.pmod(F.xxhash64("node", F.lit(1)), F.col(c)).cast("int")
        asking = fringe.join(sizes, "key").select(
            "key", own("__f").alias("__i"), F.explode(F.sequence(F.lit(0), F.col("__c") - 1)).alias("__j"), F.lit(True).alias("asks"), "node", *payload
        )
        answering = met.join(sizes, "key").select(
            "key", F.explode(F.sequence(F.lit(0), F.col("__f") - 1)).alias("__i"), own("__c").alias("__j"), F.lit(False).alias("asks"), "node", *payload
        )
        both = asking.unionByName(answering).select(F.xxhash64("key", "__i", "__j").alias("key"), "asks", "node", *payload)
        add(compared(both))
        rest = seen.where(F.col("apart") > radius).select("key", "node", *payload)
        left = rest.groupBy("key").agg(F.sum(weight).alias("__n"))
        left = materialize(left.select("key", F.ceil(F.when(F.col("__n") > bucket, F.col("__n") * 2 / bucket).otherwise(0)).cast("int").alias("__b")), "left")
        small = rest.join(left.where("__b = 0"), "key").select("key", F.lit(True).alias("asks"), "node", *payload)
        add(compared(small))
        left = left.where("__b > 0")
        if left.isEmpty():
            return found
        rows = materialize(rest.join(left, "key").select("key", "node", *payload), "rest")
    dealt = in_pairs(rows.join(left, "key"), F.col("node"), F.col("__b"))
    add(compared(dealt.select(F.xxhash64("key", "one", "other").alias("key"), F.lit(True).alias("asks"), "node", *payload)))
    return found


def in_pairs(rows: DataFrame, node, blocks) -> DataFrame:
    """rows dealt by a hash of ``node`` into so many blocks, once for each pair (one, other) of its block and another.

    Any two rows have a pair in common. With fewer than two blocks the pair is (0, 0).
    """
    own = F.when(blocks > 1, F.pmod(F.xxhash64(node, F.lit(1)), blocks)).otherwise(0).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.greatest(blocks - 1, F.lit(0))), lambda x: (x != F.col("__own")) | (blocks < 2))
    dealt = rows.withColumn("__own", own).withColumn("__other", F.explode(others))
    return dealt.withColumns({"one": F.least("__own", "__other"), "other": F.greatest("__own", "__other")}).drop("__own", "__other")


def _free(mask: int) -> list[int]:
    return [p for p in range(BITS) if not mask >> p & 1]


def covering_links(distinct: DataFrame, radius: int = 2, bucket: int = BUCKET) -> DataFrame:
    """Edges that connect distinct fingerprints ``fp`` as all pairs within the radius would; none is missed."""

    def tables(mask: int) -> list[tuple[int]]:
        # Of positions so few that a bucket can't be larger, no more tables are made.
        free = _free(mask)
        return [(mask | m,) for m in covering_masks(radius, free)] if len(free) >= bucket.bit_length() else []

    nodes = distinct.select(F.col("fp").alias("node"), "fp")
    return links(nodes, radius, ["fp"], [tables(0)], tables, bucket)


def near_duplicates(marked: DataFrame, id_col: str = "doc_id", fp_col: str = "fingerprint", radius: int = 2) -> DataFrame:
    """(id, fingerprint, component_id): the least id that links lead to, the row's own included.

    ``marked`` should be a table, as it is read twice. A component all of whose ids are null has a null component_id.
    """
    rows = marked.select(F.col(id_col).alias("id"), F.col(fp_col).alias("fp"))
    distinct = materialize(rows.groupBy("fp").agg(F.min("id").alias("least")), "fingerprints")
    roots = components(covering_links(distinct, radius))
    joined = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = joined.join(least, "root").select("fp", "component_id")
    return rows.join(classes, "fp").select(
        F.col("id").alias(id_col), F.col("fp").alias(fp_col), "component_id"
    )


def wide_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """(id, hash, f0 .. f3 long): a hash of the text and the wide fingerprint of every row."""
    names = [f"f{k}" for k in range(WIDE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([wide_simhash(t, shingle) for t in b.column("text").to_pylist()], np.uint64).reshape(-1, WIDE)
            columns = [pa.array(np.ascontiguousarray(found[:, k]).view(np.int64)) for k in range(WIDE)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("hash"), *columns], names=["id", "hash", *names])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, T.StructType([T.StructField(n, T.LongType()) for n in ["id", "hash", *names]]))


def radius_of(similarity: float, slack: float = 3.0) -> int:
    """The differing bits of a wide fingerprint at a Jaccard similarity of equally large sets, plus deviations of slack.

    As links are candidates that the sets decide, the slack only has to be wide enough for pairs at the similarity."""
    bits = BITS * WIDE
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(bits * share + slack * math.sqrt(bits * share * (1 - share)))


def wide_masks(parts: int = PARTS, radius: int = PART_RADIUS) -> list[tuple[int, ...]]:
    """The masks of all tables of wide fingerprints, one for each word: each part of the bits is covered for ``radius``."""
    bits = [list(range(BITS * WIDE))[k::parts] for k in range(parts)]
    every = [m for part in bits for m in covering_masks(radius, part)]
    return [tuple(m >> BITS * w & (1 << BITS) - 1 for w in range(WIDE)) for m in every]


def similar_links(distinct: DataFrame, similarity: float = 0.8, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) that connect the nodes of wide fingerprints which differ in at most radius_of(similarity) bits.

    At a similarity of 0.8 some 39 of 256 bits differ, for which covering all of them would take too many tables. The bits
    are cut into PARTS instead, spread over all words, and each part covered for PART_RADIUS: a pair with at most that many
    differing bits in one of the parts is never missed, and many with one more in a part are met. A link is then told by
    all bits. Which pairs are met doesn't depend on how many fingerprints there are.
    """
    words = [f"f{k}" for k in range(WIDE)]
    return links(distinct, radius_of(similarity), words, [wide_masks()], None, bucket)


def shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(root, node, size, shingles): the different shingle hashes of each ``text``, as binary values of 64-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.unique(shingle_hashes(t, shingle)) for t in b.column("text").to_pylist()]
            size = pa.array([len(x) for x in found], pa.int64())
            columns = [b.column("root"), b.column("node"), size, pa.array([x.tobytes() for x in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["root", "node", "size", "shingles"])

    return texts.select("root", "node", "text").mapInArrow(run, "root long, node long, size long, shingles binary")


def jaccard_forest(nodes: list[int], sets: list[np.ndarray], similarity: float, asks: list[bool] | None = None) -> list[tuple[int, int]]:
    """Edges that connect the sets as their pairs with a Jaccard similarity of ``similarity`` or more do; two empty sets are equal.

    With ``asks`` only pairs count of which one asks; edges then go from each set that asks to all that it is like.
    """
    ids, size = np.array(nodes, np.int64), np.array([len(x) for x in sets], np.int64)
    asking = np.ones(len(ids), bool) if asks is None else np.array(asks, bool)
    every = bool(asking.all())
    empty = ids[size == 0]
    out = list(zip(empty[:-1].tolist(), empty[1:].tolist(), strict=True))
    sets, ids, asking, size = [x for x in sets if len(x)], ids[size > 0], asking[size > 0], size[size > 0]
    if len(ids) < 2:
        return out
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    flat, has = flat.astype(np.int32), np.zeros(len(values), bool)
    starts = np.r_[0, np.cumsum(size)[:-1]]

    def near(own: np.ndarray) -> np.ndarray:
        has[own] = True
        common = np.add.reduceat(has[flat], starts, dtype=np.int64)
        has[own] = False
        return common / (len(own) + size - common) >= similarity

    if not every:
        for k in np.flatnonzero(asking):
            like = near(flat[starts[k] : starts[k] + size[k]])
            like[k] = False
            out += [(int(ids[k]), int(x)) for x in ids[like]]
        return out
    while len(ids) > 1:
        n = size[0]
        queue, flat, ids, size = [(ids[0], flat[:n])], flat[n:], ids[1:], size[1:]
        while queue and len(ids):
            x, own = queue.pop()
            starts = np.r_[0, np.cumsum(size)[:-1]]
            like = near(own)
            if like.any():
                for k in np.flatnonzero(like):
                    queue.append((ids[k], flat[starts[k] : starts[k] + size[k]]))
                    out.append((int(x), int(ids[k])))
                flat, ids, size = flat[np.repeat(~like, size)], ids[~like], size[~like]
    return out


def _confirm(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, nodes, sets, asking = None, [], [], []

        def out() -> pa.RecordBatch:
            edges = np.array(jaccard_forest(nodes, sets, similarity, asking), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], names=["a", "b"])

        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("key", "asks", "node", "shingles")]
            for group, asks, node, found in zip(*columns, strict=True):
                if group != at and nodes:
                    yield out()
                    nodes, sets, asking = [], [], []
                at = group
                nodes.append(node)
                asking.append(asks)
                sets.append(np.frombuffer(found, np.uint64))
        if nodes:
            yield out()

    return run


@F.pandas_udf(T.DoubleType())
def _jaccard_distance(x: pd.Series, y: pd.Series) -> pd.Series:
    def one(a: bytes, b: bytes) -> float:
        a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
        common = len(np.intersect1d(a, b, assume_unique=True))
        total = len(a) + len(b) - common
        return 1 - common / total if total else 0.0

    return pd.Series([one(a, b) for a, b in zip(x, y, strict=True)])


def confirmed_links(sets: DataFrame, similarity: float, rows: int = GROUP_SETS, shingles: int = GROUP_SHINGLES) -> DataFrame:
    """Edges (a, b) that connect ``node`` as all pairs of one root whose Jaccard similarity is ``similarity`` or more would.

    A root with more than ``rows`` sets or ``shingles`` shingles is compared by large_links; 1 - similarity is a metric.
    """
    spark = sets.sparkSession

    def compared(x: DataFrame) -> DataFrame:
        sorted_ = x.select("key", "asks", "node", "shingles").repartition(shuffle_width(spark), "key").sortWithinPartitions("key")
        return materialize(sorted_.mapInArrow(_confirm(similarity), "a long, b long"), "confirmed")

    size = sets.groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("total"))
    large = materialize(size.where((F.col("n") > rows) | (F.col("total") > shingles)).select("root"), "groups")
    keyed = sets.withColumnRenamed("root", "key")
    large = large.withColumnRenamed("root", "key")
    with small_batches(spark, 256):
        if large.isEmpty():
            return compared(keyed.withColumn("asks", F.lit(True)))
        small = compared(keyed.join(large, "key", "left_anti").withColumn("asks", F.lit(True)))
        apart = _jaccard_distance("shingles", "p.shingles")
        # A set takes its share of a block, by its shingles where those are what fills it.
        weight = F.greatest(F.lit(1.0), F.octet_length("shingles") / 8 * rows / shingles)
        slack = 1 - similarity + 1e-9
        more = large_links(keyed.join(large, "key").select("key", "node", "shingles"), ["shingles"], apart, slack, rows, compared, weight)
        return small.unionByName(more)


def similar_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, component_id): groups that pairs of texts link whose sets of shingles have the Jaccard similarity or more.

    Links of wide fingerprints give candidate groups; within one, the sets of all its texts are compared exactly. Equal
    fingerprints are one node, by a 64-bit hash of it; equal texts are one set, by a 64-bit hash of the text.
    """
    words = [f"f{k}" for k in range(WIDE)]
    marked = materialize(
        wide_fingerprints(docs, id_col, text_col, shingle).withColumn("print", F.xxhash64(*words)), "marked"
    )
    distinct = materialize(marked.groupBy(F.col("print").alias("node")).agg(*[F.first(w).alias(w) for w in words]), "fingerprints")
    roots = components(similar_links(distinct, similarity)).select(F.col("node").alias("__print"), "root")
    texts = marked.groupBy("print", F.col("hash").alias("node")).agg(F.min("id").alias("least"))
    texts = texts.join(roots, F.col("print") == F.col("__print"), "left").select("node", "least", F.coalesce("root", "print").alias("root"))
    texts = materialize(texts, "texts")
    several = texts.groupBy("root").agg(F.count("*").alias("n")).where("n > 1").select("root")
    wanted = materialize(texts.join(several, "root").select("root", F.col("node").alias("__node"), "least"), "wanted")
    few = wanted.count() <= BROADCAST_IDS
    all_texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("node", F.xxhash64("text"))
    found = all_texts.join(F.broadcast(wanted) if few else wanted, F.col("node") == F.col("__node"))
    # Of equal texts the one with the least id is read.
    found = found.where(F.col("least").isNull() | (F.col("id") == F.col("least")))
    with small_batches(docs.sparkSession, 256):
        sets = materialize(shingle_sets(found, shingle), "sets")
    groups = components(confirmed_links(sets, similarity)).select(F.col("node").alias("__node"), F.col("root").alias("__root"))
    joined = texts.join(groups, F.col("node") == F.col("__node"), "left").select("node", "least", F.coalesce("__root", "node").alias("group"))
    least = joined.groupBy("group").agg(F.min("least").alias("component_id"))
    classes = joined.join(least, "group").select("node", "component_id")
    return marked.select("id", F.col("hash").alias("node")).join(classes, "node").select(F.col("id").alias(id_col), "component_id")


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **rules) -> DataFrame:
    """docs with one document of each group of similar texts, the one with the least id; rows of one id are one document.

    Rows with a null id stay, as nothing tells them apart; texts move only if more ids go than can be broadcast.
    """
    ids = docs.select(F.col(id_col).cast("long").alias("id"))
    if ids.where("id IS NOT NULL").groupBy("id").count().where("count > 1").limit(1).count():
        # Of the rows of one id the one with the least text stays.
        order = Window.partitionBy(id_col).orderBy(F.col(text_col).asc_nulls_last())
        numbered = docs.withColumn("__n", F.row_number().over(order))
        docs = numbered.where((F.col("__n") == 1) | F.col(id_col).isNull()).drop("__n")
    classes = similar_classes(docs, id_col, text_col, **rules)
    gone = classes.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("__gone"))
    gone = materialize(gone, "gone")
    few = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, F.col(id_col) == F.col("__gone"), "left_anti")
