"""Ranked lexical search with Block-Max MaxScore over an inverted index in shards of documents.

Terms are runs of ASCII letters, digits and other characters than ASCII, A-Z in lower case. ``index`` reads texts once and
writes a row for each shard: some SHARD_BYTES of documents, their ids and numbers of terms, the sorted terms, and of each term a
posting list of document numbers (gaps) and occurrences, in bytes as wide as the list needs. Lists are cut into blocks of BLOCK
postings; of a block the index keeps its last document, most occurrences and fewest terms of a document, which bound what a
posting of it can add whatever the corpus's averages are.

    weight(t) = floor(1000 ln((2N + 2) / (2 df + 1)))
    m(d)      = 75 + (25 n N) div L
    score     = sum over the query's terms of weight * ((10^9 tf) div (1000 tf + 12 m))

``search`` first sums N, L and df over the shards. A task then takes all queries to each of its shards. Lists are ordered by their
bounds; those whose bounds in sum stay under the query's threshold, the k-th best score so far, are non-essential: a document
in these alone can't be among the best. Documents of essential lists are candidates and fully summed there; non-essential
lists are asked from the largest bound on: a candidate that the rest can't lift goes, one that its block's bound can't lift goes
before the block is decoded. A task keeps its thresholds from shard to shard and sends k rows a query at most; a window over
these merges the heaps. Queries that many shards are asked begin with the k-th best score of a few shards (SEEDS), which any
document of the best must reach.

All is exact in 64-bit integers (larger products are taken apart). Documents of equal score go by id, null ids last; rows of a
repeated id are documents of their own. Null texts and texts without terms are no document of N and are never found. Rows of a
repeated query id are one query with the terms of all. A query without terms has no rows. Query sets are taken in blocks of
bounded bytes, each against all documents.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize
from .licenses import words

#: Bytes of text in a shard, postings in a block, shards that thresholds begin with.
SHARD_BYTES, BLOCK, SEEDS = 16 << 20, 128, 16
#: Bytes of query texts that are taken to all shards at once.
QUERY_BYTES = 4 << 20
#: Bytes of a text that are split at a time.
PIECE = 4 << 20

_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_ARRAYS = ["ids", "known", "lens", "df", "gap_width", "tf_width", "gap1", "gap2", "gap4", "tf1", "tf2", "tf4", "last", "most_tf", "least_n"]
INDEX = "shard long, block long, n_docs long, n_terms long, terms binary, " + ", ".join(f"{a} binary" for a in _ARRAYS)
_INDEX_ARROW = pa.schema(
    [*[(n, pa.int64()) for n in ("shard", "block", "n_docs", "n_terms")], ("terms", pa.binary()), *[(a, pa.binary()) for a in _ARRAYS]]
)
_WIDTHS = {1: np.uint8, 2: np.uint16, 4: np.uint32}
#: Keys of the corpus's sums among those of terms, which hold no spaces.
_N, _L, _SHARDS = b" n", b" l", b" shards"


def terms_of(text: str, size: int) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of some ``size`` bytes each."""
    data = text.encode("utf-8", "surrogatepass").translate(_PLAIN)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + size) if len(data) - at > size else -1
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


class _Builder:
    """The documents of a shard to be."""

    def __init__(self, block: int, piece: int):
        self.block, self.piece = block, piece
        self.terms: dict = defaultdict()
        self.terms.default_factory = self.terms.__len__
        self.ids, self.lens, self.tokens, self.bytes = [], [], [], 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        n = 0
        for some in terms_of(text or "", self.piece):
            self.tokens.append(np.fromiter(map(self.terms.__getitem__, some), np.int32, len(some)))
            n += len(some)
        if n:
            self.ids.append(doc_id)
            self.lens.append(n)
        self.bytes += len(text or "")

    def row(self, shard: int) -> dict:
        names = sorted(self.terms)
        rank = np.empty(len(names), np.int64)
        rank[[self.terms[t] for t in names]] = np.arange(len(names))
        lens = np.array(self.lens, np.int64)
        n = len(lens)
        docs = np.repeat(np.arange(n), lens)
        code, tf = np.unique(rank[np.concatenate(self.tokens)] * n + docs, return_counts=True)
        term, doc = code // n, code % n
        df = np.bincount(term, minlength=len(names))
        starts = np.cumsum(df) - df
        gaps = np.diff(doc, prepend=0)
        gaps[starts] = doc[starts]
        place = np.arange(len(doc)) - np.repeat(starts, df)
        heads = np.flatnonzero(place % self.block == 0)
        out = {
            "shard": shard, "block": self.block, "n_docs": n, "n_terms": int(lens.sum()), "terms": b" ".join(names),
            "ids": np.array([x or 0 for x in self.ids], np.int64), "known": np.array([x is not None for x in self.ids], np.uint8),
            "lens": lens.astype(np.uint32), "df": df.astype(np.uint32), "last": doc[np.append(heads[1:], len(doc)) - 1].astype(np.uint32),
            "most_tf": np.maximum.reduceat(tf, heads).astype(np.uint32), "least_n": np.minimum.reduceat(lens[doc], heads).astype(np.uint32),
        }
        for name, values in (("gap", gaps), ("tf", tf)):
            top = np.maximum.reduceat(values, starts)
            width = np.where(top < 1 << 8, 1, np.where(top < 1 << 16, 2, 4)).astype(np.uint8)
            out[f"{name}_width"] = width
            each = np.repeat(width, df)
            out |= {f"{name}{w}": values[each == w].astype(kind) for w, kind in _WIDTHS.items()}
        return {k: v.tobytes() if isinstance(v, np.ndarray) else v for k, v in out.items()}


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of INDEX, a shard each; ids are integers. Shards are runs of a task's rows, so nothing is shuffled."""

    size, rules = SHARD_BYTES, (BLOCK, PIECE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, made = TaskContext.get().partitionId() << 32, _Builder(*rules)
        for b in batches:
            ids, texts = b.column("id").to_pylist(), b.column("text")
            for i, doc_id in enumerate(ids):
                made.add(doc_id, texts[i].as_py())
                if made.bytes >= size:
                    if made.ids:
                        yield pa.RecordBatch.from_pylist([made.row(shard)], schema=_INDEX_ARROW)
                        shard += 1
                    made = _Builder(*rules)
        if made.ids:
            yield pa.RecordBatch.from_pylist([made.row(shard)], schema=_INDEX_ARROW)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, INDEX)


class Corpus:
    """What all documents have in sum: N, L, and from these m of a number of terms."""

    def __init__(self, n: int, total: int):
        self.n, self.total = n, max(total, 1)

    def m(self, lens: np.ndarray) -> np.ndarray:
        """75 + (25 n N) div L in 64 bits, the product taken apart where it would pass them."""
        lens, by = lens.astype(np.int64), 25 * self.n
        if int(lens.max(initial=0)) * by < 1 << 63:
            return 75 + lens * by // self.total
        return np.array([75 + int(x) * by // self.total for x in lens], np.int64)

    def weight(self, df: int) -> int:
        return math.floor(1000 * math.log((2 * self.n + 2) / (2 * df + 1)))


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    tf = tf.astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


class Shard:
    """A shard's lists, decoded as far as they are asked."""

    def __init__(self, row: dict, corpus: Corpus, wanted: set[bytes]):
        kinds = {"ids": np.int64, "known": np.uint8, "gap_width": np.uint8, "tf_width": np.uint8, "gap1": np.uint8, "tf1": np.uint8, "gap2": np.uint16, "tf2": np.uint16}
        self.a = {k: np.frombuffer(row[k], kinds.get(k, np.uint32)) for k in _ARRAYS}
        self.place = {t: k for k, t in enumerate(row["terms"].split(b" ")) if t in wanted}
        self.n, self.block = row["n_docs"], row["block"]
        self.m = corpus.m(self.a["lens"])
        self.df = self.a["df"].astype(np.int64)
        blocks = -(-self.df // self.block)
        self.block_ends = np.cumsum(blocks)
        self.block_starts = self.block_ends - blocks
        self.bounds = impact(self.a["most_tf"], corpus.m(self.a["least_n"]))
        self.most = np.maximum.reduceat(self.bounds, self.block_starts)
        # Where a list begins in the stream of its width.
        self.at = {}
        for name in ("gap", "tf"):
            width = self.a[f"{name}_width"]
            begin = np.zeros(len(width), np.int64)
            for w in _WIDTHS:
                mine = width == w
                begin[mine] = np.cumsum(self.df[mine]) - self.df[mine]
            self.at[name] = begin
        self.decoded: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _raw(self, name: str, k: int, s: int, e: int) -> np.ndarray:
        stream, at = self.a[f"{name}{self.a[f'{name}_width'][k]}"], self.at[name][k]
        return stream[at + s : at + e]

    def whole(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, impacts) of a list."""
        if k not in self.decoded:
            docs = np.cumsum(self._raw("gap", k, 0, self.df[k]), dtype=np.int64)
            self.decoded[k] = docs, impact(self._raw("tf", k, 0, self.df[k]), self.m[docs])
        return self.decoded[k]

    def found(self, k: int, docs: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """Impacts of ascending documents in a list, 0 where it lacks them; only the blocks that they are in are decoded."""
        out = np.zeros(len(docs), np.int64)
        if k in self.decoded:
            mine, gains = self.decoded[k]
            at = np.minimum(np.searchsorted(mine, docs), len(mine) - 1)
            return np.where(mine[at] == docs, gains[at], 0)
        heads = [*np.flatnonzero(np.diff(blocks, prepend=-1)).tolist(), len(docs)]
        for s, e in zip(heads, heads[1:], strict=False):
            b = int(blocks[s])
            low, high = b * self.block, min((b + 1) * self.block, int(self.df[k]))
            before = int(self.a["last"][self.block_starts[k] + b - 1]) if b else 0
            mine = np.cumsum(self._raw("gap", k, low, high), dtype=np.int64) + before
            at = np.minimum(np.searchsorted(mine, docs[s:e]), len(mine) - 1)
            hit = mine[at] == docs[s:e]
            tf = self._raw("tf", k, low, high)[at[hit]]
            out[s:e][hit] = impact(tf, self.m[docs[s:e][hit]])
        return out

    def best(self, terms: list[tuple[bytes, int]], threshold: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of all that score at least the threshold and above 0, among others that don't reach it."""
        lists = sorted((int(self.most[k]) * w, k, w) for t, w in terms if (k := self.place.get(t)) is not None and w > 0)
        below = np.cumsum([0, *[x[0] for x in lists]])
        # Lists before this one can't reach the threshold together.
        first = int(np.searchsorted(below[1:], max(threshold, 1)))
        score = np.zeros(self.n, np.int64)
        for _, k, w in lists[first:]:
            docs, gains = self.whole(k)
            score[docs] += w * gains
        docs = np.flatnonzero(score)
        score = score[docs]
        for i in range(first - 1, -1, -1):
            keep = score + below[i + 1] >= threshold
            docs, score = docs[keep], score[keep]
            if not len(docs):
                break
            _, k, w = lists[i]
            s, e = self.block_starts[k], self.block_ends[k]
            blocks = np.searchsorted(self.a["last"][s:e], docs)
            inside = blocks < e - s
            more = np.where(inside, self.bounds[s + np.minimum(blocks, e - s - 1)] * w, 0)
            keep = score + more + below[i] >= threshold
            docs, score, blocks, inside = docs[keep], score[keep], blocks[keep], inside[keep]
            score[inside] += w * self.found(k, docs[inside], blocks[inside])
        return docs, score


class _Heap:
    """The k best documents of a query."""

    def __init__(self, k: int, threshold: int):
        self.k, self.threshold = k, threshold
        self.scores, self.nulls, self.ids = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, nulls: np.ndarray, ids: np.ndarray) -> None:
        mine = scores >= max(self.threshold, 1)
        if not mine.any():
            return
        scores, nulls, ids = (np.concatenate(p) for p in ((self.scores, scores[mine]), (self.nulls, nulls[mine]), (self.ids, ids[mine])))
        order = np.lexsort((ids, nulls, -scores))[: self.k]
        self.scores, self.nulls, self.ids = scores[order], nulls[order], ids[order]
        if len(order) == self.k:
            self.threshold = max(self.threshold, int(self.scores[-1]))


def _sums(shards: DataFrame, wanted: set[bytes]) -> dict[bytes, int]:
    """N, L, the number of shards, and df of the wanted terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[bytes, int] = defaultdict(int)
        for b in batches:
            for r in b.to_pylist():
                out[_N] += r["n_docs"]
                out[_L] += r["n_terms"]
                out[_SHARDS] += 1
                for t, n in zip(r["terms"].split(b" "), np.frombuffer(r["df"], np.uint32).tolist(), strict=True):
                    if t in wanted:
                        out[t] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.binary()), pa.array(list(out.values()), pa.int64())], names=["term", "n"])

    found = shards.select("n_docs", "n_terms", "terms", "df").mapInArrow(run, "term binary, n long")
    return {bytes(r["term"]): r["n"] for r in found.groupBy("term").agg(F.sum("n").alias("n")).collect()}


def _heaps(shards: DataFrame, queries, corpus: Corpus, thresholds: list[int], wanted: set[bytes], k: int) -> DataFrame:
    """(query, doc, score): the k best rows of each query in each task, less those under its threshold."""
    sent = shards.sparkSession.sparkContext.broadcast((queries, corpus, thresholds, wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, corpus, thresholds, wanted = sent.value
        heaps = [_Heap(k, t) for t in thresholds]
        for b in batches:
            for at in range(b.num_rows):
                shard = Shard(b.slice(at, 1).to_pylist()[0], corpus, wanted)
                for terms, heap in zip(queries, heaps, strict=True):
                    docs, scores = shard.best(terms, heap.threshold)
                    heap.add(scores, shard.a["known"][docs] == 0, shard.a["ids"][docs])
        for q, heap in enumerate(heaps):
            if len(heap.ids):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(heap.ids), q, np.int32)), pa.array(heap.ids, mask=heap.nulls), pa.array(heap.scores)],
                    names=["query", "doc", "score"],
                )

    return shards.mapInArrow(run, "query int, doc long, score long")


def _merged(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(
    shards: DataFrame, items: DataFrame, k: int = 20, item_id: str = "item_id", item_text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item; ``shards`` is a stored index."""
    spark = shards.sparkSession
    texts = items.select(F.col(item_id).alias("__item"), F.col(item_text).alias("__text"))
    size = texts.agg(F.sum(F.octet_length("__text"))).first()[0] or 0
    blocks = -(-size // QUERY_BYTES) or 1
    out = None
    for block in range(blocks):
        own = texts.where(F.pmod(F.xxhash64("__item"), F.lit(blocks)) == block) if blocks > 1 else texts
        terms = own.select("__item", F.explode(words(F.col("__text"))).alias("term")).groupBy("__item", "term").count().collect()
        by_item: dict = defaultdict(list)
        for r in terms:
            by_item[r["__item"]].append((r["term"].encode("utf-8", "surrogatepass"), r["count"]))
        keys = list(by_item)
        wanted = {t for ts in by_item.values() for t, _ in ts}
        sums = _sums(shards, wanted)
        corpus = Corpus(sums.get(_N, 0), sums.get(_L, 0))
        weights = {t: corpus.weight(sums.get(t, 0)) for t in wanted}
        queries = [[(t, n * weights[t]) for t, n in by_item[x]] for x in keys]
        thresholds = [0] * len(keys)
        parts = sums.get(_SHARDS, 0) // SEEDS
        if parts > 1:
            some = shards.where(F.pmod(F.xxhash64("shard"), F.lit(parts)) == 0)
            reached = _merged(_heaps(some, queries, corpus, thresholds, wanted, k), k).where(F.col("rank") == k)
            for r in reached.select("query", "score").collect():
                thresholds[r["query"]] = r["score"]
        found = _merged(_heaps(shards, queries, corpus, thresholds, wanted, k), k)
        kind = items.schema[item_id].dataType.simpleString()
        named = spark.createDataFrame([(q, x) for q, x in enumerate(keys)], f"query int, `{item_id}` {kind}")
        one = found.join(F.broadcast(named), "query").select(item_id, "rank", F.col("doc").alias(doc_id), "score")
        out = one if out is None else out.unionByName(one)
    return out


def ranked(docs: DataFrame, items: DataFrame, k: int = 20, **names) -> DataFrame:
    """search over an index of docs, which is written first."""
    own = {n: names.pop(n) for n in ("id_col", "text_col") if n in names}
    return search(materialize(index(docs, **own), "shards"), items, k, **names)
