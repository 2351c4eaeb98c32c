"""Katz back-off language model: counts, discounts and back-off weights of a corpus, and the score of every text.

Tokens: words `[^\\x20\\x09-\\x0D]+` with A-Z in lower case, then one end token; the history of the first is a start mark.

    p(w | h) = d(c(h, w)) * c(h, w) / c(h)    if the pair occurs in training
             = a(h) * p(w)                    else; a(h) = 1 for a history that training lacks
    p(w)     = d1(c(w)) * c(w) / N            if the token occurs in training
             = what these leave               for any other token, as one type

d are Good-Turing discounts up to a count of CUT; a count above gives up ABOVE of one occurrence, so that every history
keeps something back. a(h) makes the probabilities after h sum to one exactly: one minus what its seen pairs take,
divided by one minus what their second tokens have as single tokens.

Plan. Texts are read once into blocks of bounded size (``blocks``), a row each, in a table: token numbers within the
block, and a 64-bit hash of each distinct token. A block asks for its distinct tokens and pairs with its training
counts; requests are packed by ranges of the hash, and each range sums up what all blocks sent and answers each block
in the order of its request (``counts``). Blocks then score all pairs that occur in training, and send on the
probabilities of the pairs that they were first to name, by history, with the histories whose weight they need; ranges of
histories make the weights and answer each block, which adds up what each of its texts lacks (``weights``). A frequent
history is spread over all ranges in the first exchange and is one sum and one question from each block in the second. No
count, vocabulary or weight comes to the driver, but for the counts of counts. ``katz_tables`` keeps a model of any order.

Tokens are told apart by 64-bit hashes. Null texts have the end token alone. Rows of a repeated id each count.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, materialize, shuffle_width

#: Tokens in a block, and tokens of the corpus for each range of hashes.
BLOCK_TOKENS, RANGE_TOKENS = 2_000_000, 1_500_000
CUT, ABOVE = 5, 0.05
#: Hashes of marks that no word can have: words hold no spaces.
END, START = xxhash.xxh64_intdigest(b" end"), xxhash.xxh64_intdigest(b" start")

PACKED = "kind int, part int, block long, a binary, b binary, c binary, d binary, e binary, f binary"
_NAMES = ["kind", "part", "block", *"abcdef"]
_ARROW = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("block", pa.int64()), *[(n, pa.binary()) for n in "abcdef"]])
DOCS, TOKENS, PAIRS, STATS, SUMS, LACKS, PLACES, WEIGHTS = range(8)


def pack(x: np.ndarray) -> bytes:
    """An array in little memory: its bytes by place value, compressed."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(b: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def _row(kind: int, part: int, block: int, *blobs: bytes) -> tuple:
    return (kind, part, block, *blobs, *[None] * (6 - len(blobs)))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in _NAMES]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def is_training(id_col: str, folds: int = 10, held: int = 0) -> Column:
    """Whether a row is learned from: the CRC-32 of its id as text leaves another remainder than ``held``."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds != held


def blocks(docs: DataFrame, id_col: str, text_col: str, training: Column) -> DataFrame:
    """Rows of PACKED, a block each: ids, whether training, lengths, token numbers, hashes of the tokens."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(training, F.lit(False)).alias("train"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 24
        made = 0

        def fresh():
            known: dict = defaultdict()
            known.default_factory = known.__len__
            known[b" end"]  # the end token is number 0
            return known, [], [], [], [], 0

        def out(known, ids, train, lens, tokens) -> pa.RecordBatch:
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, known), np.uint64, len(known))
            present = np.array([x is not None for x in ids], np.uint8)
            numbers = np.array([x or 0 for x in ids], np.int64)
            flags = np.array(train, np.uint8) | present << 1
            blobs = numbers, flags, np.array(lens, np.int32), np.concatenate(tokens), hashes
            return _batch([_row(DOCS, -1, base + made, *map(pack, blobs))])

        known, ids, train, lens, tokens, total = fresh()
        for b in batches:
            for i, t, text in zip(*[b.column(n).to_pylist() for n in ("id", "train", "text")], strict=True):
                words = (text or "").encode().translate(LOWER).split()
                words.append(b" end")
                tokens.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
                ids.append(i)
                train.append(t)
                lens.append(len(words))
                total += len(words)
                if total >= BLOCK_TOKENS:
                    yield out(known, ids, train, lens, tokens)
                    made += 1
                    known, ids, train, lens, tokens, total = fresh()
        if ids:
            yield out(known, ids, train, lens, tokens)

    return rows.mapInArrow(run, PACKED)


class Block:
    """A block's tokens and pairs in the order in which it asks for them."""

    def __init__(self, row: dict):
        self.ids, self.flags = unpack(row["a"], np.int64), unpack(row["b"], np.uint8)
        self.lens, self.tokens = unpack(row["c"], np.int32), unpack(row["d"], np.int32)
        hashes = unpack(row["e"], np.uint64)
        self.train = (self.flags & 1).astype(bool)
        ends = np.cumsum(self.lens)
        self.doc = np.repeat(np.arange(len(self.lens), dtype=np.int32), self.lens)
        # Numbers in order of the hashes; the start mark is the number after all.
        order = np.argsort(hashes)
        self.token_keys = hashes[order]
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        self.tokens = rank[self.tokens]
        size = len(order) + 1
        before = np.empty(len(self.tokens), np.int32)
        before[1:] = self.tokens[:-1]
        before[ends - self.lens] = size - 1
        code, self.pair = np.unique(before.astype(np.int64) * size + self.tokens, return_inverse=True)
        self.history, self.second = (code // size).astype(np.int32), (code % size).astype(np.int32)
        self.hashes = np.append(self.token_keys, np.uint64(START))
        keys = mixed(self.hashes[self.history], self.token_keys[self.second])
        self.pair_order = np.argsort(keys, kind="stable")
        self.pair_keys = keys[self.pair_order]

    def training_counts(self) -> tuple[np.ndarray, np.ndarray]:
        mark = np.repeat(self.train, self.lens)
        one = np.bincount(self.tokens[mark], minlength=len(self.token_keys)).astype(np.uint32)
        two = np.bincount(self.pair[mark], minlength=len(self.history)).astype(np.uint32)
        return one, two[self.pair_order]


def mixed(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each pair of hashes."""
    x = h * np.uint64(0x9E3779B97F4A7C15) + w
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


def _ranges(keys: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(range, from, to) of ascending keys, by their upper bits."""
    if not len(keys):
        return
    if not bits:
        yield 0, 0, len(keys)
        return
    of = (keys >> np.uint64(64 - bits)).astype(np.int64)
    starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    for s, e in zip(starts, [*starts[1:], len(of)], strict=True):
        yield int(of[s]), int(s), int(e)


def _gaps(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def _keys(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b, np.uint64), dtype=np.uint64)


def requests(made: DataFrame, bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                x = Block(row)
                out = []
                for kind, keys, counts in zip((TOKENS, PAIRS), (x.token_keys, x.pair_keys), x.training_counts(), strict=True):
                    for part, s, e in _ranges(keys, bits):
                        out.append(_row(kind, part, row["block"], _gaps(keys[s:e]), pack(counts[s:e])))
                yield _batch(out)

    return made.mapInArrow(run, PACKED)


def _answer(table: pa.Table) -> pa.Table:
    """Total counts of a range's keys for each block, and the counts of counts."""
    rows = sorted(table.to_pylist(), key=lambda r: r["block"])
    keys = [_keys(r["a"]) for r in rows]
    sizes = [len(k) for k in keys]
    every, first, at = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    total = np.bincount(at, weights=np.concatenate([unpack(r["b"], np.uint32) for r in rows]), minlength=len(every)).astype(np.int64)
    own = np.zeros(len(at), np.uint8)
    own[first] = 1  # the first block to name a key
    out, s = [], 0
    kind, part = rows[0]["kind"], rows[0]["part"]
    for r, n in zip(rows, sizes, strict=True):
        out.append(_row(kind, part, r["block"], pack(total[at[s : s + n]].astype(np.uint32)), pack(own[s : s + n])))
        s += n
    stats = np.r_[np.bincount(total[total <= CUT + 1], minlength=CUT + 2), (total > 0).sum(), total.sum()].astype(np.int64)
    out.append(_row(STATS, kind, -1, stats.tobytes()))
    return pa.Table.from_batches([_batch(out)])


def _dealt(rows: DataFrame, bits: int, *keys: str):
    """rows grouped by the keys, in as many partitions as there are ranges, so that a task's share doesn't grow with the corpus."""
    return rows.repartition(max(shuffle_width(rows.sparkSession), 1 << bits), *keys).groupBy(*keys)


def counts(made: DataFrame, bits: int) -> DataFrame:
    return _dealt(requests(made, bits), bits, "kind", "part").applyInArrow(_answer, PACKED)


def discounts(of_counts: list[int]) -> list[float]:
    """What remains of an occurrence at counts 0 .. CUT, from the numbers of types with counts 0 .. CUT + 1."""
    n = of_counts
    last = (CUT + 1) * n[CUT + 1] / n[1] if n[1] else 1.0
    out = [0.0]
    for r in range(1, CUT + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - last) / (1 - last) if n[r] and last < 1 else 0.0
        out.append(d if 0 < d < 1 else (r - 0.5) / r)
    return out


def kept_of(total: np.ndarray, d: list[float]) -> np.ndarray:
    """Discounted counts."""
    c = total.astype(np.float64)
    return np.where(total <= CUT, np.array(d)[np.minimum(total, CUT)] * c, c - ABOVE)


class Model:
    """The few numbers of a corpus that every task needs."""

    def __init__(self, tokens: list[int], pairs: list[int]):
        self.one, self.two = discounts(tokens), discounts(pairs)
        self.types, self.total = tokens[CUT + 2], tokens[CUT + 3]
        kept = sum(self.one[r] * r * tokens[r] for r in range(1, CUT + 1))
        small, small_types = sum(r * tokens[r] for r in range(1, CUT + 1)), sum(tokens[1 : CUT + 1])
        kept += (self.total - small) - ABOVE * (self.types - small_types)
        self.unknown = 1 - kept / self.total if self.total else 1.0

    def single(self, c: np.ndarray) -> np.ndarray:
        """p(w) from the tokens' counts."""
        return np.where(c > 0, kept_of(c, self.one) / max(self.total, 1), self.unknown)


def scores(made: DataFrame, answers: DataFrame, model: Model, bits: int) -> DataFrame:
    """For each block: its texts' sums (DOCS), its histories' sums (SUMS), the histories whose weights it needs (LACKS), and
    the texts that need them (PLACES)."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["kind"], r["part"]))
        x, block = Block(rows[0]), rows[0]["block"]

        def joined(kind: int, column: str, of) -> np.ndarray:
            return np.concatenate([unpack(r[column], of) for r in rows if r["kind"] == kind])

        c1 = joined(TOKENS, "a", np.uint32).astype(np.int64)
        c2, own = np.empty(len(x.pair_order), np.int64), np.empty(len(x.pair_order), bool)
        c2[x.pair_order], own[x.pair_order] = joined(PAIRS, "a", np.uint32), joined(PAIRS, "b", np.uint8)
        p1 = model.single(c1)
        # A word is a history as often as a token; the start mark, as often as the end token.
        ch = np.append(c1, c1[np.searchsorted(x.token_keys, np.uint64(END))])
        seen, known = c2 > 0, ch[x.history] > 0
        p2 = np.divide(kept_of(c2, model.two), ch[x.history], where=seen, out=np.ones(len(c2)))
        logs = np.where(seen, np.log10(p2), np.log10(p1[x.second]))
        base = np.log10((c1 + 0.1) / (model.total + 0.1 * (model.types + 1)))
        n = len(x.lens)
        add = lambda w: np.bincount(x.doc, weights=w, minlength=n)
        out = [
            _row(
                DOCS, -1, block, pack(x.ids), pack(x.flags), pack(x.lens), pack(add(c1[x.tokens] > 0).astype(np.int32)),
                pack(add(base[x.tokens])), pack(add(logs[x.pair])),
            )
        ]
        # By history, in order of the hashes: the start mark's number is moved to its place.
        order = np.argsort(x.hashes)
        mine = seen & own
        sum2 = np.bincount(x.history[mine], weights=p2[mine], minlength=len(ch))[order]
        sum1 = np.bincount(x.history[mine], weights=p1[x.second[mine]], minlength=len(ch))[order]
        some = sum2 > 0
        keys = x.hashes[order][some]
        for part, s, e in _ranges(keys, bits):
            out.append(_row(SUMS, part, block, _gaps(keys[s:e]), pack(sum2[some][s:e]), pack(sum1[some][s:e])))
        # The different histories whose weight the block needs, and how often each text needs which.
        lack = (~seen & known)[x.pair]
        keys, at = np.unique(x.hashes[x.history[x.pair[lack]]], return_inverse=True)
        pairs, times = np.unique(x.doc[lack].astype(np.int64) * max(len(keys), 1) + at, return_counts=True)
        if len(keys):
            places = pairs % len(keys), pairs // len(keys)
            out.append(_row(PLACES, -1, block, *[pack(v.astype(np.int32)) for v in (*places, times)]))
        for part, s, e in _ranges(keys, bits):
            out.append(_row(LACKS, part, block, _gaps(keys[s:e])))
        return pa.Table.from_batches([_batch(out)])

    return _dealt(made.unionByName(answers.where(F.col("kind") != STATS)), bits, "block").applyInArrow(run, PACKED)


def _weigh(table: pa.Table) -> pa.Table:
    """The logarithms of the weights of a range's histories, for each block in the order in which it asks."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["kind"], r["block"]))
    sums = [r for r in rows if r["kind"] == SUMS]
    out = []
    if sums:
        every, at = np.unique(np.concatenate([_keys(r["a"]) for r in sums]), return_inverse=True)
        two = np.bincount(at, weights=np.concatenate([unpack(r["b"], np.float64) for r in sums]))
        one = np.bincount(at, weights=np.concatenate([unpack(r["c"], np.float64) for r in sums]))
        weight = np.log10((1 - two) / (1 - one))
        out = [_row(WEIGHTS, r["part"], r["block"], pack(weight[np.searchsorted(every, _keys(r["a"]))])) for r in rows[len(sums) :]]
    return pa.Table.from_batches([_batch(out)])


def _missing(table: pa.Table) -> pa.Table:
    """The sums of the logarithms of weights that each text of a block lacks."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["kind"], r["part"]))
    of, docs, times = (unpack(rows[0][c], np.int32) for c in "abc")
    logs = np.concatenate([unpack(r["a"], np.float64) for r in rows[1:]])
    more = np.bincount(docs, weights=logs[of] * times)
    found = np.unique(docs)
    return pa.table({"block": np.full(len(found), rows[0]["block"]), "at": found, "more": more[found]})


def weights(scored: DataFrame, bits: int) -> DataFrame:
    """(block, at, more): what each text lacks. A range gets a history once from each block, however many texts need it."""
    found = _dealt(scored.where(F.col("kind").isin(SUMS, LACKS)), bits, "part").applyInArrow(_weigh, PACKED)
    both = scored.where(F.col("kind") == PLACES).unionByName(found)
    return _dealt(both, bits, "block").applyInArrow(_missing, "block long, at int, more double")


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in b.to_pylist():
            ids, flags = unpack(r["a"], np.int64), unpack(r["b"], np.uint8)
            lens = unpack(r["c"], np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(ids), r["block"])), pa.array(np.arange(len(ids), dtype=np.int32)),
                    pa.array(ids, mask=flags & 2 == 0), pa.array(flags & 1 == 0), pa.array(lens.astype(np.int64)),
                    pa.array(unpack(r["d"], np.int32).astype(np.int64)),
                    pa.array(unpack(r["e"], np.float64)), pa.array(unpack(r["f"], np.float64)),
                ],
                names=["block", "at", "id", "held_out", "n_tokens", "n_known", "base_score", "part_score"],
            )


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", training: Column | None = None) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; scores are log10 probabilities.

    ``training`` tells the rows to learn from; by default those that is_training picks. Without any training token all
    scores are those of an unknown token. Other columns of docs are left behind.
    """
    made = materialize(blocks(docs, id_col, text_col, is_training(id_col) if training is None else training), "blocks")
    tokens = made.select("c").mapInArrow(_lengths, "n long").agg(F.sum("n")).first()[0] or 0
    bits = max(0, (tokens // RANGE_TOKENS).bit_length())
    answers = materialize(counts(made, bits), "counts")
    model = Model(*[_stats(answers, kind) for kind in (TOKENS, PAIRS)])
    scored = materialize(scores(made, answers, model, bits), "scores")
    more = weights(scored, bits)
    texts = scored.where(F.col("kind") == DOCS).mapInArrow(
        _texts, "block long, at int, id long, held_out boolean, n_tokens long, n_known long, base_score double, part_score double"
    )
    return texts.join(more, ["block", "at"], "left").select(
        F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"),
        "base_score", (F.col("part_score") + F.coalesce("more", F.lit(0.0))).alias("score"),
    )


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sums = [int(unpack(x, np.int32).sum()) for x in b.column("c").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int64())], names=["n"])


def _add_stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(CUT + 4, np.int64)
    for b in batches:
        for x in b.column("a").to_pylist():
            total += np.frombuffer(x, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(CUT + 4)), pa.array(total)], names=["at", "n"])


def _stats(answers: DataFrame, kind: int) -> list[int]:
    rows = answers.where((F.col("kind") == STATS) & (F.col("part") == kind)).select("a")
    found = rows.mapInArrow(_add_stats, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    by = {r["at"]: r["n"] for r in found}
    return [by.get(k, 0) for k in range(CUT + 4)]
