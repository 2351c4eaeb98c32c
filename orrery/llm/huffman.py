"""Token ids in a binary file format: canonical length-limited Huffman codes in independent blocks.

``token_ids`` makes the ids of every text with a tokenizer of the tokenizers library. ``write`` counts the ids of the
whole corpus, fits a code of at most MAX_BITS bits an id to the counts, and writes a folder with the code's lengths
(``codebook``) and blocks of texts in ascending order of ids (``blocks``); ``read`` gives the texts' ids back, with the
number of ids before each.

A block holds whole texts and needs nothing but the codebook: MAGIC; the numbers of texts and checkpoints; the texts' ids,
flags, numbers of ids and of bytes; the checkpoints; the bits. Each text starts at a byte, and every STEP ids a checkpoint
gives the bit where the next ones start, so that all runs of STEP ids are decoded side by side, each step by a look at a
table of 2^MAX_BITS entries. Blocks are stored as binary values of a Parquet table, which is what makes the writing safe
against lost executors and works in any store.

Texts move once, coded. They are dealt out by ranges of ids; a range is a shard, and its blocks are numbered in order.
Null texts have no ids but the end id; null text ids come first; equal ids are ordered by their codes.
"""

from __future__ import annotations

import itertools
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, shuffle_width, slices, small_batches

MAX_BITS, STEP = 18, 256
#: A block is closed once it has so many ids.
BLOCK_IDS = 1 << 17
MAGIC = b"OHB1"
#: Shards for each shuffle partition, about; each is a range of ids.
SHARDS = 8
#: Words whose ids a worker remembers.
REMEMBERED = 300_000
#: Bytes of texts whose words are encoded at once, texts that a worker gets at once, and that it codes at once.
SLICE_BYTES, BATCH_TEXTS, CODED_TEXTS = 3 << 20, 2000, 200
BROADCAST_SHARDS = 100_000


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Signs that the tokenizer splits from letters before them; an apostrophe may begin a contraction.
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Letters of one byte each in Latin-1, which have no other composed form and one lower-case letter at most.
_LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
_LETTERS = "".join(re.findall(f"[{_LATIN}]", "".join(map(chr, range(256)))))
# A run of letters, with signs after it or without.
_RUN, _MARKED = f"^[{_LATIN}]+$", f"^[{_LATIN}]+[{re.escape(SIGNS)}]*$"
# Bytes as the characters that byte-level models write them with: printable ones of Latin-1 stand for themselves, the
# others follow from U+0100 on.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_OTHER = [b for b in range(256) if b not in _PRINTED]
_AS_CHAR = {b: chr(b) for b in _PRINTED} | {b: chr(0x100 + k) for k, b in enumerate(_OTHER)}
_BYTES = str.maketrans({chr(b): c for b, c in _AS_CHAR.items()} | {" ": " "})


def _parts(pool: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The parts of ``pool`` that begin at ``first`` and have ``size`` items, one after the other."""
    before = np.cumsum(size) - size
    return pool[np.repeat(first - before, size) + np.arange(size.sum())]


class WordIds:
    """Ids of texts by a tokenizer that never joins what a space separates: every word is encoded once.

    The tokenizer has to split words at the ends of runs of letters, lower-case them, and mark the last token of a run;
    ``word_bpe_49k`` does. A run of letters of Latin-1 is looked up in lower case and apart from the signs after it, and goes
    to the tokenizer's model at once; other words go through the whole tokenizer. Words and their ids are remembered, at
    some 140 bytes a word; beyond ``remembered`` of them those are forgotten that have not occurred in later texts again.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.tokenizer, self.remembered = _tokenizer(path), remembered
        self.whole = lru_cache(10_000)(lambda w: self.tokenizer.encode(w, add_special_tokens=False).ids)
        self.known: dict[str, int] = {}  # places, which are in order of entry
        self.again, self.sizes, self.pool = np.empty(0, bool), np.empty(0, np.int64), np.empty(0, np.uint32)

    def _letters(self, runs: list[str]) -> list[list[int]]:
        """Ids of runs of lower-case letters."""
        if not runs:
            return []
        tokenize = self.tokenizer.model.tokenize
        return [[t.id for t in tokenize(w)] for w in " ".join(runs).encode().decode("latin-1").translate(_BYTES).split(" ")]

    def _look_up(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.known.get, words, itertools.repeat(-1)), np.int64, len(words))

    def _forget(self, new: int) -> None:
        """Make room for new words."""
        kept = self.again if int(self.again.sum()) + new <= self.remembered else np.zeros(len(self.again), bool)
        first = np.cumsum(self.sizes) - self.sizes
        self.pool, self.sizes = _parts(self.pool, first[kept], self.sizes[kept]), self.sizes[kept]
        self.known = {w: k for k, w in enumerate(itertools.compress(self.known, kept.tolist()))}
        self.again = np.zeros(len(self.known), bool)

    def _places(self, words: pa.LargeStringArray) -> np.ndarray:
        """The places of different words, which are runs in lower case or others."""
        listed = words.to_numpy(zero_copy_only=False).tolist()
        at = self._look_up(listed)
        self.again[at[at >= 0]] = True
        if len(self.known) + int((at < 0).sum()) > self.remembered:
            self._forget(int((at < 0).sum()))
            at = self._look_up(listed)
        missing = np.flatnonzero(at < 0)
        run = pc.match_substring_regex(words.take(pa.array(missing)), _RUN).to_numpy(zero_copy_only=False)
        runs, others = [[listed[k] for k in missing[x].tolist()] for x in (run, ~run)]
        found = self._letters(runs) + [self.whole(w) for w in others]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(sizes.sum()))
        at[np.r_[missing[run], missing[~run]]] = len(self.known) + np.arange(len(missing))
        self.known.update(zip(runs + others, range(len(self.known), len(self.known) + len(missing)), strict=True))
        self.again = np.r_[self.again, np.zeros(len(missing), bool)]
        self.sizes, self.pool = np.r_[self.sizes, sizes], np.r_[self.pool, flat]
        return at

    def _words(self, words: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different words, one after the other, and how many each has."""
        marked = pc.match_substring_regex(words, _MARKED)
        run = pc.if_else(marked, pc.utf8_lower(pc.ascii_rtrim(words, SIGNS)), words)
        signs = pc.if_else(marked, pc.utf8_ltrim(words, _LETTERS), "")
        parts = pa.concat_arrays([run, signs]).dictionary_encode()
        at = self._places(parts.dictionary)[parts.indices.to_numpy(zero_copy_only=False)]
        at = at.reshape(2, -1).T.ravel()  # each word's run, then its signs
        size = self.sizes[at]
        return _parts(self.pool, (np.cumsum(self.sizes) - self.sizes)[at], size), size.reshape(-1, 2).sum(axis=1)

    def texts(self, texts: pa.Array, end: int) -> pa.Array:
        """Ids as little-endian unsigned 32-bit integers, with the end id."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
        # Spaces at the ends of a text leave empty words, which have no ids.
        coded = split.flatten().dictionary_encode()
        pool, sizes = self._words(coded.dictionary)
        code = coded.indices.to_numpy(zero_copy_only=False)
        size = sizes[code]
        cuts = np.r_[0, np.cumsum(size)][np.asarray(split.offsets) - split.offsets[0].as_py()]  # ids before each text
        flat = _parts(pool, (np.cumsum(sizes) - sizes)[code], size)
        out = np.insert(flat, cuts[1:], end).astype("<u4")
        offsets = (cuts + np.arange(len(cuts))) * 4
        return pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out)])


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One for each Python worker, so that what it remembers outlives a task."""
    return WordIds(path)


def token_ids(docs: DataFrame, path: str, end: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id long, ids binary) of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(path)
        for b in slices(batches, "text", SLICE_BYTES):
            found = words.texts(b.column("text"), end).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("id"), found], names=["id", "ids"])
        pa.default_memory_pool().release_unused()

    return rows.mapInArrow(run, "id long, ids binary")


def counts(ids: DataFrame) -> dict[int, int]:
    """How often each id occurs in the column ``ids``; as many entries as the vocabulary has at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for b in batches:
            raw = b.column("ids").to_pylist()
            found = np.bincount(np.frombuffer(b"".join(raw), "<u4")) if any(raw) else np.zeros(1, np.int64)
            if len(found) > len(total):
                total, found = found.astype(np.int64), total
            total[: len(found)] += found
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])

    per = ids.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return {r["id"]: r["n"] for r in per.collect()}


def code_lengths(weights: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Lengths of an optimal prefix code of at most ``limit`` bits for ascending weights, by package-merge."""
    n = len(weights)
    if n < 2:
        return np.ones(n, np.int64)
    if n > 1 << limit:
        raise ValueError(f"{n} ids don't fit codes of {limit} bits")
    levels, packages = [], np.empty(0)
    for _ in range(limit):
        every = np.concatenate([weights.astype(np.float64), packages])
        order = np.argsort(every, kind="stable")
        levels.append(order < n)  # which of the ascending items are ids
        merged = every[order]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for single in reversed(levels):
        own = int(single[:take].sum())
        lengths[:own] += 1
        take = 2 * (take - own)
    return lengths


class Code:
    """A canonical code: ids in order of length, then value, have ascending codes."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.uint8)  # by id; zero: no code
        ids = np.flatnonzero(lengths)
        ids = ids[np.lexsort((ids, lengths[ids]))]
        width = lengths[ids].astype(np.int64)
        # Each code is the sum of the shares of those before it, as a fraction of 2^MAX_BITS.
        share = np.left_shift(np.int64(1), MAX_BITS - width)
        first = np.cumsum(share) - share
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[ids] = (first >> (MAX_BITS - width)).astype(np.uint64)
        self.symbol = np.zeros(1 << MAX_BITS, np.uint32)
        self.width = np.ones(1 << MAX_BITS, np.uint8)
        filled = int(share.sum())
        self.symbol[:filled], self.width[:filled] = np.repeat(ids, share), np.repeat(width, share)

    @classmethod
    def fitted(cls, n: dict[int, int], limit: int = MAX_BITS) -> Code:
        ids = np.array(sorted(n, key=lambda k: (n[k], k)), np.int64)
        lengths = np.zeros(int(ids.max()) + 1 if len(ids) else 0, np.int64)
        lengths[ids] = code_lengths(np.array([n[int(k)] for k in ids]), limit)
        return cls(lengths)

    def encode(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes, bytes of each text, and checkpoints in bits from a text's start, of texts of ``sizes`` ids each."""
        width = self.lengths[ids].astype(np.int64)
        code = self.codes[ids]
        end = np.cumsum(width)
        text_end = np.cumsum(sizes)
        bits = np.diff(np.r_[0, np.r_[0, end][text_end]])
        used = (bits + 7) // 8
        shift = np.cumsum(used) * 8 - used * 8 - (np.cumsum(bits) - bits)  # bits that alignment has put before a text
        at = end - width + np.repeat(shift, sizes)
        rank = np.arange(len(ids)) - np.repeat(text_end - sizes, sizes)
        start = np.repeat((np.cumsum(used) - used) * 8, sizes)
        checks = (at - start)[rank % STEP == 0].astype(np.uint32)
        # Codes as 64-bit values that straddle two 32-bit words; words get sums of bits that don't overlap.
        word, low = at >> 5, (at & 31).astype(np.uint64)
        value = code << (np.uint64(64) - low - width.astype(np.uint64))
        words = int(used.sum() * 8 >> 5) + 2
        out = np.bincount(word, weights=(value >> np.uint64(32)).astype(np.float64), minlength=words)
        out += np.bincount(word + 1, weights=(value & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=words)
        return out.astype(np.uint32).astype(">u4").view(np.uint8)[: int(used.sum())], used, checks

    def decode(self, data: np.ndarray, used: np.ndarray, sizes: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """The ids of all texts, one after the other."""
        if not sizes.sum():
            return np.empty(0, np.uint32)
        d = np.concatenate([data, np.zeros(STEP * MAX_BITS // 8 + 8, np.uint8)]).astype(np.uint32)
        window = d[:-3] << 24 | d[1:-2] << 16 | d[2:-1] << 8 | d[3:]
        lanes = -(-sizes // STEP)
        at = checks.astype(np.int64) + np.repeat((np.cumsum(used) - used) * 8, lanes)
        rank = np.arange(len(at)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        left = np.minimum(np.repeat(sizes, lanes) - rank * STEP, STEP)
        out = np.empty((STEP, len(at)), np.uint32)
        drop = 32 - MAX_BITS
        for k in range(int(left.max())):
            look = (window[at >> 3] << (at & 7).astype(np.uint32)) >> np.uint32(drop)
            out[k] = self.symbol[look]
            at += self.width[look]
            np.minimum(at, (len(window) - 1) * 8, out=at)
        return out.T[np.arange(STEP) < left[:, None]]


def pack_block(texts: list[tuple[int | None, int, bytes, bytes]]) -> bytes:
    """A block of (id, number of ids, bits, checkpoints)."""
    n = len(texts)
    ids = np.array([t[0] or 0 for t in texts], "<i8").tobytes()
    present = np.array([t[0] is not None for t in texts], np.uint8).tobytes()
    sizes = np.array([t[1] for t in texts], "<u4").tobytes()
    used = np.array([len(t[2]) for t in texts], "<u4").tobytes()
    checks = b"".join(t[3] for t in texts)
    head = MAGIC + np.array([n, len(checks) // 4], "<u4").tobytes()
    return b"".join([head, ids, present, sizes, used, checks, *[t[2] for t in texts]])


def unpack_block(raw: bytes, code: Code) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, present, sizes, token ids of all) of a block."""
    if raw[:4] != MAGIC:
        raise ValueError("not a block of token ids")
    n, k = np.frombuffer(raw, "<u4", 2, 4).astype(int)
    at = 12
    ids = np.frombuffer(raw, "<i8", n, at)
    present = np.frombuffer(raw, np.uint8, n, at + 8 * n).astype(bool)
    sizes = np.frombuffer(raw, "<u4", n, at + 9 * n).astype(np.int64)
    used = np.frombuffer(raw, "<u4", n, at + 13 * n).astype(np.int64)
    checks = np.frombuffer(raw, "<u4", k, at + 17 * n)
    data = np.frombuffer(raw, np.uint8, -1, at + 17 * n + 4 * k)
    return ids, present, sizes, code.decode(data, used, sizes, checks)


def write(ids: DataFrame, path: str) -> None:
    """Write rows of (id long, ids binary) to the folder ``path``. They are kept in a table, to be counted and coded."""
    spark = ids.sparkSession
    # Workers hold many words already.
    with small_batches(spark, BATCH_TEXTS):
        ids = materialize(ids, "ids")
    code = Code.fitted(counts(ids))
    book = [(1, MAX_BITS, code.lengths.tobytes())]
    spark.createDataFrame(book, "version int, max_bits int, lengths binary").coalesce(1).write.parquet(f"{path}/codebook")
    lengths = code.lengths

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Code(lengths)
        # Coding takes some hundred bytes an id: a few texts at a time.
        for b in (x.slice(s, CODED_TEXTS) for x in batches for s in range(0, x.num_rows, CODED_TEXTS)):
            raw = [x or b"" for x in b.column("ids").to_pylist()]
            sizes = np.array([len(x) // 4 for x in raw], np.int64)
            if not len(sizes):
                continue
            data, used, checks = own.encode(np.frombuffer(b"".join(raw), "<u4"), sizes)
            lanes = -(-sizes // STEP)
            cut, mark = np.r_[0, np.cumsum(used)], np.r_[0, np.cumsum(lanes)]
            bits = [data[s:e].tobytes() for s, e in zip(cut, cut[1:], strict=False)]
            marks = [checks[s:e].tobytes() for s, e in zip(mark, mark[1:], strict=False)]
            keys = pc.fill_null(b.column("id"), -(1 << 63)).to_numpy(zero_copy_only=False)
            shard = pa.array(np.searchsorted(cuts, keys, side="right").astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [shard, b.column("id"), pa.array(sizes), pa.array(bits, pa.binary()), pa.array(marks, pa.binary())],
                names=["shard", "id", "n", "bits", "checks"],
            )

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, before, texts, total = None, 0, 0, [], 0

        def out() -> pa.RecordBatch:
            row = [[shard], [block], [before], [total], [pack_block(texts)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in zip(row, kinds, strict=True)], names=["shard", "block", "before", "n_ids", "payload"]
            )

        for b in batches:
            for s, i, n, bits, checks in zip(*[b.column(c).to_pylist() for c in ("shard", "id", "n", "bits", "checks")], strict=True):
                if texts and (s != shard or total >= BLOCK_IDS):
                    yield out()
                    block, before, texts, total = (block + 1, before + total, [], 0) if s == shard else (0, 0, [], 0)
                elif s != shard:
                    block, before = 0, 0
                shard = s
                texts.append((i, n, bits, checks))
                total += n
        if texts:
            yield out()

    keys = ids.select(F.coalesce("id", F.lit(-(1 << 63))).alias("key"))
    n = SHARDS * shuffle_width(spark)
    found = keys.approxQuantile("key", [k / n for k in range(1, n)], 1 / (2 * n))
    cuts = np.array(sorted({min(int(x), (1 << 63) - 1) for x in found}), np.int64)

    made = ids.select("id", "ids").mapInArrow(coded, "shard int, id long, n long, bits binary, checks binary")
    # Each file has a run of shards, and the files are in order of the ids.
    width = shuffle_width(spark)
    dealt = made.repartitionById(width, (F.col("shard") * width / F.lit(len(cuts) + 1)).cast("int"))
    dealt = dealt.sortWithinPartitions("shard", F.col("id").asc_nulls_first(), "bits")
    made = dealt.mapInArrow(blocks, "shard int, block int, before long, n_ids long, payload binary")
    with small_batches(spark, BATCH_TEXTS):
        made.write.option("compression", "none").parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(id long, start long, n_tokens long, ids binary) of every text of a folder that ``write`` made."""
    book = spark.read.parquet(f"{path}/codebook").first()
    if (book["version"], book["max_bits"]) != (1, MAX_BITS):
        raise ValueError("another version of the format")
    lengths = np.frombuffer(book["lengths"], np.uint8)
    stored = spark.read.parquet(f"{path}/blocks")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(lengths.astype(np.int64))
        for b in batches:
            for shard, before, raw in zip(*[b.column(c).to_pylist() for c in ("shard", "before", "payload")], strict=True):
                ids, present, sizes, found = unpack_block(raw, code)
                end = np.cumsum(sizes)
                raws = [found[s:e].astype("<u4").tobytes() for s, e in zip(end - sizes, end, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(ids), shard, np.int32)), pa.array(ids, mask=~present),
                        pa.array(end - sizes + before), pa.array(sizes), pa.array(raws, pa.binary()),
                    ],
                    names=["shard", "id", "at", "n_tokens", "ids"],
                )

    from pyspark.sql.window import Window

    # A row for each shard meets in this window.
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    totals = stored.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    bases = totals.select(F.col("shard").alias("of"), F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))
    few = totals.count() <= BROADCAST_SHARDS
    rows = stored.select("shard", "before", "payload").mapInArrow(texts, "shard int, id long, at long, n_tokens long, ids binary")
    joined = rows.join(F.broadcast(bases) if few else bases, F.col("shard") == F.col("of"))
    return joined.select("id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids")
