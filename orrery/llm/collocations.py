"""Phrase collocation mining with weighted acyclic automata.

A text is cut into pieces at `[.,;:!?\\x0A-\\x0D]`, a piece into words at spaces and tabs, A-Z in lower case. Of each language (a
null one is ``und``) f counts every contiguous run of one to four words within pieces, overlaps included, and n all words.
Candidates are phrases of two to four words with f of LEAST or more. A cut after k words gives l = f(first part),
r = f(rest) and floor(SCALE * a / (l + r)); the lowest-scoring cut counts, of equal ones the shortest first part. Candidates that
lie inside a longer one which has at least NEAR percent of their occurrences are dropped.

Plan. A task reads runs of some SHARD_TOKENS tokens. Every word begins one sequence: its language, itself and up to three words
that follow in its piece; so counts of shorter phrases are sums over the sequences that begin with them. Sorted sequences of a
run become a count automaton (``automata``), cut where ranges of sequences begin and sent by range (``exchange``): a range
holds a bounded number of sequences however often its first words occur, as cuts are whole sequences, taken from a bounded sample
of texts that decides about balance alone. Where there are more ranges than FAN, automata go through levels of FAN ranges each,
and are merged in bundles of bounded size on the way, so that the number of parts sent grows with the corpus and not with its
square. A range unites its automata and adds up weights; phrases at its two ends, which others may share, are added up across
ranges (``phrases``). What is under LEAST is gone by now. Parts of candidates are asked where they belong, each once by each
range that needs it: a range composes the asked phrases with its automaton of counts and answers (``parts``).

Scores are Python integers, so products of any size are exact. Null texts have no words; an empty table has no phrases; ids play
no part, so repeated rows count as often as they are there.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .automata import DEPTH, Automaton, place, summed, union
from .common import materialize, shuffle_width

LEAST, SCALE, NEAR, LONGEST = 30, 2_000_000, 80, DEPTH - 1
#: Tokens of a run, tokens of the corpus for each range, ranges that a level sends to.
SHARD_TOKENS, RANGE_TOKENS, FAN = 1_500_000, 1_500_000, 256
#: Texts of the sample that cuts are taken from, and its sequences for each range.
SAMPLE_TEXTS, SAMPLE = 4_000, 20
#: Most ranges; beyond some 4 * 10^11 tokens ranges grow instead.
MOST_RANGES = 1 << 18
#: Bytes of a text that are split at a time.
PIECE = 4 << 20

_BREAKS = b".,;:!?\n\x0b\x0c\r"
_PLAIN = bytes(10 if c in _BREAKS else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))

PARTS = "part long, bundle long, data binary"
_PARTS_ARROW = pa.schema([("part", pa.int64()), ("bundle", pa.int64()), ("data", pa.binary())])
NODES = "part long, lang string, phrase string, k int, n long, shared boolean"
_NODES_ARROW = pa.schema(
    [("part", pa.int64()), ("lang", pa.string()), ("phrase", pa.string()), ("k", pa.int32()), ("n", pa.int64()), ("shared", pa.bool_())]
)


def tokens(text: str, size: int) -> Iterator[list[bytes]]:
    """Words, breaks between pieces (a line feed) and empty strings, in lists of some ``size`` bytes each."""
    data = text.encode("utf-8", "surrogatepass").translate(_PLAIN)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + size) if len(data) - at > size else -1
        end = len(data) if end < 0 else end
        yield data[at:end].replace(b"\n", b" \n ").split(b" ")
        at = end


class _Run:
    """Tokens of consecutive texts, as numbers: 0 is nothing, 1 a break, and their languages."""

    def __init__(self):
        self.known: dict = defaultdict()
        self.known.default_factory = self.known.__len__
        for mark in (b"", b"\n"):
            self.known[mark]
        self.words, self.langs, self.size = [], [], 0

    def add(self, some: list[bytes], lang: bytes) -> None:
        ids = np.fromiter(map(self.known.__getitem__, some), np.int32, len(some))
        ids = ids[ids != 0]
        if len(ids):
            self.words.append(ids)
            self.langs.append(np.full(len(ids), self.known[lang], np.int32))
            self.size += len(ids)

    def end(self) -> None:
        self.words.append(np.ones(1, np.int32))
        self.langs.append(np.ones(1, np.int32))

    def rest(self) -> list[bytes]:
        """The last words of an open piece, which begin sequences that go on in the next run."""
        last = np.concatenate([np.ones(1, np.int32), *self.words[-LONGEST:]])[-(LONGEST - 1) :]
        last = last[np.flatnonzero(last == 1)[-1] + 1 :] if (last == 1).any() else last
        names = list(self.known)
        return [names[k] for k in last.tolist()]

    def sequences(self, open_end: int = 0) -> tuple[list[bytes], list[np.ndarray], np.ndarray]:
        """(names, columns, counts) of the sequences that begin with each word, but for the last ``open_end`` tokens."""
        names = sorted(self.known)
        rank = np.empty(len(names), np.int64)
        rank[[self.known[x] for x in names]] = np.arange(len(names))
        words = np.concatenate([*self.words, np.ones(LONGEST, np.int32)])
        langs = np.concatenate([*self.langs, np.ones(LONGEST, np.int32)])
        starts = np.flatnonzero(words[: len(words) - LONGEST - open_end] != 1)
        columns, alive = [rank[langs[starts]]], np.ones(len(starts), bool)
        for k in range(LONGEST):
            word = words[starts + k]
            alive &= word != 1
            columns.append(np.where(alive, rank[word], 0))
        return names, *summed(columns, np.ones(len(starts), np.int64))


def runs(batches: Iterator[pa.RecordBatch], size: int, piece: int) -> Iterator[tuple]:
    """The sequences of runs of texts; long texts are cut, their sequences are not."""
    run = _Run()
    for b in batches:
        texts, langs = b.column("text"), b.column("lang").to_pylist()
        for i, lang in enumerate(langs):
            name = lang.encode("utf-8", "surrogatepass")
            for some in tokens(texts[i].as_py() or "", piece):
                for s in range(0, len(some), size):
                    run.add(some[s : s + size], name)
                    if run.size >= size:
                        rest = run.rest()
                        yield run.sequences(len(rest))
                        run = _Run()
                        run.add(rest, name)
            run.end()
    if run.size:
        yield run.sequences()


def _texts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))


def cuts_of(texts: DataFrame) -> list[tuple[bytes, ...]]:
    """Where ranges begin but for the first, in order."""
    size, n = texts.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    total = (size or 0) // 5
    wanted = min(max(-(-total // RANGE_TOKENS), min(shuffle_width(texts.sparkSession), total // 100_000)), MOST_RANGES)
    if wanted < 2:
        return []
    size, piece = SHARD_TOKENS, PIECE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, columns, _ in runs(batches, size, piece):
            at = np.arange(0, len(columns[0]), max(1, len(columns[0]) // 5_000))
            some = [pa.array([names[k] for k in c[at].tolist()], pa.binary()) for c in columns]
            yield pa.RecordBatch.from_arrays(some, names=[f"s{k}" for k in range(DEPTH)])

    some = texts.where(F.pmod(F.xxhash64("text"), F.lit(max(1, n // SAMPLE_TEXTS))) == 0)
    found = some.mapInArrow(run, ", ".join(f"s{k} binary" for k in range(DEPTH))).distinct()
    rows = found.orderBy(F.xxhash64(*found.columns)).limit(SAMPLE * wanted).collect()
    rows = sorted(tuple(bytes(x) for x in r) for r in rows)
    return sorted({rows[len(rows) * k // wanted] for k in range(1, wanted)}) if rows else []


def _bundle(of: int, *parts: int) -> int:
    return xxhash.xxh64_intdigest(repr(parts).encode()) % of


def _sent(names, columns, weights, cuts: list, first: int, last: int, step: int, bundles: int, key: tuple) -> pa.RecordBatch:
    """An automaton for each of the ranges first .. last - 1, ``step`` to a part, which has any sequence."""
    rows = []
    low = 0
    for part in range(first // step, -(-last // step)):
        end = min((part + 1) * step, last)
        high = place(names, columns, cuts[end - 1]) if end <= len(cuts) and end < last else len(weights)
        if high > low:
            data = Automaton.of(names, [c[low:high] for c in columns], weights[low:high]).dump()
            rows.append({"part": part, "bundle": _bundle(bundles, *key, part), "data": data})
        low = high
    return pa.RecordBatch.from_pylist(rows, schema=_PARTS_ARROW)


def _dealt(rows: DataFrame, n: int, *keys: str):
    """Grouped by the keys, in as many partitions as there are groups, up to a bound."""
    width = max(shuffle_width(rows.sparkSession), min(n, 20_000))
    return rows.repartition(width, *keys).groupBy(*keys)


def exchange(texts: DataFrame, cuts: list, fan: int | None = None) -> DataFrame:
    """Rows of PARTS: the automata of each range."""
    fan, n = fan or FAN, len(cuts) + 1
    steps = [1]
    while steps[-1] * fan < n:
        steps.append(steps[-1] * fan)
    steps.reverse()
    size, piece = SHARD_TOKENS, PIECE

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for k, (names, columns, weights) in enumerate(runs(batches, size, piece)):
            yield _sent(names, columns, weights, cuts, 0, n, steps[0], steps[0], (task, k))

    def merger(before: int, step: int):
        def merged(table: pa.Table) -> pa.Table:
            part, bundle = table.column("part")[0].as_py(), table.column("bundle")[0].as_py()
            found = union([Automaton.load(x) for x in table.column("data").to_pylist()])
            first, last = part * before, min((part + 1) * before, n)
            return pa.Table.from_batches([_sent(*found, cuts, first, last, step, step, (part, bundle))])

        return merged

    rows = texts.mapInArrow(shards, PARTS)
    for before, step in zip(steps, steps[1:], strict=False):
        rows = _dealt(rows, n, "part", "bundle").applyInArrow(merger(before, step), PARTS)
    return rows


def _finished(table: pa.Table, least: int) -> pa.Table:
    """The phrases of a range that occur ``least`` times or more, and those at its ends, with their counts; k = 0 counts all words."""
    part = table.column("part")[0].as_py()
    names, columns, weights = union([Automaton.load(x) for x in table.column("data").to_pylist()])
    new = np.zeros(len(weights), bool)
    new[0] = True
    out = {f.name: [] for f in _NODES_ARROW}
    for k, c in enumerate(columns):
        new[1:] |= c[1:] != c[:-1]
        heads = np.flatnonzero(new)
        n = np.add.reduceat(weights, heads)
        ends = np.zeros(len(heads), bool)
        ends[[0, -1]] = True
        mine = ((n >= least) | ends | (k == 0)) & ((k == 0) | (c[heads] != 0))
        at = heads[mine].tolist()
        out["part"] += [part] * len(at)
        out["lang"] += [names[columns[0][i]].decode("utf-8", "replace") for i in at]
        words = [x.tolist() for x in (col[heads[mine]] for col in columns[1 : k + 1])]
        out["phrase"] += [b" ".join(names[w] for w in ws).decode("utf-8", "replace") for ws in zip(*words, strict=True)] if k else [""] * len(at)
        out["k"] += [k] * len(at)
        out["n"] += n[mine].tolist()
        out["shared"] += (ends | (k == 0))[mine].tolist()
    return pa.table(out, schema=_NODES_ARROW)


def _path(lang: str, phrase: str) -> tuple[bytes, ...]:
    words = [lang.encode(), *(phrase.encode().split(b" ") if phrase else [])]
    return (*words, *[b""] * (DEPTH - len(words)))


def phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", fan: int | None = None) -> tuple[DataFrame, list]:
    """(rows of NODES: a row for each phrase of one to four words with LEAST occurrences or more; the ranges' cuts).

    ``part`` is the range that a phrase belongs to. Rows of no words (k = 0) have a language's number of words.
    """
    texts = _texts(docs, text_col, lang_col)
    cuts = cuts_of(texts)
    least = LEAST

    def finished(table: pa.Table) -> pa.Table:
        return _finished(table, least)

    found = materialize(_dealt(exchange(texts, cuts, fan), len(cuts) + 1, "part").applyInArrow(finished, NODES), "ranges")

    def owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            for r in rows:
                r["part"] = bisect_right(cuts, _path(r["lang"], r["phrase"]))
            yield pa.RecordBatch.from_pylist(rows, schema=_NODES_ARROW)

    ends = found.where("shared").groupBy("lang", "phrase", "k").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("k") == 0))
    ends = ends.select(F.lit(0).cast("long").alias("part"), "lang", "phrase", "k", "n", F.lit(True).alias("shared")).mapInArrow(owned, NODES)
    return materialize(found.where("not shared").unionByName(ends), "phrases"), cuts


def _cut(phrase: str) -> list[tuple[str, str]]:
    words = phrase.split(" ")
    return [(" ".join(words[:k]), " ".join(words[k:])) for k in range(1, len(words))]


def parts(nodes: DataFrame, cuts: list) -> DataFrame:
    """(part, lang, phrase, n): the counts of phrases that candidates of a range have as parts and that other ranges hold."""

    def asked(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        rows = list(zip(*[table.column(c).to_pylist() for c in ("lang", "phrase")], strict=True))
        own = set(rows)
        # A word that begins no phrase's rest or first part is asked for by nobody; each part once, sorted.
        wanted = sorted({(lang, p) for lang, phrase in rows for both in _cut(phrase) for p in both} - own)
        return pa.table(
            {
                "target": pa.array([bisect_right(cuts, _path(*w)) for w in wanted], pa.int64()), "part": pa.array([part] * len(wanted), pa.int64()),
                "lang": pa.array([w[0] for w in wanted], pa.string()), "phrase": pa.array([w[1] for w in wanted], pa.string()),
            }
        )

    def answered(counts: pa.Table, asks: pa.Table) -> pa.Table:
        rows = sorted((_path(lang, p), n) for lang, p, n in zip(*[counts.column(c).to_pylist() for c in ("lang", "phrase", "n")], strict=True))
        names = sorted({x for path, _ in rows for x in path} | {b""})
        number = {x: k for k, x in enumerate(names)}
        columns = [np.array([number[path[d]] for path, _ in rows], np.int64) for d in range(DEPTH)]
        held = Automaton.of(names, columns, np.array([n for _, n in rows], np.int64))
        n = held.compose([_path(*x) for x in zip(asks.column("lang").to_pylist(), asks.column("phrase").to_pylist(), strict=True)])
        return asks.select(["part", "lang", "phrase"]).append_column("n", pa.array(n, pa.int64()))

    width = len(cuts) + 1
    words = nodes.where("k > 0")
    asks = _dealt(words, width, "part").applyInArrow(asked, "target long, part long, lang string, phrase string")
    return _dealt(words, width, "part").cogroup(_dealt(asks, width, "target")).applyInArrow(
        answered, "part long, lang string, phrase string, n long"
    )


def candidates(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", fan: int | None = None) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, k, a, l, r, score) of every candidate, (lang, n) of every language)."""
    nodes, cuts = phrases(docs, text_col, lang_col, fan)

    def scored(own: pa.Table, answers: pa.Table) -> pa.Table:
        rows = list(zip(*[own.column(c).to_pylist() for c in ("lang", "phrase", "n", "k")], strict=True))
        n = {(lang, p): count for lang, p, count, _ in rows}
        n |= {(lang, p): count for lang, p, count in zip(*[answers.column(c).to_pylist() for c in ("lang", "phrase", "n")], strict=True)}
        out = []
        for lang, phrase, a, k in rows:
            if k > 1:
                both = [(n[lang, first], n[lang, rest]) for first, rest in _cut(phrase)]
                score, at = min((SCALE * a // (x + y), at) for at, (x, y) in enumerate(both))
                out.append((lang, phrase, k, a, *both[at], score))
        kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 4]
        names = ["lang", "phrase", "k", "a", "l", "r", "score"]
        columns = list(zip(*out, strict=True)) or [[]] * len(names)
        return pa.table({name: pa.array(list(c), kind) for name, c, kind in zip(names, columns, kinds, strict=True)})

    width = len(cuts) + 1
    both = _dealt(nodes.where("k > 0"), width, "part").cogroup(_dealt(parts(nodes, cuts), width, "part"))
    found = both.applyInArrow(scored, "lang string, phrase string, k int, a long, l long, r long, score long")
    return materialize(found, "candidates"), nodes.where("k = 0").select("lang", "n")


def mined(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most: int = 2000, fan: int | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best collocations."""
    found, sizes = candidates(docs, text_col, lang_col, fan)
    # A phrase within one that is longer by two is also within one that is longer by one and occurs as often at least.
    inside = F.expr("explode(array(substring_index(phrase, ' ', k - 1), substring_index(phrase, ' ', 1 - k)))")
    longer = found.where("k > 2").select("lang", inside.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    left = found.join(longer, ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * F.col("most") < NEAR * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    best = left.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= most)
    return best.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
