"""Toxicity by a support vector machine on subsequence string kernels, with Nyström landmarks.

The kernel of two strings sums over all common subsequences of ORDER bytes, each occurrence weighed by DECAY to the power
of the spans that it takes up in both, so that gaps and inserted characters cost likeness but don't end it. Normalised and
raised to POWER it is the kernel of two windows; the kernel of two texts is the sum over all pairs of windows of their
different words. A text is mapped by its kernel values with landmarks, strings that toxic training texts share and clean
ones lack, and the inverse root of the landmarks' own kernel matrix (Nyström). The machine sees two scalings of
the kernel values, by the fourth root of the text's kernel with itself, so that the fortieth repeat counts less than the first,
and by the root of its number of words; and that number itself, as long texts have such values by chance. It is linear with
squared hinge loss and the norm of the Nyström map, and no weight of a kernel value is negative: likeness to a landmark never
lowers a score. It is trained also on toxic texts with characters put into their landmarks, and on short texts: single telling
words among a few others, and a few words of clean texts. A sigmoid fitted across folds, on values of machines that didn't see
the text, turns its values into probabilities.

Words are runs of other characters than `[\\x20\\x09-\\x0D]` with A-Z in lower case and without ASCII punctuation, as UTF-8 bytes
after a mark of their beginning; three or more one-byte words in a row are taken together as one more word. Words of more than WINDOW bytes are cut
into overlapping pieces. Windows are of a landmark's length or up to SLACK longer. What adds next to nothing is left out:
words with fewer than LETTERS of a landmark's distinct bytes, or whose kernel with it is under FLOOR of the landmark's own.

Landmarks and machine are fitted on the driver, on a sample of labelled texts that is bounded by TOXIC_TEXTS, CLEAN_TEXTS
and SAMPLE_CHARS; texts are sampled by a hash of their ids. Everything that is scored is scored whole. Null and empty texts
have the kernel value 0 with all landmarks. Without training texts of both kinds all scores are the share of toxic labels.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, appended, slices

ORDER, DECAY, FLOOR, LETTERS, POWER = 3, 0.8, 0.5, 0.7, 3
#: Bytes of a word that are compared at once, and by how many a window may be longer than a landmark.
WINDOW, SLACK = 24, 3
#: Bounds of the training sample: texts of each kind, and characters of a text that takes part in it.
TOXIC_TEXTS, CLEAN_TEXTS, SAMPLE_CHARS = 1500, 3000, 20_000
LANDMARKS, MIN_TEXTS, GRAMS = 48, 4, (4, 5, 6)
#: How much more frequent among toxic texts a landmark is, at least.
RATIO = 4.0
#: How far the logarithm of its likelihood ratio is over that of the number of strings tried, at least.
TELLING = 3.0
#: Score from which a text is toxic, weight of the machine's norm in what it minimises, and folds of the sample for the sigmoid.
THRESHOLD, RIDGE, FOLDS = 0.7, 1e-4, 4
#: Weight in training of a toxic text's copy whose landmarks have a character put in.
DISGUISED = 1.0
#: Weight in training of all short texts of a kind, by that of all texts of the kind.
LONE = 1.0

#: Bytes of texts that are scored at a time.
BATCH_BYTES = 8 << 20

#: What stands before each word, so that its beginning counts as a byte of its own.
BEGIN = b"\x02"
_SPELT = re.compile(rb"(?<![^ ])[^ ](?: [^ ]){2,}(?![^ ])")
#: ASCII punctuation, which is left out of words.
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def words_of_text(text: str | None) -> set[bytes]:
    words = (text or "").encode().translate(LOWER, PUNCTUATION).split()
    found = {BEGIN + w for w in words}
    for m in _SPELT.finditer(b" ".join(words)):
        found.add(BEGIN + m[0].replace(b" ", b""))
    return found


def _matrix(words: list[bytes]) -> np.ndarray:
    """Words of up to WINDOW bytes as rows, filled with zeros."""
    width = max(map(len, words), default=1)
    return np.frombuffer(np.array(words, f"S{width}").tobytes(), np.uint8).reshape(len(words), width)


def kernel(rows: np.ndarray, t: bytes | np.ndarray, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """The subsequence kernel of each row with t, or with the row of t at the same place."""
    other = [np.full(len(rows), c, np.uint8) for c in t] if isinstance(t, bytes) else list(t.T)
    n, m, size = rows.shape[1], len(other), len(rows)
    # partial[q][j]: weights of common subsequences of q bytes up to the current byte and t[:j], spans counted to there.
    partial = [np.ones((m + 1, size))] + [np.zeros((m + 1, size)) for _ in range(order - 1)]
    total = np.zeros(size)
    for i in range(n):
        same = [(rows[:, i] == c) & (c > 0) for c in other]
        for j in range(m):
            total += np.where(same[j], partial[order - 1][j], 0.0) * decay**2
        for q in range(order - 1, 0, -1):
            run = np.zeros(size)
            for j in range(m):
                run = run * decay + np.where(same[j], partial[q - 1][j], 0.0) * decay**2
                partial[q][j + 1] = partial[q][j + 1] * decay + run
    return total


class Landmarks:
    def __init__(self, strings: list[bytes]):
        self.strings = strings
        own = [float(kernel(_matrix([t]), t)[0]) for t in strings]
        self.own = np.array(own)
        self.bits = [self._mask(_matrix([t]))[0] for t in strings]
        both = np.array([[float(kernel(_matrix([s]), t)[0]) for t in strings] for s in strings]).reshape(len(strings), -1)
        gram = (both / np.sqrt(np.outer(self.own, self.own))) ** POWER + 1e-3 * np.eye(len(strings))
        value, vector = np.linalg.eigh(gram)
        self.root = vector @ np.diag(np.maximum(value, 1e-6) ** -0.5) @ vector.T
        # The norm of a machine in terms of its weights on kernel values: the map's root, undone twice.
        self.gram = vector @ np.diag(np.maximum(value, 1e-6)) @ vector.T

    @staticmethod
    def _mask(rows: np.ndarray) -> np.ndarray:
        """The set of bytes of each row, by their lower six bits."""
        bits = np.where(rows > 0, np.uint64(1) << (rows & 63).astype(np.uint64), np.uint64(0))
        return np.bitwise_or.reduce(bits, axis=1)

    def of_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(places, values): the words that have a kernel value with some landmark, and their values with each."""
        pieces, owners = [], []
        for k, w in enumerate(words):
            for s in range(0, max(1, len(w) - WINDOW // 2), WINDOW // 2) if len(w) > WINDOW else (0,):
                pieces.append(w[s : s + WINDOW])
                owners.append(k)
        lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
        found: dict[int, np.ndarray] = {}
        for low, high in ((2, 8), (8, 13), (13, WINDOW)):
            at = np.flatnonzero((lens > low) & (lens <= high))
            if not len(at):
                continue
            rows = _matrix([pieces[k] for k in at])
            bits = self._mask(rows)
            for c, t in enumerate(self.strings):
                need = math.ceil(LETTERS * int(self.bits[c]).bit_count())
                close = np.flatnonzero(np.bitwise_count(bits & np.uint64(self.bits[c])) >= need)
                if not len(close):
                    continue
                close = close[kernel(rows[close], t) > FLOOR * self.own[c]]
                for k, v in zip(close, self._in_windows([pieces[at[k]] for k in close], t, self.own[c]), strict=True):
                    x = found.setdefault(owners[at[k]], np.zeros(len(self.strings)))
                    x[c] = max(x[c], v)
        return np.array(list(found), np.int64), np.array(list(found.values())).reshape(-1, len(self.strings))

    @staticmethod
    def _in_windows(words: list[bytes], t: bytes, own: float) -> np.ndarray:
        """The sum of the kernel values of each word's windows with t."""
        windows, at = [], []
        for k, w in enumerate(words):
            for size in range(len(t), max(len(t), min(len(t) + SLACK, len(w))) + 1):
                for s in range(max(1, len(w) - size + 1)):
                    windows.append(w[s : s + size])
                    at.append(k)
        if not windows:
            return np.empty(0)
        rows = _matrix(windows)
        like = kernel(rows, t) / np.sqrt(np.maximum(kernel(rows, rows), 1e-12) * own)
        return np.bincount(at, weights=np.minimum(like, 1.0) ** POWER, minlength=len(words))

    def of_texts(self, texts: list[str | None]) -> np.ndarray:
        """The Nyström map of texts in both scalings."""
        n = len(self.strings)
        values = self.values([words_of_text(t) for t in texts])
        return np.hstack([values[:, :n] @ self.root, values[:, n : 2 * n] @ self.root])

    def values(self, sets: list[set[bytes]]) -> np.ndarray:
        """What the machine sees of sets of words: kernel values with the landmarks in both scalings, and two columns of the size."""
        every = list(set().union(*sets)) if sets else []
        places, values = self.of_words(every)
        number = {every[k]: n for n, k in enumerate(places.tolist())}
        sums = np.zeros((len(sets), len(self.strings)))
        for k, s in enumerate(sets):
            own = [number[w] for w in s if w in number]
            if own:
                sums[k] = values[own].sum(axis=0)
        length = np.sqrt(((sums @ self.root) ** 2).sum(axis=1, keepdims=True))
        size = np.array([max(len(s), 1) for s in sets])[:, None]
        return np.hstack([sums / np.sqrt(np.maximum(length, 1e-9)), sums / np.sqrt(size), np.log1p(size) / 5, np.sqrt(size) / 30])


def _likelihood_ratio(t: float, c: float, nt: int, nc: int) -> float:
    p = (t + c) / (nt + nc)
    part = lambda k, n: (k * math.log(k / n / p) if k else 0) + ((n - k) * math.log((n - k) / n / (1 - p)) if n > k and p < 1 else 0)
    return part(min(t, nt), nt) + part(min(c, nc), nc)


def distinct(sets: list[set[bytes]]) -> list[set[bytes]]:
    """The sets but for those that share half of their words with an earlier one: copies tell nothing more."""
    kept: list[set[bytes]] = []
    buckets: dict = defaultdict(list)
    for s in sets:
        keys = [(k, min(xxhash.xxh32_intdigest(w, k) for w in s)) for k in range(4)] if s else []
        near = {n for key in keys for n in buckets[key]}
        if any(2 * len(s & kept[n]) > len(s | kept[n]) for n in near):
            continue
        for key in keys:
            buckets[key].append(len(kept))
        kept.append(s)
    return kept


def mine(toxic: list[set[bytes]], clean: list[set[bytes]]) -> list[bytes]:
    """Strings that tell words of toxic texts, the most telling first; each accounts for words that those before don't."""
    nt, nc = len(toxic), len(clean)
    of_t, of_c = Counter(w for s in toxic for w in s), Counter(w for s in clean for w in s)

    def grams(w: bytes) -> set[bytes]:
        return {w[k : k + n] for n in GRAMS for k in range(len(w) - n + 1)}

    t: Counter = Counter()
    for w, n in of_t.items():
        if len(w) <= 4 * WINDOW:
            for g in grams(w):
                t[g] += n
    t = Counter({g: n for g, n in t.items() if n >= MIN_TEXTS})
    c: Counter = Counter()
    holders = defaultdict(list)
    for w, n in of_c.items():
        if len(w) <= 4 * WINDOW:
            for g in grams(w):
                if g in t:
                    c[g] += n
    least = math.log(max(len(t), 1)) + TELLING
    telling = {g for g, n in t.items() if n / nt >= RATIO * c[g] / nc}
    for w in of_t:
        if len(w) <= 4 * WINDOW:
            for g in grams(w) & telling:
                holders[g].append(w)
    chosen: list[bytes] = []
    gone: set[bytes] = set()
    while telling and len(chosen) < LANDMARKS:
        best = max(telling, key=lambda g: (_likelihood_ratio(t[g], c[g], nt, nc), len(g), g))
        if _likelihood_ratio(t[best], c[best], nt, nc) < least:
            break
        words = [w for w in holders[best] if w not in gone]
        chosen.append(_grown(best, Counter({w: of_t[w] for w in words})))
        for w in words:
            gone.add(w)
            for g in grams(w) & telling:
                t[g] -= of_t[w]
        telling = {g for g in telling if t[g] >= MIN_TEXTS and t[g] / nt >= RATIO * c[g] / nc}
    return list(dict.fromkeys(chosen))


def _grown(gram: bytes, words: Counter) -> bytes:
    """The gram with the bytes beside it that nine tenths of the words' occurrences have."""
    while len(gram) < 12:
        sides: Counter = Counter()
        for w, n in words.items():
            at = w.find(gram)
            if at > 0:
                sides[w[at - 1 : at] + gram] += n
            if 0 <= at < len(w) - len(gram):
                sides[gram + w[at + len(gram) : at + len(gram) + 1]] += n
        longer, n = max(sides.items(), key=lambda x: (x[1], x[0]), default=(b"", 0))
        if n < 0.9 * sum(words.values()):
            break
        gram = longer
    return gram


def _disguised(text: str | None, strings: list[bytes], salt: int) -> str:
    """The text with a character put into each occurrence of a landmark."""
    shape = re.compile("|".join(re.escape(t.strip(BEGIN).decode(errors="ignore")) for t in strings) or "(?!)", re.IGNORECASE)

    def put(m: re.Match) -> str:
        w = m[0]
        at = 1 + xxhash.xxh32_intdigest(w, salt) % max(len(w) - 1, 1)
        return w[:at] + "-.*_x"[salt % 5] + w[at:]

    return shape.sub(put, text or "")


def _few(words: set[bytes], salt: bytes, n: int = 4) -> set[bytes]:
    """Up to n of the words, by their hashes."""
    return set(sorted(words, key=lambda w: (xxhash.xxh32_intdigest(w + salt), w))[:n])


def _lone(words: set[bytes], strings: list[bytes]) -> list[set[bytes]]:
    """For each landmark that a word holds, one such word among a few words that hold none."""
    holders = {t: min((w for w in words if t in w), default=None) for t in strings}
    rest = {w for w in words if not any(t in w for t in strings)}
    return [{w} | _few(rest, t) for t, w in holders.items() if w is not None]


def machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, norm: np.ndarray, ridge: float | None = None) -> np.ndarray:
    """Weights and bias of a machine with squared hinge loss, none of whose weights on kernel values is negative, by Newton steps
    on those that aren't held at zero; y is 1 or -1, ``norm`` the matrix of the norm of these weights. The last two columns
    of x, of a text's size, have weights of any sign.

    So no kernel value with a landmark of toxic texts ever lowers a text's value.
    """
    z = np.c_[x, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    weight = weight / weight.sum()
    keep = np.zeros((len(w), len(w)))
    keep[:-3, :-3] = norm * (RIDGE if ridge is None else ridge)
    keep[[-3, -2], [-3, -2]], keep[-1, -1] = RIDGE, 1e-8
    free = np.ones(len(w), bool)

    def loss(w: np.ndarray) -> float:
        return float((weight * np.maximum(1 - y * (z @ w), 0) ** 2).sum() + w @ keep @ w)

    for _ in range(200):
        inside = y * (z @ w) < 1
        a = z[inside] * weight[inside, None]
        hess, right = z[inside].T @ a + keep, a.T @ y[inside]
        # A weight at zero is let go where that lowers the loss.
        free = (w > 0) | (right - hess @ w > 1e-12)
        free[-3:] = True
        new = np.zeros(len(w))
        new[free] = np.linalg.solve(hess[np.ix_(free, free)] + 1e-12 * np.eye(free.sum()), right[free])
        # Along the step no weight goes below zero, and the loss falls.
        before, share = loss(w), 1.0
        while share > 1e-6:
            step = w + share * (new - w)
            step[:-3] = np.maximum(step[:-3], 0)
            if loss(step) < before:
                break
            share /= 2
        else:
            break
        done = np.abs(step - w).max() < 1e-9
        w = step
        if done:
            break
    return w


def sigmoid_of(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """(a, b) so that 1 / (1 + exp(-(a s + b))) fits the labels, with targets that stay off 0 and 1."""
    n1, n0 = weight[y > 0].sum(), weight[y < 0].sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, math.log((n1 + 1) / (n0 + 1))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * score + b, -30, 30)))
        g = weight * (p - target)
        h = weight * np.maximum(p * (1 - p), 1e-9)
        hess = np.array([[(h * score**2).sum() + 1e-3, (h * score).sum()], [(h * score).sum(), h.sum() + 1e-3]])
        step = np.linalg.solve(hess, [(g * score).sum(), g.sum()])
        a, b = a - min(1, 5 / (abs(step[0]) + 1e-9)) * step[0], b - min(1, 5 / (abs(step[1]) + 1e-9)) * step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(a, 0.0), b


class Model:
    """A fitted scorer; ``share`` is the score where there is nothing to learn from."""

    def __init__(self, toxic: list[str | None], clean: list[str | None], n_toxic: int, n_clean: int):
        self.share = n_toxic / max(n_toxic + n_clean, 1)
        self.landmarks = None
        if len(toxic) < 4 or len(clean) < 4:
            return
        strings = mine(*[distinct([words_of_text(t) for t in texts]) for texts in (toxic, clean)])
        if not strings:
            return
        self.landmarks = Landmarks(strings)
        disguised = [_disguised(t, strings, k) for k, t in enumerate(toxic)]
        sets = [words_of_text(t) for t in [*toxic, *disguised, *clean]]
        bad, good = sets[: len(toxic)], sets[2 * len(toxic) :]
        # Short texts: each telling word of a toxic text among a few of its other words, and as few words of clean ones.
        lone = [(k, short) for k, s in enumerate(bad) for short in _lone(s, strings)]
        plain = [_few(s, b"") for s in good]
        x = self.landmarks.values([*sets, *[s for _, s in lone], *plain])
        y = np.r_[np.ones(2 * len(toxic)), -np.ones(len(clean)), np.ones(len(lone)), -np.ones(len(plain))]
        # Weights undo the sampling: the sigmoid gives the share of toxic texts among all labelled ones.
        own, other = n_toxic / len(toxic), n_clean / len(clean)
        weight = np.r_[
            np.full(len(toxic), own), np.full(len(toxic), DISGUISED * own), np.full(len(clean), other),
            np.full(len(lone), LONE * n_toxic / max(len(lone), 1)), np.full(len(plain), LONE * other),
        ]
        # A text and what is made of it are in one fold; the sigmoid sees values of machines that didn't see the text.
        t, c = np.arange(len(toxic)), np.arange(len(clean))
        fold = np.r_[t, t, c, np.array([k for k, _ in lone], int), c] % FOLDS
        even = weight / np.where(y > 0, weight[y > 0].sum(), weight[y < 0].sum())
        value = np.empty(len(y))
        norm = np.kron(np.eye(2), self.landmarks.gram)
        for k in range(FOLDS):
            own = fold == k
            w = machine(x[~own], y[~own], even[~own], norm)
            value[own] = x[own] @ w[:-1] + w[-1]
        self.w = machine(x, y, even, norm)
        real = np.zeros(len(y), bool)
        real[: len(toxic)] = real[2 * len(toxic) : 2 * len(toxic) + len(clean)] = True
        self.a, self.b = sigmoid_of(value[real], y[real], weight[real])

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.landmarks is None:
            return np.full(len(texts), self.share)
        s = self.landmarks.values([words_of_text(t) for t in texts]) @ self.w[:-1] + self.w[-1]
        return 1 / (1 + np.exp(-np.clip(self.a * s + self.b, -30, 30)))


def is_held_out(id_col: str, folds: int = 3, held: int = 1) -> Column:
    """Whether labels of a row are left alone: the CRC-32 of its id as text leaves the remainder ``held``."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == held


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit a model to the labels of rows that aren't held out. A text that is labelled twice is toxic if either says so."""
    known = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~is_held_out(id_col))
        .groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label"))
    )
    totals = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    order = F.xxhash64("id")
    # More ids than texts are wanted, as some have long texts; the bound stays a fixed one.
    picked = [
        known.where(F.col("label") == v).orderBy(order, "id").limit(2 * n).select("id", "label")
        for v, n in ((1, TOXIC_TEXTS), (0, CLEAN_TEXTS))
    ]
    sample = docs.sparkSession.createDataFrame([r for p in picked for r in p.collect()], picked[0].schema)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(
        F.coalesce(F.length("text"), F.lit(0)) <= SAMPLE_CHARS
    )
    rows = texts.join(F.broadcast(sample), "id").select("id", "label", "text")
    found: dict = {}
    for v, n in ((1, TOXIC_TEXTS), (0, CLEAN_TEXTS)):
        some = rows.where(F.col("label") == v).orderBy(order, "id", "text").limit(n).collect()
        found[v] = [r["text"] for r in some]
    return Model(found[1], found[0], totals.get(1, 0), totals.get(0, 0))


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """docs with ``out_col`` double, the probability that the text is toxic."""
    kept, schema = appended(docs, [(out_col, T.DoubleType())])
    names = kept.columns
    source = kept if text_col in names else docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col, BATCH_BYTES):
            found = model.scores(b.column(text_col).to_pylist())
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(found, pa.float64())], names=[*names, out_col])

    return source.mapInArrow(run, schema)
