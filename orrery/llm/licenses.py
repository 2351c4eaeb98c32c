"""License scan by ordered signature rules, in DataFrame functions only.

A text becomes its words: A-Z are lower-cased and runs of other ASCII than letters and digits part words. A rule is a regex over
words, gated by a keyword: a text is matched with the rules only whose keyword is one of its words, all found by one look-up of
its words among the keywords. Matches of a rule are found from left to right and don't overlap; those of different rules may.

A detection is suppressed if its words lie within those of another one that goes before: of a smaller priority, or of the same
priority and longer, or with the same words by an earlier rule. Base phrases are rules of priority 0 that nothing suppresses.
Suppression is a running maximum of the ends of what began before, per priority, over the detections in order of their
beginnings; so work grows with a text and its detections, never with pairs of them, and a text is never shuffled.

A null text is an empty one: no words and no detections. Ids play no part, so repeated and null ids are rows like others;
columns of docs that are named like the results are replaced.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_rules import RULES as _LINES

#: Words that start a rule's match, and the label it gives.
BASE = (("under the mit license", "mit", "mit"), ("apache license version 2", "apache-2", "apache"), ("cc by nc", "cc-by-nc", "nc"))
#: How sure a detection of each priority is.
SURE = (1.0, 1.0, 0.95, 0.9, 0.7, 0.3)
RULE_TYPE = "array<struct<at: int, priority: int, label: string, keyword: string, regex: string>>"
#: Values that a running result takes at a time.
CHUNK = 256

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: ASCII that parts words: all but letters and digits.
PARTING = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


class Rule(NamedTuple):
    priority: int
    label: str
    keyword: str
    regex: str


def parsed(lines: str = _LINES) -> list[Rule]:
    """The rules of ``priority | label | keyword | regex`` lines, after the base phrases."""
    found = [Rule(0, label, keyword, phrase) for phrase, label, keyword in BASE]
    for line in lines.strip().splitlines():
        priority, label, keyword, regex = (x.strip() for x in line.split(" | ", 3))
        if not 1 <= int(priority) < len(SURE) or not keyword.isalnum():
            raise ValueError(f"no rule: {line}")
        found.append(Rule(int(priority), label, keyword, regex))
    return found


def over_words(regex: str) -> str:
    """The regex over words as a regex over a text that has a space on each side of each word, so that matches share none."""
    return f" {regex.replace(' ', '  ')} "


def words(text: Column) -> Column:
    """The array of a text's words, lower-cased."""
    plain = F.translate(F.coalesce(text, F.lit("")), UPPER + PARTING, UPPER.lower() + " " * len(PARTING))
    return F.array_remove(F.split(plain, " "), "")


def running(values: Column, zero: Column, add: Callable[[Column, Column], Column], chunk: int | None = None) -> Column:
    """The running results of an array: of each value with all before it. ``add`` is associative.

    Arrays grow by copies, so they are built a chunk at a time: a chunk's own results, then those of chunks before it.
    """
    n = chunk or CHUNK

    def simple(v: Column, start: Column) -> Column:
        begin = F.struct(start.alias("at"), F.slice(F.array(start), 1, 0).alias("out"))

        def step(acc: Column, x: Column) -> Column:
            return F.transform(F.array(add(acc["at"], x)), lambda y: F.struct(y.alias("at"), F.concat(acc["out"], F.array(y)).alias("out")))[0]

        return F.aggregate(v, begin, step, lambda acc: acc["out"])

    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / n).cast("int")), lambda b: F.slice(values, b * n + 1, n))

    def chunked(parts: Column) -> Column:
        ends = F.transform(parts, lambda part: F.aggregate(part, zero, add))
        before = F.concat(F.array(zero), simple(ends, zero))
        return F.flatten(F.zip_with(parts, F.slice(before, 1, F.size(parts)), simple))

    return F.when(F.size(values) <= n, simple(values, zero)).otherwise(chunked(parts))


def _words_in(padded: Column) -> Column:
    """Words of a piece of the padded text: half its spaces."""
    return ((F.octet_length(padded) - F.octet_length(F.replace(padded, F.lit(" "), F.lit("")))) / 2).cast("int")


def _places(padded: Column, rule: Column) -> Column:
    """(first, last, priority, rule) of the matches of a rule, last being the word behind it."""
    both = F.struct(
        F.transform(F.regexp_extract_all(padded, rule["regex"], F.lit(0)), _words_in).alias("sizes"),
        F.transform(F.split(padded, rule["regex"], -1), _words_in).alias("gaps"),
    )

    def found(x: Column) -> Column:
        # A match begins where the one before it ends, and the gap between them.
        steps = F.zip_with(F.slice(x["gaps"], 1, F.size(x["sizes"])), F.concat(F.array(F.lit(0)), x["sizes"]), lambda g, s: g + F.coalesce(s, F.lit(0)))
        steps = F.slice(steps, 1, F.size(x["sizes"]))
        starts = running(steps, F.lit(0), lambda a, b: a + b)
        return F.zip_with(
            starts, x["sizes"],
            lambda at, n: F.struct(
                at.alias("first"), (-(at + n)).alias("minus_last"), rule["priority"].alias("priority"), rule["at"].alias("rule"), rule["label"].alias("label")
            ),
        )

    return F.transform(F.array(both), found)[0]


def scan(docs: DataFrame, text_col: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """docs with n_words and detections: an array of (first, last, priority, rule, label, kept) in order of their beginnings.

    first is a detection's first word, from 0, last its last one; rule is the rule's place in the list.
    """
    rules = parsed() if rules is None else rules
    table = [{"at": k, "regex": over_words(r.regex), **{n: getattr(r, n) for n in ("priority", "label", "keyword")}} for k, r in enumerate(rules)]
    # Constants, folded once: a table in a string takes one expression instead of thousands.
    listed = F.from_json(F.lit(json.dumps(table)), RULE_TYPE)
    keywords = F.from_json(F.lit(json.dumps(sorted({r.keyword for r in rules}))), "array<string>")
    own = [c for c in docs.columns if c.lower() not in ("n_words", "detections")]
    out = docs.select(*[F.col(f"`{c}`") for c in own], words(F.col(f"`{text_col}`")).alias("__words"))
    out = out.select(
        *[F.col(f"`{c}`") for c in own], F.size("__words").cast("long").alias("n_words"),
        F.array_intersect(keywords, F.col("__words")).alias("__keys"), F.col("__words"),
    )
    out = out.withColumn("__padded", F.when(F.size("__keys") > 0, F.concat(F.lit(" "), F.array_join("__words", "  "), F.lit(" ")))).drop("__words")
    asked = F.filter(listed, lambda r: F.array_contains(F.col("__keys"), r["keyword"]))
    matching = F.filter(asked, lambda r: F.rlike("__padded", r["regex"]))
    places = F.array_sort(F.flatten(F.transform(matching, lambda r: _places(F.col("__padded"), r))))
    none = F.slice(places, 1, 0)
    out = out.withColumn("__places", F.when(F.col("__padded").isNull(), none).otherwise(places)).drop("__padded", "__keys")

    def ends(d: Column) -> Column:
        return F.array(*[F.when(d["priority"] <= p, -d["minus_last"]).otherwise(-1) for p in range(len(SURE))])

    zero = F.array(*[F.lit(-1) for _ in SURE])
    reached = running(F.transform("__places", ends), zero, lambda a, b: F.zip_with(a, b, lambda x, y: F.greatest(x, y)))
    out = out.withColumn("__before", F.concat(F.array(zero), reached))

    def judged(d: Column, before: Column) -> Column:
        last = -d["minus_last"]
        return F.struct(
            d["first"].alias("first"), (last - 1).alias("last"), d["priority"].alias("priority"), d["rule"].alias("rule"), d["label"].alias("label"),
            ((d["priority"] == 0) | (F.get(before, d["priority"]) < last)).alias("kept"),
        )

    found = F.zip_with("__places", F.slice(F.col("__before"), F.lit(1), F.size("__places")), judged)
    return out.withColumn("detections", found).drop("__places", "__before")


def digest(scanned: DataFrame) -> DataFrame:
    """A scan with n_base, first_word, last_word, base_labels, labels and score instead of its detections.

    Labels are those of base phrases and of detections that aren't suppressed; the score is that of the surest of these.
    """
    base = F.filter("detections", lambda d: d["priority"] == 0)
    kept = F.filter("detections", lambda d: d["kept"])
    joined = lambda found: F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda d: d["label"]))), ",")
    sure = F.array(*[F.lit(x) for x in SURE])
    return scanned.select(
        "*", F.size(base).cast("long").alias("n_base"), F.array_min(F.transform(base, lambda d: d["first"])).cast("long").alias("first_word"),
        F.array_max(F.transform(base, lambda d: d["first"])).cast("long").alias("last_word"), joined(base).alias("base_labels"),
        joined(kept).alias("labels"), F.coalesce(F.array_max(F.transform(kept, lambda d: F.get(sure, d["priority"]))), F.lit(0.0)).alias("score"),
    ).drop("detections")
