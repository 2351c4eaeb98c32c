"""Boilerplate lines by their frequency relative to a site.

A line's frequency in a group (a host, a source) is the number of pages of the group that contain it, however often,
divided by the pages of the group. Lines over ``ratio`` that stand on ``min_pages`` pages or more are dropped from all
pages of that group. Lines are compared after trimming spaces; blank lines are never boilerplate and stay.

What is shuffled is a group and a 128-bit hash for each line, counted on the map side first, so that neither a hot group
nor a hot line meets in one task. The boilerplate of a group has at most lines-per-page / ratio lines; it returns to the
pages by a broadcast if it is small, else by a join in which the pages of a hot group are dealt out. Texts are read twice and
not moved by the broadcast.

Documents, unlike pages, share passages with a small part of a group only: drop_shared has a cutoff for those, by the
length of the line, and leaves each such passage in one text.

A null group is a group; null texts have no lines and stay null; a page whose lines all go has the empty text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, left_join_split, materialize

#: Boilerplate lines up to which the table is broadcast (32 bytes each).
BROADCAST_LINES = 100_000
#: Pages of a group, or copies of a text, that meet in a task at most where boilerplate isn't broadcast.
HOT_PAGES = 20_000


def _key(line: Column) -> Column:
    """A hash of 128 bits."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(line, F.lit(1)).alias("b"))


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACES))


def boilerplate(pages: DataFrame, group_col: str, text_col: str, ratio: float, min_pages: int) -> DataFrame:
    """(group, keys): the hashes of the boilerplate lines of each group that has some."""
    lines = F.array_distinct(
        F.transform(F.filter(F.split(F.col(text_col), "\n"), lambda x: _trimmed(x) != ""), lambda x: _key(_trimmed(x)))
    )
    on_pages = pages.select(F.col(group_col).alias("group"), F.explode(lines).alias("key"))
    counts = on_pages.groupBy("group", "key").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    totals = pages.groupBy(F.col(group_col).alias("__group")).agg(F.count("*").alias("total"))
    found = counts.join(totals, F.col("group").eqNullSafe(F.col("__group"))).where(F.col("n") > ratio * F.col("total"))
    return found.groupBy("group").agg(F.collect_list("key").alias("keys"))


def drop_boilerplate(
    pages: DataFrame, group_col: str, text_col: str = "text", ratio: float = 0.5, min_pages: int = 4
) -> DataFrame:
    """pages with the text less its boilerplate, and n_lines, n_dropped (long; lines that aren't blank)."""
    found = materialize(boilerplate(pages, group_col, text_col, ratio, min_pages), "boilerplate").select(
        F.col("group").alias("__group"), F.col("keys").alias("__keys")
    )
    size = found.agg(F.sum(F.size("__keys"))).first()[0] or 0
    if size <= BROADCAST_LINES:
        joined = pages.join(F.broadcast(found), F.col(f"`{group_col}`").eqNullSafe(F.col("__group")), "left")
    else:
        joined = left_join_split(pages, found, [(group_col, "__group")], HOT_PAGES)
    lines = F.split(F.col(f"`{text_col}`"), "\n")
    bad = F.col("__keys")
    clean = F.when(bad.isNull(), lines).otherwise(
        F.filter(lines, lambda x: (_trimmed(x) == "") | ~F.array_contains(bad, _key(_trimmed(x))))
    )

    def solid(x: Column) -> Column:
        return F.coalesce(F.size(F.filter(x, lambda y: _trimmed(y) != "")), F.lit(0)).cast("long")

    kept = [c for c in pages.columns if c.lower() not in ("n_lines", "n_dropped")]
    marked = joined.select(*[F.col(f"`{c}`") for c in kept], lines.alias("__lines"), clean.alias("__clean"))
    n = F.when(F.col("__lines").isNull(), F.lit(0).cast("long")).otherwise(solid(F.col("__lines")))
    return marked.select(
        *[F.array_join("__clean", "\n").alias(c) if c == text_col else F.col(f"`{c}`") for c in kept],
        n.alias("n_lines"),
        (n - F.when(F.col("__clean").isNull(), F.lit(0).cast("long")).otherwise(solid(F.col("__clean")))).alias("n_dropped"),
    )


#: Lines of so many characters are passages if they are in PASSAGE_TEXTS different texts of a group; of fewer, down to
#: PHRASE_CHARS, if they are in more than PHRASE_ROOTS times the square root of the group's documents. Shorter ones say
#: too little to be told from chance.
PASSAGE_CHARS, PASSAGE_TEXTS = 100, 4
PHRASE_CHARS, PHRASE_ROOTS = 30, 2.0


def _keys_of_lines(docs: DataFrame, group_col: str, text_col: str) -> DataFrame:
    """(group, text, a, b, chars): a row for each document and different line that isn't blank; ``text`` is a hash."""
    solid = F.filter(F.transform(F.split(F.col(f"`{text_col}`"), "\n"), _trimmed), lambda x: x != "")
    lines = F.array_distinct(F.transform(solid, lambda x: F.struct(_key(x).alias("key"), F.length(x).alias("chars"))))
    rows = docs.select(F.col(f"`{group_col}`").alias("group"), F.xxhash64(f"`{text_col}`").alias("text"), F.explode(lines).alias("l"))
    return rows.select("group", "text", "l.key.a", "l.key.b", "l.chars")


def shared_lines(docs: DataFrame, group_col: str, text_col: str, ratio: float, min_pages: int = 4) -> DataFrame:
    """(group, a, b, keeper): lines to drop from a group's texts other than the keeper; from all if that is null.

    As boilerplate, lines on more than ``ratio`` of a group's documents have no keeper. Exact copies are one text of the
    counts below that: a document isn't boilerplate because it was copied.
    """
    by_text = _keys_of_lines(docs, group_col, text_col).groupBy("group", "text", "a", "b").agg(F.count("*").alias("n"), F.max("chars").alias("chars"))
    counts = by_text.groupBy("group", "a", "b").agg(
        F.sum("n").alias("n"), F.count("*").alias("texts"), F.min("text").alias("first"), F.max("chars").alias("chars")
    ).where(F.col("n") >= min(min_pages, PASSAGE_TEXTS))
    totals = docs.groupBy(F.col(f"`{group_col}`").alias("__group")).agg(F.count("*").alias("total"))
    joined = counts.join(totals, F.col("group").eqNullSafe(F.col("__group")))
    everywhere = (F.col("n") >= min_pages) & (F.col("n") > ratio * F.col("total"))
    passage = (F.col("chars") >= PASSAGE_CHARS) & (F.col("texts") >= PASSAGE_TEXTS)
    phrase = (F.col("chars") >= PHRASE_CHARS) & (F.col("texts") >= PASSAGE_TEXTS) & (F.col("texts") > PHRASE_ROOTS * F.sqrt("total"))
    return joined.where(everywhere | passage | phrase).select("group", "a", "b", F.when(~everywhere, F.col("first")).alias("keeper"))


def drop_shared(docs: DataFrame, group_col: str, text_col: str = "text", ratio: float = 0.5) -> DataFrame:
    """docs with the text less the lines of shared_lines; only texts that lose some are changed."""
    found = materialize(shared_lines(docs, group_col, text_col, ratio), "shared")
    found = F.broadcast(found) if found.count() <= BROADCAST_LINES else found
    lines = _keys_of_lines(docs, group_col, text_col).alias("l")
    on = F.col("l.group").eqNullSafe(F.col("f.group")) & (F.col("l.a") == F.col("f.a")) & (F.col("l.b") == F.col("f.b"))
    hits = lines.join(found.alias("f"), on).where(F.col("keeper").isNull() | (F.col("keeper") != F.col("l.text")))
    # The lines to drop follow from the group and the text, so documents need no id and copies stay copies.
    per_text = hits.groupBy(F.col("l.group").alias("__group"), F.col("l.text").alias("__text")).agg(
        F.collect_set(F.struct("l.a", "l.b")).alias("__keys")
    )
    per_text = materialize(per_text, "hits")
    size = per_text.agg(F.sum(F.size("__keys"))).first()[0] or 0
    hashed = docs.withColumn("__hash", F.xxhash64(f"`{text_col}`"))
    if size <= BROADCAST_LINES:
        same = F.col(f"`{group_col}`").eqNullSafe(F.col("__group")) & (F.col("__hash") == F.col("__text"))
        joined = hashed.join(F.broadcast(per_text), same, "left")
    else:
        joined = left_join_split(hashed, per_text, [(group_col, "__group"), ("__hash", "__text")], HOT_PAGES)
    bad, text = F.col("__keys"), F.col(f"`{text_col}`")
    kept = F.filter(F.split(text, "\n"), lambda x: (_trimmed(x) == "") | ~F.array_contains(bad, _key(_trimmed(x))))
    clean = F.when(bad.isNull(), text).otherwise(F.array_join(kept, "\n"))
    return joined.select(*[clean.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


#: Elements without text of their own, comments, and tags that end a line.
HIDDEN = r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->"
BREAKS = r"(?i)</?(p|div|li|ul|ol|h1|h2|h3|h4|h5|h6|br|hr|table|tr|td|th|article|section|nav|header|footer|title|head|body|html)([ \t\n][^>]*)?/?>"


def html_lines(html: Column) -> Column:
    """The text of a page with a line for each block element; tags go, entities stay as they are."""
    text = F.regexp_replace(F.regexp_replace(html, HIDDEN, "\n"), BREAKS, "\n")
    return F.regexp_replace(F.regexp_replace(text, "<[^>]*>", ""), r"[ \t\r\x0b\x0c]*\n[ \t\n\r\x0b\x0c]*", "\n")


def host_of(url: Column) -> Column:
    """The lower-case host without a leading www., null if there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:www\.)?([^/?#:]+)", 1)
    return F.nullif(host, F.lit(""))
