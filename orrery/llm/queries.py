"""The queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, corpus_queries, huffman, katz, line_dedup, mixing, prefix_hash, quality, revisits, simhash, toxicity
from .common import materialize, scratch_path, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = dict(corpus_queries.QUERIES)
ORACLES: dict[str, str] = dict(corpus_queries.ORACLES)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("op4_byte_bpe")
def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes of every text, as digests."""
    import public_tokenizers as P

    rules = P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = byte_bpe.encode(docs, *rules, keep_text=False)
    return byte_bpe.decode(ids, *rules).select(
        "doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


_LADDERS_SQL = ", ".join(
    f"('{rule}', {at}, CAST({cut} AS DOUBLE))" for rule, cuts in quality.LADDERS.items() for at, cut in enumerate(cuts)
)
_SHARE, _LEVEL = quality.ALPHA / len(quality.LADDERS), quality.DELTA / len(quality.LADDERS)

OP9_SQL = rf"""
WITH texts AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text FROM documents),
split AS (SELECT *, list_filter(regexp_split_to_array(text, '[ \t\n\x0b\x0c\r]+'), lambda x: x <> '') AS w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0b\x0c\r]')) AS l FROM texts),
places AS (SELECT rid, unnest(range(1, len(w) - 3)) AS i, w FROM split WHERE len(w) >= 5),
windows AS (SELECT rid, i, array_to_string(w[i : i + 4], ' ') AS five FROM places),
twice AS (SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY rid, five) > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, range(5) AS r(k) GROUP BY rid),
measured AS (SELECT split.rid, doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(length(text) - length(replace(text, '!', '')) AS BIGINT) AS n_exclaims, len(l) AS n_lines,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
  FROM split LEFT JOIN covered ON covered.rid = split.rid),
based AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM measured),
valued AS (SELECT rid, doc_id, lang, base_failed, unnest(['symbol_ratio', 'exclaim_ratio', 'dup_line_ratio', 'word_length']) AS rule,
    unnest([n_symbols / nullif(word_chars, 0), n_exclaims / nullif(word_chars, 0), n_dup_lines / nullif(n_lines, 0), word_chars / nullif(n_words, 0)]) AS value FROM based),
good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1),
held AS (SELECT valued.* FROM valued JOIN good ON valued.doc_id = good.doc_id WHERE NOT base_failed),
ladder(rule, step, cut) AS (VALUES {_LADDERS_SQL}),
tried AS (SELECT lang, held.rule, step, cut, count(*) AS n, count(*) FILTER (value >= cut) AS k, (SELECT count(*) FROM (SELECT DISTINCT lang FROM held)) AS strata
  FROM held JOIN ladder ON held.rule = ladder.rule GROUP BY ALL),
tested AS (SELECT *, k < n * {_SHARE} AND list_sum(list_transform(range(0, k + 1), lambda i:
    exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({_SHARE}) + (n - i) * ln(1 - {_SHARE})))) <= {_LEVEL} / strata AS passed FROM tried),
taken AS (SELECT lang, rule, min(cut) AS cut FROM (SELECT *, bool_and(passed) OVER (PARTITION BY lang, rule ORDER BY step) AS ok FROM tested) WHERE ok GROUP BY ALL),
rejected AS (SELECT DISTINCT rid FROM valued JOIN taken ON valued.rule = taken.rule AND valued.lang IS NOT DISTINCT FROM taken.lang WHERE value >= cut)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT EXISTS (SELECT 1 FROM rejected WHERE rejected.rid = based.rid) AS kept
FROM based
"""


@query("op9_quality_rules", OP9_SQL)
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return quality.quality_verdicts(docs, labels).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query("op6_simhash_near_dedup")
def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = materialize(simhash.fingerprints(docs).select("doc_id", "fingerprint"), "marked")
    return simhash.near_duplicates(marked).select(
        "doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id"
    )


@query("op1_prefix_fingerprints")
def op1_prefix_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return prefix_hash.fingerprint_pairs(docs).select(
        "doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint", "near_edited", "near_next",
    )


@query("op7_mixing_pivotal")
def op7_mixing_pivotal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


_SP = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP8_SQL = rf"""
WITH lines AS (
  SELECT page_id,
    nullif(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:www\.)?([^/?#:]+)', 1), '') AS host,
    string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
      '{line_dedup.HIDDEN}', chr(10), 'g'), '{line_dedup.BREAKS}', chr(10), 'g'), '<[^>]*>', '', 'g'),
      '[ \t\r\x0b\x0c]*\n[ \t\n\r\x0b\x0c]*', chr(10), 'g'), chr(10)) AS ls
  FROM pages),
solid AS (SELECT page_id, host, ls,
    list_filter(list_transform(ls, lambda x: trim(x, {_SP})), lambda x: x <> '') AS ts FROM lines),
each AS (SELECT host, unnest(list_distinct(ts)) AS line FROM solid),
total AS (SELECT host, count(*) AS n FROM solid GROUP BY host),
bad AS (SELECT each.host, list(each.line) AS bad FROM
    (SELECT host, line, count(*) AS k FROM each GROUP BY ALL) each JOIN total ON each.host IS NOT DISTINCT FROM total.host
    WHERE k >= 4 AND k > 0.5 * n GROUP BY each.host),
clean AS (SELECT page_id, solid.host, ls, ts, CASE WHEN bad IS NULL THEN ls ELSE
    list_filter(ls, lambda x: NOT list_contains(bad, trim(x, {_SP})) OR trim(x, {_SP}) = '') END AS cs
  FROM solid LEFT JOIN bad ON solid.host IS NOT DISTINCT FROM bad.host)
SELECT page_id, host, CAST(len(ts) AS BIGINT) AS n_lines,
  CAST(len(ts) - len(list_filter(cs, lambda x: trim(x, {_SP}) <> '')) AS BIGINT) AS n_dropped,
  CAST(length(array_to_string(cs, chr(10))) AS BIGINT) AS text_chars, md5(array_to_string(cs, chr(10))) AS text_md5
FROM clean
"""


@query("op8_line_dedup", OP8_SQL)
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's lines without its host's boilerplate."""
    pages = table(spark, sf_dir, "pages").select(
        "page_id", line_dedup.host_of(F.col("url")).alias("host"), line_dedup.html_lines(F.col("html")).alias("text")
    )
    return line_dedup.drop_boilerplate(pages, "host", "text").select(
        "page_id", "host", "n_lines", "n_dropped",
        F.length("text").cast("long").alias("text_chars"), F.md5("text").alias("text_md5"),
    )


def _captures(pages: DataFrame) -> DataFrame:
    """Archive records of the pages: a response for each, and revisits before and after it, of differing validators."""
    digest = F.md5("html")
    k = F.col("page_id") % 5
    modified = F.concat(F.lit("day "), (F.col("page_id") % 97).cast("string"))

    def record(offset: int, kind: str, url, etag, last_modified, headers):
        return F.struct(
            (F.col("page_id") * 3 + offset).alias("record_id"), url.alias("url"), (F.col("page_id") * 10 + [5, 0, 8][offset]).alias("ts"),
            F.lit(kind).alias("kind"), etag.cast("string").alias("etag"), last_modified.cast("string").alias("last_modified"),
            headers.alias("headers"), (digest if kind == "response" else F.lit(None).cast("string")).alias("digest"),
        )

    day = F.concat(F.lit("t"), F.col("page_id").cast("string"))
    stored = F.create_map(
        F.lit("Content-Type"), F.lit("text/html"), F.lit("Cache-Control"), F.lit("max-age=60"), F.lit("Date"), day
    )
    renewed = F.create_map(
        F.lit("content-type"), F.lit("ignored"), F.lit("CACHE-CONTROL"), F.lit("no-cache"), F.lit("Date"), F.concat(day, F.lit("+"))
    )
    tag = F.when(k.isin(0, 4), F.concat(F.lit("W/"), digest)).when(k == 2, F.lit("other"))
    since = F.when(k != 3, modified)
    other = F.concat(F.lit("HTTPS://"), F.regexp_replace("url", "^[a-z]+://", ""))
    return pages.select(
        F.explode(
            F.array(
                record(0, "response", F.col("url"), digest, modified, stored),
                record(1, "revisit", other, tag, since, renewed),
                record(2, "revisit", other, tag, since, renewed),
            )
        ).alias("r")
    ).select("r.*")


OP10_SQL = r"""
WITH base AS (SELECT page_id, md5(html) AS digest, page_id % 5 AS k, 'day ' || (page_id % 97) AS modified,
    regexp_replace(regexp_replace(trim(url, ' '), '#.*$', ''), '^(?i)[a-z][a-z0-9+.-]*://(www\.)?', '') AS rest FROM pages),
canon AS (SELECT *, regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), ':(80|443)$', '')
    || regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(rest, '^[^/?]*', ''),
      '(?i)([?&])(utm_[a-z]+|ref)=[^&]*', '\1', 'g'), '&+', '&', 'g'), '\?&', '?', 'g'), '[?&]+$', ''), '/$', '') AS canonical_url FROM base),
full_ AS (SELECT canonical_url, page_id * 10 + 5 AS ts, page_id * 3 AS record_id, page_id, digest, modified FROM canon),
revisit AS (SELECT canonical_url, page_id, page_id * 10 + o.d AS ts, page_id * 3 + o.o AS record_id,
    CASE WHEN k IN (0, 4) THEN digest WHEN k = 2 THEN 'other' END AS etag, CASE WHEN k <> 3 THEN modified END AS modified
  FROM canon, (VALUES (1, 0), (2, 8)) o(o, d)),
found AS (SELECT r.*, f.record_id AS to_id, f.digest AS to_digest, f.modified AS to_modified, f.page_id AS to_page
  FROM revisit r ASOF LEFT JOIN full_ f ON r.canonical_url = f.canonical_url AND r.ts > f.ts),
judged AS (SELECT *, CASE WHEN to_id IS NULL THEN 'no_earlier_response' WHEN etag IS NULL AND modified IS NULL THEN 'no_validator'
    WHEN (etag IS NOT NULL AND etag = to_digest) OR (etag IS NULL AND modified = to_modified) THEN 'resolved'
    ELSE 'validator_mismatch' END AS status FROM found)
SELECT record_id, canonical_url, ts, status, CASE WHEN status = 'resolved' THEN to_id END AS refers_to,
  CASE WHEN status = 'resolved' THEN to_digest END AS digest,
  CASE WHEN status = 'resolved' THEN 'text/html' END AS content_type,
  CASE WHEN status = 'resolved' THEN 'no-cache' END AS cache_control,
  CASE WHEN status = 'resolved' THEN 't' || page_id || '+' END AS date_header
FROM judged
""".replace("\\\\", "\\")


@query("op10_warc_revisits", OP10_SQL)
def op10_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every revisit among the captures of the pages, with the response that it confirms and its merged headers."""
    found = revisits.resolve(_captures(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    header = lambda name: F.try_element_at("headers", F.lit(name))
    return found.select(
        "record_id", "canonical_url", "ts", "status", "refers_to", "digest", header("content-type").alias("content_type"),
        header("cache-control").alias("cache_control"), header("date").alias("date_header"),
    )


@query("op2_katz_backoff")
def op2_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model score of every text."""
    return katz.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op5_token_huffman")
def op5_token_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, written in the block format and read back."""
    import public_tokenizers as P

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = scratch_path(spark, "tokens")
    huffman.write(huffman.token_ids(docs, P.path("word_bpe_49k.json"), end=2), path)
    return huffman.read(spark, path).select(
        F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


@query("op3_toxicity_kernel")
def op3_toxicity_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of toxicity of every text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.is_held_out("doc_id").alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline over the documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
