"""The queries of phrase mining, license scans and ranked search, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import collocations, lexical_search, licenses
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


_RULES_SQL = ",\n  ".join(
    f"({at}, {r.priority}, '{r.label}', '{r.keyword}', '{licenses.over_words(r.regex)}')" for at, r in enumerate(licenses.parsed())
)
_SURE_SQL = "[" + ", ".join(f"CAST({x} AS DOUBLE)" for x in licenses.SURE) + "]"

OP12_SQL = rf"""
WITH rules(rule, priority, label, keyword, re) AS (VALUES {_RULES_SQL}),
texts AS (SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
padded AS (SELECT rid, w, ' ' || array_to_string(w, '  ') || ' ' AS p FROM texts),
asked AS (SELECT rid, p, rules.* FROM (SELECT rid, p, unnest(list_distinct(w)) AS word FROM padded) t JOIN rules ON rules.keyword = t.word),
pieces AS (SELECT rid, rule, priority, label, regexp_extract_all(p, re) AS m, regexp_split_to_array(p, re) AS g FROM asked),
sizes AS (SELECT rid, rule, priority, label,
    list_transform(m, lambda x: (length(x) - length(replace(x, ' ', ''))) // 2) AS m,
    list_transform(g, lambda x: (length(x) - length(replace(x, ' ', ''))) // 2) AS g FROM pieces WHERE len(m) > 0),
each AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM sizes),
found AS (SELECT rid, rule, priority, label, CAST(list_sum(g[1 : i]) + coalesce(list_sum(m[1 : i - 1]), 0) AS BIGINT) AS first, m[i] AS n FROM each),
marked AS (SELECT *, priority = 0 OR NOT EXISTS (SELECT 1 FROM found b WHERE b.rid = a.rid AND b.priority <= a.priority
      AND b.first <= a.first AND b.first + b.n >= a.first + a.n
      AND (b.n > a.n OR b.priority < a.priority OR b.rule < a.rule)) AS kept FROM found a),
per AS (SELECT rid, count(*) FILTER (priority = 0) AS n_base, min(first) FILTER (priority = 0) AS first_word,
    max(first) FILTER (priority = 0) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (priority = 0) AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (kept) AS labels,
    max({_SURE_SQL}[priority + 1]) FILTER (kept) AS score FROM marked GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM texts LEFT JOIN per ON per.rid = texts.rid
"""


@query("op12_license_scan", OP12_SQL)
def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base phrases, labels and score of every text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.digest(licenses.scan(docs)).drop("text")


_TERMS_SQL = (
    "regexp_extract_all(translate(coalesce(text, ''), '{u}', '{l}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
).format(u=licenses.UPPER, l=licenses.UPPER.lower())

OP13_SQL = rf"""
WITH texts AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS_SQL} AS w FROM documents),
sizes AS (SELECT rid, doc_id, CAST(len(w) AS BIGINT) AS n FROM texts WHERE len(w) > 0),
corpus AS (SELECT count(*) AS n, CAST(sum(n) AS BIGINT) AS l FROM sizes),
tf AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(w) AS term FROM texts) GROUP BY ALL),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS_SQL}) AS term FROM benchmark) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM df, corpus),
m AS (SELECT rid, doc_id, 75 + (25 * sizes.n * corpus.n) // l AS m FROM sizes, corpus),
scores AS (SELECT item_id, doc_id, tf.rid, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM asked JOIN tf ON tf.term = asked.term JOIN weights ON weights.term = tf.term JOIN m ON m.rid = tf.rid GROUP BY ALL),
best AS (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM best WHERE rank <= 20
"""


@query("op13_ranked_search", OP13_SQL)
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of each benchmark item."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lexical_search.ranked(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


OP11_SQL = rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.UPPER.lower()}'),
    '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
split AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase
  FROM split, range(1, {collocations.LONGEST + 1}) r(k)),
f AS (SELECT lang, k, phrase, CAST(count(*) AS BIGINT) AS a FROM grams GROUP BY ALL HAVING count(*) >= {collocations.LEAST}),
sizes AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM split GROUP BY lang),
cuts AS (SELECT lang, k, phrase, a, cut, array_to_string(string_split(phrase, ' ')[1 : cut], ' ') AS first,
    array_to_string(string_split(phrase, ' ')[cut + 1 :], ' ') AS rest FROM f, range(1, {collocations.LONGEST}) r(cut) WHERE cut < k),
valued AS (SELECT cuts.lang, cuts.k, cuts.phrase, cuts.a, cut, x.a AS l, y.a AS r,
    CAST(CAST({collocations.SCALE} AS HUGEINT) * cuts.a // (x.a + y.a) AS BIGINT) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = cuts.first JOIN f y ON y.lang = cuts.lang AND y.phrase = cuts.rest),
scored AS (SELECT * FROM valued QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
kept AS (SELECT * FROM scored s WHERE NOT EXISTS (SELECT 1 FROM scored t WHERE t.lang = s.lang AND t.k > s.k
    AND contains(' ' || t.phrase || ' ', ' ' || s.phrase || ' ') AND 100 * t.a >= {collocations.NEAR} * s.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT ranked.lang, rank, phrase, a, l, r, n, score FROM ranked JOIN sizes ON sizes.lang = ranked.lang WHERE rank <= 2000
"""


@query("op11_collocations", OP11_SQL)
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's best phrases of two to four words."""
    return collocations.mined(table(spark, sf_dir, "documents").select("lang", "text"))
