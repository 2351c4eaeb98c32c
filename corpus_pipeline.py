"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing, and encoding of documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; a stage's rows are written as Parquet and read again as the
documents of the next one. Null texts count as empty; columns other than the documents' are left behind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import byte_bpe, line_dedup, mixing, quality, simhash
from orrery.llm.common import materialize, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A line on more than this share of a source's documents goes from all of them; lines that fewer share stay in one.
LINE_RATIO = 0.5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the risk-controlled cutoffs reject."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return quality.quality_rules(docs.select(*COLUMNS), labels).where("kept").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that most documents of their source have, and with shared passages in one of them."""
    clean = line_dedup.drop_shared(docs.select(*COLUMNS), "source", "text", LINE_RATIO)
    return clean.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose texts share five-word shingles to a similarity of 0.8 or more."""
    return simhash.without_near_duplicates(docs.select(*COLUMNS), shingle=5, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs.select(*COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the documents, checked by decoding them."""
    import public_tokenizers as P

    rules = P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN
    texts = docs.select("doc_id", "lang", "source", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
    decoded = byte_bpe.decode(byte_bpe.encode(texts, *rules, keep_text=False), *rules, digest_only=True)
    return decoded.select(
        "doc_id", "lang", "source", "n_tokens", "token_ids", F.sha2("token_ids", 256).alias("ids_sha256"),
        (F.col("decoded") == F.col("text_sha256")).alias("round_trip"),
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", drop_lines),
    ("simhash_near_dedup", near_dedup),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: No SQL gives the rows of the similarity and encoding stages; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
