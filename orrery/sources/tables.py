"""Readers and writers of panels, with declared schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.facts import FACTS
from ..operators.panels import upserted
from . import versions

SCHEMAS = {
    "universe": "ticker string, cik bigint, company_name string, sic int, naics string, exchange string, tier string, sector_code string, expected_rho int, first_10k_date date, last_10k_date date, n_pre_shock_quarters int, consumer_flag boolean",
    "financial": "ticker string, cik bigint, period_end date, fiscal_quarter int, fiscal_year int, metric string, value double",
    "rpo": "ticker string, cik bigint, period_end date, fiscal_quarter int, fiscal_year int, rpo_value double, tag_used string",
    "billings": "ticker string, cik bigint, period_end date, fiscal_quarter int, fiscal_year int, revenue double, rpo_value double, rpo_delta double, billings double",
    "margins": "ticker string, cik bigint, period_end date, fiscal_quarter int, fiscal_year int, metric string, value double, value_winsorized double",
}


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",", columns: list[str] | None = None, index: bool = False) -> DataFrame:
    """A delimited file with a header; ``columns`` prunes at the scan. With ``index`` its first column is a row's number and is dropped."""
    declared = SCHEMAS.get(schema, schema)
    df = spark.read.schema(f"__index string, {declared}" if index else declared).option("header", True).option("sep", sep).csv(path)
    df = df.drop("__index")
    return df.select(*columns) if columns else df


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """Company facts, a JSON value in each file; files that can't be parsed have _corrupt_record."""
    schema = T.StructType([*FACTS.fields, T.StructField("_corrupt_record", T.StringType())])
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return rows.select("*", F.col("_metadata.file_path").alias("path"))


def facts_status(requested: DataFrame, facts: DataFrame, key: str = "ticker") -> DataFrame:
    """(key, status) of requested keys: ok, cache_read_error where the key's file isn't company facts, no_cache where there is none.

    ``facts`` is what read_facts gives, with the ``path`` of each file; a file is named after its key.
    """
    named = facts.select(
        F.regexp_extract("path", r"([^/]+?)\.json$", 1).alias("__of"),
        (F.col("_corrupt_record").isNull() & (F.col("cik").isNotNull() | F.col("facts").isNotNull())).cast("int").alias("good"),
    )
    per = named.groupBy("__of").agg(F.max("good").alias("good"))
    status = F.when(F.col("good").isNull(), "no_cache").when(F.col("good") == 1, "ok").otherwise("cache_read_error")
    return requested.select(key).join(per, F.col(key) == F.col("__of"), "left").select(key, status.alias("status"))


def read_config(path: str) -> dict:
    """A small configuration file of nested lists and mappings, read on the driver."""
    import yaml

    with open(path, encoding="utf-8") as f:
        found = yaml.safe_load(f)
    if not isinstance(found, dict):
        raise ValueError(f"{path} is no mapping")
    return found


def lexicon_terms(config: dict) -> tuple[tuple[str, str], ...]:
    """(pattern, category) of the terms of a lexicon, for ``lexicon.counted``; a term without either is an error."""
    return tuple((t["pattern"], t["category"]) for t in config["inclusion_terms"])


def listed_tickers(spark: SparkSession, config: dict) -> DataFrame:
    """(ticker, tier, sector, expected_rho, company) of the lists ``<tier>_tickers``; of a ticker in two the first list's."""
    rows = {}
    for name, entries in config.items():
        if name.endswith("_tickers"):
            for e in entries or []:
                rows.setdefault(e["ticker"], (e["ticker"], name.removesuffix("_tickers"), e.get("sector"), e.get("expected_rho"), e.get("company")))
    return spark.createDataFrame(list(rows.values()), "ticker string, tier string, sector string, expected_rho int, company string")


def universe_rules(config: dict) -> dict:
    """The filters of a universe: software_sic, exchanges in upper case, least quarters, and excluded tickers."""
    return {
        "software_sic": config["tiers"]["primary_software"]["sic_codes"],
        "exchanges": tuple(x.upper() for x in config["exchanges"]),
        "min_quarters": config["min_pre_shock_quarters"],
        "excluded": tuple(e["ticker"] for e in config.get("exclusions", [])),
    }


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    """A ticker directory of column names and rows of values, as rows; of each cik the first."""
    raw = spark.read.schema("fields array<string>, data array<array<string>>").option("multiLine", True).json(path)
    rows = raw.select("fields", F.posexplode("data").alias("pos", "r"))
    at = lambda name: F.try_element_at("r", F.array_position("fields", F.lit(name)).cast("int"))
    flat = rows.select("pos", at("cik").cast("bigint").alias("cik"), at("name").alias("name"), at("ticker").alias("ticker"), at("exchange").alias("exchange"))
    return flat.groupBy("cik").agg(*[F.min_by(c, "pos").alias(c) for c in ("name", "ticker", "exchange")])


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def write_sorted_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """One sorted file with a header, for people; tables for machines are Parquet."""
    df.orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def append_csv(df: DataFrame, path: str) -> None:
    """Add rows to a folder of delimited files, each of which has the header once; the first write makes the folder."""
    df.write.mode("append").option("header", True).csv(path)


def replace_json(df: DataFrame, path: str) -> None:
    """Make df the records at ``path``, whole: readers find the old ones or the new ones, at any moment (see ``versions``)."""
    versions.replace(df, path, "json")


def read_records(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The records at ``path`` as they stand; a plain folder of JSON lines is read as it is."""
    if versions.current(spark, path) is None and versions.exists(spark, path):
        return spark.read.schema(schema).json(path)
    return versions.read(spark, path, schema)


def merge_records(new: DataFrame, path: str, key: str) -> None:
    """The records at ``path`` less those of the new keys, and the new ones, in the place of the old."""
    replace_json(upserted(read_records(new.sparkSession, path, new.schema), new, [key]), path)


def write_marked(df: DataFrame, path: str, key: str, text_col: str = "text") -> None:
    """A text file for each key, in a folder ``key=...``; ``filings.marked_text`` makes such texts."""
    df.select(key, F.col(text_col).alias("value")).repartition(key).write.mode("overwrite").partitionBy(key).text(path)


def write_lines(df: DataFrame, path: str, mode: str = "append") -> None:
    """A JSON object in each line."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode(mode).text(path)


def upsert_parquet(new: DataFrame, path: str, keys: list[str], out: str) -> None:
    """Write to ``out`` the table at ``path`` with the rows of the new keys replaced; paths differ, as one is read."""
    if path == out:
        raise ValueError("a table can't be read and overwritten at once")
    upserted(new.sparkSession.read.parquet(path), new, keys).write.mode("overwrite").parquet(out)


def land_missing(spark: SparkSession, requested: DataFrame, path: str, key: str, fetch) -> DataFrame:
    """A read-through store: keys that the table at ``path`` lacks are fetched, by fetch(DataFrame), and appended."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    missing = requested.join(spark.read.parquet(path).select(key), key, "left_anti") if there else requested
    fetch(missing).write.mode("append").parquet(path)
    return spark.read.parquet(path).join(requested.select(key), key, "left_semi")
