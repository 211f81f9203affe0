"""Registered queries: name -> (Spark callable, DuckDB text or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.functions.text import simple_preprocess
from vectorloom.runtime import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        assert name not in QUERIES, name
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash a table by its unique key when its files give fewer tasks than there are cores.

    Small test files arrive as one split; a large table has thousands and passes through untouched.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, tokens) of the whole corpus."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return docs.select("doc_id", simple_preprocess(F.col("text")).alias("tokens"))


def r6(c, name: str):
    return F.round(c, 6).alias(name)


# ---- shared DuckDB fragments
def draw_sql(*keys, seed: int = 0) -> str:
    """`runtime.draw48` in SQL."""
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(map(str, keys))}, '{seed}')), 1, 12) AS BIGINT)"


def hash01_sql(*keys, seed: int = 0) -> str:
    return f"({draw_sql(*keys, seed=seed)} / 281474976710656.0::DOUBLE)"


def tok_sql(source: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    return (f"SELECT {key}, list_filter(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{Nl}}\\p{{No}}_]+'), "
            f"lambda t: length(t) BETWEEN 2 AND 15 AND t[1] <> '_') AS tokens FROM {source}")


TOK = f"tok AS ({tok_sql()})"
OCC = f"{TOK}, occ AS (SELECT doc_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) - 1 AS pos FROM tok)"
BOW = f"{OCC}, bow AS (SELECT doc_id, token, count(*) AS tf FROM occ GROUP BY ALL)"
VOCAB = (f"{BOW}, vocab AS (SELECT token, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf, "
         "row_number() OVER (ORDER BY count(*) DESC, token) - 1 AS term_id FROM bow GROUP BY token)")
