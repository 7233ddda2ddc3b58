"""Landed files: JSON pages and tapes that an ingestion job has written, and settings."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BAR_SCHEMA = "date STRING, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume DOUBLE"


def cache_key(endpoint: Column, params: Column) -> Column:
    """The name of an endpoint's landed file: its slug and 16 digits of a digest of the request."""
    slug = F.regexp_replace(endpoint, "[^A-Za-z0-9]+", "-")
    return F.concat(slug, F.lit("__"), F.substring(F.sha1(F.to_json(F.struct(endpoint.alias("endpoint"), params.alias("params")))), 1, 16), F.lit(".json"))


def landed_json(spark: SparkSession, path: str, schema: str = BAR_SCHEMA) -> DataFrame:
    """Rows of all JSON files under a glob; broken records and empty files give no row."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").option("multiLine", "true").json(path)


def first_pages(pages: DataFrame, page: str, size: int) -> DataFrame:
    """Rows of (…, page) up to and with the first short page: a paged scan's stop rule."""
    counts = pages.groupBy(page).agg(F.count("*").alias("n"))
    short = counts.where(F.col("n") < size).agg(F.min(page).alias("stop"))
    return pages.crossJoin(F.broadcast(short)).where(F.col("stop").isNull() | (F.col(page) <= F.col("stop"))).drop("stop")  # one row


def capabilities(responses: DataFrame) -> DataFrame:
    """(endpoint, available) from landed responses (endpoint, status): 402 and 403 mark it unavailable."""
    return responses.groupBy("endpoint").agg((~F.bool_or(F.col("status").isin(402, 403))).alias("available"))


def dedup_bars(rows: DataFrame, order: str) -> DataFrame:
    """The first row of each (symbol, ts) in source order."""
    w = Window.partitionBy("symbol", "ts").orderBy(order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


@dataclass(frozen=True)
class Settings:
    """Thresholds of an investigation; from_dict takes a parsed YAML or JSON document."""

    ret_z: float = 4.0
    vol_z: float = 5.0
    vol_z_ret_min: float = 2.0
    merge_gap_minutes: int = 15
    vwap_sigma: float = 2.0
    gap_z: float = 2.5
    day_z: float = 2.0
    max_iters: int = 5
    confidence: float = 0.70
    benchmarks: tuple[str, ...] = field(default_factory=tuple)

    @classmethod
    def from_dict(cls, values: dict) -> Settings:
        return cls(**{f.name: values[f.name] for f in fields(cls) if f.name in values})
