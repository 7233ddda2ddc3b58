"""Sinks: nested JSON events, Parquet tables and Markdown reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_json(df: DataFrame, key: str, digits: int = 4) -> DataFrame:
    """(key, json): each row as a document, doubles rounded, NaN as null."""
    values = [F.round(F.nanvl(c, F.lit(None).cast("double")), digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes]
    return df.select(key, F.to_json(F.struct(*values)).alias("json"))


def write_events(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """A Parquet table, partitioned if asked."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def markdown(df: DataFrame, columns: Sequence[str], most: int = 200) -> str:
    """A small result as a Markdown table: at most `most` rows come to the driver, and it says so."""
    rows = df.select(*columns).limit(most + 1).collect()
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    lines += ["| " + " | ".join("" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in rows[:most]]
    return "\n".join(lines + ["", f"(first {most} rows)"] * (len(rows) > most))
