"""Registered queries and their SQL twins, one key for each operator."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.market import FRAMES, FRAMES_SQL, NEEDS, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

TABLES = "region nation customer supplier part orders lineitem events documents benchmark labels conversations embeddings pages".split()
#: Functions that DuckDB calls otherwise.
_OTHER = {
    r"\bpercentile\(": "quantile_cont(",
    r"\bbround\(": "round_even(",
    r"\bcollect_list\(": "list(",
    r"date_format\((\w+), 'HH:mm'\)": r"strftime(\1, '%H:%M')",
    r"\bto_date\((\w+)\)": r"CAST(\1 AS DATE)",
    r"\brlike\(": "regexp_matches(",
    r"\bexplode\(sequence\(": "unnest(generate_series(",
    r"\bstartswith\(": "starts_with(",
    r"\bsize\(": "len(",
    r"\bunix_micros\(": "epoch_us(",
    r"\bdate_add\((\w+), (\w+)\)": r"CAST(\1 + INTERVAL (\2) DAY AS DATE)",
    r"\bweekday\((\w+)\)": r"(isodow(\1) - 1)",
    r"\bmicros\((\w+)\)": r"epoch_us(\1)",
}


def frames_of(text: str) -> list[str]:
    found = re.findall(r"\{(\w+)\}", text)
    return list(dict.fromkeys(found))


def with_frames(text: str, frames: list[str] | None = None) -> str:
    """DuckDB SQL with the frames' definitions in front; {name} stands for a frame."""
    frames = frames_of(text) if frames is None else frames
    needed: list[str] = []
    for f in frames:
        needed += [n for n in [*NEEDS.get(f, []), f] if n not in needed and n not in TABLES]
    heads = ", ".join(f"{n} AS ({FRAMES_SQL[n]})" for n in needed)
    text = re.sub(r"\{(\w+)\}", r"\1", text).strip()
    if not heads:
        return text
    deep = "RECURSIVE " if "RECURSIVE_" in text else ""
    text = text.replace("RECURSIVE_ ", "")
    rest = ", " + text[5:] if text.upper().startswith("WITH ") else " " + text
    return f"WITH {deep}{heads}{rest}"


def to_duckdb(text: str) -> str:
    for pattern, other in _OTHER.items():
        text = re.sub(pattern, other, text)
    return text


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return FRAMES[name](spark, sf_dir) if name in FRAMES else read(spark, sf_dir, name)


#: Result columns that are dates; both engines return them as text.
DATES = ("day", "effective", "start")


def undated(df: DataFrame) -> DataFrame:
    return df.withColumns({c: df[c].cast("string") for c, kind in df.dtypes if kind == "date"})


def outputs(text: str) -> str:
    """The select list of a text's outermost SELECT, without what stands in parentheses."""
    while (flat := re.sub(r"\([^()]*\)", " ", text)) != text:
        text = flat
    text = re.sub(r"\bCASE\b.*?\bEND\b", " ", text)
    return re.sub(r"\b[\w.]+\s+AS\s+(?=\w)", "", re.split(r"\bFROM\b", text[text.rindex("SELECT") + 6 :] if " UNION " not in text and "EXCEPT" not in text else text[text.index("SELECT") + 6 :])[0])


def sql(name: str, text: str, duck: str | None = None) -> None:
    """Register a query given as Spark SQL over {frames}; duck replaces the DuckDB form where it
    is more than a matter of names."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark_text = re.sub(r"\bmicros\((\w+)\)", r"unix_micros(CAST(\1 AS TIMESTAMP))", text)
        return undated(spark.sql(spark_text, **{f: frame(spark, sf_dir, f) for f in frames_of(text)}))

    QUERIES[name] = run
    found = with_frames(duck) if duck is not None else with_frames(to_duckdb(text))
    dates = [c for c in DATES if re.search(rf"\b{c}\b", outputs(text))]
    ORACLE_SQL[name] = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in dates)}) FROM ({found}) AS q" if dates else found


def query(name: str, oracle: str | None = None) -> Callable:
    """Register a DataFrame function of (spark, sf_dir), with DuckDB SQL over {frames}."""

    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if oracle is not None:
            ORACLE_SQL[name] = with_frames(oracle)
        return f

    return keep
