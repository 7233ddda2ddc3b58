"""Fill-in-the-middle: texts cut at unit bounds into prefix, middle and suffix, and put in another order."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import fresh, table

UNIT = regex.compile(r"[A-Za-z]+|[^A-Za-z]")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 documents, those left plain, and of the others those with the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20
SCHEMA = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string, restored_sha256 string"


def unit_ends(text: str) -> array:
    """Where each unit ends, in code points."""
    return array("Q" if len(text) > 0xFFFFFFFF else "I", (m.end() for m in UNIT.finditer(text)))


def draws(seed: str) -> list[int]:
    """Four numbers of 32 bits from a seed."""
    digest = hashlib.sha256(seed.encode()).hexdigest()
    return [int(digest[at : at + 8], 16) for at in (0, 8, 16, 24)]


def arrange(text: str, seed: str) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, prefix and middle characters, output) of a text."""
    ends = unit_ends(text)
    n = len(ends)
    a, b, plain, order = draws(seed)
    if not text or plain % 100 >= 100 - PLAIN or any(x in text for x in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    first, second = sorted((a % (n + 1), b % (n + 1)))
    at, to = (ends[k - 1] if k else 0 for k in (first, second))
    prefix, middle, suffix = text[:at], text[at:to], text[to:]
    if order % 100 < SUFFIX_FIRST:
        return n, "spm", at, to - at, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", at, to - at, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restore(output: str, form: str) -> str:
    """The text, from output and form alone: no part holds a mark, so the first of each is the one that was set."""
    if form == "plain":
        return output
    lead, mark = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    first, rest = output[len(lead) :].split(mark, 1)
    second, middle = rest.split(MIDDLE, 1)
    return f"{first}{middle}{second}" if form == "psm" else f"{second}{middle}{first}"


def fill_in_middle(docs: DataFrame, epoch: int = 1, texts: bool = True) -> DataFrame:
    """docs with n, form, prefix_chars, middle_chars, output (if texts), output_sha256 and restored_sha256.

    The cuts and the form depend on epoch and doc_id alone (seed `<epoch>:<doc_id>`, a null id being
    empty), so a new epoch cuts anew and a task that runs again gives the same. A null text is empty; an
    empty one is plain; equal rows get equal results; texts of any length are cut whole; an empty table
    gives an empty one. Columns of docs called like the added ones are replaced.
    """

    @pandas_udf(SCHEMA)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        for seeds, bodies in batches:
            rows = []
            for seed, text in zip(seeds, bodies, strict=True):
                n, form, prefix, middle, output = arrange(text, seed)
                rows.append((n, form, prefix, middle, output if texts else None, sha(output), sha(restore(output, form))))
            found = pd.DataFrame(rows, columns=NAMES)
            yield found.astype({"prefix_chars": "Int64", "middle_chars": "Int64", "n": "int64"})

    seed = F.concat(F.lit(f"{epoch}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    added = [x for x in NAMES if texts or x != "output"]
    kept = [c for c in docs.columns if c.lower() not in added]
    made = fresh(docs, "made")
    found = docs.withColumn(made, run(seed, F.coalesce("text", F.lit(""))))
    return found.select(*(F.col(f"`{c}`") for c in kept), *(F.col(made)[x].alias(x) for x in added))


NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's cut: units, form, lengths and digests of the output and of the text rebuilt from it.
    Null texts are empty and plain, equal rows get equal results and a row each, very long texts are cut
    whole, an empty table gives none."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return fill_in_middle(docs, texts=False).drop("text")


OP12_SQL = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
    sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d
  FROM documents),
drawn AS (
  SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n,
    CAST('0x' || substr(d, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(d, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(d, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(d, 25, 8) AS BIGINT) AS h4
  FROM cut),
parts AS (
  SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts
"""
