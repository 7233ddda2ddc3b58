"""Removal of repeated line runs by prefix doubling over line ids, in DataFrame functions only.

The corpus is one sequence of lines, ordered by doc_id and line number; runs never cross
documents. Up: level 0 names every line by a hash of 128 bits, level j+1 names the 2**(j+1)
lines from a position on by the names of its two halves; only positions whose block occurs
twice or more are kept, which are the suffixes that share a common prefix of that length.

Down: the common-prefix intervals are descended. Suffixes that share their first `size` lines
are a group; at level j its members are told apart by their next 2**j lines. A suffix moves
down if an earlier one has the same lines, so in the end `size` is the longest prefix that
occurs earlier. The first member of each such subgroup stays behind as its representative
for shorter prefixes and also goes down as a mark that later suffixes are held against.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import remove, table, written

#: Words that a repeated run must hold to be deleted.
MIN_WORDS = 3
_DOC = ["_doc", "_text"]
_NAME = ["x", "y"]


def _keyed(docs: DataFrame) -> DataFrame:
    body = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns({"_doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)), "_text": F.xxhash64(body)})


def _named(*parts) -> dict:
    """Two 64-bit hashes as one name."""
    return {"x": F.xxhash64(*parts), "y": F.xxhash64(F.lit("other"), *parts)}


def _levels(docs: DataFrame) -> list[DataFrame]:
    """A table (_doc, _text, at, x, y, words) a level: the blocks of 2**level lines that occur twice or more."""
    lines = _keyed(docs).where("text IS NOT NULL").select(*_DOC, F.posexplode(F.split("text", "\n")).alias("at", "line"))
    blocks = lines.select(*_DOC, "at", *(c.alias(n) for n, c in _named("line").items()), F.regexp_count("line", F.lit(r"\S+")).alias("words"))
    blocks = written(blocks.distinct(), "line-blocks")
    out, n = [], 1
    while True:
        # Pre-aggregated map-side; written, as Spark splits the hot names of a join of two plain scans.
        names = written(blocks.groupBy(*_NAME).agg(F.count("*").alias("times")).where("times > 1").select(*_NAME), "line-names")
        alive = written(blocks.join(names, _NAME), "line-alive")
        remove(blocks)
        remove(names)
        if alive.isEmpty():
            return out
        out.append(alive)
        right = alive.select(*_DOC, (F.col("at") - n).alias("at"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("words").alias("words2"))
        both = alive.join(right, [*_DOC, "at"])
        names = {"x": F.xxhash64("x", "x2"), "y": F.xxhash64("y", "y2"), "words": F.col("words") + F.col("words2")}
        blocks = written(both.select(*_DOC, "at", *(c.alias(n) for n, c in names.items())), "line-blocks")
        n *= 2


def repeated_runs(docs: DataFrame) -> DataFrame:
    """(_doc, _text, at, size, words): for each line the longest run from it on that occurs earlier in the corpus."""
    levels = _levels(docs)
    if not levels:
        return docs.sparkSession.createDataFrame([], "_doc long, _text long, at int, size int, words int")
    states = levels[0].select(*_DOC, "at", F.lit(0).alias("size"), F.lit(0).alias("words"), F.lit(True).alias("real"), F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"))
    columns = states.columns
    place = F.struct(*_DOC, "at")
    done: list[DataFrame] = []
    for j in reversed(range(len(levels))):
        right = levels[j].select(*_DOC, F.col("at").alias("next"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("words").alias("more"))
        tried = states.withColumn("next", F.col("at") + F.col("size")).join(right, [*_DOC, "next"], "left").drop("next")
        # A name is that of lines alone: equal runs are put together from blocks of the same sizes.
        tried = tried.withColumns({"x2": F.when(F.col("x2").isNotNull(), F.xxhash64("x", "x2", "size")), "y2": F.when(F.col("x2").isNotNull(), F.xxhash64("y", "y2", "size"))})
        tried = written(tried, "line-tried")
        for old in (*done, *levels[j : j + 1] * (j > 0)):
            remove(old)
        longer = tried.where("x2 IS NOT NULL")
        groups = written(longer.groupBy("x2", "y2").agg(F.count("*").alias("times"), F.min(place).alias("first")).where("times > 1").select("x2", "y2", "first"), "line-groups")
        met = longer.join(groups, ["x2", "y2"], "left").withColumn("kind", F.when(F.col("first").isNull(), 0).when(F.col("first") == place, 1).otherwise(2))
        stay = F.struct(F.col("size"), F.col("words"), F.col("real"), F.col("x"), F.col("y"))
        down = lambda real: F.struct((F.col("size") + 2**j).alias("size"), (F.col("words") + F.col("more")).alias("words"), real.alias("real"), F.col("x2").alias("x"), F.col("y2").alias("y"))  # noqa: B023, E731
        to = F.when(F.col("kind") == 0, F.array(stay)).when(F.col("kind") == 1, F.array(stay, down(F.lit(False)))).otherwise(F.array(down(F.col("real"))))
        moved = met.select(*_DOC, "at", F.inline(to)).select(*columns)
        states = tried.where("x2 IS NULL").select(*columns).unionByName(moved)
        done = [tried, groups]
    return states.where(F.col("real") & (F.col("size") > 0)).select(*_DOC, "at", "size", "words")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with later copies of repeated line runs cut from text, and n_lines, n_removed (long).

    A line goes if it lies in a run of lines, of any length, that holds min_words words or more
    and occurs earlier, by (doc_id, line number). The first occurrence always stays, so no
    line vanishes from the corpus; shorter repeats stay unless a longer run has them.

    Null text stays null with 0 lines; a text is never dropped, a fully repeated one becomes
    empty. Rows that are equal in doc_id and text are one document and are cut alike; rows of
    one doc_id are ordered by a hash of their text; a null doc_id comes last. Other columns
    pass through, whatever they are called; columns called n_lines or n_removed are replaced.
    Very long texts are taken whole. An empty table gives an empty one.
    """
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    # The caller's columns travel in one struct, so that none can clash with a helper.
    docs = docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in columns)).alias("_row"))
    spans = repeated_runs(docs.select("doc_id", "text")).where(F.col("words") >= min_words).select(*_DOC, "at", (F.col("at") + F.col("size")).alias("stop"))
    # Each document's spans become maximal runs: a span starts one if none before reaches it.
    order = Window.partitionBy(*_DOC).orderBy("at")
    spans = spans.withColumn("reach", F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    spans = spans.withColumn("run", F.sum(F.when(F.col("at") <= F.col("reach"), 0).otherwise(1)).over(order))
    runs = spans.groupBy(*_DOC, "run").agg(F.min("at").alias("at"), F.max("stop").alias("stop"))
    # Written, as Spark splits the hot keys of a join of two plain scans.
    runs = written(runs.groupBy(*_DOC).agg(F.collect_list(F.struct("at", "stop")).alias("_runs")), "line-runs")

    rows = _keyed(docs).join(runs, _DOC, "left")
    cut = F.filter(F.split("text", "\n"), lambda _, k: ~F.exists("_runs", lambda r: (k >= r["at"]) & (k < r["stop"])))
    lost = F.aggregate("_runs", F.lit(0), lambda n, r: n + r["stop"] - r["at"])
    total = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n")))
    left = F.when(F.col("_runs").isNull(), F.col("text")).otherwise(F.array_join(cut, "\n"))
    kept = (left.alias(c) if c == "text" else F.col("_row").getField(c).alias(c) for c in columns)
    return rows.select(*kept, total.cast("long").alias("n_lines"), F.coalesce(lost, F.lit(0)).cast("long").alias("n_removed"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the remaining text, n_lines and n_removed of every document. Null texts stay null, empty ones empty; of equal
    rows the later ones lose what repeats; an empty table gives none."""
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: The same from the definition: the shortest stretches of lines with MIN_WORDS words, from each
#: line on and up to each line, as strings. A run with so many words that occurs earlier is
#: the union of those in it, and each of them occurs earlier too.
OP10_SQL = rf"""
WITH each AS (
  SELECT doc_id, k, body, len(regexp_extract_all(body, '\S+')) AS words
  FROM (SELECT doc_id, unnest(range(0, len(lines))) AS k, unnest(lines) AS body FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents) AS s) AS e),
upto AS (SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY k) AS c FROM each),
stretch AS (
  SELECT a.doc_id, a.k AS lo, min(b.k) AS hi FROM upto a JOIN upto b ON a.doc_id = b.doc_id AND b.k >= a.k AND b.c - a.c + a.words >= {MIN_WORDS} GROUP BY 1, 2
  UNION SELECT b.doc_id, max(a.k) AS lo, b.k AS hi FROM upto a JOIN upto b ON a.doc_id = b.doc_id AND b.k >= a.k AND b.c - a.c + a.words >= {MIN_WORDS} GROUP BY 1, 3),
whole AS (SELECT s.doc_id, s.lo, s.hi, string_agg(e.body, chr(10) ORDER BY e.k) AS body FROM stretch s JOIN each e ON e.doc_id = s.doc_id AND e.k BETWEEN s.lo AND s.hi GROUP BY 1, 2, 3),
seen AS (SELECT *, min((doc_id, lo)) OVER (PARTITION BY body) AS first FROM whole),
gone AS (SELECT DISTINCT doc_id, unnest(range(lo, hi + 1)) AS k FROM seen WHERE (doc_id, lo) <> first)
SELECT doc_id, coalesce(string_agg(body, chr(10) ORDER BY k) FILTER (WHERE gone.k IS NULL), '') AS text,
  count(*) AS n_lines, count(gone.k) AS n_removed
FROM each LEFT JOIN gone USING (doc_id, k) GROUP BY doc_id
"""
