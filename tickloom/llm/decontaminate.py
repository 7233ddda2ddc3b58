"""Benchmark decontamination by pigeonhole pieces and bit-parallel edit distance.

Texts are compared as lower-case words joined by single spaces. An item of m characters may
be met with k = m // 20 edits. Cut into k + 1 pieces, at least one piece must occur
unchanged; an automaton finds all piece hits of all items in one pass over a text, and each
hit's surroundings are verified with Myers' bit-parallel distance.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sliced, table

#: An item may differ in one of so many characters.
CHARS_AN_EDIT = 20
#: Shorter items (in normalised characters) have no edit to spare: they are met exactly, at word boundaries.
LEAST_CHARS = CHARS_AN_EDIT
#: UTF-8 bytes of items that one pass over the documents looks for; larger tables take more passes.
PASS_BYTES = 32 << 20
_GAP = re.compile(r"[\W_]+")


def normalised(text: str | None) -> str:
    return _GAP.sub(" ", (text or "").lower()).strip()


def pieces(item: str) -> list[tuple[int, str]]:
    """(offset, piece): error budget plus one pieces of about equal length."""
    n = len(item) // CHARS_AN_EDIT + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def masks(item: str) -> dict[str, int]:
    """For each character the bits of its places in the item."""
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


def distance(item: dict[str, int], m: int, text: str) -> int:
    """The least edit distance of the item to any substring of text, by Myers' recurrence."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    for c in text:
        eq = item.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best = score
        ph = ph << 1  # a match may start anywhere: no carry into the first row
        pv = (mh << 1 | ~(xv | ph)) & full
        mv = ph & xv & full
    return best


class Matcher:
    """All items' pieces in one automaton."""

    def __init__(self, items: list[tuple[int, str]]):
        import ahocorasick

        self.items = [(key, text, masks(text), len(text) // CHARS_AN_EDIT if len(text) >= LEAST_CHARS else 0) for key, text in items]
        at: dict[str, list[tuple[int, int]]] = {}
        for i, (_, text) in enumerate(items):
            for offset, piece in pieces(text) if len(text) >= LEAST_CHARS else [(0, text)]:
                at.setdefault(piece, []).append((i, offset + len(piece) - 1))
        self.pieces = ahocorasick.Automaton()
        for piece, places in at.items():
            self.pieces.add_word(piece, places)
        if at:
            self.pieces.make_automaton()
        self.empty = not at

    def found(self, text: str) -> dict[int, int]:
        """{item: distance} of the items that the normalised text has within their budget."""
        best: dict[int, int] = {}
        if self.empty:
            return best
        tried: dict[int, int] = {}
        for end, places in self.pieces.iter(text):
            for i, offset in places:
                _, item, mask, k = self.items[i]
                start = end - offset
                if len(item) < LEAST_CHARS:
                    if text[max(0, start - 1) : start].strip() == "" == text[end + 1 : end + 2].strip():
                        best[i] = 0
                    continue
                if best.get(i) == 0 or 0 <= start - tried.get(i, start + 1) <= k:
                    continue
                if text.startswith(item, max(start, 0)):
                    best[i] = 0
                    continue
                # Wide enough to hold also what hits that start up to k later could show.
                tried[i] = start
                d = distance(mask, len(item), text[max(0, start - k) : start + len(item) + 3 * k])
                if d <= min(k, best.get(i, k)):
                    best[i] = d
        return best


def _passes(spark: SparkSession, benchmark: DataFrame) -> Iterator:
    """Broadcast items [(item_id, normalised text)], PASS_BYTES of the benchmark at a time."""
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = size // PASS_BYTES + 1
    for part in range(n):
        share = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == part) if n > 1 else benchmark
        items = [(r["item_id"], t) for r in share.select("item_id", "text").collect() if (t := normalised(r["text"]))]
        yield spark.sparkContext.broadcast(items)


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, distance) of every item that a document holds within the item's budget.

    docs has doc_id, text; benchmark item_id, text. Null and empty texts match nothing, items
    under LEAST_CHARS normalised characters are met only as whole words without an edit, equal items are all reported, and
    repeated rows of either side report their matches again. Items reach the executors as
    a value of at most PASS_BYTES a pass; a larger benchmark is dealt to several passes.
    """
    out = None
    for held in _passes(docs.sparkSession, benchmark):

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(held.value)
            for batch in sliced(batches, "text", 1 << 20):
                rows, items, distances = [], [], []
                for row, text in enumerate(batch.column("text").to_pylist()):
                    for i, d in matcher.found(normalised(text)).items():
                        rows.append(row)
                        items.append(matcher.items[i][0])
                        distances.append(d)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(items, pa.int64()), pa.array(distances, pa.int32())], ["doc_id", "item_id", "distance"])

        one = docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, item_id bigint, distance int")
        out = one if out is None else out.union(one)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows whose own text holds an item; all columns pass through."""
    for held in _passes(docs.sparkSession, benchmark):

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(held.value)
            for batch in sliced(batches, "text", 1 << 20):
                yield batch.filter(pa.array([not matcher.found(normalised(t)) for t in batch.column("text").to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (doc_id, item_id) match and its edit distance. Null and empty texts and items match nothing, equal rows and
    equal items match each, very long texts are searched whole, empty tables give no row."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return matches(docs, table(spark, sf_dir, "benchmark"))
