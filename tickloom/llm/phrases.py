"""Lempel-Ziv phrase fingerprints.

A text's UTF-8 bytes are parsed into the phrases of an LZ78 dictionary: each phrase is the
longest one seen plus one byte. The phrases' 64-bit hashes are a set; its KEEP least members
are the signature. Two signatures estimate the Jaccard likeness of the phrase sets, which
follows how well one text's dictionary compresses the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MIX_A, mix, sliced, table

#: Signature size; each member is shown by 8 hex digits.
KEEP = 128
#: Slots a shuffle partition: documents are dealt to ranges of ids in slots.
SLOTS = 4


def _parse(data: bytes, phrases: dict[int, int], node: int) -> int:
    """Go on with a parse: phrases maps parent * 256 + byte to a node (itself times 256).
    Returns the node of the unfinished phrase."""
    get, n = phrases.get, len(phrases) << 8
    for c in data:
        at = get(node | c)
        if at is None:
            n += 256
            phrases[node | c] = n
            node = 0
        else:
            node = at
    return node


def _signature(phrases: dict[int, int], unfinished: int) -> np.ndarray:
    """The KEEP least 32-bit heads of the phrases' hashes, ascending, each once.

    An unfinished last phrase is one of the dictionary already, so it adds nothing.
    """
    n = len(phrases)
    if not n:
        return np.empty(0, np.uint32)
    keys = np.fromiter(phrases, np.int64, n)
    parent = np.append(0, keys >> 8)
    # hash(child) = hash(parent) * A + g(byte) by pointer doubling: n phrases are about log(n) deep.
    add = np.append(np.uint64(0), mix((keys & 255).astype(np.uint64) + np.uint64(1)))
    times = np.append(np.uint64(1), np.full(n, MIX_A))
    while parent.any():
        add, times, parent = add[parent] * times + add, times[parent] * times, parent[parent]
    return np.unique((mix(add[1:] + times[1:]) >> np.uint64(32)).astype(np.uint32))[:KEEP]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard estimate from two signatures: of the union's KEEP least members, the share in both."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)[:KEEP]
    return float((np.isin(union, a, assume_unique=True) & np.isin(union, b, assume_unique=True)).mean())


def fingerprint(text: bytes) -> np.ndarray:
    phrases: dict[int, int] = {}
    return _signature(phrases, _parse(text, phrases, 0))


def shown(signature: np.ndarray) -> str:
    return signature.astype(">u4").tobytes().hex()


def edit(text: str, other: str) -> str:
    """text with its last floor(n/2) characters replaced by the first as many (or all) of other."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def two_fingerprints(text: str, other: str) -> tuple[np.ndarray, np.ndarray, str]:
    """Fingerprints of text and of edit(text, other), whose common head is parsed once."""
    half = len(text) // 2
    phrases: dict[int, int] = {}
    node = _parse(text[: len(text) - half].encode(), phrases, 0)
    fork = phrases.copy()
    own = _signature(phrases, _parse(text[len(text) - half :].encode(), phrases, node))
    return own, _signature(fork, _parse(other[:half].encode(), fork, node)), edit(text, other)


def in_slots(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with slot and ahead, dealt out by slot and sorted within it by descending doc_id.

    A slot is a range of ids. The document that follows a slot's last one comes again at its
    end, marked as ahead, so texts move once and only a row a slot is repeated. Slots are cut
    at quantiles of doc_id; null ids come last, ties are ordered by text.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    share = [i / (parts * SLOTS) for i in range(1, parts * SLOTS)]
    cuts = sorted(set(docs.agg(F.percentile_approx("doc_id", F.lit(share), 10_000)).first()[0] or [0]), reverse=True)
    held = F.array(*map(F.lit, cuts))
    # How many cuts lie above the id, found bit by bit, as they descend.
    steps = F.array(*(F.lit(1 << b) for b in reversed(range(len(cuts).bit_length()))))
    above = F.aggregate(steps, F.lit(0), lambda n, step: F.when((n + step <= len(cuts)) & (F.get(held, n + step - 1) > F.col("doc_id")), n + step).otherwise(n))
    docs = docs.withColumn("slot", F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(above))
    heads = docs.groupBy("slot").agg(F.max("doc_id").alias("head")).orderBy("slot").collect()  # a row a slot
    slots = [r["slot"] for r in heads]
    before = spark.createDataFrame(list(zip(slots[-1:] + slots[:-1], (r["head"] for r in heads), strict=True)), "slot int, head long")
    ahead = docs.drop("slot").join(F.broadcast(before), F.col("doc_id").eqNullSafe(F.col("head"))).drop("head")
    rows = docs.withColumn("ahead", F.lit(False)).unionByName(ahead.withColumn("ahead", F.lit(True)))
    return rows.repartition(parts, "slot").sortWithinPartitions("slot", "ahead", F.desc("doc_id"), "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each document.

    The next document is the next lower doc_id (after the last: the first); equal ids are
    ordered by text, null ids come last. A null text counts as empty: its phrase set is
    empty, which is like another empty one (1) and unlike any other (0). Every row of docs
    gives one row; an empty table none. Long texts are parsed whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None

        def result(i: int | None, text: str, following: str) -> tuple:
            own, edited, body = two_fingerprints(text, following)
            return (i, len(text), hashlib.sha256(body.encode()).hexdigest(), own, edited)

        done: list[tuple] = []
        waiting: tuple | None = None  # a row that lacks its next one's fingerprint
        for batch in sliced(batches, "text"):
            for slot, i, text, ahead in zip(*(batch.column(c).to_pylist() for c in ("slot", "doc_id", "text", "ahead")), strict=True):
                if last is not None and last[0] == slot:
                    row = result(last[1], last[2], text)
                    if waiting is not None:
                        done.append((*waiting, row[3]))
                    waiting = row
                if ahead:
                    if waiting is not None:
                        done.append((*waiting, fingerprint(text.encode())))
                    last = waiting = None
                else:
                    last = (slot, i, text)
            if done:
                yield _rows(done)
                done = []

    return in_slots(docs).mapInArrow(run, SCHEMA)


SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _rows(done: list[tuple]) -> pa.RecordBatch:
    ids, n, sha, own, edited, following = zip(*done, strict=True)
    near = [likeness(a, b) for a, b in zip(own, edited, strict=True)], [likeness(a, b) for a, b in zip(own, following, strict=True)]
    columns = [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(sha), pa.array(map(shown, own)), pa.array(map(shown, edited)), pa.array(near[0]), pa.array(near[1])]
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SCHEMA.split(", ")])


def op9_phrase_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprints. Null texts are empty, equal ids are ordered by text, null ids come
    last, long texts are parsed whole, an empty table gives none."""
    return fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
