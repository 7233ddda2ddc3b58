"""Best-fit packing into sequences of several permitted lengths.

Pieces of documents are packed by descending length. A piece goes to the open bin with the
least room that takes it; if there is none, the bin size with the least cost a useful token
is opened: its cost over the piece and what smaller pieces may still fill. At the end each
bin is cut down to the least permitted size that holds its contents.

Best-fit is sequential, so documents are dealt to shards of about SHARD pieces by a hash; each
shard is packed alone with lengths only (no texts move). A shard's waste beyond that of one
global pass is at most its few last bins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

CAPACITIES = (512, 1024, 2048, 4096)
#: Documents that are packed together.
SHARD = 8_192
#: Pieces that are packed at once, so that a shard of any size fits into memory.
MOST = 1 << 18
SCHEMA = "doc_id bigint, piece int, start bigint, n_tokens int, bin_id bigint, bin_offset int, bin_capacity int"


def sequence_cost(capacity: int) -> float:
    """Cost of a sequence: its tokens, attention's share that grows with the square, and a fixed part."""
    return 16 + capacity + capacity * capacity / 32_768


def best_fit(lengths: np.ndarray, capacities: Sequence[int] = CAPACITIES, cost: Callable[[int], float] = sequence_cost) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset in it) for each length, and the bins' capacities. 1 <= lengths <= max(capacities)."""
    capacities = sorted(capacities)
    order = np.argsort(-lengths, kind="stable")
    ordered = lengths[order].tolist()
    rest = np.append(np.cumsum(lengths[order][::-1])[::-1], 0)  # tokens from each piece on
    descending = -lengths[order]
    at, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    used: list[int] = []
    size: list[int] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0  # a bit for each room that some open bin has
    for i, n in enumerate(ordered):
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            least = None
            for c in capacities:
                if c >= n:
                    small = int(np.searchsorted(descending, n - c)) if c > n else len(ordered)
                    fill = min(c - n, int(rest[max(i + 1, small)]) if c > n else 0)
                    price = (cost(c) / (n + fill), c)
                    least = price if least is None or price < least else least
            b, room = len(used), least[1]
            used.append(0)
            size.append(room)
        at[order[i]], offset[order[i]] = b, used[b]
        used[b] += n
        if room > n:
            by_room.setdefault(room - n, []).append(b)
            rooms |= 1 << (room - n)
    caps = np.array(capacities)
    return at, offset, caps[np.searchsorted(caps, used)] if used else np.empty(0, np.int64)


def pack(docs: DataFrame, capacities: Sequence[int] = CAPACITIES) -> DataFrame:
    """Pieces (SCHEMA) of docs (doc_id, n_tokens), each in one bin.

    A document longer than the largest capacity is cut into pieces of that size and a rest;
    start is a piece's first token. Null and non-positive lengths are taken as 1 token (an
    end of text), so every row is packed; repeated rows and null doc_ids are packed as rows of
    their own. bin_id is unique in the result: the shard, then the bin within it.
    """
    spark = docs.sparkSession
    most = max(capacities)
    docs = docs.select("doc_id", F.greatest(F.coalesce("n_tokens", F.lit(1)), F.lit(1)).cast("long").alias("n_tokens"))
    shards = docs.count() // SHARD + 1
    docs = docs.withColumn("shard", F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(shards)))
    docs = docs.withColumn("piece", F.explode(F.sequence(F.lit(0), ((F.col("n_tokens") - 1) / most).cast("int"))))
    start = F.col("piece").cast("long") * most
    pieces = docs.select("shard", "doc_id", "piece", start.alias("start"), F.least(F.lit(most), F.col("n_tokens") - start).cast("int").alias("n"))

    def flush(shard: int, first: int, rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows)
        at, offset, caps = best_fit(t["n"].to_numpy(), capacities)
        columns = [t[c].combine_chunks() for c in ("doc_id", "piece", "start", "n")]
        return pa.RecordBatch.from_arrays([*columns, pa.array((shard << 32) + first + at), pa.array(offset.astype(np.int32)), pa.array(caps[at].astype(np.int32))], SCHEMA_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        shard, first, rows = -1, 0, 0
        for batch in batches:
            ids = batch.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                # Rows of one id and length meet in one shard; it is packed in parts, each of many pieces.
                if held and (ids[a] != shard or rows >= MOST):
                    yield flush(shard, first, held)
                    first, held, rows = (first + rows, [], 0) if ids[a] == shard else (0, [], 0)
                shard = int(ids[a])
                held.append(batch.slice(a, b - a))
                rows += b - a
        if held:
            yield flush(shard, first, held)

    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), shards)
    return pieces.repartition(parts, "shard").sortWithinPartitions("shard", F.desc("n"), "doc_id", "piece").mapInArrow(run, SCHEMA)


SCHEMA_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def word_lengths(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens): words between white space, and one end of text."""
    return docs.select("doc_id", (F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")) + 1).alias("n_tokens"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, by their words, packed into sequences of CAPACITIES tokens. Null texts are one
    token (an end), equal rows are packed each, an empty table gives none."""
    return pack(word_lengths(table(spark, sf_dir, "documents")))
