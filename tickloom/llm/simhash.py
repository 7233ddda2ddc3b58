"""SimHash fingerprints and their near-duplicate links by Golay-code hashing.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits. If two fingerprints
differ in at most 4 bits, then by the pigeonhole principle either some segment is equal,
or two segments differ in exactly one bit each (the third in two). The first case is met
by an exact key on a segment. For the second the binary Golay code is used: it is
perfect, so every 23-bit word lies within 3 bits of exactly one of its 4,096 codewords. A
word's keys are the codewords that it or a word one bit away decodes to - one or six of
them - so the codeword of one word is always among the keys of a word one bit away, and
words two bits away share a key. A pair of segments gives up to 36 query keys of 24 bits and
one index key. The short segment alone would be a key of too few values: if it is equal,
one of the others differs in two bits at most, so it is taken with that one's codewords.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forest, sliced, table, texts_of, written
from .graph import components

#: The generator polynomial of the binary Golay code, and the segments.
GENERATOR = 0xC75
SEGMENTS = ((0, 23), (23, 23), (46, 18))
PAIRS = ((0, 1), (0, 2), (1, 2))
MOST_BITS = 4
#: Index rows that one block of a key holds; a hotter key is cut into blocks.
BLOCK = 20_000
#: A key is hot only if it also holds this share of the fingerprints, which bounds the hot keys.
HOT_SHARE = 1 / 500
#: Comparisons made at once.
CHUNK = 500_000


def fingerprints_of(texts: list[bytes], words_each: int) -> np.ndarray:
    """Fingerprints of UTF-8 texts: the majority of each bit over the XXH64 (seed 42) of all shingles."""
    out = np.zeros(len(texts), np.uint64)
    weights = np.uint64(1) << np.arange(63, -1, -1, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    for row, text in enumerate(texts):
        words = text.lower().split()
        if not words:
            continue
        n = max(1, len(words) - words_each + 1)
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate([[0], ends[: n - 1]]).tolist()
        stops = (ends[min(words_each, len(words)) - 1 :] - 1).tolist()
        ones = np.zeros(64, np.int64)
        for at in range(0, n, 4096):
            h = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[at : at + 4096], stops[at : at + 4096], strict=True)), np.uint64, min(4096, n - at))
            ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        out[row] = weights[2 * ones > n].sum()
    return out


def fingerprints(docs: DataFrame, words_each: int = 4) -> DataFrame:
    """docs' rows as (doc_id, fp): fp is the fingerprint as a signed long. Null and wordless texts: 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 1 << 20):
            fp = fingerprints_of(texts_of(batch.column("text")), words_each).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, fp bigint")


class Golay:
    """Nearest codewords of 23-bit words, as 12-bit indices."""

    def __init__(self):
        def remainder(x: np.ndarray) -> np.ndarray:
            for bit in range(22, 10, -1):
                x = np.where(x >> bit & 1, x ^ (GENERATOR << (bit - 11)), x)
            return x

        self.low, self.high = remainder(np.arange(1 << 12)), remainder(np.arange(1 << 11) << 12)
        bits = 1 << np.arange(23)
        two = (bits[:, None] | bits)[np.triu_indices(23, 1)]
        errors = np.unique(np.concatenate([[0], bits, two, (two[:, None] | bits).ravel()]))
        self.error = np.zeros(1 << 11, np.int64)
        self.error[remainder(errors)] = errors  # one error pattern of weight 3 at most for each syndrome

    def decode(self, x: np.ndarray) -> np.ndarray:
        return (x ^ self.error[self.low[x & 0xFFF] ^ self.high[x >> 12]]) >> 11

    def keys(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n, 6) codewords of the words up to one bit away, and which of them are real and new."""
        near = np.sort(self.decode(x[:, None] ^ np.concatenate([[0], 1 << np.arange(23)])), axis=1)
        new = np.concatenate([np.ones((len(x), 1), bool), near[:, 1:] != near[:, :-1]], axis=1)
        place = np.cumsum(new, axis=1) - 1
        out, real = np.zeros((len(x), 6), np.int64), np.zeros((len(x), 6), bool)
        r, c = np.nonzero(new)
        out[r, place[r, c]], real[r, place[r, c]] = near[r, c], True
        return out, real


_GOLAY: list[Golay] = []


def keys_of(fp: np.ndarray, query: bool) -> tuple[np.ndarray, np.ndarray]:
    """(keys, rows): the keys of each fingerprint as an index entry or as a query."""
    _GOLAY or _GOLAY.append(Golay())
    code, rows = _GOLAY[0], np.arange(len(fp))
    parts = [(fp >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    keys, of = [(k << 24 | p) for k, p in enumerate(parts[:2])], [rows] * 2
    for k in (0, 1):
        near, real = code.keys(parts[k])
        r, c = np.nonzero(real)
        keys.append(k + 6 << 30 | parts[2][r] << 12 | near[r, c])
        of.append(r)
    near = [code.keys(p) if query else (code.decode(p)[:, None], np.ones((len(p), 1), bool)) for p in parts]
    for k, (i, j) in enumerate(PAIRS, 3):
        (a, real_a), (b, real_b) = near[i], near[j]
        r, x, y = np.nonzero(real_a[:, :, None] & real_b[:, None, :])
        keys.append(k << 24 | a[r, x] << 12 | b[r, y])
        of.append(r)
    return np.concatenate(keys), np.concatenate(of)


def _links(fp: np.ndarray, query: np.ndarray, lo: np.ndarray, n: np.ndarray, of: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A forest of the links between each query and the index rows of[lo:lo+n], chunk by chunk."""
    ends = np.cumsum(n)
    at = 0
    while at < len(query):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, "right")))
        count = n[at:to]
        q = np.repeat(query[at:to], count)
        i = np.arange(len(q)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo[at:to], count)
        x, y = fp[q], fp[of[i]]
        hit = (x < y) & (np.bitwise_count(x ^ y) <= MOST_BITS)
        if hit.any():
            yield forest(x[hit], y[hit])
        at = to


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links from rows (key, role, fp) sorted by key and role; role 0 is the index."""
    kept: list[np.ndarray] = [np.empty(0, np.int64), np.empty(0, np.int8), np.empty(0, np.uint64)]

    def found(key: np.ndarray, role: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(key):
            return
        index, query = np.flatnonzero(role == 0), np.flatnonzero(role)
        lo = np.searchsorted(key[index], key[query], "left")
        n = np.searchsorted(key[index], key[query], "right") - lo
        for a, b in _links(fp, query, lo, n, index):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    for batch in batches:
        new = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)]
        rows = [np.concatenate(x) for x in zip(kept, new, strict=True)]
        if not len(rows[0]):
            continue
        cut = int(np.searchsorted(rows[0], rows[0][-1]))
        yield from found(*(x[:cut] for x in rows))
        kept = [x[cut:] for x in rows]
    yield from found(*kept)


def links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) that connect all fingerprints within MOST_BITS of each other, as a spanning
    forest of each block of candidates rather than all pairs.

    distinct: (fp), each once. Every candidate pair meets in an equal key and is verified
    on all 64 bits. Keys with over BLOCK index rows are cut into blocks of index rows by
    blocks of queries, each a task's work of its own.
    """
    spark = distinct.sparkSession
    total = distinct.count()
    least = max(BLOCK, int(total * HOT_SHARE))

    def index_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, _ = keys_of(batch.column(0).to_numpy().view(np.uint64), False)
            k, n = np.unique(keys, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n.astype(np.int64))], ["key", "n"])

    # At most 17 / HOT_SHARE keys, as a fingerprint has 17 index keys at most.
    counts = distinct.mapInArrow(index_keys, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    hot = {r["key"]: -(-r["n"] // BLOCK) for r in counts.where(F.col("n") > least).collect()} if total > least else {}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_keys = np.array(sorted(hot), np.int64)
        for batch in batches:
            whole = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(whole), 4096):
                fp = whole[at : at + 4096]
                for role in (0, 1):
                    key, of = keys_of(fp, bool(role))
                    value, place = fp[of], key << 24
                    if len(hot_keys):
                        # A hot key's rows go to a row or a column of its r x r blocks.
                        is_hot = np.isin(key, hot_keys)
                        r = np.array([hot[k] for k in key[is_hot].tolist()], np.int64)
                        own = (value[is_hot] % np.maximum(r, 1).astype(np.uint64)).astype(np.int64)
                        other = np.arange(r.sum()) - np.repeat(np.cumsum(r) - r, r)
                        mine, r = np.repeat(own, r), np.repeat(r, r)
                        block = mine * r + other if role == 0 else other * r + mine
                        spread = np.repeat(np.flatnonzero(is_hot), [hot[k] for k in key[is_hot].tolist()])
                        place = np.concatenate([place[~is_hot], place[spread] | block])
                        value = np.concatenate([value[~is_hot], value[spread]])
                    yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(np.full(len(place), role, np.int8)), pa.array(value.view(np.int64))], ["key", "role", "fp"])

    rows = distinct.mapInArrow(deal, "key bigint, role tinyint, fp bigint")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "key").sortWithinPartitions("key", "role").mapInArrow(_match, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, words_each: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs (doc_id, text).

    Fingerprints within 4 bits are linked; component_id is the least doc_id that links
    reach (null only if all of a component are null). Documents with null, empty or
    wordless text have fingerprint 0, which is linked like any other. Equal fingerprints
    are one node, whatever their number, so groups of copies cost one row; rows with a
    repeated doc_id are judged by their own texts. An empty table gives an empty one.
    """
    prints = written(fingerprints(docs, words_each), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    joined = components(links(nodes.select("fp"))).toDF("fp", "root")
    nodes = nodes.join(joined, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(nodes.join(least, "root").select("fp", "component_id"), "fp")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document. Texts without a word, null ones too, share the
    fingerprint zero and are linked; equal rows get a row each; null ids are not counted among the smallest; an empty table gives none."""
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
