"""Near-duplicate documents: SimHash candidates by Golay-code keys, exact Jaccard of five-word shingles.

A document's SimHash sums are those of its shingles' random signs, here of many more bits than
one fingerprint has: at a likeness of 0.8 every bit differs with 0.15, so 64 bits differ in 10,
give or take 3, which no key of one fingerprint bears. The sums are cut into SEGMENTS segments of
23; each is decoded to a codeword of the binary Golay code, by the sums and not their signs alone: the
DOUBTFUL least certain bits are tried both ways, and of the codewords found the one stays that
contradicts the least sums. Two documents of likeness 0.8 share a segment's codeword with 0.25
(0.12 by signs alone, 0.55 at 0.95), so the error budget is one of the segments: a key is the
codewords of two, and at 0.8 all KEYS keys miss with about 1e-3 (3 of 3,600 made pairs), at 0.85 with 2e-6. Those that meet in
a key and differ in at most MOST_BITS of 64 bits of the fingerprint are verified on the whole shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix, remove, sliced, texts_of, written
from .graph import components
from .simhash import Golay

WORDS_EACH = 5
#: Keys a document (120 << 24 is below 2**31), of two segments each.
KEYS = 120
SEGMENTS = 2 * KEYS
BITS = 23
#: Bits of a segment that are tried both ways.
DOUBTFUL = 4
#: Differing bits of 64: five spreads above the mean at 0.8.
MOST_BITS = 24
#: Shingles are counted with a sign in so many places, which the sums are made of.
PLACES = 512
_RNG = np.random.default_rng(42)
#: Multipliers of the words of a shingle.
TIMES = _RNG.integers(1 << 63, size=WORDS_EACH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Documents whose keys are made at once, and a key's rows that are compared with each other before the rounds.
TOGETHER, CROWD = 64, 256
#: Bits of a bitmap of rows: 32 MB at most.
MOST_MARKS = 1 << 28
#: Rounds in which a key's members meet only their first one; the others then meet pairwise.
ROUNDS = 3


def shingles_of(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the shingles; a text of fewer words is one shingle."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - WORDS_EACH + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(WORDS_EACH, len(words))):
        out += h[k : k + n] * TIMES[k]
    return np.unique(mix(out))


_PARTS: list[np.ndarray] = []


def sums_of(sets: list[np.ndarray]) -> np.ndarray:
    """(documents, SEGMENTS * BITS) SimHash sums. The places' parts in them are whole numbers, so that sums are exact in any order."""
    _PARTS or _PARTS.append(np.rint(16 * np.random.default_rng(42).standard_normal((PLACES, SEGMENTS * BITS), np.float32)))
    counts = np.empty((len(sets), PLACES), np.float32)
    for row, h in enumerate(sets):
        sign = (h & np.uint64(1)).astype(np.float64) * 2 - 1
        counts[row] = np.bincount((h >> np.uint64(55)).astype(np.int64), sign, PLACES)
    return counts @ _PARTS[0]


_GOLAY: list[tuple[Golay, np.ndarray, np.ndarray]] = []


def _golay() -> tuple[Golay, np.ndarray, np.ndarray]:
    """The code, the wrong bits of each syndrome (23: none), the syndrome of each bit."""
    if not _GOLAY:
        code = Golay()
        wrong = np.full((len(code.error), 3), BITS)
        for row, error in enumerate(code.error.tolist()):
            at = [b for b in range(BITS) if error >> b & 1]
            wrong[row, : len(at)] = at
        bit = 1 << np.arange(BITS)
        _GOLAY.append((code, wrong, code.low[bit & 0xFFF] ^ code.high[bit >> 12]))
    return _GOLAY[0]


def codewords(sums: np.ndarray) -> np.ndarray:
    """The codeword (12-bit index) of each row of BITS sums."""
    code, wrong, syndromes = _golay()
    rows = np.arange(len(sums))
    weight = np.zeros((len(sums), BITS + 1), np.float32)
    np.abs(sums, out=weight[:, :BITS])
    word = ((sums > 0).astype(np.float32) @ (1 << np.arange(BITS)).astype(np.float32)).astype(np.int64)
    doubtful = np.argpartition(weight[:, :BITS], DOUBTFUL, axis=1)[:, :DOUBTFUL]
    syndrome = code.low[word & 0xFFF] ^ code.high[word >> 12]
    flips, moved, cost = [np.zeros_like(word)], [np.zeros_like(word)], [np.zeros(len(word), np.float32)]
    for k in range(DOUBTFUL):
        at = doubtful[:, k]
        bit, step, more = 1 << at, syndromes[at], weight[rows, at]
        flips += [x ^ bit for x in flips]
        moved += [x ^ step for x in moved]
        cost += [x + more for x in cost]
    flat, base = weight.ravel(), rows * (BITS + 1)
    least, best = np.full(len(word), np.inf, np.float32), np.zeros_like(word)
    for flip, step, price in zip(flips, moved, cost, strict=True):
        s = syndrome ^ step
        # A flipped bit that is also found wrong counts twice here; without its flip the same codeword costs less.
        for k in range(3):
            price = price + flat[base + wrong[s, k]]
        better = price < least
        least = np.where(better, price, least)
        best = np.where(better, word ^ flip ^ code.error[s], best)
    return best >> 11


def keys_of(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(documents, KEYS) keys and the fingerprints of 64 bits of sets with a shingle at least."""
    sums = sums_of(sets)
    code = codewords(sums.reshape(-1, BITS)).reshape(len(sets), KEYS, 2)
    keys = np.arange(KEYS) << 24 | code[:, :, 0] << 12 | code[:, :, 1]
    return keys.astype(np.int32), np.packbits(sums[:, :64] > 0, axis=1).view(">u8").ravel().astype(np.uint64)


def _sketches(rows: DataFrame) -> DataFrame:
    """(_row, doc_id, node, n, fp, keys): node names the shingle set, n is its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(iter([whole]), "text", 1 << 20):
                sets = [shingles_of(t) for t in texts_of(batch.column("text"))]
                node = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
                fp, keys = np.zeros(len(sets), np.uint64), [np.empty(0, np.int32)] * len(sets)
                some = [i for i, s in enumerate(sets) if len(s)]
                for at in range(0, len(some), TOGETHER):
                    part = some[at : at + TOGETHER]
                    k, fp[part] = keys_of([sets[i] for i in part])
                    for i, x in zip(part, k, strict=True):
                        keys[i] = x
                n = pa.array([len(s) for s in sets], pa.int64())
                columns = [batch.column("_row"), batch.column("doc_id"), pa.array(node), n, pa.array(fp.view(np.int64)), pa.array(keys, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, ["_row", "doc_id", "node", "n", "fp", "keys"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("_row", "doc_id", "text").mapInArrow(run, f"_row bigint, doc_id {kind}, node bigint, n bigint, fp bigint, keys array<int>")


def _close(fp: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (np.bitwise_count(fp[a] ^ fp[b]) <= MOST_BITS) & (5 * n[a] >= 4 * n[b]) & (5 * n[b] >= 4 * n[a])


def _meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, node, n, fp) sorted by key those that a row of their key is close to; all rows of a key with over CROWD."""
    names = ["key", "node", "n", "fp"]
    kept = [np.empty(0, np.int32), *[np.empty(0, np.int64)] * 3]
    crowded = None

    def out(rows: list[np.ndarray], at) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x[at]) for x in rows], names)

    def found(rows: list[np.ndarray]) -> pa.RecordBatch:
        key, _, n, fp = rows
        fp, good = fp.view(np.uint64), np.zeros(len(key), bool)
        _, start, size = np.unique(key, return_index=True, return_counts=True)
        good |= np.repeat(size > CROWD, size)
        left = np.repeat(np.where(size > CROWD, 0, start + size), size) - np.arange(len(key))  # rows of the key from each on
        for step in range(1, int(size[size <= CROWD].max(initial=0))):
            a = np.flatnonzero(left > step)
            a = a[_close(fp, n, a, a + step)]
            good[a] = good[a + step] = True
        return out(rows, good)

    for batch in batches:
        rows = [x.to_numpy() for x in batch.columns]
        if crowded is not None:
            cut = int(np.searchsorted(rows[0], crowded, "right"))
            yield out(rows, slice(0, cut))
            rows = [x[cut:] for x in rows]
        rows = [np.concatenate(x) for x in zip(kept, rows, strict=True)]
        kept = rows
        if not len(rows[0]):
            continue
        cut = int(np.searchsorted(rows[0], rows[0][-1]))
        yield found([x[:cut] for x in rows])
        kept, crowded = [x[cut:] for x in rows], None
        if len(kept[0]) > CROWD:
            crowded = kept[0][0]
            yield out(kept, slice(None))
            kept = [x[:0] for x in kept]
    if len(kept[0]):
        yield found(kept)


def marks(rows: DataFrame) -> np.ndarray:
    """A bitmap of a long column of hashes, _row: 8 bits a row or more, MOST_MARKS at most."""
    bits = 1 << min(MOST_MARKS.bit_length() - 1, max(10, (8 * rows.count()).bit_length()))
    place = F.col("_row").bitwiseAND(bits - 1)
    mark = F.expr("shiftleft(1L, CAST(_row & 63 AS INT))")
    found = rows.groupBy(F.shiftrightunsigned(place, 6).alias("place")).agg(F.bit_or(mark).alias("mark")).toArrow()
    out = np.zeros(bits >> 6, np.int64)
    out[found["place"].to_numpy()] = found["mark"].to_numpy()
    return out.view(np.uint64)


def flagged(df: DataFrame, rows: DataFrame) -> DataFrame:
    """df with _flag: whether its _row is among the rows', or shares its bits with one of them. Whatever has none need not go through the exact join."""
    held = df.sparkSession.sparkContext.broadcast(marks(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for batch in batches:
            h = batch.column("_row").to_numpy().view(np.uint64) & np.uint64(64 * len(bits) - 1)
            hit = bits[(h >> np.uint64(6)).astype(np.int64)] >> (h & np.uint64(63)) & np.uint64(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hit.astype(bool))], [*batch.schema.names, "_flag"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("_flag", T.BooleanType())]))


def _sets(rows: DataFrame) -> DataFrame:
    """(node, shingles) of rows (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 1 << 20):
            sets = [shingles_of(t).view(np.int64) for t in texts_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    return rows.select("node", "text").mapInArrow(run, "node bigint, shingles array<bigint>")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose shingle sets have a likeness of 0.8 or more."""
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(9 * shared >= 4 * (F.size("x") + F.size("y"))).select("a", "b")


def one_of_each_similar(docs: DataFrame) -> DataFrame:
    """docs with one row of each group that likenesses of 0.8 or more hold together: the least
    doc_id's (nulls last, then by text).

    A key's members meet its leader: the least one, in later rounds the one that meets most others.
    Those that are not like it go on to the next round, in the last one pairwise, so a large group costs a row each and two like documents that share
    a key are never both kept. Equal shingle sets are one node; texts without a word are one
    too. Rows that are equal in doc_id and text count once: the least of their other columns, as
    JSON, stays. All columns pass through, whatever they are called.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # The caller's columns travel in one struct, so that none can clash with a helper.
    columns = docs.columns
    whole = F.struct(*(F.col(f"`{c}`") for c in columns))
    others = F.to_json(F.struct(*(F.col(f"`{c}`") for c in columns if c != "text")))
    tagged = docs.select("doc_id", "text", whole.alias("_whole"), others.alias("_others"), F.xxhash64("doc_id", text).alias("_row"))
    sketches = written(_sketches(tagged.select("_row", "doc_id", text.alias("text"))), "sketches")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")
    nodes = written(sketches.groupBy("node").agg(F.min(order).alias("least")), "nodes")

    # Equal shingle sets have equal keys, so copies add none.
    keyed = sketches.groupBy("node").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys"))
    keyed = keyed.select(F.explode("keys").alias("key"), "node", "n", "fp")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = keyed.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_meeting, "key int, node bigint, n bigint, fp bigint")
    met = written(met, "met")
    pool = written(met.join(nodes, "node").select("node", "least", "n", "fp", "key"), "pool")
    remove(met)
    named = written(pool.select("node", F.col("least._row").alias("_row")).distinct(), "named")
    texts = flagged(tagged.select("_row", text.alias("text")), named).where("_flag").join(named, "_row").dropDuplicates(["_row"])
    sets = written(_sets(texts), "sets")
    close = (5 * F.col("n") >= 4 * F.col("m")) & (5 * F.col("m") >= 4 * F.col("n")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= MOST_BITS)
    found = []
    for _ in range(ROUNDS):
        if pool.isEmpty():
            break
        if found:
            # Of many copies of one text that text leads, which all are like: the node that meets most others.
            times = pool.groupBy("key").agg(F.count("*").alias("times"))
            met = pool.join(written(times, "times"), "key").groupBy("node").agg((-F.sum("times")).alias("met"))
            ranked = written(pool.join(written(met, "met"), "node").select("node", "least", "n", "fp", "key", F.struct("met", "least").alias("rank")), "pool")
            remove(pool)
            pool = ranked
        else:
            pool = pool.withColumn("rank", F.struct(F.lit(0).cast("long").alias("met"), "least"))
        first = pool.groupBy("key").agg(F.count("*").alias("times"), F.min(F.struct("rank", "node", "n", "fp")).alias("first")).where("times > 1")
        first = written(first.select("key", F.col("first.node").alias("a"), F.col("first.n").alias("m"), F.col("first.fp").alias("fp2")), "first")
        met = written(pool.join(first, "key").where("node <> a"), "met")
        pairs = met.where(close).select("a", F.col("node").alias("b")).distinct()
        found.append(written(_verified(pairs, sets), "similar"))
        rest = met.join(found[-1].withColumnRenamed("b", "node"), ["a", "node"], "left_anti")
        remove(pool)
        remove(first)
        pool = written(rest.select("node", "least", "n", "fp", "key"), "pool")
        remove(met)
    other = pool.select(F.col("node").alias("b"), F.col("least").alias("later"), F.col("n").alias("m"), F.col("fp").alias("fp2"), "key")
    pairs = pool.join(other, "key").where((F.col("least") < F.col("later")) & close).select(F.col("node").alias("a"), "b").distinct()
    links = written(_verified(pairs, sets), "similar")
    for more in found:
        links = links.union(more)
    joined = components(links).toDF("node", "root")
    remove(pool)
    remove(sets)
    kept = nodes.join(joined, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("least").alias("least"))
    kept = kept.select(F.col("least._row").alias("_row"), F.lit(True).alias("stays"))
    # Rows that go or are repeated are told apart exactly; the texts of all others do not move.
    odd = sketches.groupBy("_row").agg(F.count("*").alias("times")).join(kept, "_row", "left")
    odd = written(odd.where("stays IS NULL OR times > 1").select("_row", F.coalesce("stays", F.lit(False)).alias("stays")), "odd")
    told = flagged(tagged.select("_row", "_whole", "_others"), odd)
    few = told.where("_flag").join(odd, "_row", "left").where("stays IS NULL OR stays")
    few = few.groupBy("_row").agg(F.min_by("_whole", "_others").alias("_whole"))
    one = told.where("NOT _flag").select("_whole").unionByName(few.select("_whole"))
    return one.select(*(F.col("_whole").getField(c).alias(c) for c in columns))
