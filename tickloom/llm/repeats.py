"""Exact long repeats by a sparse suffix array and its common-prefix interval tree.

Only some suffixes are kept: a position is an anchor if its 16-byte hash is the least
among the first REACH positions of some LEAST bytes. The choice looks at those LEAST bytes
alone, so two equal windows hold an anchor at the same place, at most REACH - 1 bytes from
their start. An anchor's key is the hash of the CORE bytes that any such window has from the
anchor on; only anchors with equal keys can share a window.

Anchors whose whole surroundings (REACH - 1 bytes before, WINDOW after) are equal are one
class; a class of two or more is covered to the full. For keys with several classes, one
suffix a class is sorted, common-prefix intervals are found by a scan with a stack, and
each interval's members are compared to the left: two members of an interval of prefix
length R that agree on L bytes before the anchor, R + L >= WINDOW, are occurrences of one
repeat that is removed; with R + L >= LEAST they are one that is only told.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, remove, sliced, table, texts_of, written

#: Bytes of a repeat that is removed, and of one that is told: some fifty words.
WINDOW, LEAST = 400, 256
REACH = 128
CORE = LEAST - REACH + 1
LEFT = REACH - 1
#: Bytes that are compared on either side at most.
WIDTH = max(LEFT, WINDOW - CORE)
#: Bytes of a text that are handled at once, and classes of a key that one task sorts.
SEGMENT = 1 << 21
BLOCK = 20_000
#: Rows whose bytes are compared at once.
CHUNK = 16_384


def _words(buffer: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on, as one number."""
    n = len(buffer) - 7
    out = np.empty(n, np.uint64)
    for r in range(8):
        m = (n - r + 7) // 8
        out[r::8] = np.frombuffer(buffer.data, np.uint64, m, r)
    return out


def _slide(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over x[i:i+width], width a power of two; short at the end."""
    x, step = x.copy(), 1
    while step < width:
        op(x[:-step], x[step:], out=x[:-step])
        step *= 2
    return x


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text, position, key, full, left, right) of the anchors of all texts.

    left and right are the bytes that a text has before the anchor (LEFT at most) and from
    it on (WINDOW at most).
    """
    pieces, spans, at = [], [], WINDOW
    pad = bytes(WINDOW)
    for row, text in enumerate(texts):
        starts = len(text) - LEAST + 1
        for s in range(0, max(0, starts), SEGMENT):
            e = min(s + SEGMENT, starts)  # window starts s..e-1
            lo, hi = max(0, s - LEFT), min(len(text), e + REACH + WINDOW)
            pieces += [pad, text[lo:hi]]
            spans.append((at, at + hi - lo, at + s - lo, at + e - lo, row, lo, len(text)))
            at += hi - lo + WINDOW
    if not spans:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64, np.int64, np.int64))
    buffer = np.frombuffer(b"".join([*pieces, pad, pad]), np.uint8)
    span = np.array(spans, np.int64)
    words = _words(buffer)
    gram = mix(words[:-8] ^ mix(words[8:]))
    gram &= np.uint64(0xFFFFFFFF00000000)
    gram |= np.arange(len(gram), dtype=np.uint64)  # leftmost of equals
    least = _slide(gram, REACH, np.minimum)
    edge = np.zeros(len(gram) + 1, np.int8)
    edge[span[:, 2]] += 1
    edge[span[:, 3]] -= 1
    least[np.cumsum(edge[:-1], dtype=np.int8) == 0] = 0
    reached = _slide(least[::-1], REACH, np.maximum)[::-1]
    a = np.flatnonzero((gram == reached) & (reached > 0))  # 0: no window starts near
    del gram, least, reached
    of = np.searchsorted(span[:, 0], a, "right") - 1
    position = a - span[of, 0] + span[of, 5]
    left, right = np.minimum(position, LEFT), np.minimum(span[of, 6] - position, WINDOW)

    def digest(h: np.ndarray, offsets: list[int]) -> np.ndarray:
        for o in offsets:
            h = (h ^ words[a + o]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
        return mix(h)

    key = digest(np.full(len(a), 0x51, np.uint64), [*range(0, CORE - 8, 8), CORE - 8])
    around = [*range(-LEFT, 0, 8), *range(CORE, WINDOW - 8, 8), WINDOW - 8]
    full = digest(mix(left.astype(np.uint64) << np.uint64(16) | right.astype(np.uint64)), around)
    row = span[of, 4]
    order = np.lexsort((position, row))
    row, position, key, full, left, right = (x[order] for x in (row, position, key, full, left, right))
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (position[1:] != position[:-1])  # segments of one text overlap
    return tuple(x[new] for x in (row, position, key, full, left, right))


def _common(x: list[bytes], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of x[i] and x[j]."""
    out = np.empty(len(i), np.int64)
    if not len(i):
        return out
    size = np.fromiter(map(len, x), np.int64, len(x))
    start = np.cumsum(size) - size
    flat = np.frombuffer(b"".join(x) + bytes(WINDOW), np.uint8)
    step = np.arange(WIDTH)
    for at in range(0, len(i), CHUNK):
        p, q = i[at : at + CHUNK], j[at : at + CHUNK]
        differ = flat[start[p][:, None] + step] != flat[start[q][:, None] + step]
        first = np.where(differ.any(1), differ.argmax(1), WIDTH)
        out[at : at + CHUNK] = np.minimum(first, np.minimum(size[p], size[q]))
    return out


def intervals(lcp: list[int]) -> list[tuple[int, int, int]]:
    """Common-prefix intervals (first, last, length) of sorted suffixes.

    lcp[i] is the common prefix of suffixes i-1 and i, -1 between groups.
    """
    out, stack = [], [(-1, 0)]
    for i, value in enumerate([*lcp[1:], -1], 1):
        first = i - 1
        while stack[-1][0] > value:
            length, first = stack.pop()
            out.append((first, i - 1, length))
        if stack[-1][0] < value:
            stack.append((value, first))
    return out


def cover(group: np.ndarray, left: list[bytes], right: list[bytes]) -> np.ndarray:
    """(4, n): the bytes before each anchor and from it on that repeats of WINDOW bytes through it
    cover, then those that repeats of LEAST bytes cover. 0, 0 where none passes.

    Rows come sorted by group, then right; right begins CORE bytes after the anchor, left is
    the bytes before it, nearest first.
    """
    n = len(group)
    most = np.zeros((4, n), np.int64)
    if n < 2:
        return most
    rows = np.arange(n)
    lcp = np.concatenate([[-1], _common(right, rows[:-1], rows[1:])])
    lcp[1:][group[1:] != group[:-1]] = -1
    nodes = np.array(intervals(lcp.tolist()), np.int64).reshape(-1, 3)
    nodes = nodes[nodes[:, 2] >= 0]
    if not len(nodes):
        return most
    rank = np.empty(n, np.int64)
    rank[np.array(sorted(range(n), key=left.__getitem__), np.int64)] = rows
    size = nodes[:, 1] - nodes[:, 0] + 1
    ends = np.cumsum(size)
    at = 0
    while at < len(nodes):  # some nodes at once, as nested ones may repeat their rows
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 500_000, "right")))
        node = np.repeat(np.arange(at, to), size[at:to])
        member = np.arange(len(node)) - np.repeat(ends[at:to] - size[at:to] - (ends[at - 1] if at else 0), size[at:to]) + nodes[node, 0]
        order = np.lexsort((rank[member], node))
        node, member = node[order], member[order]
        beside = _common(left, member[:-1], member[1:])
        beside[node[1:] != node[:-1]] = -1
        best = np.maximum(np.append(beside, -1), np.insert(beside, 0, -1))
        length = CORE + nodes[node, 2]
        for k, least in enumerate((WINDOW, LEAST)):
            hit = (best >= 0) & (best + length >= least)
            np.maximum.at(most[2 * k], member[hit], best[hit])
            np.maximum.at(most[2 * k + 1], member[hit], length[hit])
        at = to
    return most


SIDES = ["l", "r", "near_l", "near_r"]


def _cover_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (place, key, full, before, after), sorted by place and after, to (key, full, l, r, near_l, near_r)."""
    kept: list[pa.RecordBatch] = []

    def run(part: pa.Table) -> pa.RecordBatch:
        most = cover(part["place"].to_numpy(), part["before"].to_pylist(), part["after"].to_pylist())
        hit = np.flatnonzero(most[3])
        return pa.RecordBatch.from_arrays([part["key"].combine_chunks().take(hit), part["full"].combine_chunks().take(hit), *map(pa.array, most[:, hit])], ["key", "full", *SIDES])

    for batch in batches:
        rows = pa.Table.from_batches([*kept, batch])
        if not rows.num_rows:
            continue
        place = rows["place"].to_numpy()
        cut = int(np.searchsorted(place, place[-1]))
        if cut:
            yield run(rows.slice(0, cut))
        kept = rows.slice(cut).to_batches()
    if kept:
        yield run(pa.Table.from_batches(kept))


def repeats(docs: DataFrame) -> DataFrame:
    """(t0, t1, key, position, start, stop, near_start, near_stop): the stretches through an anchor of
    each text that repeats of WINDOW (else start = stop) and of LEAST bytes cover.

    t0, t1 are a text's 128-bit hash, so copies of a text share their rows. Rows with one key
    are the occurrences of repeats that share the anchor's CORE bytes.
    """
    named = _named(docs)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", SEGMENT):
            row, position, key, full, left, right = anchors(texts_of(batch.column("text")))
            rows = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column("t0").take(rows), batch.column("t1").take(rows), pa.array(position.astype(np.int32)), pa.array(key.view(np.int64)), pa.array(full.view(np.int64)), pa.array(left.astype(np.int16)), pa.array(right.astype(np.int16))],
                ["t0", "t1", "position", "key", "full", "l", "r"],
            )

    every = written(named.mapInArrow(find, "t0 bigint, t1 bigint, position int, key bigint, full bigint, l smallint, r smallint"), "anchors")
    keys = every.groupBy("key").agg(F.count("*").alias("n"), F.min("full").alias("least"), F.max("full").alias("most"))
    # Written, as a join of two plain scans is one whose hot keys Spark splits.
    keys = written(keys.where("n > 1").select("key", (F.col("least") != F.col("most")).alias("mixed")), "keys")
    repeated = written(every.join(keys, "key"), "repeated")
    remove(every)
    mixed = repeated.where("mixed")
    classes = mixed.groupBy("key", "full").agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("t0", "t1", "position", "l", "r")))
    classes = written(classes, "classes")
    both = [F.col("l").cast("long"), F.col("r").cast("long")]
    removed = F.col("l") + F.col("r") >= WINDOW
    sides = [F.when(removed, c).otherwise(0).alias(n) for c, n in zip(both, SIDES, strict=False)] + [c.alias(n) for c, n in zip(both, SIDES[2:], strict=True)]
    whole = classes.where("n > 1").select("key", "full", *sides)
    partial = _partial(named, classes).unionByName(whole).groupBy("key", "full").agg(*(F.max(c).alias(f"p_{c}") for c in SIDES))
    partial = written(partial, "partial")
    found = mixed.join(partial, ["key", "full"]).select("t0", "t1", "key", "position", *(F.col(f"p_{c}").alias(c) for c in SIDES))
    found = found.union(repeated.where("NOT mixed").select("t0", "t1", "key", "position", *sides))
    at = F.col("position").cast("long")
    return found.select("t0", "t1", "key", "position", (at - F.col("l")).alias("start"), (at + F.col("r")).alias("stop"), (at - F.col("near_l")).alias("near_start"), (at + F.col("near_r")).alias("near_stop"))


def _named(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(text.alias("text")).withColumns({"t0": F.xxhash64("text"), "t1": F.xxhash64(F.lit("other"), "text")})


def _partial(named: DataFrame, classes: DataFrame) -> DataFrame:
    """(key, full, l, r, near_l, near_r) from comparing one suffix of each class with the others of its key."""
    # Written, so that Spark splits a hot key of the join below.
    sizes = written(classes.groupBy("key").agg(F.count("*").alias("size")), "sizes")
    wanted = classes.groupBy("t0", "t1").agg(F.collect_list(F.struct("position", "key", "full")).alias("at"))
    texts = named.groupBy("t0", "t1").agg(F.first("text").alias("text")).join(wanted, ["t0", "t1"]).select("text", "at")

    def surround(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", SEGMENT):
            out: list[list] = [[], [], [], []]
            for text, at in zip(texts_of(batch.column("text")), batch.column("at").to_pylist(), strict=True):
                for x in at:
                    p = x["position"]
                    for column, value in zip(out, (x["key"], x["full"], text[max(0, p - LEFT) : p][::-1], text[p + CORE : p + WINDOW]), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.binary())], ["key", "full", "before", "after"])

    rows = texts.mapInArrow(surround, "key bigint, full bigint, before binary, after binary")
    # A key with over BLOCK classes is cut into blocks; each pair of blocks is a place of its own.
    blocks = F.ceil(F.col("size") / BLOCK)
    own = F.pmod("full", blocks)
    other = F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))
    rows = rows.join(sizes, "key").select("key", "full", "before", "after", own.alias("own"), other.alias("other"))
    rows = rows.withColumn("place", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")))
    parts = int(named.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select("place", "key", "full", "before", "after").repartition(parts, "place").sortWithinPartitions("place", "after").mapInArrow(_cover_batches, "key bigint, full bigint, l bigint, r bigint, near_l bigint, near_r bigint")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of half-open spans as maximal runs."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) as (doc_id, n_bytes, n_removed, n_repeated, spans, kept): every byte covered by
    a WINDOW-byte string that also starts elsewhere is removed.

    n_repeated counts the bytes that a LEAST-byte string which also starts elsewhere covers: it
    tells shared passages that are too short to be removed. kept is the remaining bytes, spans the maximal removed runs (start, stop). A null text
    counts as empty; texts under WINDOW bytes lose nothing; a repeated row, being a copy of
    another, is removed whole like that other (each copy's strings start elsewhere too).
    Texts of any length go through in segments. An empty table gives an empty one.
    """
    spans = repeats(docs).groupBy("t0", "t1").agg(F.collect_set(F.struct("start", "stop", "near_start", "near_stop")).alias("found"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).withColumns({"t0": F.xxhash64("text"), "t1": F.xxhash64(F.lit("other"), "text")})
    rows = rows.join(spans, ["t0", "t1"], "left").select("doc_id", "text", "found")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", SEGMENT):
            out: list[list] = [[], [], [], [], []]
            for text, found in zip(texts_of(batch.column("text")), batch.column("found").to_pylist(), strict=True):
                runs = merged([(x["start"], x["stop"]) for x in found or () if x["stop"] > x["start"]])
                near = merged([(x["near_start"], x["near_stop"]) for x in found or ()])
                stops = [0, *(b for _, b in runs)]
                kept = b"".join(text[a:b] for a, b in zip(stops, [*(a for a, _ in runs), len(text)], strict=True))
                for column, value in zip(out, (len(text), len(text) - len(kept), sum(b - a for a, b in near), [{"start": a, "stop": b} for a, b in runs], kept), strict=True):
                    column.append(value)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], kind), pa.array(out[4], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_repeated", "spans", "kept"])

    return rows.mapInArrow(cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_repeated bigint, spans array<struct<start:bigint,stop:bigint>>, kept binary")


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's sizes and what is left of it, by its hash. Null texts are empty, repeated rows
    are removed whole, an empty table gives none."""
    cut = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_repeated", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def by_brute_force(texts: list[bytes]) -> list[tuple[int, int, int, int, str]]:
    """op7's figures for a few small texts, by counting all windows."""

    def covered(width: int) -> list[list[tuple[int, int]]]:
        seen: dict[bytes, int] = {}
        for t in texts:
            for p in range(len(t) - width + 1):
                seen[t[p : p + width]] = seen.get(t[p : p + width], 0) + 1
        return [merged([(p, p + width) for p in range(len(t) - width + 1) if seen[t[p : p + width]] > 1]) for t in texts]

    out = []
    for t, runs, near in zip(texts, covered(WINDOW), covered(LEAST), strict=True):
        stops = [0, *(b for _, b in runs)]
        kept = b"".join(t[a:b] for a, b in zip(stops, [*(a for a, _ in runs), len(t)], strict=True))
        out.append((len(t), len(t) - len(kept), sum(b - a for a, b in near), len(runs), hashlib.sha256(kept).hexdigest()))
    return out
