"""Spelling variants by full neighbourhoods.

For each word of the vocabulary all texts one edit away are generated over the observed alphabet:
every deletion, replacement and insertion. A neighbour that is itself a word is a near word; that is
an equi-join on the text, and no distance is computed.

A word of L letters has some 2 * L * letters neighbours, nearly none of them words. They are
generated as hashes: a word's hash is a sum of letter codes times powers of one factor, so those of
its neighbours come from sums over what stands before and after, for whole blocks of words at once.
A bitmap of the vocabulary's hashes, of MOST_BITS at most, drops what cannot be a word; the
rest is spelled out and joined exactly. A fuller bitmap lets more through to the join and loses none.

Forms lead to words at least RATIO times as frequent, so chains have no loops and are short;
their ends are found by pointer doubling.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MIX_A, mix, sliced, table, written

LEAST_LETTERS, LEAST_COUNT, RATIO = 7, 2, 10
#: Of so many (document, run) pairs one has a letter deleted.
SLIP = 31
#: Words a task counts before it sends the counts on, about 60 MB.
HELD = 400_000
#: The bitmap has 16 bits a word, within these bounds (powers of two): 32 MB at most.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 28
#: Words whose neighbours one task generates: some 20 seconds' work, whatever their bytes.
SHARE = 20_000
#: Letters of the neighbours that are sent at a time.
TEXTS = 1 << 22
#: Letters of a block of words.
BLOCK = 50_000
_FACTOR = int(MIX_A)
_RUN = re.compile(r"[a-zÀ-ÿ]+")


def slipped(doc: str, run: str) -> str:
    """The run, with one letter deleted if the draw of (document, run) says so."""
    h = zlib.crc32(f"{doc}:{run}".encode())
    if h % SLIP:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def vocabulary(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): the words of docs (doc_id, text) after slips, of at least so many letters and occurrences."""
    runs_of = re.compile(r"[a-zÀ-ÿ]{%d,}" % max(1, least_letters))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return batch

        for batch in sliced(batches, "text"):
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                name = "" if doc is None else str(doc)
                # Bytes know no letters but A-Z, so only these are lowered.
                for run, n in Counter(runs_of.findall((text or "").encode().lower().decode())).items():
                    word = slipped(name, run)
                    if len(word) >= least_letters:
                        held[word] += n
                if len(held) > HELD:
                    yield out()
        yield out()

    counted = docs.select("doc_id", "text").mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def codes(letters: np.ndarray) -> np.ndarray:
    """A 64-bit code of each letter (code point)."""
    return mix(letters.astype(np.uint64) + np.uint64(0x51ED270B))


def powers(n: int) -> np.ndarray:
    out = np.full(n, _FACTOR, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def points(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1)


def hashed(words: list[str]) -> np.ndarray:
    """The hashes of words of one length: sums of code times power of the place."""
    x = points(words)
    return mix((codes(x) * powers(x.shape[1])).sum(1, dtype=np.uint64))


def near_hashes(x: np.ndarray, alphabet: np.ndarray) -> Iterator[tuple[str, int, np.ndarray, np.ndarray]]:
    """(edit, letter, hashes by word and place, where they count) for all texts one edit from the words x (rows of code points).

    A text that several places give counts at the first: a letter in a run of its like is deleted, or put in, there.
    """
    p = powers(x.shape[1] + 1)
    term = codes(x) * p[:-1]
    before = np.zeros((len(x), x.shape[1] + 1), np.uint64)
    np.cumsum(term, axis=1, out=before[:, 1:])
    after = before[:, -1:] - before  # of the letters from each place on
    first = np.ones(x.shape, bool)
    first[:, 1:] = x[:, 1:] != x[:, :-1]
    yield "delete", 0, mix(before[:, :-1] + after[:, 1:] * np.uint64(pow(_FACTOR, -1, 1 << 64))), first
    whole, moved = before[:, -1:] - term, before + after * np.uint64(_FACTOR)
    for letter, code in zip(alphabet.tolist(), codes(alphabet), strict=True):
        other = x != letter
        yield "replace", letter, mix(whole + code * p[:-1]), other
        yield "insert", letter, mix(moved + code * p), np.concatenate([np.ones((len(x), 1), bool), other], 1)


def by_length(batches: Iterator[pa.RecordBatch]) -> Iterator[list[str]]:
    """Blocks of words of one length, of about BLOCK letters."""
    for batch in batches:
        held: dict[int, list[str]] = {}
        for word in batch.column("word").to_pylist():
            some = held.setdefault(len(word), [])
            some.append(word)
            if len(some) * len(word) >= BLOCK:
                yield held.pop(len(word))
        yield from held.values()


def bitmap(words: DataFrame, bits: int) -> np.ndarray:
    """One bit for each hash of a word. Tasks send 64 bits at a time, merged in a shuffle: bits / 64 rows at most."""
    mask = np.uint64(bits - 1)

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in by_length(batches):
            h = hashed(block) & mask
            mark = (np.uint64(1) << (h & np.uint64(63))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((h >> np.uint64(6)).view(np.int64)), pa.array(mark)], ["place", "mark"])

    rows = words.select("word").mapInArrow(marks, "place long, mark long").groupBy("place").agg(F.bit_or("mark").alias("mark")).toArrow()
    found = np.zeros(bits // 64, np.int64)
    found[rows["place"].to_numpy()] = rows["mark"].to_numpy()
    return found.view(np.uint64)


def near_words(words: DataFrame, size: int) -> DataFrame:
    """(word, n, near, near_n): the pairs of words (word, n; size rows) that are one edit apart, both ways."""
    spark = words.sparkSession
    # Letters of the runs' own range: 90 at most.
    alphabet = np.array([ord(r[0]) for r in words.select(F.explode(F.array_distinct(F.split("word", "")))).distinct().where("col <> ''").orderBy("col").collect()], np.uint32)
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << math.ceil(math.log2(16 * max(1, size)))))
    seen, mask = spark.sparkContext.broadcast(bitmap(words, bits)), np.uint64(bits - 1)

    def sent(pairs: list[tuple[str, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in pairs], pa.string()), pa.array([x for _, x in pairs], pa.string())], ["word", "near"])

    def generate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in by_length(batches):
            pairs: list[tuple[str, str]] = []
            most = max(1, TEXTS // len(block[0]))
            for edit, letter, h, counts in near_hashes(points(block), alphabet):
                h &= mask
                hit = counts & ((seen.value[h >> np.uint64(6)] >> (h & np.uint64(63))) & np.uint64(1)).astype(bool)
                for row, at in zip(*(x.tolist() for x in np.nonzero(hit)), strict=True):
                    w = block[row]
                    pairs.append((w, w[:at] + w[at + 1 :] if edit == "delete" else w[:at] + chr(letter) + w[at + (edit == "replace") :]))
                    if len(pairs) >= most:
                        yield sent(pairs)
                        pairs = []
            if pairs:
                yield sent(pairs)

    candidates = words.select("word").repartition(size // SHARE + 1, "word").mapInArrow(generate, "word string, near string")
    return candidates.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")


def follow(links: DataFrame, longest: int) -> DataFrame:
    """(word, root) for links (word, form) of chains of at most `longest` steps: each round doubles the step."""
    jump = links.select("word", F.col("form").alias("root"))
    step = 1
    while step < longest:
        more = jump.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jump = written(jump.join(more, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
        step *= 2
    return jump


def spelling_forms(docs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of docs (doc_id, text).

    form is the near word of largest n (ties: the smallest) if it is at least ratio times as frequent, root
    the end of the chain of forms. A null text has no words, a null doc_id draws slips as an empty one;
    repeated rows count as often as they stand; runs of any length are words; an empty table gives none;
    other columns are not read.
    """
    words = written(vocabulary(docs), "words")
    size, top = words.agg(F.count("*"), F.max("n")).first()
    pairs = near_words(words, size)
    order = F.struct((-F.col("near_n")).alias("o"), F.col("near").alias("near"))
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(order).alias("best"))
    frequent = -F.col("best.o") >= ratio * F.col("n")
    found = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(frequent, F.col("best.near")).alias("form"), F.when(frequent, -F.col("best.o")).alias("form_n")
    )
    found = written(found, "forms")
    # Every step multiplies n by ratio, so that is the most steps a chain has.
    roots = follow(found.where("form IS NOT NULL").select("word", "form"), math.ceil(math.log(max(2, top or 0), ratio)) if ratio > 1 else size)
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of `documents` with its form, root and counts. Null texts have no words, equal rows count
    each, ties of frequency go to the smallest word, very long runs are words, an empty table gives none."""
    return spelling_forms(table(spark, sf_dir, "documents"))
