"""Language identification by interpolated Kneser-Ney character models.

A text is lowered and all but letters become single spaces. For each language a model of
order 4 is learned from all training texts: counts are gathered as 64-bit codes of four
characters, smoothed with one discount an order estimated from the counts of counts, and
lower orders use continuation counts. The models are stored as sorted hash arrays, one an
order, with a row of probabilities for all languages. The language with the lowest
cross-entropy a character wins; unlike texts are rejected by a threshold that is set from
the spread of the training texts' own entropies.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import HashArray, fresh, mix, remove, sliced, table, written

ORDER = 4
#: N-grams under this share of their language's (types or tokens, as counted) are left to the
#: lower order, their mass included; so a model has at most 1 / LEAST_SHARE entries an order.
LEAST_SHARE = 1 / (1 << 18)
#: Bits of an unseen character.
UNSEEN_BITS = 17
#: Bits a character beyond the usual spread that a text of a known language may take: names, quotations, mixed text.
MARGIN = 1.0
UND = "und"
_GAP = re.compile(r"[\W\d_]+")


def normalised(text: str | None) -> str:
    return _GAP.sub(" ", text.lower()) if text else ""


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, starts): for each character its own and the three before it in 64 bits.

    Each text gets a space in front; codes of a text's first characters hold zeros before
    it. Characters beyond 16 bits are folded into the private-use area.
    """
    parts = [" " + t.strip() + " " if t else "" for t in texts]
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    starts = np.cumsum(size) - size
    c = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(c > 0xFFFF, 0xE000 + c % 6400, c).astype(np.uint64)
    out = c.copy()
    since = np.arange(len(c)) - np.repeat(starts, size)
    for k in range(1, ORDER):
        before = np.zeros(len(c), np.uint64)
        before[k:] = c[:-k] if k < len(c) else 0
        before[since < k] = 0
        out |= before << np.uint64(16 * k)
    return out, starts


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, code, n) of all four-character windows of the whole texts of docs (text, lang)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 1 << 20):
            by: dict[str, list[str]] = {}
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                by.setdefault(lang, []).append(normalised(text))
            for lang, texts in by.items():
                found, _ = codes(texts)
                found, n = np.unique(found[found >> np.uint64(48) > 0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "code", "n"])

    rows = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang").mapInArrow(run, "lang string, code bigint, n bigint")
    return rows.groupBy("lang", "code").agg(F.sum("n").alias("n"))


def smoothed(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((lang, k, code, p), (lang, k, context, rest)): discounted probabilities of kept n-grams
    of each order and the mass that each context leaves to the order below."""
    grams, rests = [], []
    level = counts
    for k in range(ORDER, 0, -1):
        stats = level.groupBy("lang").agg(F.sum("n").alias("total"), F.sum((F.col("n") == 1).cast("long")).alias("n1"), F.sum((F.col("n") == 2).cast("long")).alias("n2"))
        # Small or even tables may have no single counts; then a fixed discount.
        discount = F.when(F.col("n1") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.5)
        discount = F.least(F.lit(0.95), F.greatest(F.lit(0.05), discount))
        marked = level.join(F.broadcast(stats.select("lang", "total", discount.alias("d"))), "lang")  # a row a language
        context = F.shiftrightunsigned("code", 16)
        marked = marked.select("lang", "code", "n", "total", "d", context.alias("context"))
        sums = marked.groupBy("lang", "context").agg(F.sum("n").alias("all"))
        kept = marked.where(F.col("n") >= F.col("total") * LEAST_SHARE).join(sums, ["lang", "context"])
        kept = kept.withColumn("p", (F.col("n") - F.least(F.col("d"), F.col("n") * 0.95)) / F.col("all"))
        grams.append(kept.select("lang", F.lit(k).alias("k"), "code", "p"))
        rests.append(kept.groupBy("lang", "context").agg((1 - F.sum("p")).alias("rest")).select("lang", F.lit(k).alias("k"), "context", "rest"))
        # Continuation counts: how many different characters stand before the shorter n-gram.
        level = level.select("lang", F.col("code").bitwiseAND((1 << (16 * (k - 1))) - 1).alias("code")).groupBy("lang", "code").agg(F.count("*").alias("n"))
    g, r = grams[0], rests[0]
    for more, less in zip(grams[1:], rests[1:], strict=True):
        g, r = g.union(more), r.union(less)
    return g, r


class Model:
    """Interpolated log2 probabilities, orders as sorted hash arrays with a column a language."""

    def __init__(self, grams: pa.Table, rests: pa.Table):
        self.langs = sorted(set(grams["lang"].to_pylist()))
        self.grams, self.values, self.rests, self.left = {}, {}, {}, {}
        for k in range(1, ORDER + 1):
            self.rests[k], self.left[k] = self._columns(rests, k, "context", "rest", 1.0)
            self.grams[k], p = self._columns(grams, k, "code", "p", 0.0)
            code = self.codes
            below = np.full((1, len(self.langs)), 2.0**-UNSEEN_BITS) if k == 1 else self._p(code & np.uint64((1 << 16 * (k - 1)) - 1), k - 1)
            self.values[k] = (p + self._rest(code, k) * below).astype(np.float32)

    def _columns(self, rows: pa.Table, k: int, code: str, value: str, absent: float) -> tuple[HashArray, np.ndarray]:
        at = np.flatnonzero(rows["k"].to_numpy() == k)
        raw = rows[code].to_numpy()[at].view(np.uint64)
        lang = np.searchsorted(self.langs, np.array(rows["lang"].to_pylist(), dtype=object)[at].astype(str)) if len(at) else at
        hashes, place = np.unique(mix(raw), return_inverse=True)
        out = np.full((len(hashes), len(self.langs)), absent)
        out[place, lang] = rows[value].to_numpy()[at]
        self.codes = np.zeros(len(hashes), np.uint64)
        self.codes[place] = raw
        return HashArray(hashes), out

    def _rest(self, code: np.ndarray, k: int) -> np.ndarray:
        at = self.rests[k].find(mix(code >> np.uint64(16)))
        return np.where((at < 0)[:, None], 1.0, self.left[k][at])

    def _p(self, code: np.ndarray, k: int) -> np.ndarray:
        """(n, languages) probabilities of the last character of each k-gram."""
        if k == 0:
            return np.full((len(code), len(self.langs)), 2.0**-UNSEEN_BITS)
        at = self.grams[k].find(mix(code))
        out = self.values[k][at] if len(self.values[k]) else np.zeros((len(code), len(self.langs)))
        miss = np.flatnonzero(at < 0)
        if len(miss):
            out[miss] = self._rest(code[miss], k) * self._p(code[miss] & np.uint64((1 << 16 * (k - 1)) - 1), k - 1)
        return out

    def bits(self, code: np.ndarray) -> np.ndarray:
        """(n, languages) bits of each code's last character; codes with zeros use a lower order."""
        out = np.empty((len(code), len(self.langs)), np.float32)
        full = code >> np.uint64(48) > 0
        out[full] = self._p(code[full], ORDER)
        for k in range(1, ORDER):
            here = np.flatnonzero(~full & (code >> np.uint64(16 * k) == 0) & (code >> np.uint64(16 * (k - 1)) > 0))
            out[here] = self._p(code[here], k)
        return -np.log2(np.maximum(out, 1e-12))


def fit(docs: DataFrame) -> Model | None:
    """A model of every language in docs (text, lang); None if there is nothing to learn from.

    Rows with a null text or lang teach nothing, repeated rows teach as often as they occur,
    letterless texts teach nothing, other columns are not read.
    """
    counts = written(gram_counts(docs), "gram-counts")
    grams, rests = smoothed(counts)
    g = grams.toArrow()  # bounded by LEAST_SHARE for each language and order
    if not g.num_rows:
        return None
    model = Model(g, rests.toArrow())
    remove(counts)
    return model


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with lang_pred, entropy (bits a character, the best language's), margin (bits a
    character to the next language) and n_letters. und, null entropy: no letter.

    Columns of docs with these four names are replaced, all others pass through. Null, empty
    and letterless texts are und; of languages with equal bits the first by name is taken;
    repeated rows are scored each, very long texts whole; without a model (fit gave None) all
    are und with a null entropy.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    columns = [c for c in docs.columns if c not in ("lang_pred", "entropy", "margin", "n_letters")]
    docs = docs.select(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in sliced(batches, "text", 1 << 18):
            texts = [normalised(t) for t in batch.column("text").to_pylist()]
            letters = np.array([any(map(str.isalpha, set(t))) for t in texts], bool)
            texts = [t if ok else "" for t, ok in zip(texts, letters, strict=True)]
            n = np.fromiter((len(t.strip()) + 1 for t in texts), np.int64, len(texts))
            pred, entropy, margin = [UND] * len(texts), np.full(len(texts), np.nan), np.zeros(len(texts))
            at = np.flatnonzero(letters)
            if m is not None and len(at):
                code, starts = codes([texts[i] for i in at])
                bits = m.bits(code)
                bits[starts] = 0  # the space in front is given
                h = np.add.reduceat(bits, starts, axis=0, dtype=np.float64) / n[at][:, None]
                best = h.argmin(1)
                entropy[at] = h[np.arange(len(at)), best]
                if len(m.langs) > 1:
                    margin[at] = np.partition(h, 1, axis=1)[:, 1] - entropy[at]
                for i, b in zip(at.tolist(), best.tolist(), strict=True):
                    pred[i] = m.langs[b]
            added = [pa.array(pred), pa.array(entropy, mask=np.isnan(entropy)), pa.array(margin), pa.array(np.where(letters, n - 1, 0))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *added], [*columns, "lang_pred", "entropy", "margin", "n_letters"])

    added = T.StructType().add("lang_pred", "string").add("entropy", "double").add("margin", "double").add("n_letters", "long")
    schema = T.StructType([*docs.schema.fields, *added.fields])
    return docs.mapInArrow(run, schema)


def confidence() -> Column:
    """0 to 1: how the best language's likelihood stands against the next one's, by at most 100 characters."""
    gap = F.least(F.col("n_letters"), F.lit(100)) * F.col("margin")
    return F.when(F.col("entropy").isNull(), 0.0).otherwise(1 / (1 + F.pow(F.lit(2.0), -F.least(gap, F.lit(60.0)))))


def unlike(scored: DataFrame, training: Column) -> DataFrame:
    """scored with rejected: no letters, or more bits a character than the training texts of
    that language explain: MARGIN and six spreads above their median, a spread being their own
    (MAD) and that of a mean over so few characters (about 3 bits a character).

    A column called rejected is replaced, all others are kept. A language with one training
    text has no spread of its own; without any training text only those without a letter go.
    """
    med, mad = fresh(scored, "med"), fresh(scored, "mad")
    of = scored.where(training & F.col("entropy").isNotNull()).select("lang_pred", "entropy")
    middle = of.groupBy("lang_pred").agg(F.percentile_approx("entropy", 0.5, 1000).alias(med))
    spread = of.join(F.broadcast(middle), "lang_pred")  # a row a language
    spread = spread.groupBy("lang_pred").agg(F.first(med).alias(med), F.percentile_approx(F.abs(F.col("entropy") - F.col(med)), 0.5, 1000).alias(mad))
    out = scored.join(F.broadcast(spread), "lang_pred", "left")
    most = F.col(med) + MARGIN + 6 * (1.4826 * F.col(mad) + 3 / F.sqrt(F.col("n_letters") + 1))
    return out.withColumn("rejected", F.col("entropy").isNull() | F.coalesce(F.col("entropy") > most, F.lit(False))).drop(med, mad)


def held_out(parts: int, part: int) -> Column:
    """Whether crc32 of doc_id as text leaves `part`; a null doc_id does not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts == part, F.lit(False))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every document; learned from those not
    held out. Null and letterless texts are und with score 0; repeated rows each get a row; without labelled
    documents, or in an empty table, no language is learned."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out(4, 2)))
    scored = score(docs.select("doc_id", "text"), model).drop("text").withColumn("held_out", held_out(4, 2))
    scored = written(scored, "scored")
    return unlike(scored, ~F.col("held_out")).select("doc_id", "held_out", "lang_pred", confidence().alias("score"), "rejected")
