"""Token counts with a digest cache."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import exists, sliced, stage_path, table, written

#: Entries of a worker's memory of parts, about 100 MB; it starts anew when full.
MEMORY = 800_000
_PART = re.compile(r" *[^ ]+| +")


class PieceCounter:
    """Counts of a sentencepiece model, equal to encoding the whole text.

    If no piece has the space mark after another character, no merge crosses the start
    of a space run, so a text's tokens are those of its (spaces, word) parts; each
    distinct part is encoded once. Any other model, and a text that holds the mark
    itself, is encoded whole.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.memory: dict[str, int] = {}
        self.by_parts = not any("▁" in self.model.id_to_piece(i).lstrip("▁") for i in range(self.model.get_piece_size()))
        # The library may also squeeze spaces or rewrite characters; parts are taken only if this model leaves them.
        probe = [" a  b \t\nﬁ① c ", "  ", " x"]
        self.by_parts = self.by_parts and self._by_parts(probe) == self._whole(probe)

    def _whole(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(texts, num_threads=1)]

    @staticmethod
    def _split(text: str) -> tuple[list[str], int]:
        """The parts as texts of their own, and tokens besides. The library puts one space
        before a text; for a later part that is its own first one."""
        if "  " not in text and text[:1] != " " and text[-1:] != " ":
            return text.split(" "), 0
        first, *later = _PART.findall(text)
        return [first, *(p[1:] for p in later if p != " ")], later[-1:] == [" "]

    def _by_parts(self, texts: list[str]) -> list[int]:
        split = [self._split(t) if t else ([], 0) for t in texts]
        if len(self.memory) > MEMORY:
            self.memory = {}
        new = list(set().union(*(parts for parts, _ in split)).difference(self.memory))
        for at in range(0, len(new), 20_000):
            self.memory.update(zip(new[at : at + 20_000], self._whole(new[at : at + 20_000]), strict=True))
        return [sum(map(self.memory.__getitem__, parts)) + more for parts, more in split]

    def __call__(self, texts: list[str]) -> list[int]:
        plain = [t for t in texts if "▁" not in t] if self.by_parts else []
        rest = [t for t in texts if "▁" in t] if self.by_parts else texts
        counts, others = iter(self._by_parts(plain)), iter(self._whole(rest))
        return [next(counts if self.by_parts and "▁" not in t else others) for t in texts]


class JsonCounter:
    """Counts of a tokenizers .json file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()

    def __call__(self, texts: list[str]) -> list[int]:
        return [len(x.ids) for x in self.model.encode_batch(texts, add_special_tokens=False)]


_COUNTERS: dict[str, PieceCounter | JsonCounter] = {}


def counter(path: str) -> PieceCounter | JsonCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = (PieceCounter if path.endswith(".model") else JsonCounter)(path)
    return _COUNTERS[path]


def version(path: str) -> str:
    """Digest of the tokenizer's file: another file, another version."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()[:32]


def count_tokens(docs: DataFrame, tokenizer: str, cache: str | None = None) -> DataFrame:
    """docs with content_digest, n_bytes and n_tokens.

    cache is a Parquet folder (content_digest, tokenizer_digest, n_tokens) that grows by
    this call's misses and may be shared by runs and tokenizers; None takes a new one in
    the shared folder. One text of each missing digest is encoded (texts are pre-aggregated
    map-side, so a text with a third of all rows reaches the encoder once a task at most).

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows stay and get equal
    counts; an empty table gives an empty one. Columns of docs that are called like the
    three added ones are replaced.
    """
    spark = docs.sparkSession
    cache, tag = cache or stage_path(spark, "token-cache"), version(tokenizer)
    body = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.withColumns({"content_digest": F.unhex(F.sha2(body, 256)), "n_bytes": F.octet_length(body).cast("long")}).drop("n_tokens")
    texts = docs.select("content_digest", body.alias("text"))

    def known() -> DataFrame:
        rows = spark.read.schema("content_digest binary, tokenizer_digest string, n_tokens long").parquet(cache)
        return rows.where(F.col("tokenizer_digest") == tag).groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))

    if exists(spark, cache):
        texts = texts.join(known().select("content_digest"), "content_digest", "left_anti")
    misses = texts.groupBy("content_digest").agg(F.first("text").alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer)
        for batch in sliced(batches, "text"):
            n = count(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("content_digest"), pa.array([tag] * len(n)), pa.array(n, pa.int64())], ["content_digest", "tokenizer_digest", "n_tokens"])

    misses.mapInArrow(encode, "content_digest binary, tokenizer_digest string, n_tokens long").write.mode("append").parquet(cache)
    # Written, as Spark splits the hot digests of a join of two plain scans.
    return docs.join(written(known(), "known"), "content_digest", "left")


def op2_token_counts(spark: SparkSession, sf_dir: str, limit: int = 4096) -> DataFrame:
    """Every document's tokens by the library. Null texts are empty (0 tokens), repeated rows get equal
    counts and a row each, very long texts are encoded whole, an empty table gives none."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
