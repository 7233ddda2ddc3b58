"""Hierarchical packing: several context sizes, exact fills and balanced step groups.

A document's ids are cut into full windows of the largest size and a rest. The rest goes to the
least of TIERS that holds it. In each shard the tiers are packed from the longest to the
shortest: a rest opens a window of its tier, the gap is filled with the longest shorter rests that
fit, and what is then still open with the head of the shortest rest that is longer (its tail goes
back to the tier of its length). So every window is full; only the tokens that are left when a
shard has no more rests are dealt to sequences of powers of two.

Sequences of one tier form step groups of STEP_TOKENS tokens. As the dearest sequence sets
the time of a step, sequences of like attention cost (sum of squared piece lengths) meet.

Only rests travel, at most 4 KB a document; full windows send their checksum, spread over
all shards, so a very long document is no hot key.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sliced, table

TIERS = (64, 128, 256, 512, 1024)
#: Documents whose rests are packed together.
SHARD = 4_096
#: Rests that are packed at once: some 256 MB. A shard comes to it only by tens of thousands of rows equal in id and text.
MOST = 1 << 16
#: Tokens of a step group.
STEP_TOKENS = 8_192
#: Entries of a worker's memory of parts, about 150 MB; it starts anew when full.
MEMORY = 800_000
#: Parts that are encoded in one call.
TOGETHER = 500
#: Marks that are split from the end of a part.
MARKS = ",.;:!?%\"\n#$&*()[]{}<>/+-=_~^|@"
#: Letters and digits after which they are split.
SOLID = frozenset(chr(c) for c in range(0x100) if chr(c).isalnum() and (c < 0x80 or c >= 0xC0))
#: Characters that are split at once.
PART = 1 << 20
CUT = "shard long, doc_id long, doc_tokens long, start long, length long, ids_crc32 long, ids binary"
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier long, step_group long"
CUT_NAMES, NAMES = ([x.split()[0] for x in s.split(", ")] for s in (CUT, SCHEMA))

# A space with white space before it, and after it white space or nothing, is no sure start of a token.
_DOUBTFUL = re.compile(r"[\s᠎] (?:[\s᠎]|\Z)")
# A line feed between characters that are no white space is a token of its own.
_LINE = re.compile(r"(?<=[^\s᠎])\n(?=[^\s᠎])")
_SURE = re.compile(r"(?<=[^\s᠎]) (?=[^\s᠎])")


class ByteIds:
    """Ids of a byte-level BPE file, equal to encoding the whole text, as little-endian 32-bit bytes.

    This kind of tokenizer never joins a space to what stands before it, so a text's ids are
    those of its parts, each with the space before it; each distinct part is encoded once. Where a
    run of white space might go over a cut, only spaces between other characters cut. Other kinds
    of tokenizers, and texts with a special string, are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.special = [x.content for x in self.model.get_added_tokens_decoder().values()]
        kind = type(self.model.pre_tokenizer).__name__
        self.by_parts = kind == "ByteLevel" and self.model.normalizer is None and not self.model.pre_tokenizer.add_prefix_space
        self.memory: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        self.lines: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_parts(self, parts: list[str]) -> Iterator[bytes]:
        """Ids of each part. Many go in one call, a special string between any two: it ends a part as the end of a text does,
        and its id marks the places, as texts that hold one do not come here."""
        if not self.special:
            yield from self._encode(parts)
            return
        mark = self.model.token_to_id(self.special[0])
        for ids in self._encode([self.special[0].join(parts[at : at + TOGETHER]) for at in range(0, len(parts), TOGETHER)]):
            cuts = (4 * np.flatnonzero(np.frombuffer(ids, "<u4") == mark)).tolist()
            yield from (ids[a:b] for a, b in zip([0, *(c + 4 for c in cuts)], [*cuts, len(ids)], strict=True))

    def _parts(self, text: str) -> list[str]:
        return _SURE.split(text) if _DOUBTFUL.search(text) else text.split(" ")

    def _pieces(self, text: str) -> Iterator[list[str]]:
        """Lists of parts, of about PART characters each."""
        at = 0
        while len(text) - at > 2 * PART and (m := _SURE.search(text, at + PART)):
            yield self._parts(text[at : m.start()])
            at = m.end()
        yield self._parts(text[at:])

    def _learn(self, new: set[str], memory: dict[str, bytes], before: str) -> None:
        """Add the ids of new parts, with the character before them. Marks after a letter or digit are tokens of their own,
        so a part is known by what stands before them and by the marks; only what stands before is encoded for each part."""
        cut = {w: base for w in new if (base := w.rstrip(MARKS)) != w and base and base[-1] in SOLID}
        tails = {w[len(base) :] for w, base in cut.items()}.difference(self.tails)
        words = list(({cut.get(w, w) for w in new}).difference(memory))
        memory.update(zip(words, self._encode_parts([before + x for x in words]), strict=True))
        if tails:
            self.tails.update(zip(tails, self._encode(list(tails)), strict=True))
        memory.update((w, memory[base] + self.tails[w[len(base) :]]) for w, base in cut.items())

    def _learn_lines(self, new: set[str]) -> None:
        """Add the ids of new parts; one of several lines has those of its lines."""
        several = {w: lines for w in new if "\n" in w and len(lines := _LINE.split(w)) > 1}
        if first := {several[w][0] if w in several else w for w in new}.difference(self.memory):
            self._learn(first, self.memory, " ")
        if later := {x for lines in several.values() for x in lines[1:]}.difference(self.lines):
            self._learn(later, self.lines, "\n")
        self.memory.update((w, b"".join([self.memory[lines[0]], *(self.lines[x] for x in lines[1:])])) for w, lines in several.items())

    def __call__(self, text: str) -> bytes:
        if not self.by_parts or any(x in text for x in self.special):
            return self._encode([text])[0]
        found = []
        for parts in self._pieces(text):
            if len(self.memory) + len(self.lines) > MEMORY:
                self.memory, self.tails, self.lines = {}, {}, {}
            later = parts if found else parts[1:]
            ids = list(map(self.memory.get, later))
            if new := [i for i, x in enumerate(ids) if x is None]:
                self._learn_lines({later[i] for i in new})
                for i in new:
                    ids[i] = self.memory[later[i]]
            if not found:
                found.append(self._encode([parts[0]])[0] if parts[0] else b"")
            found.append(b"".join(ids))
        return b"".join(found)


    def many(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. Parts are looked up once for all texts that are cut at every space."""
        plain = [i for i, t in enumerate(texts) if self.by_parts and len(t) <= PART and not _DOUBTFUL.search(t) and not any(x in t for x in self.special)]
        out = dict.fromkeys(range(len(texts)), b"")
        if plain:
            split = pc.split_pattern(pa.array([texts[i] for i in plain], pa.large_string()), " ")
            coded, offsets = split.flatten().dictionary_encode(), split.offsets.to_numpy().astype(np.int64)
            parts, index = coded.dictionary.to_pylist(), coded.indices.to_numpy().copy()
            if len(self.memory) + len(self.lines) > MEMORY:
                self.memory, self.tails, self.lines = {}, {}, {}
            self._learn_lines({x for x in parts if x not in self.memory})
            known = pa.array([*map(self.memory.__getitem__, parts), b""], pa.large_binary())
            # A text's first part has no space before it.
            first = [parts[k] for k in index[offsets[:-1]].tolist()]
            begin = dict(zip(distinct := list(set(first)), self._encode(distinct), strict=True))
            index[offsets[:-1]] = len(parts)
            joined = known.take(pa.array(index))
            whole, stop = memoryview(joined.buffers()[2] or b""), np.frombuffer(joined.buffers()[1], np.int64)
            bounds = stop[offsets].tolist()
            out |= {i: b"".join((begin[x], whole[a:b])) for i, x, a, b in zip(plain, first, bounds, bounds[1:], strict=False)}
        for i in set(out).difference(plain):
            out[i] = self(texts[i])
        return list(out.values())


_MODELS: dict[str, ByteIds] = {}


def model_of(path: str) -> ByteIds:
    if path not in _MODELS:
        _MODELS[path] = ByteIds(path)
    return _MODELS[path]


def fill(lengths: Sequence[int], tiers: Sequence[int] = TIERS) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
    """(size, its pieces) of each sequence; a piece is (number of the length, first token in it, tokens).
    1 <= lengths <= max(tiers). Every size is a tier but the last ones, powers of two that hold what is left."""
    by_length: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for i in range(len(lengths) - 1, -1, -1):
        by_length[lengths[i]].append((i, 0))
    have = sum(1 << n for n in by_length)  # a bit for each length that is there

    def take(n: int) -> tuple[int, int, int]:
        nonlocal have
        i, first = by_length[n].pop()
        if not by_length[n]:
            have ^= 1 << n
        return i, first, n

    while have:
        longest = have.bit_length() - 1
        size = next(t for t in sorted(tiers) if t >= longest)
        pieces, room = [take(longest)], size - longest
        while room and have:
            if fits := have & ((2 << room) - 1):
                pieces.append(take(fits.bit_length() - 1))
                room -= pieces[-1][2]
            else:
                i, first, n = take((have & -have).bit_length() - 1)
                pieces.append((i, first, room))
                by_length[n - room].append((i, first + room))
                have |= 1 << (n - room)
                room = 0
        if not room:
            yield size, pieces
            continue
        left = size - room
        while left:
            size, part = 1 << (left.bit_length() - 1), []
            left -= size
            while size:
                i, first, n = pieces.pop(0)
                part.append((i, first, min(n, size)))
                if n > size:
                    pieces.insert(0, (i, first + size, n - size))
                size -= part[-1][2]
            yield sum(x[2] for x in part), part


def groups_of(sizes: np.ndarray, costs: np.ndarray) -> np.ndarray:
    """The step group of each sequence: STEP_TOKENS tokens of one size (the last of a size may have
    fewer), the dearest sequences together."""
    order = np.lexsort((-costs, -sizes))
    ordered = sizes[order]
    starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(order) else np.empty(0, int)
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    inside = rank // np.maximum(1, STEP_TOKENS // np.maximum(ordered, 1))
    new = np.append(True, (np.diff(inside) != 0) | (np.diff(ordered) != 0)) if len(order) else np.empty(0, bool)
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    return group


def pack_tiers(docs: DataFrame, tokenizer: str, end: int = 0, tiers: Sequence[int] = TIERS) -> DataFrame:
    """Pieces (SCHEMA) of docs (doc_id, text): each document's ids and then end, each id in one piece.

    A null text is empty (its end alone). Repeated rows and null doc_ids are packed as rows of their
    own; very long texts are cut into full windows and a rest; an empty table gives none; other columns
    are not carried. Sequences are full: their tokens are a tier or, at a shard's end, a power of two.
    sequence_id and step_group are unique in the result: the shard, then a number in it.
    """
    most = max(tiers)
    shards = docs.count() // SHARD + 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, last = model_of(tokenizer), np.array([end], "<u4").tobytes()
        for batch in sliced(batches, "text"):
            out: list[tuple] = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), model.many([x or "" for x in batch.column("text").to_pylist()]), strict=True):
                ids += last
                n = len(ids) // 4
                key = zlib.crc32(ids, zlib.crc32(str(doc).encode()))
                for at in range(0, n, most):
                    some = ids[4 * at : 4 * (at + most)]
                    full = len(some) == 4 * most
                    out.append(((key + (at // most) * 0x9E3779B1) % shards, doc, n, at, len(some) // 4, zlib.crc32(some), None if full else some))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64()] * 6 + [pa.binary()], strict=True)], CUT_NAMES)

    def flush(shard: int, first: tuple[int, int], rows: list[pa.RecordBatch]) -> tuple[pa.RecordBatch, tuple[int, int]]:
        t = pa.Table.from_batches(rows)
        doc, tokens, start, crc = (t[c].to_pylist() for c in ("doc_id", "doc_tokens", "start", "ids_crc32"))
        ids = t["ids"].to_pylist()
        rest = [i for i, x in enumerate(ids) if x is not None]
        packed = [(most, [(i, 0, most)]) for i, x in enumerate(ids) if x is None]
        packed += [(size, [(rest[k], a, n) for k, a, n in pieces]) for size, pieces in fill([len(ids[i]) // 4 for i in rest], tiers)]
        sizes = np.array([s for s, _ in packed], np.int64)
        group = groups_of(sizes, np.array([sum(n * n for _, _, n in pieces) for _, pieces in packed], np.int64)).tolist()
        out = []
        for s, (size, pieces) in enumerate(packed):
            offset = 0
            for i, a, n in pieces:
                check = crc[i] if ids[i] is None else zlib.crc32(ids[i][4 * a : 4 * (a + n)])
                out.append((doc[i], start[i] + a, n, check, tokens[i], (shard << 32) + first[0] + s, offset, size, (shard << 32) + first[1] + group[s]))
                offset += n
        columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
        return pa.RecordBatch.from_arrays(columns, NAMES), (first[0] + len(packed), first[1] + max(group) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        shard, first, rows = -1, (0, 0), 0
        for batch in batches:
            ids = batch.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if held and (ids[a] != shard or rows >= MOST):
                    out, first = flush(shard, first, held)
                    yield out
                    held, rows = [], 0
                if ids[a] != shard:
                    shard, first = int(ids[a]), (0, 0)
                held.append(batch.slice(a, b - a))
                rows += b - a
        if held:
            yield flush(shard, first, held)[0]

    pieces = docs.select("doc_id", "text").mapInArrow(cut, CUT)
    parts = min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), shards)
    ordered = pieces.repartition(parts, "shard").sortWithinPartitions("shard", F.desc("length"), "doc_id", "start", "ids_crc32", "doc_tokens")
    return ordered.mapInArrow(run, SCHEMA)


def op11_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by their ids of byte_bpe_50k.json and an end (0), in sequences of at most 1,024 tokens.
    Null texts are their end alone, equal rows are packed each, very long texts are cut, an empty table
    gives no piece."""
    import public_tokenizers

    return pack_tiers(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
