"""Language-model scores by online logistic context mixing over bits.

A text is its UTF-8 bytes and an end mark. Each byte is predicted bit by bit. Predictors are
the bit counts, over all training texts, in the contexts of the last 0 to 5 bytes of the running
text (spaces do not end a context), and a long match: where the last MATCH bytes stand in
another training text too, the byte that followed there. Their stretched predictions are added
with weights from two gates: the bit's place with the longest known context and how well it
is known, and the bit's place with the match's length and frequency. A last table refines the
mixed prediction by what followed it so far.

Weights and refinement are learned online, in text order: a block of texts is scored with what
the blocks before it taught, then its training texts teach. A training text leaves one count of
itself out, and is never matched with itself alone.

Nothing of the model is broadcast, so it may grow with the corpus. Texts are dealt to slices
of about SLICE bytes; each slice asks for the contexts, matches and words that stand in it, is
sent their counts as arrays, and is scored by one task that streams over its texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MIX_A, HashArray, mix, sliced, table, texts_of, written, written_alone
from .langid import held_out

#: Contexts of 0 to BYTES bytes.
BYTES = 5
ORDERS = BYTES + 1
INPUTS = ORDERS + 2
#: A match starts where the last MATCH bytes end in one of 1 / ANCHORS places; it foretells AHEAD bytes.
MATCH, ANCHORS, AHEAD = 24, 128, 64
#: Bytes of text in a slice, in a block that is scored at once, and that teach the starting weights.
SLICE, BLOCK, WARM = 64 << 20, 2 << 20, 1 << 20
#: Contexts of a block that are mixed at once, so that their numbers stay in a processor's cache.
TILE = 1 << 14
#: How often the first texts are gone through for the starting weights.
TURNS = 3
#: Contexts or words that a worker holds before it sends them on, bytes of text that it counts at once, buckets of
#: counts for each partition, and how many last bytes choose the bucket of longer contexts.
GRAMS, PIECE, BUCKETS_EACH, NEAR = 1 << 20, 1 << 20, 4, 3
#: Levels of confidence by a context's count.
LEVELS = np.array([0, 1, 2, 4, 16, 256])
GATES = (ORDERS + 1) * len(LEVELS)
MATCHES = 8
STEP = 12.0
MOST = 11.5
BUCKETS = 33
END = b"\xff"
#: White space and the end mark part words; letters count as their lower-case form, each by a number of its own.
SPACE = np.isin(np.arange(256), [*range(9, 14), 32, 255])
_NUMBERS = np.random.default_rng(5).integers(1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)
LETTERS = _NUMBERS[LOWER]
POWER, LONG = np.uint64(0x9E3779B97F4A7C15), 32
#: The first bytes of eight, by how many.
KEPT = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Kinds of a slice's rows: those of each order come first, by their number.
AHEADS, WORDS, TEXTS = range(ORDERS, ORDERS + 3)
ROLE = 48
WIDE = 1 << 32
COUNTED = "bucket int, kind int, slice int, ids binary, n binary, ahead binary"
ANSWERS = "slice int, kind int, ids binary, v binary, levels binary, n bigint, id bigint"
#: What a slice may be given a row each.
ROWS = pa.schema([("kind", pa.int32()), ("id", pa.int64()), ("v", pa.int64()), ("n", pa.int64()), ("ahead", pa.binary())])
COUNTED_NAMES, ANSWER_NAMES = ([x.split()[0] for x in t.split(", ")] for t in (COUNTED, ANSWERS))


def words_at(buffer: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on, as one number."""
    n = max(0, len(buffer) - 7)
    out = np.empty(n, np.uint64)
    for r in range(min(8, n)):
        m = (n - r + 7) // 8
        out[r::8] = np.frombuffer(buffer.data, np.uint64, m, r)
    return out


def framed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, sizes) of the texts, each with its end mark."""
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    return np.frombuffer(END.join([*texts, b""]), np.uint8), np.cumsum(size) - size, size


def codes_of(b: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each byte the BYTES before it in its text (0 before the text) and itself, in 48 bits."""
    out = words_at(np.append(np.zeros(7, np.uint8), b)).byteswap(inplace=True)
    out &= np.uint64((1 << 8 * ORDERS) - 1)
    for j in range(BYTES):  # bytes of the text before are none of this one's
        at = starts[size > j] + j
        out[at] &= np.uint64((1 << 8 * (j + 1)) - 1)
    return out


def turned(code: np.ndarray) -> np.ndarray:
    """Codes with their context the other way round, the last byte first, above the byte itself: in that order contexts with
    the same last bytes stand together. A bit ROLE stays where it is."""
    swapped = (code << np.uint64(16)).byteswap()
    own, role = np.uint64((1 << 8 * BYTES) - 1), np.uint64(1 << ROLE)
    return (swapped & own) << np.uint64(8) | swapped >> np.uint64(8 * BYTES) | code & role


def turned_back(code: np.ndarray) -> np.ndarray:
    """The codes of turned codes."""
    own, role = np.uint64((1 << 8 * BYTES) - 1), np.uint64(1 << ROLE)
    return (code >> np.uint64(8) & own | (code & np.uint64(255)) << np.uint64(8 * BYTES)).byteswap() >> np.uint64(16) | code & role


def shorter(k: int) -> np.uint64:
    """What remains of a turned code of the longest order in order k: byte, last k bytes and role."""
    return np.uint64(((1 << 8 * k) - 1) << 8 * (ORDERS - k) | 255 | 1 << ROLE)


def firsts(x: np.ndarray) -> np.ndarray:
    """Where the runs of equal numbers begin."""
    return np.flatnonzero(np.append(True, x[1:] != x[:-1])[: len(x)])


def packed(x: np.ndarray) -> bytes:
    """Numbers, compressed: how many, then all their first bytes, their second bytes and so on, so that rising or small
    numbers take little of disk and network. A table of bytes is left in its order."""
    planes = x if x.ndim > 1 else x.view(np.uint8).reshape(len(x), x.itemsize).T
    return len(x).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(planes), "zstd", asbytes=True)


def unpacked(data: bytes | pa.Buffer, kind: type, width: int = 0) -> np.ndarray:
    """What packed() was given: numbers of that kind, or a table of bytes of that width."""
    n, size = int.from_bytes(data[:8], "little"), width or np.dtype(kind).itemsize
    plain = np.frombuffer(pa.decompress(memoryview(data)[8:], n * size, "zstd"), np.uint8)
    return plain.reshape(n, width) if width else np.ascontiguousarray(plain.reshape(size, n).T).view(kind).ravel()


def hashed(ahead: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of AHEAD bytes."""
    out = np.zeros(len(ahead), np.uint64)
    for x in ahead.view(np.uint64).T:
        out = mix(out ^ x) + np.uint64(1)
    return out


def anchors_of(b: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, key, text) of the places whose last 8 bytes choose them; key names the last MATCH bytes."""
    words = words_at(b)
    if len(words) <= MATCH:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    # A place is chosen by the top bits of a product of its last 8 bytes; chosen: where the MATCH bytes begin.
    chosen = np.flatnonzero(words[MATCH - 8 :] * MIX_A < np.uint64((1 << 64) // ANCHORS))
    at = chosen + MATCH
    of = np.searchsorted(starts, chosen, "right") - 1
    inside = at < starts[of] + size[of]
    chosen, at, of = chosen[inside], at[inside], of[inside]
    key = np.zeros(len(chosen), np.uint64)
    for k in range(0, MATCH, 8):
        key = mix(key ^ words[chosen + k]) + np.uint64(k + 1)
    return at, key, of


def aheads_at(b: np.ndarray, place: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The AHEAD bytes from each place on, zeros from stop on."""
    at = place[:, None] + np.arange(AHEAD)
    return np.where(at < stop[:, None], b[np.minimum(at, len(b) - 1)], np.uint8(0))


def words_of(b: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ends) of framed bytes: the 64-bit hash of each lower-cased word, as a signed number, and for
    each text how many words there are up to its end."""
    solid = ~SPACE[b]
    edge = np.diff(solid.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    first, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    ends = np.append(np.searchsorted(first, starts[1:]), len(first))
    if not len(first):
        return np.empty(0, np.int64), ends
    size = stop - first
    h = size.astype(np.uint64)
    words = words_at(np.append(LOWER[b], np.zeros(8, np.uint8)))
    # Eight bytes at a time; the rest of a word that is longer than LONG by a sum of all its letters.
    on = np.arange(len(h))
    for k in range(0, LONG, 8):
        on = on[size[on] > k]
        if not len(on):
            break
        part = words[first[on] + k] & KEPT[np.minimum(size[on] - k, 8)]
        h[on] = mix(h[on] ^ part) + np.uint64(k + 1)
    on = on[size[on] > LONG]
    if len(on):
        size = size[on]
        begin = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - np.repeat(begin, size)
        powers = np.cumprod(np.full(int(size.max()), POWER, np.uint64))
        h[on] ^= np.add.reduceat(LETTERS[b[np.repeat(first[on], size) + place]] * powers[place], begin)
    return mix(h).view(np.int64), ends


def paths(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """(full, less, level, level less): for each (context, byte), sorted, the stretched predictions
    on the byte's path of eight bits, eight numbers of one byte each in a long, from counts n of
    all bytes of the context; less: with one count of the byte itself left out. Codes may be turned."""
    full, less = np.zeros((len(code), 8), np.int8), np.zeros((len(code), 8), np.int8)
    own = np.minimum(n, 1)
    stretch = lambda one, zero: np.clip(np.rint(STEP * np.log((one + 0.4) / (zero + 0.4))), -127, 127)
    for j in range(8):
        node = code >> np.uint64(8 - j)
        start = np.concatenate([[0], np.flatnonzero(node[1:] != node[:-1]) + 1])
        bit = (code >> np.uint64(7 - j) & np.uint64(1)).astype(np.int64)
        each = np.diff(np.append(start, len(code)))
        total = np.repeat(np.add.reduceat(n, start), each)
        one = np.repeat(np.add.reduceat(n * bit, start), each)
        zero = total - one
        full[:, j] = stretch(one, zero)
        less[:, j] = stretch(one - bit * own, zero - (1 - bit) * own)
        if j == 0:
            levels = [(np.searchsorted(LEVELS, x, "right") - 1).astype(np.int16) for x in (total, total - own)]
    return full.view(np.int64).ravel(), less.view(np.int64).ravel(), *levels


class Mixer:
    """The weights of both gates and the refining table, learned online."""

    def __init__(self):
        self.by_context = np.full((8 * GATES, INPUTS), 0.25, np.float32)
        self.by_context[:, ORDERS:] = 0
        self.by_match = np.zeros((8 * MATCHES, INPUTS), np.float32)
        self.by_match[:, ORDERS] = 2
        grid = 1 / (1 + np.exp(-np.linspace(-MOST, MOST, BUCKETS)))
        self.ones, self.seen = np.tile(20 * grid, 8 * GATES), np.full(8 * GATES * BUCKETS, 20.0)
        self.blocks = 0

    @staticmethod
    def _teach(weights: np.ndarray, sums: np.ndarray, rate: float) -> None:
        """One step for each gate; sums: its errors by input, and the curves of these."""
        weights += rate * np.clip(sums[:, 0] / (sums[:, 1] + 1), -1, 1)

    def block(self, byte: np.ndarray, vectors: np.ndarray, gate: np.ndarray, expected: np.ndarray, match: np.ndarray, n: np.ndarray) -> np.ndarray:
        """log10 probabilities of bytes (vectors: bytes x orders x bits), scored before they teach; n: how
        often each is in a training text of the block."""
        # A match holds until the bit that it foretells wrongly. Sorted by gate, match and that bit, the longest first, the
        # rows of a gate and those for which a match still holds stand together at every bit.
        held = 8 - np.frexp((byte ^ expected).astype(np.float32))[1]
        order = np.argsort(((gate * MATCHES + match) * 9 + 8 - held).astype(np.int16), kind="stable")
        byte, gate, expected, match, held = (x.astype(np.int32)[order] for x in (byte, gate, expected, match, held))
        w = n[order].astype(np.float32)
        learns = bool(w.any())
        rate = max(0.02, 0.4 / (1 + self.blocks / 3))
        x = np.empty((INPUTS, TILE), np.float32)
        x[-1] = 0.3
        out = np.empty(len(byte))
        table = (self.ones / self.seen).astype(np.float32).reshape(8, -1)
        sums = [np.zeros((*y.reshape(8, -1, INPUTS).shape[:2], 2, INPUTS), np.float32) for y in (self.by_context, self.by_match)]
        seen = np.zeros((8, GATES * BUCKETS, 2))
        for at in range(0, len(byte), TILE):
            here = slice(at, at + TILE)
            self._tile(byte[here], vectors[order[here]], gate[here], expected[here], match[here], held[here], w[here], x, table, sums if learns else None, seen, out[here])
        if learns:
            self._teach(self.by_context, sums[0].reshape(-1, 2, INPUTS), rate)
            self._teach(self.by_match, sums[1].reshape(-1, 2, INPUTS), rate / 2)
            self.seen += seen.sum(2).ravel()
            self.ones += seen[:, :, 1].ravel()
        self.blocks += learns
        result = np.empty(len(byte))
        result[order] = out
        return result

    def _tile(self, byte: np.ndarray, vectors: np.ndarray, gate: np.ndarray, expected: np.ndarray, match: np.ndarray, held: np.ndarray, w: np.ndarray, x: np.ndarray, table: np.ndarray, sums: list[np.ndarray] | None, seen: np.ndarray, out: np.ndarray) -> None:
        """Scores some sorted rows of a block (into out) and adds what they teach to sums and seen."""
        size = len(byte)
        x = x[:, :size]
        start, cuts = runs(gate * MATCHES + match)
        parts = [(g, m, a, b) for g, m, (a, b) in zip(gate[start].tolist(), match[start].tolist(), cuts, strict=True)]
        by_context, by_match = (y.reshape(8, -1, INPUTS) for y in (self.by_context, self.by_match))
        inputs = np.ascontiguousarray(vectors.transpose(2, 1, 0))
        scale, half, grid, one = np.float32(1 / STEP), np.float32(0.5), np.float32((BUCKETS - 1) / (2 * MOST)), np.float32(1)
        s, cell = np.empty(size, np.float32), gate * BUCKETS
        p_all = np.ones(size, np.float32)
        for j in range(8):
            bit = (byte >> 7 - j & 1).astype(np.float32)
            np.multiply(inputs[j], scale, out=x[:ORDERS])
            on = (match > 0) & (held >= j)
            np.multiply((expected >> 7 - j & 1) * 2 - 1, on, out=x[ORDERS], casting="unsafe")
            # (gate, match or 0, first, stop) of rows with the same weights.
            same = []
            for g, m, a, b in parts:
                until = a + int(np.count_nonzero(on[a:b])) if m else a
                if until > a:
                    same.append((g, m, a, until))
                if b > until:
                    same.append((g, 0, until, b))
            for g, m, a, b in same:
                np.dot(by_context[j, g] + by_match[j, m] if m else by_context[j, g], x[:, a:b], out=s[a:b])
            np.clip(s, 0.01 - MOST, MOST - 0.01, out=s)
            p = np.exp(-s)
            p += one
            np.divide(one, p, out=p)
            place = (s + np.float32(MOST)) * grid
            low = np.floor(place)
            share = place - low
            base = cell + low.astype(np.int32)
            first = table[j][base]
            refined = (p + first + share * (table[j][base + 1] - first)) * half
            np.clip(refined, 1e-5, 1 - 1e-5, out=refined)
            p_all *= np.where(bit > 0, refined, one - refined)
            if j == 3:  # four bits' product is far from the least number of 32 bits
                out[:] = np.log10(p_all)
                p_all[:] = 1
            if sums is not None:
                error, curve = w * (bit - p), w * (p * (one - p) + np.float32(1e-3))
                square = x * x
                for g, m, a, b in same:
                    taught = np.stack([x[:, a:b] @ error[a:b], square[:, a:b] @ curve[a:b]])
                    sums[0][j, g] += taught
                    if m:
                        sums[1][j, m] += taught
                base += share > half
                seen[j] += np.bincount(2 * base + (byte >> 7 - j & 1), w, 2 * GATES * BUCKETS).reshape(-1, 2)
        out += np.log10(p_all)


class Slice:
    """What one slice was sent, and its mixer."""

    def __init__(self, rows: pa.Table, arrays: list[tuple[int, pa.Buffer, pa.Buffer, pa.Buffer | None]] | None = None):
        """rows: ROWS; arrays: (kind, ids, v, levels) as in answers(), packed."""
        kind = rows["kind"].to_numpy()
        part = {k: rows.filter(pa.array(kind == k)) for k in range(TEXTS)}

        def many(k: int, rest: str) -> Iterator[np.ndarray]:
            """ids, v and levels (of contexts) of a kind."""
            here = [x[1:] for x in arrays or () if x[0] == k]
            for i, name, t in ((0, "id", np.int64), (1, rest, np.int64), (2, "n", np.int8))[: 3 if k < ORDERS else 2]:
                yield np.concatenate([part[k][name].to_numpy().astype(t), *(unpacked(x[i], t) for x in here)])

        self.codes, self.vectors, self.levels = [], [], []
        for k in range(ORDERS):
            ids, v, level = many(k, "v")
            code = mix(ids.view(np.uint64))
            order = np.argsort(code)
            self.codes.append(HashArray(code[order]))
            # A last row of zeros stands for all contexts that were not sent: they are not known.
            self.vectors.append(np.append(v[order], 0).view(np.int8).reshape(-1, 8))
            self.levels.append(np.append(level[order], np.int8(0)))
        key, times = many(AHEADS, "n")
        key = mix(key.view(np.uint64))
        order = np.argsort(key)
        self.keys = HashArray(key[order])
        ahead = np.frombuffer(b"".join(x.ljust(AHEAD, b"\0") for x in part[AHEADS]["ahead"].to_pylist()), np.uint8).reshape(-1, AHEAD)
        self.ahead = np.concatenate([ahead, *(unpacked(x[3], np.uint8, AHEAD) for x in arrays or () if x[0] == AHEADS)])[order]
        self.times = times[order]
        ids, n = many(WORDS, "n")
        word, at = np.unique(mix(ids.view(np.uint64)), return_index=True)
        self.words = HashArray(word)
        self.counts = n[at]
        self.mixer = Mixer()

    def predictions(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(vectors, gates) of codes with their role; equal contexts that stand together are looked up once."""
        vectors, gate = np.empty((len(code), ORDERS), np.int64), np.zeros(len(code), np.int8)
        for k in range(ORDERS):
            part = code & np.uint64((1 << 8 * (k + 1)) - 1 | 1 << ROLE)
            start = firsts(part)
            each = np.diff(np.append(start, len(code)))
            at = self.codes[k].find(mix(part[start]))
            vectors[:, k] = np.repeat(self.vectors[k].view(np.int64)[at, 0], each)
            level = np.repeat(self.levels[k][at], each)
            gate = np.where(level > 0, level + np.int8((k + 1) * len(LEVELS)), gate)
        return vectors.view(np.int8).reshape(-1, ORDERS, 8), gate.astype(np.int64)

    def foretold(self, b: np.ndarray, starts: np.ndarray, size: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(expected byte, match 0 to 6) at each byte."""
        expected, match = np.zeros(len(b), np.uint8), np.zeros(len(b), np.uint8)
        at, key, of = anchors_of(b, starts, size)
        found = self.keys.find(mix(key))
        on = np.flatnonzero(found >= 0)
        if not len(on):
            return expected, match
        at, of, found = at[on], of[on], found[on]
        ahead, step = self.ahead[found], np.arange(AHEAD)
        stop = starts[of] + size[of]
        place = at[:, None] + step
        inside = place < stop[:, None]
        real = b[np.minimum(place, len(b) - 1)]
        same = (real == ahead) | ~inside
        # One's own continuation does not count for a training text.
        times = self.times[found] - (same.all(1) & train[of])
        until = np.where(same.all(1), AHEAD, same.argmin(1) + 1)
        good = inside & (step < until[:, None]) & (times > 0)[:, None]
        level = 1 + np.minimum(2, np.log2(np.maximum(times, 1)).astype(np.int64))[:, None] + 3 * (step >= 8)
        expected[place[good]], match[place[good]] = ahead[good], level[good]
        return expected, match

    def bytes_log10(self, texts: list[bytes], train: np.ndarray) -> np.ndarray:
        """The texts' scores; then they teach."""
        b, starts, size = framed(texts)
        expected, match = self.foretold(b, starts, size, train)
        # By role, byte, last byte, the one before and so on, so that contexts with the same last bytes stand together.
        whole = codes_of(b, starts, size).byteswap(inplace=True)
        whole >>= np.uint64(1)
        whole |= np.repeat((~train).astype(np.uint64) << np.uint64(63), size)
        whole |= match.astype(np.uint16) << np.uint16(8) | expected
        order = np.argsort(whole)
        whole = whole[order]
        first = firsts(whole)
        whole, n = whole[first], np.diff(np.append(first, len(order)))
        each, role = n.copy(), whole >> np.uint64(63)
        n[role == 1] = 0
        code = (whole >> np.uint64(15) << np.uint64(16)).byteswap() | role << np.uint64(ROLE)
        scores = self.mixer.block((whole >> np.uint64(55)).astype(np.uint8), *self.predictions(code), whole.astype(np.uint8), (whole >> np.uint64(8)).astype(np.int64) & 7, n)
        result = np.empty(len(order))
        result[order] = np.repeat(scores, each)
        return np.add.reduceat(result, starts)

    def word_logs(self, texts: list[bytes], train: np.ndarray) -> tuple[np.ndarray, ...]:
        """(words, known words, sum of log10(count + 0.1)) of each text. A word that was not sent stands
        once in training if a training text has it, else never."""
        b, starts, _ = framed(texts)
        ids, ends = words_of(b, starts)
        begin = np.append(0, ends[:-1])
        at = self.words.find(mix(ids.view(np.uint64)))
        c = np.repeat(train, ends - begin).astype(np.int64)
        c[at >= 0] = self.counts[at[at >= 0]]
        known, logs = np.append(0, np.cumsum(c > 0)), np.append(0.0, np.cumsum(np.log10(c + 0.1)))
        return ends - begin, known[ends] - known[begin], logs[ends] - logs[begin]


def _blocks(texts: list[bytes], most: int) -> Iterator[slice]:
    at, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > most:
            yield slice(at, i)
            at, held = i, 0
        held += len(t)
    if at < len(texts):
        yield slice(at, len(texts))


def _by_slice(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(slice, rows of that slice) of batches with a slice column, about `most` bytes of text each."""
    for batch in sliced(batches, "text", most):
        ids = batch.column("slice").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield int(ids[a]), batch.slice(a, b - a)


def runs(of: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(starts, (start, stop) of each) of the runs of equal numbers, none below 0."""
    start = np.flatnonzero(np.diff(of, prepend=-1))
    return start, list(zip(start.tolist(), np.append(start, len(of))[1:].tolist(), strict=True))


def dealt_counts(texts: DataFrame, buckets: int) -> DataFrame:
    """(bucket, kind, slice, ids, n): the contexts with bytes (kind: the longest order) and the lower-cased words of each
    slice, and how often its training texts have them, and (kind AHEADS) what follows its anchors, as packed arrays of 64-bit numbers. Contexts' codes are turned; a
    context's bucket is that of its last bytes, so that shorter contexts meet there too. Contexts of other texts have a bit
    ROLE and n = 0; a word's n is doubled and odd if another text has it. ahead: the AHEAD bytes after each anchor; its n is
    how often they follow in training texts, times WIDE, and in any. A large slice may give a row several times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, grams, words, anchors = -1, [], [], []

        def merged(pending: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
            ids, *n = (np.concatenate(x) for x in zip(*pending, strict=True))
            order = np.argsort(ids)
            ids = ids[order]
            start = firsts(ids)
            return ids[start], *(np.add.reduceat(x[order], start, dtype=np.int64) for x in n)

        def split(kind: int, ids: np.ndarray, n: np.ndarray, key: np.ndarray, ahead: np.ndarray | None = None) -> pa.RecordBatch:
            bucket = (mix(key + np.uint64(kind)) % np.uint64(buckets)).astype(np.min_scalar_type(buckets))
            order = np.argsort(bucket, kind="stable")
            bucket, ids, n = bucket[order].astype(np.int32), ids[order], n[order]
            start, cuts = runs(bucket)
            ahead = None if ahead is None else ahead[order]
            blobs = [pa.array([None if x is None else packed(x[i:j]) for i, j in cuts], pa.binary()) for x in (ids, n, ahead)]
            numbers = [pa.array(x.astype(np.int32)) for x in (bucket[start], np.full(len(start), kind), np.full(len(start), own))]
            return pa.RecordBatch.from_arrays([*numbers, *blobs], COUNTED_NAMES)

        def flush_grams() -> Iterator[pa.RecordBatch]:
            code, n = merged(grams)
            grams.clear()
            n[code >> np.uint64(ROLE) == 1] = 0
            yield split(BYTES, code, n, code & shorter(NEAR) & np.uint64((1 << ROLE) - 256))
            for k in range(NEAR - 1, -1, -1):
                code, n = merged([(code & shorter(k), n)])
                yield split(k, code, n, code & np.uint64((1 << ROLE) - 256))

        def flush_words() -> Iterator[pa.RecordBatch]:
            ids, n, held = merged(words)
            words.clear()
            yield split(WORDS, ids, 2 * n + (held > 0), ids)

        def flush_anchors() -> Iterator[pa.RecordBatch]:
            ids, ahead, n = (np.concatenate(x) for x in zip(*anchors, strict=True))
            anchors.clear()
            h = hashed(ahead)
            order = np.lexsort((h, ids))
            ids, h = ids[order], h[order]
            start = np.union1d(firsts(ids), firsts(h))
            ids = ids[start]
            yield split(AHEADS, ids, np.add.reduceat(n[order], start), ids, ahead[order[start]])

        def flush_all() -> Iterator[pa.RecordBatch]:
            for pending, flush in ((grams, flush_grams), (words, flush_words), (anchors, flush_anchors)):
                if pending:
                    yield from flush()

        for at, batch in _by_slice(batches, PIECE):
            if at != own:
                yield from flush_all()
                own = at
            b, starts, size = framed(texts_of(batch.column("text")))
            train = batch.column("train").to_numpy(zero_copy_only=False).astype(bool)
            role = np.repeat(~train, size).astype(np.uint64)
            grams.append(np.unique(turned(codes_of(b, starts, size) | role << np.uint64(ROLE)), return_counts=True))
            ids, ends = words_of(b, starts)
            on = np.repeat(train, np.diff(np.append(0, ends)))
            words.append(merged([(ids.view(np.uint64), on, ~on)]))
            place, key, of = anchors_of(b, starts, size)
            if len(key):
                anchors.append((key, aheads_at(b, place, starts[of] + size[of]), train[of] * WIDE + 1))
            for pending, flush in ((grams, flush_grams), (words, flush_words)):
                if sum(len(x[0]) for x in pending) > GRAMS:
                    pending[:] = [merged(pending)]
                    # What merging leaves beyond half goes out.
                    if len(pending[0][0]) > GRAMS // 2:
                        yield from flush()
            if sum(len(x[0]) for x in anchors) > GRAMS // 4:
                yield from flush_anchors()
        yield from flush_all()

    return texts.mapInArrow(run, COUNTED)


def answers(counted: DataFrame, small: bool = False) -> DataFrame:
    """(slice, kind, ids, v, levels, n, id) of dealt_counts: for each slice what it asked for, as arrays. Of each order
    the predictions of its contexts with a byte and their levels, for training texts with one count left out (contexts that
    nothing else in training has are not sent); of words the counts (v), those that stand once in training only where
    other texts ask for them; of anchors that stand elsewhere too what follows them most often in training texts (levels)
    and how often (v). Rows of slice -1 have the number of training words (n) and of distinct ones (id). small: the
    arrays are packed."""
    parts = int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def rows(kind: int, names: np.ndarray, of: np.ndarray, ids: np.ndarray, v: np.ndarray, levels: np.ndarray | None) -> pa.RecordBatch:
        """of: the slice of each id, rising."""
        start, cuts = runs(of)
        blobs = [pa.array([None if x is None else packed(x[i:j]) if small else x[i:j].tobytes() for i, j in cuts], pa.binary()) for x in (ids, v, levels)]
        none = pa.nulls(len(start), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(names[of[start]].astype(np.int32)), pa.array(np.full(len(start), kind, np.int32)), *blobs, none, none], ANSWER_NAMES)

    def context_answers(k: int, names: np.ndarray, of: np.ndarray, code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        held = (code >> np.uint64(ROLE)).astype(np.int64)
        # Contexts of held-out texts alone are counted with 0, so that each asked byte has its path.
        code, at = np.unique(code & shorter(k) & np.uint64((1 << ROLE) - 1), return_inverse=True)
        full, less, cf, cl = paths(code, np.bincount(at, n, len(code)).astype(np.int64))
        asked = np.unique((of * 2 + held) * len(code) + at)
        of, at = np.divmod(asked, len(code))
        held = of % 2 == 1
        levels = np.where(held, cf[at], cl[at]).astype(np.int8)
        on = np.flatnonzero(levels)
        of, at, held = of[on] // 2, at[on], held[on]
        return rows(k, names, of, turned_back(code[at] | held.astype(np.uint64) << np.uint64(ROLE)), np.where(held, full[at], less[at]), levels[on])

    def word_answers(names: np.ndarray, of: np.ndarray, word: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        word, at = np.unique(word, return_inverse=True)
        total = np.bincount(at, n >> 1, len(word)).astype(np.int64)
        asked, each = np.unique(of * len(word) + at, return_inverse=True)
        of, at = np.divmod(asked, len(word))
        on = np.flatnonzero((total[at] > 1) | (total[at] > 0) & (np.bincount(each, n & 1, len(asked)) > 0))
        yield rows(WORDS, names, of[on], word[at[on]], total[at[on]], None)
        sums = [pa.array([x], t) for x, t in ((-1, pa.int32()), (WORDS, pa.int32()), *[(None, pa.binary())] * 3, (int(total.sum()), pa.int64()), (int((total > 0).sum()), pa.int64()))]
        yield pa.RecordBatch.from_arrays(sums, ANSWER_NAMES)

    def ahead_answers(names: np.ndarray, of: np.ndarray, key: np.ndarray, n: np.ndarray, ahead: np.ndarray) -> Iterator[pa.RecordBatch]:
        key, at = np.unique(key, return_inverse=True)
        on = np.flatnonzero((np.bincount(at, n % WIDE, len(key)) > 1)[at])
        of, at, n, ahead = of[on], at[on], n[on] // WIDE, ahead[on]
        h = hashed(ahead)
        order = np.lexsort((h, at))
        start = np.union1d(firsts(at[order]), firsts(h[order]))
        if not len(start):
            return
        # The most frequent of each anchor, of equally frequent ones the greatest, stands last.
        total, first = np.add.reduceat(n[order], start), order[start]
        best = np.lexsort((*ahead[first].view(">u8").T[::-1], total, at[first]))
        best = best[np.append(at[first][best][1:] != at[first][best][:-1], True)]
        best = best[total[best] > 0]
        place = np.full(len(key), -1)
        place[at[first[best]]] = np.arange(len(best))
        on = place[at] >= 0
        of, at = np.divmod(np.unique(of[on] * len(key) + at[on]), len(key))
        best = best[place[at]]
        yield rows(AHEADS, names, of, key[at], total[best], ahead[first[best]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            kind = own[1]
            arrays = [[unpacked(x[i], t) for x in held] for i, t in ((1, np.uint64), (2, np.int64))]
            ids, n = map(np.concatenate, arrays)
            names, of = np.unique([x[0] for x in held], return_inverse=True)
            of = np.repeat(of, [*map(len, arrays[0])])
            if kind == AHEADS:
                yield from ahead_answers(names, of, ids, n, np.concatenate([unpacked(x[3], np.uint8, AHEAD) for x in held]))
            elif kind == WORDS:
                yield from word_answers(names, of, ids, n)
            else:
                for k in range(BYTES, NEAR - 1, -1) if kind == BYTES else (kind,):
                    yield context_answers(k, names, of, ids, n)

        for batch in batches:
            for bucket, kind, *row in zip(*(batch.column(x).to_pylist() for x in COUNTED_NAMES), strict=True):
                if (bucket, kind) != own:
                    if held:
                        yield from done()
                    own, held = (bucket, kind), []
                held.append(row)
        if held:
            yield from done()

    return counted.repartition(parts, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(run, ANSWERS)


def dealt(docs: DataFrame, total: int, rows: int) -> DataFrame:
    """docs, written, with slice and id: neighbours by partition and row, about SLICE bytes a slice."""
    parts = max(1, docs.rdd.getNumPartitions())
    # Small partitions share a slice, large ones have several.
    together = max(1, round(SLICE * parts / max(1, total)))
    each = max(1, SLICE * rows // max(1, total))
    place = F.monotonically_increasing_id()
    number = F.floor(F.spark_partition_id() / together) * (1 << 12) + F.floor(place.bitwiseAND((1 << 33) - 1) / each) % (1 << 12)
    return written(docs.select(number.cast("int").alias("slice"), place.alias("id"), "doc_id", "text", "train"), "dealt")


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by slice, kind and id to a row (doc_id, train, n_bytes, n_tokens, n_known, logs, score) a text."""
    arrays: list[tuple[int, pa.Buffer, pa.Buffer, pa.Buffer | None]] = []
    own, model, waiting = None, None, []

    def rows(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in held:
            texts = texts_of(batch.column("text"))
            train = batch.column("train").to_numpy(zero_copy_only=False).astype(bool)
            score = np.concatenate([model.bytes_log10(texts[part], train[part]) for part in _blocks(texts, BLOCK)])
            words, known, logs = (np.concatenate(x) for x in zip(*(model.word_logs(texts[part], train[part]) for part in _blocks(texts, BLOCK)), strict=True))
            sizes = pa.array(map(len, texts), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("train"), sizes, pa.array(words + 1), pa.array(known), pa.array(logs), pa.array(score)], ["doc_id", "train", "n_bytes", "n_tokens", "n_known", "logs", "score"])

    def warmed(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first texts teach the starting weights, then are scored like the rest."""
        for batch in held * TURNS:
            train = batch.column("train").to_numpy(zero_copy_only=False).astype(bool)
            texts = [t for t, on in zip(texts_of(batch.column("text")), train, strict=True) if on]
            for part in _blocks(texts, BLOCK // 4):
                model.bytes_log10(texts[part], np.ones(len(texts[part]), bool))
        yield from rows(held)

    for at, batch in _by_slice(batches, BLOCK):
        if at != own:
            if waiting:
                yield from warmed(waiting)
            own, model, arrays, waiting, warm = at, None, [], [], 0
        cut = int(np.searchsorted(batch.column("kind").to_numpy(), TEXTS))
        if cut:
            blobs = ([x.as_buffer() for x in batch.column(name).slice(0, cut)] for name in ("ids", "v", "levels"))
            arrays += zip(batch.column("kind").slice(0, cut).to_pylist(), *blobs, strict=True)
        batch = batch.slice(cut).select(["doc_id", "text", "train"])
        if not batch.num_rows:
            continue
        if model is None:
            model, arrays = Slice(ROWS.empty_table(), arrays), []
        if waiting is not None:
            waiting.append(batch)
            warm += batch.column("text").nbytes
            if warm >= WARM:
                yield from warmed(waiting)
                waiting = None
        else:
            yield from rows([batch])
    if waiting:
        yield from warmed(waiting)


def score(docs: DataFrame, training: Column) -> DataFrame:
    """docs (doc_id, text) with train, n_bytes, n_tokens, n_known, train_tokens, base_score, score and
    bits_per_byte, learned from the rows where training holds.

    base_score is that of single lower-cased words and an end each, with 0.1 added to counts;
    score is the mixing model's log10 probability of the text. A null text counts as empty
    (one token, the end). Repeated rows count as often as they occur and each get a row; their
    scores may differ, as the model goes on learning. With no training text both models fall
    back to their uniform starts. An empty table gives an empty one; other columns are dropped.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select("doc_id", text.alias("text"), training.alias("train"))
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n"), F.count("*").alias("rows"), F.count_if("train").alias("ends")).first()
    texts = dealt(docs, total["n"], total["rows"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # What was counted is given up before the texts are dealt with it, so that little stands on disk at once.
    found = written_alone(answers(dealt_counts(texts, BUCKETS_EACH * parts), small=True), "answers")
    sums = found.where("slice = -1").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("id"), F.lit(0)).alias("v")).first()
    n, v = sums["n"] + total["ends"], sums["v"] + (total["ends"] > 0)
    rows = found.where("slice >= 0").drop("n", "id").unionByName(texts.withColumn("kind", F.lit(TEXTS)), allowMissingColumns=True)
    scored = rows.repartition(parts, "slice").sortWithinPartitions("slice", "kind", "id").mapInArrow(_scored, "doc_id bigint, train boolean, n_bytes bigint, n_tokens bigint, n_known bigint, logs double, score double")
    end = float(np.log10(total["ends"] + 0.1))
    per = float(np.log10(n + 0.1 * (v + 1)))
    return scored.select(
        "doc_id",
        "train",
        "n_bytes",
        "n_tokens",
        (F.col("n_known") + int(total["ends"] > 0)).alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("logs") + F.lit(end) - F.col("n_tokens") * per).alias("base_score"),
        "score",
        (-F.col("score") / float(np.log10(2)) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's scores; learned from those that are not held out. Null texts are empty,
    repeated rows are scored each, an empty table gives none."""
    return score(table(spark, sf_dir, "documents"), ~held_out(10, 0)).withColumn("held_out", ~F.col("train")).drop("train")
