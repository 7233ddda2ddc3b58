"""Online context mixing: its counts, bits and weights against plain loops, its scores by their properties."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickloom.llm import mixing
from tickloom.llm.langid import held_out
from tickloom.plans.ship import ship

R = random.Random(11)
WORDS = ["".join(R.choice("abcde") for _ in range(R.randint(1, 6))) for _ in range(60)]


def text(n=120):
    return " ".join(R.choice(WORDS) for _ in range(n)) + R.choice([".", "\n", " é"])


def chained(n):
    """Words of which each is one of three that may follow the last."""
    at = [R.randrange(60)]
    for _ in range(n - 1):
        at.append((at[-1] * 7 + R.randrange(3)) % 60)
    return " ".join(WORDS[i] for i in at)


def counted(texts):
    """{order: {context: {byte: count}}} by a loop over all bytes."""
    out = {k: defaultdict(Counter) for k in range(mixing.ORDERS)}
    for t in texts:
        data = t.encode() + mixing.END
        for i, c in enumerate(data):
            for k in range(mixing.ORDERS):
                out[k][bytes(max(0, k - i)) + data[max(0, i - k) : i]][c] += 1
    return out


def bits_of(counts, byte, less):
    """(ones, zeros) on the byte's path of eight bits."""
    for j in range(8):
        on = [(c, n) for c, n in counts.items() if c >> (8 - j) == byte >> (8 - j)]
        one = sum(n for c, n in on if c >> (7 - j) & 1)
        zero = sum(n for _, n in on) - one
        bit = byte >> (7 - j) & 1
        yield (one - less * bit, zero - less * (1 - bit), bit)


def stretched(one, zero):
    return max(-127, min(127, round(mixing.STEP * math.log((one + 0.4) / (zero + 0.4)))))


def test_codes_and_paths():
    texts = [text(20), "", text(5), "x", "né"]
    counts = counted(texts)
    b, starts, size = mixing.framed([t.encode() for t in texts])
    code, n = np.unique(mixing.codes_of(b, starts, size), return_counts=True)
    full, less, *_ = mixing.paths(code, n)
    full, less = full.view(np.int8).reshape(-1, 8), less.view(np.int8).reshape(-1, 8)
    for i, c in enumerate(code.tolist()):
        context, byte = (c >> 8).to_bytes(mixing.BYTES, "big"), c & 255
        seen = counts[mixing.BYTES][context]
        assert n[i] == seen[byte]
        assert full[i].tolist() == [stretched(one, zero) for one, zero, _ in bits_of(seen, byte, 0)]
        assert less[i].tolist() == [stretched(one, zero) for one, zero, _ in bits_of(seen, byte, 1)]


def sent(texts, asked, ahead=()):
    """What a slice of the asked texts is sent, by loops."""
    counts = counted(texts)
    b, starts, size = mixing.framed([t.encode() for t in asked])
    rows = []
    codes = np.unique(mixing.codes_of(b, starts, size))
    for k in range(mixing.ORDERS):
        for c in np.unique(codes & np.uint64((1 << 8 * (k + 1)) - 1)).tolist():
            seen = counts[k][(c >> 8).to_bytes(k, "big")]
            if seen.total():
                v = int(np.array([stretched(one, zero) for one, zero, _ in bits_of(seen, c & 255, 0)], np.int8).view(np.int64)[0])
                rows.append({"kind": k, "id": c | 1 << mixing.ROLE, "v": v, "n": int(np.searchsorted(mixing.LEVELS, seen.total(), "right")) - 1})
    rows += [{"kind": mixing.AHEADS, "id": k, "n": n, "ahead": a} for k, a, n in ahead]
    fields = [("kind", pa.int32()), ("id", pa.int64()), ("v", pa.int64()), ("n", pa.int64()), ("ahead", pa.binary())]
    return mixing.Slice(pa.Table.from_pylist(rows, pa.schema(fields)))


def test_first_scores_equal_plain_loops():
    texts, asked = [text(40) for _ in range(6)], [text(30), "zzz QQ\x00"]
    counts = counted(texts)
    got = sent(texts, asked).bytes_log10([t.encode() for t in asked], np.zeros(2, bool))
    for t, score in zip(asked, got, strict=True):
        total, data = 0.0, t.encode() + mixing.END
        for i, c in enumerate(data):
            paths = [list(bits_of(counts[k][bytes(max(0, k - i)) + data[max(0, i - k) : i]], c, 0)) for k in range(mixing.ORDERS)]
            for j in range(8):
                s = max(-mixing.MOST, min(mixing.MOST, sum(0.25 * stretched(*p[j][:2]) / mixing.STEP for p in paths)))
                p = 1 / (1 + math.exp(-s))
                total += math.log10(max(1e-5, p if paths[0][j][2] else 1 - p))
        assert score == pytest.approx(total, rel=0.01)  # the refining table starts as the same curve, in steps


def test_bytes_sum_to_one():
    texts = [text(40) for _ in range(6)]
    context = texts[0].encode()[:17]
    asked = [context + bytes([c]) for c in range(256)]
    b, starts, size = mixing.framed(asked)
    known = sent(texts, [])
    counts = counted(texts)
    code = mixing.codes_of(b, starts, size)[starts + len(context)]
    vectors = np.empty((256, mixing.ORDERS, 8), np.int8)
    for c in range(256):
        for k in range(mixing.ORDERS):
            vectors[c, k] = [stretched(one, zero) for one, zero, _ in bits_of(counts[k][context[len(context) - k :]], c, 0)]
    assert (code & np.uint64(255)).tolist() == list(range(256))
    for expected, match in ((0, 0), (101, 5)):
        p = known.mixer.block(np.arange(256), vectors, np.full(256, 30), np.full(256, expected), np.full(256, match), np.zeros(256, np.int64))
        assert (10**p).sum() == pytest.approx(1, abs=1e-4)
        assert (p[101] > p.mean()) or not match


def test_learning_lowers_the_cost():
    texts = [text() for _ in range(40)]
    model = sent(texts, texts)
    data = [t.encode() for t in texts]
    first = model.bytes_log10(data, np.zeros(40, bool)).sum()
    assert model.mixer.blocks == 0  # held-out texts never teach
    b, starts, size = mixing.framed(data)
    code = mixing.codes_of(b, starts, size) | np.uint64(1 << mixing.ROLE)
    code, n = np.unique(code, return_counts=True)
    vectors, gates = model.predictions(code)
    zero = np.zeros(len(code), np.int64)
    for _ in range(6):
        model.mixer.block((code & np.uint64(255)).astype(np.int64), vectors, gates, zero, zero, n)
    assert model.mixer.blocks == 6 and model.bytes_log10(data, np.zeros(40, bool)).sum() > 0.95 * first


def test_a_slice_is_sent_arrays(spark):
    """What two slices are sent, by loops; a row holds many contexts or words (one row each took over 3,000 MB of an executor on 0.51 GB)."""
    given = [(i % 2, i, text(60) + " own%d" % i + " Aa" * (i == 1), i % 3 > 0) for i in range(8)]
    texts = ship(spark).createDataFrame(given, "slice int, id long, text string, train boolean").repartition(2, "slice").sortWithinPartitions("slice", "id")
    got = mixing.answers(mixing.dealt_counts(texts, 3)).collect()
    train = [t for *_, t, on in given if on]
    counts, words = counted(train), Counter(w for t in train for w in t.lower().split())
    assert sum(r["n"] or 0 for r in got) == words.total() and sum(r["id"] or 0 for r in got) == len(words)
    for at in (0, 1):
        for k in range(mixing.ORDERS):
            want = {}
            for *_, t, on in (x for x in given if x[0] == at):
                for context, seen in counted([t])[k].items():
                    for byte in seen:
                        known = counts[k][context].total() - on
                        if known:
                            v = [stretched(*b[:2]) for b in bits_of(counts[k][context], byte, on)]
                            want[int.from_bytes(context, "big") << 8 | byte | (not on) << mixing.ROLE] = (v, int(np.searchsorted(mixing.LEVELS, known, "right")) - 1)
            rows = [r for r in got if (r["slice"], r["kind"]) == (at, k)]
            ids = np.frombuffer(b"".join(r["ids"] for r in rows), np.int64).tolist()
            v = np.frombuffer(b"".join(r["v"] for r in rows), np.int8).reshape(-1, 8).tolist()
            levels = np.frombuffer(b"".join(r["levels"] for r in rows), np.int8).tolist()
            assert len(set(ids)) == len(ids) and len(rows) <= 3
            assert dict(zip(ids, zip(v, levels, strict=True), strict=True)) == want
        held = {w for a, _, t, on in given if a == at and not on for w in t.lower().split()}
        want = sorted(n for w, n in words.items() if (n > 1 or w in held) and any(w in t.lower().split() for a, _, t, _ in given if a == at))
        assert sorted(np.frombuffer(b"".join(r["v"] for r in got if (r["slice"], r["kind"]) == (at, mixing.WORDS)), np.int64).tolist()) == want


def test_what_is_counted_takes_little_disk(spark):
    """Contexts and words on their way (on 0.51 GB the tool stopped at 2.32 GB of disk): 16 bytes each before."""
    given = [(i % 2, i, "".join(R.choice("abcdefgh ") for _ in range(50_000)), i % 3 > 0) for i in range(8)]
    texts = ship(spark).createDataFrame(given, "slice int, id long, text string, train boolean").repartition(2, "slice").sortWithinPartitions("slice", "id")
    got = [r for r in mixing.dealt_counts(texts, 3).collect() if r["kind"] != mixing.AHEADS]
    assert sum(len(r["ids"]) + len(r["n"]) for r in got) < 5 * sum(len(t) for _, _, t, _ in given)


def test_packed_numbers():
    for x in (np.array([], np.int64), np.arange(-5, 1000), np.array([3, 1 << 63], np.uint64), np.arange(7, dtype=np.int8)):
        assert (mixing.unpacked(mixing.packed(x), x.dtype) == x).all()
    x = np.arange(128, dtype=np.uint8).reshape(2, 64)
    assert (mixing.unpacked(mixing.packed(x), np.uint8, 64) == x).all()


def test_words_of_any_length():
    words = ["Ab", "ab", "aB" * 16, "ab" * 16, "ab" * 16 + "c", "ab" * 16 + "C", "ab" * 16 + "d", "ab" * 500, "ab" * 499 + "ba", "a", "é", "\x00", "\x00\x00"]
    texts = [" ".join(words), "", " \n", *words]
    b, starts, _ = mixing.framed([t.encode() for t in texts])
    ids, ends = mixing.words_of(b, starts)
    lower = [w.lower() for t in texts for w in t.split()]
    assert ends.tolist() == np.cumsum([len(t.split()) for t in texts]).tolist() and len(ids) == len(lower)
    assert all((a == c) == (x == y) for a, x in zip(ids.tolist(), lower, strict=True) for c, y in zip(ids.tolist(), lower, strict=True))


def test_turned_codes():
    code = mixing.codes_of(*mixing.framed([text(20).encode(), b"", b"abc"])) | np.uint64(1 << mixing.ROLE)
    for k in range(mixing.ORDERS):
        less = code & np.uint64((1 << 8 * (k + 1)) - 1 | 1 << mixing.ROLE)
        assert (mixing.turned_back(mixing.turned(code) & mixing.shorter(k)) == less).all()


def test_anchors_are_sent_what_follows_most_often(spark):
    """By loops over all anchors of all texts."""
    passage = chained(400)
    given = [(i % 2, i, text(40) + passage[: 900 + 60 * i] + text(20) * (i % 4) + passage[:700] * (i == 5), i % 5 > 0) for i in range(12)]
    texts = ship(spark).createDataFrame(given, "slice int, id long, text string, train boolean").repartition(2, "slice").sortWithinPartitions("slice", "id")
    after, asked, times = defaultdict(Counter), defaultdict(set), Counter()
    for at, _, t, on in given:
        b, starts, size = mixing.framed([t.encode()])
        for place, key, _ in zip(*mixing.anchors_of(b, starts, size), strict=True):
            after[int(key)][b[place : place + mixing.AHEAD].tobytes().ljust(mixing.AHEAD, b"\0")] += on
            asked[at].add(int(key))
            times[int(key)] += 1
    found = [r for r in mixing.answers(mixing.dealt_counts(texts, 3), small=True).collect() if r["kind"] == mixing.AHEADS]
    assert found
    for at in (0, 1):
        rows = [r for r in found if r["slice"] == at]
        ids, n = (np.concatenate([mixing.unpacked(r[x], t) for r in rows]).tolist() for x, t in (("ids", np.uint64), ("v", np.int64)))
        ahead = np.concatenate([mixing.unpacked(r["levels"], np.uint8, mixing.AHEAD) for r in rows])
        want = {k: max(after[k].values()) for k in asked[at] if times[k] > 1 and max(after[k].values())}
        assert dict(zip(ids, n, strict=True)) == want and len(ids) == len(want)
        assert all(after[k][a.tobytes()] == want[k] for k, a in zip(ids, ahead, strict=True))


@pytest.fixture(scope="module")
def scored(spark):
    base = [chained(300) for _ in range(80)]
    rows = [(i, t) for i, t in enumerate(base)]
    shuffled = base[0].split(" ")
    R.shuffle(shuffled)
    rows += [(1000, base[5]), (1001, " ".join(shuffled)), (1002, None), (1003, "  "), (None, base[0][:900]), (1004, "zzz QQ\x00"), (7, base[7])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("train", F.lit("clash")).repartition(3)
    return base, mixing.score(docs, ~held_out(10, 0)).collect(), rows


def test_scores(spark, scored):
    base, rows, given = scored
    assert len(rows) == len(given)
    train = [t or "" for i, t in given if i is None or zlib.crc32(str(i).encode()) % 10]
    counts = Counter(w for t in train for w in t.lower().split())
    n, v = sum(counts.values()) + len(train), len(counts) + 1
    texts = {i: t or "" for i, t in given}
    for r in rows:
        words = texts[r["doc_id"]].lower().split()
        per = math.log10(n + 0.1 * (v + 1))
        assert r["base_score"] == pytest.approx(sum(math.log10(counts[w] + 0.1) for w in words) + math.log10(len(train) + 0.1) - per * (len(words) + 1))
        assert r["n_known"] == sum(w in counts for w in words) + 1 and r["n_tokens"] == len(words) + 1 and r["train_tokens"] == n
        assert r["n_bytes"] == len(texts[r["doc_id"]].encode()) and r["score"] < 0
    by = {r["doc_id"]: r for r in rows}
    held = [r for r in rows if not r["train"] and r["n_bytes"] > 900]
    assert held and all(r["score"] > r["base_score"] for r in held)
    # A text that stands in training twice costs less than the others; word order matters.
    others = sorted(by[i]["bits_per_byte"] for i in range(10, 60))
    assert by[7]["bits_per_byte"] < others[0] and by[1001]["bits_per_byte"] != pytest.approx(by[0]["bits_per_byte"])
    assert by[1004]["bits_per_byte"] > others[-1]


def test_no_training_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in mixing.score(docs, F.lit(False)).collect()}
    assert rows[1]["score"] == pytest.approx(-24 * math.log10(2), rel=1e-3) and rows[2]["n_known"] == 0
    assert mixing.score(docs.where("doc_id > 5"), F.lit(True)).count() == 0


def test_a_very_long_text(spark):
    long = " ".join(R.choice(WORDS) for _ in range(400_000))
    docs = spark.createDataFrame([(1, long), (2, text()), (3, long)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in mixing.score(docs, F.lit(True)).collect()}
    assert rows[1]["n_bytes"] == len(long) and rows[1]["n_tokens"] == 400_001
