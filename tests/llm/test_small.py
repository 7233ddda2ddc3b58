"""The training-data operators on small tables: against brute force, and on odd input."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import decontaminate as dc
from tickloom.llm import langid, lines, packing, phrases, repeats, secrets, simhash, tokens

DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def docs(spark, texts, ids=None, lang="en"):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, lang, "src", None if t is None else len(t), "x") for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows and ids, clashing column names."""
    r = random.Random(3)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 7))) for _ in range(300)]
    long = " ".join(r.choice(words) for _ in range(60_000))
    texts = [None, "", " \n\t", "one", "one two three", long, long, long[:5000] + " changed " + long[5000:9000], "x" * 5000, "line a b c d e f g h i j\n" * 20, None, "one"]
    frame = docs(spark, texts, [None, 1, 2, 3, 4, 5, 6, 7, 8, 9, 9, 3])
    for name in ("n_tokens", "n_bytes", "fp", "slot", "key", "lang_pred", "n_lines", "score"):
        frame = frame.withColumn(name, F.lit("clash"))
    return frame


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("doc_id < -1")


def path(name):
    return pytest.importorskip("public_tokenizers").path(name)


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "word_bpe_49k.json"])
def test_token_counts_equal_the_library(spark, odd, none, name):
    texts = {r["doc_id"]: r["text"] or "" for r in odd.collect() if r["doc_id"] not in (None, 9)}
    rows = tokens.count_tokens(odd, path(name)).collect()
    assert len(rows) == 12
    for r in rows:
        if r["doc_id"] in texts:
            t = texts[r["doc_id"]]
            assert r["n_tokens"] == tokens.counter(path(name))([t])[0] and r["n_bytes"] == len(t.encode())
    assert tokens.count_tokens(none, path(name)).count() == 0


def test_parts_equal_whole_texts():
    count, r = tokens.counter(path("piece_bpe_32k.model")), random.Random(1)
    parts = [" ", "  ", "a", "the", "ß", "\n", "é", "▁", "!!", "　", "日本", " and", "<s>", "\x00"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 10))) for _ in range(3000)]
    assert count(texts) == count._whole(texts)


def test_cache_is_read_and_grows(spark, tmp_path):
    cache, model = f"file://{tmp_path}/cache", path("piece_bpe_32k.model")
    tokens.count_tokens(docs(spark, ["a b", "c"]), model, cache).count()
    assert spark.read.parquet(cache).count() == 2
    found = tokens.count_tokens(docs(spark, ["a b", "d e f", "d e f"]), model, cache).collect()
    assert spark.read.parquet(cache).count() == 3 and all(r["n_tokens"] for r in found)


def test_golay_keys_meet_within_one_bit():
    code = simhash.Golay()
    x = np.random.default_rng(0).integers(0, 1 << 23, 2000)
    keys, real = code.keys(x)
    assert set(real.sum(1)) == {1, 6}
    for bit in range(23):
        y = code.decode(x ^ (1 << bit))
        assert ((keys == y[:, None]) & real).any(1).all()


def test_links_are_all_links_within_four_bits(spark, monkeypatch):
    r = np.random.default_rng(5)
    base = r.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = set(base.tolist())
    for b in base.tolist():
        for _ in range(30):
            x = b
            for bit in r.choice(64, r.integers(1, 8), replace=False):
                x ^= 1 << int(bit)
            fps.add(x)
    fps = np.array(sorted(fps), np.uint64)
    parent = {int(x): int(x) for x in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(fps):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ x) <= 4):
            parent[root(int(x))] = root(int(fps[i + 1 + j]))
    frame = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long").repartition(3)
    for block in (20_000, 7):
        monkeypatch.setattr(simhash, "BLOCK", block)
        found = {int(x): int(x) for x in fps}

        def up(x):
            while found[x] != x:
                x = found[x]
            return x

        for a, b in simhash.links(frame).collect():
            found[up(a % (1 << 64))] = up(b % (1 << 64))
        groups = lambda f: sorted(Counter(f(int(x)) for x in fps).values())
        assert groups(up) == groups(root)


def test_near_duplicates_on_odd_rows(odd, none):
    rows = simhash.near_duplicates(odd.select("doc_id", "text")).collect()
    assert len(rows) == 12
    by = {r["doc_id"]: r for r in rows}
    assert by[5]["component_id"] == by[6]["component_id"] == 5 and by[1]["fp"] == by[2]["fp"] == 0
    assert simhash.near_duplicates(none.select("doc_id", "text")).count() == 0


def test_repeats_equal_brute_force(spark, monkeypatch):
    r = random.Random(7)
    common = ["".join(r.choice("abcd ") for _ in range(n)) for n in (255, 256, 257, 300, 399, 400, 401, 700, 2000)]
    texts = ["", "short", "ab" * 500, "ab" * 450]
    for _ in range(40):
        parts = ["".join(r.choice("abcd é") for _ in range(r.randint(0, 900)))]
        for _ in range(r.randint(0, 3)):
            c = r.choice(common)
            cut = r.choice([0, r.randint(0, 150)])
            parts += [c[cut : len(c) - r.choice([0, r.randint(0, 150)])], "".join(r.choice("wxyz") for _ in range(r.randint(0, 60)))]
        texts.append("".join(parts))
    texts += texts[10:13]
    expected = repeats.by_brute_force([t.encode() for t in texts])
    for segment, block in ((1 << 21, 20_000), (1500, 3)):
        monkeypatch.setattr(repeats, "SEGMENT", segment)
        monkeypatch.setattr(repeats, "BLOCK", block)
        rows = repeats.remove_repeats(docs(spark, texts)).collect()
        got = {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_repeated"], len(x["spans"]), hashlib.sha256(x["kept"]).hexdigest()) for x in rows}
        assert [got[i] for i in range(len(texts))] == expected


def test_repeats_on_odd_rows(odd, none):
    rows = {r["doc_id"]: r for r in repeats.remove_repeats(odd).collect()}
    assert rows[5]["n_removed"] == rows[5]["n_bytes"] > 0 and rows[1]["n_bytes"] == 0 and rows[8]["n_removed"] == 5000
    assert repeats.remove_repeats(none).count() == 0


def test_intervals():
    assert sorted(repeats.intervals([-1, 2, 2, 0, 3])) == [(0, 2, 2), (0, 4, 0), (3, 4, 3)]


def test_lines(spark, odd, none):
    text = ["a1 b c d e f g h i j k\nshort\nz1 y x w v u t s r q p", "new\na1 b c d e f g h i j k\nshort\nz1 y x w v u t s r q p\nshort", None, ""]
    rows = {r["doc_id"]: r for r in lines.dedup_lines(docs(spark, text)).collect()}
    assert rows[0]["text"] == text[0] and rows[1]["text"] == "new\nshort" and (rows[1]["n_lines"], rows[1]["n_removed"]) == (5, 3)
    assert rows[2]["text"] is None and rows[3]["text"] == ""
    whole = lines.dedup_lines(odd)
    assert whole.count() == 12 and set(whole.columns) == set(odd.columns) | {"n_removed"}
    assert lines.dedup_lines(none).count() == 0


def test_myers_distance():
    r = random.Random(2)

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return min(row)

    for _ in range(300):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(1, 20))) for _ in range(2))
        assert dc.distance(dc.masks(a), len(a), b) == plain(a, b)


def test_decontamination(spark, odd, none):
    r = random.Random(4)
    item = " ".join("".join(r.choice("abcdefg") for _ in range(5)) for _ in range(30))
    k = len(item) // dc.CHARS_AN_EDIT
    changed = list(item)
    for i in r.sample(range(len(item)), k):
        changed[i] = "z"
    far = "".join("q" if i % 7 == 0 else c for i, c in enumerate(item))
    texts = ["x " + item.upper().replace(" ", "!!  ") + " y", "pre " + "".join(changed) + " post", far, "clean text", None, ""]
    bench = spark.createDataFrame([(1, item), (2, "tiny"), (3, None), (4, item)], "item_id long, text string")
    found = {(m["doc_id"], m["item_id"]): m["distance"] for m in dc.matches(docs(spark, texts), bench).collect()}
    assert set(found) == {(0, 1), (0, 4), (1, 1), (1, 4)} and found[0, 1] == 0 and 0 < found[1, 1] <= k
    assert {m["doc_id"] for m in dc.decontaminate(docs(spark, texts), bench).collect()} == {2, 3, 4, 5}
    assert dc.decontaminate(odd, bench).columns == odd.columns and dc.matches(none, bench).count() == 0
    assert dc.matches(odd, bench.where("item_id < 0")).count() == 0


def test_best_fit(spark, none):
    lengths = np.random.default_rng(1).integers(1, 4097, 5000)
    at, offset, caps = packing.best_fit(lengths)
    used = np.bincount(at, lengths)
    assert (used <= caps).all() and used.sum() / caps.sum() > 0.97
    for b in range(50):
        on = np.flatnonzero(at == b)
        spans = sorted((offset[i], offset[i] + lengths[i]) for i in on)
        assert all(x[1] == y[0] for x, y in zip(spans, spans[1:], strict=False)) and spans[0][0] == 0
    sizes = sorted(packing.CAPACITIES)
    assert all(c == min(s for s in sizes if s >= u) for c, u in zip(caps, used, strict=True))
    frame = spark.createDataFrame([(1, 10_000), (2, None), (2, 0), (None, 5), (3, 4096)], "doc_id long, n_tokens long")
    rows = packing.pack(frame).collect()
    assert sum(r["n_tokens"] for r in rows) == 10_000 + 1 + 1 + 5 + 4096
    assert sorted((r["start"], r["n_tokens"]) for r in rows if r["doc_id"] == 1) == [(0, 4096), (4096, 4096), (8192, 1808)]
    assert packing.pack(packing.word_lengths(none)).count() == 0


def test_language_models(spark, odd, none):
    r = random.Random(9)
    make = lambda parts: " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 4))) for _ in range(80))
    en, de = ["the", "ing", "er", "on"], ["sch", "ung", "ein", "ü"]
    train = docs(spark, [make(en) for _ in range(30)]).union(docs(spark, [make(de) for _ in range(30)], lang="de"))
    model = langid.fit(train)
    code, _ = langid.codes(["abc the"])
    total = sum(2.0 ** -model.bits(np.array([(int(code[5]) & ~0xFFFF) | c], np.uint64))[0].astype(float) for c in range(1, 2000))
    assert (total <= 1.0001).all() and (total > 0.9).all()
    rows = langid.score(docs(spark, [make(en), make(de), None, "", "12 34 !"]), model).collect()
    assert {x["doc_id"]: x["lang_pred"] for x in rows} == {0: "en", 1: "de", 2: "und", 3: "und", 4: "und"}
    assert langid.score(odd, model).count() == 12 and langid.score(none, model).count() == 0 and langid.fit(none) is None
    flagged = langid.unlike(langid.score(train, model), F.lit(True))
    assert flagged.where("rejected").count() == 0


def test_phrases(spark, odd, none):
    def lz(data):
        found, now = set(), b""
        for c in data:
            now += bytes([c])
            if now not in found:
                found.add(now)
                now = b""
        return found

    r = random.Random(6)
    a = "".join(r.choice("abc é") for _ in range(3000))
    b = a[:1500] + "".join(r.choice("abc é") for _ in range(1500))
    x, y = lz(a.encode()), lz(b.encode())
    assert phrases.likeness(phrases.fingerprint(a.encode()), phrases.fingerprint(b.encode())) == pytest.approx(len(x & y) / len(x | y), abs=0.15)
    texts = [a, b, "", None, "q", a]
    rows = {x["doc_id"]: x for x in phrases.fingerprints(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        t, after = t or "", texts[(i - 1) % 6] or ""
        edited = phrases.edit(t, after)
        assert rows[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and rows[i]["n_chars"] == len(t)
        assert rows[i]["fingerprint"] == phrases.shown(phrases.fingerprint(t.encode()))
        assert rows[i]["edited_fingerprint"] == phrases.shown(phrases.fingerprint(edited.encode()))
        assert rows[i]["near_next"] == phrases.likeness(phrases.fingerprint(t.encode()), phrases.fingerprint(after.encode()))
    assert phrases.fingerprints(odd).count() == 12 and phrases.fingerprints(none).count() == 0


def test_secrets(spark, odd, none):
    model = secrets.train(secrets.labelled_findings(spark))
    hexed = hashlib.sha1(b"1").hexdigest()
    texts = [f'set token = "{hexed}" now', f"fixed in commit {hexed} today", "thetionschenverheitungmentlich plain", None, ""]
    rows = {r["doc_id"]: r for r in secrets.scan(docs(spark, texts), model).collect()}
    assert set(rows) == {0, 1, 2} and rows[0]["is_secret"] and not rows[1]["is_secret"] and not rows[2]["is_secret"]
    assert rows[0]["candidate"] == hexed and rows[0]["word_at"] == 3
    held = secrets.features(secrets.labelled_findings(spark, 8000).where("candidate <> ''"))
    right = model.transform(held).where("label = prediction").count() / held.count()
    assert right > 0.95
    assert secrets.scan(odd, model).count() >= 1 and secrets.scan(none, model).count() == 0


def test_short_items(spark):
    bench = spark.createDataFrame([(1, "What is it?"), (2, "二十四个字的题目" * 3), (3, "?!"), (4, None)], "item_id long, text string")
    texts = ["so: WHAT is, it", "what is it", "what is items", "somewhat is it", "what isnt it", "见 " + "二十四个字的题目" * 3 + "。", "", None]
    found = {(m["doc_id"], m["item_id"], m["distance"]) for m in dc.matches(docs(spark, texts), bench).collect()}
    assert found == {(0, 1, 0), (1, 1, 0), (5, 2, 0)}


def test_an_item_of_one_edit_is_met_with_it(spark):
    bench = spark.createDataFrame([(1, "which gas do fires use"), (2, "twenty characters it")], "item_id long, text string")
    texts = ["so: which gas do fyres use?", "which gas do fires use", "wich gas do fyres use", "twenty characters in", "twenty charakters in"]
    found = {(m["doc_id"], m["item_id"], m["distance"]) for m in dc.matches(docs(spark, texts), bench).collect()}
    assert found == {(0, 1, 1), (1, 1, 0), (3, 2, 1)}
