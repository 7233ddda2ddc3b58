"""Tiered packing, fill-in-the-middle and spelling variants against brute force, and on odd input."""

import hashlib
import os
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import middle, spelling, tiers
from tickloom.llm.queries import ORACLE_SQL, QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", "src", None if t is None else len(t)) for i, t in zip(ids, texts, strict=True)]
    frame = spark.createDataFrame(rows, DOCS).repartition(3)
    for name in ("n", "form", "output", "made", "word", "shard", "ids", "start", "sequence_id"):
        frame = frame.withColumn(name, F.lit("clash"))
    return frame


def written(spark, tmp_path, texts, ids=None):
    docs(spark, texts, ids).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


@pytest.fixture(scope="module")
def odd():
    r = random.Random(3)
    words = ["".join(r.choice("abcdefgé") for _ in range(r.randint(1, 9))) for _ in range(200)]
    long = " ".join(r.choice(words) for _ in range(30_000))
    texts = [None, "", " \n\t", "one", "two  three\n\n 4 five's", long, long, "x" * 9000, "a<P>b", "holds <S> and", "<M>", "<|endoftext|> x", "日本語 ß 😀 " * 40, None, "one"]
    return texts, [None, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, -11, 12, 9, 3]


@pytest.fixture(scope="module")
def library():
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    return path, Tokenizer.from_file(path)


def test_ids_equal_the_library(library, monkeypatch):
    path, model = library
    r = random.Random(1)
    bits = ["a,", ".", "%", "wo.\n", ",,", " ", "  ", "   ", "\n", "\t", "a", "word", "'s", "don't", "1", "23", "é", "日本", "...", "\x1c", "\x85", "᠎", "\xa0", " ", "<|endoftext|>", "<|endof", "text|>", "'", "ll", "\r\n", "😀", "́", "²", "_"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 12))) for _ in range(5000)]
    want = [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in model.encode_batch(texts, add_special_tokens=False)]
    for part, memory in ((1 << 20, 800_000), (5, 800_000), (5, 10)):
        monkeypatch.setattr(tiers, "PART", part)
        monkeypatch.setattr(tiers, "MEMORY", memory)
        ids = tiers.ByteIds(path)
        assert [ids(t) for t in texts] == want


@pytest.mark.parametrize("lengths", [[], [5], [1023] * 40, [700] * 9, [64, 1, 1, 1], [1] * 700, list(range(1, 1024))])
def test_fill_uses_each_token_once_and_no_padding(lengths):
    seen, sizes = Counter(), []
    for size, pieces in tiers.fill(lengths):
        assert sum(n for _, _, n in pieces) == size and size & (size - 1) == 0 and size <= 1024
        sizes.append(size)
        for i, first, n in pieces:
            seen.update((i, t) for t in range(first, first + n))
    assert seen == Counter((i, t) for i, n in enumerate(lengths) for t in range(n))
    # Small sequences hold what is left of the last window only.
    odd = [s for s in sizes if s not in tiers.TIERS]
    assert sum(odd) < max(tiers.TIERS) and len(odd) <= 10


def test_step_groups_hold_one_size_and_like_costs():
    r = np.random.default_rng(2)
    sizes = r.choice([256, 512, 1024], 500)
    costs = r.integers(1, 1000, 500)
    group = tiers.groups_of(sizes, costs)
    waste = lambda g: sum(costs[g == k].max() * (g == k).sum() - costs[g == k].sum() for k in set(g.tolist()))
    for k in set(group.tolist()):
        assert len(set(sizes[group == k])) == 1 and sizes[group == k].sum() <= tiers.STEP_TOKENS
    arrival = np.concatenate([1000 * s + np.arange((sizes == s).sum()) // (tiers.STEP_TOKENS // s) for s in (256, 512, 1024)])
    by_arrival = np.empty(500, int)
    by_arrival[np.argsort(sizes, kind="stable")] = arrival
    assert waste(group) < 0.2 * waste(by_arrival)


@pytest.mark.parametrize("most", [1 << 16, 3])
def test_packing_against_the_library(spark, tmp_path, odd, library, monkeypatch, most):
    monkeypatch.setattr(tiers, "MOST", most)
    monkeypatch.setattr(tiers, "SHARD", 6)
    texts, ids = odd
    rows = QUERIES["op11_hierarchical_packing"](spark, written(spark, tmp_path, texts, ids)).collect()
    whole = defaultdict(list)  # of each id: the documents' ids
    for i, t in zip(ids, texts, strict=True):
        whole[i].append(library[1].encode(t or "", add_special_tokens=False).ids + [0])
    pieces = Counter()
    for r in rows:
        fits = [d for d in whole[r["doc_id"]] if len(d) == r["doc_tokens"] and zlib.crc32(struct.pack(f"<{r['length']}I", *d[r["start"] : r["start"] + r["length"]])) == r["ids_crc32"]]
        assert fits
        pieces[r["doc_id"]] += r["length"]
    assert pieces == Counter({i: sum(map(len, ds)) for i, ds in whole.items()})
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"], r["tier"], r["step_group"]))
    for s in sequences.values():
        s.sort()
        assert s[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(s, s[1:], strict=False))
        size = sum(x[1] for x in s)
        assert size <= 1024 and size & (size - 1) == 0 and {x[2] for x in s} == {size} and len({x[3] for x in s}) == 1


def test_packing_of_nothing_and_of_equal_rows(spark, library):
    assert tiers.pack_tiers(docs(spark, ["a"]).where("doc_id < 0"), library[0]).count() == 0
    rows = tiers.pack_tiers(docs(spark, ["same text"] * 50, [7] * 50), library[0]).collect()
    assert sum(r["length"] for r in rows) == 50 * rows[0]["doc_tokens"]


def test_middle_against_brute_force_and_sql(spark, tmp_path, odd):
    texts, ids = odd
    r = random.Random(5)
    texts = texts + ["".join(r.choice("ab1 é\n.") for _ in range(r.randint(0, 60))) for _ in range(200)]
    ids = ids + list(range(100, 300))
    folder = written(spark, tmp_path, texts, ids)
    frame = QUERIES["op12_fill_in_middle"](spark, folder)
    rows = Counter(map(tuple, frame.collect()))
    want, forms = Counter(), Counter()
    for i, t in zip(ids, texts, strict=True):
        t = t or ""
        units = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
        n = len(units)
        h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        plain = not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90
        form = "plain" if plain else "spm" if h4 % 100 < 20 else "psm"
        out = {"plain": t, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want[i, n, form, None if plain else len(p), None if plain else len(m), sha(out), sha(t)] += 1
        forms[form] += 1
    assert rows == want and min(forms[x] for x in ("plain", "psm", "spm")) > 5
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    assert Counter(con.sql(ORACLE_SQL["op12_fill_in_middle"]).fetchall()) == want


def test_middle_keeps_columns_and_gives_texts(spark, odd):
    texts, ids = odd
    made = middle.fill_in_middle(docs(spark, texts, ids))
    assert made.count() == len(texts) and dict(made.dtypes)["n"] == "bigint" and "made" in made.columns
    for r in made.collect():
        assert middle.restore(r["output"], r["form"]) == (r["text"] or "")
    assert middle.fill_in_middle(docs(spark, ["a"]).where("doc_id < 0")).count() == 0
    assert any(x != y for x, y in zip(middle.draws("1:5"), middle.draws("2:5"), strict=True))


def plain_variants(texts, ids):
    n = Counter()
    for i, t in zip(ids, texts, strict=True):
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    form, close = {}, {}
    for w in n:
        close[w] = [x for x in n if abs(len(x) - len(w)) < 2 and near(w, x)]
        best = min(close[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    rows = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, n[w], len(close[w]), n[form[w]] if form[w] else None))
    return rows


@pytest.mark.parametrize("block", [50_000, 20])
def test_variants_against_brute_force(spark, tmp_path, odd, monkeypatch, block):
    monkeypatch.setattr(spelling, "BLOCK", block)
    monkeypatch.setattr(spelling, "HELD", block)
    monkeypatch.setattr(spelling, "LEAST_BITS", 64)  # a full bitmap lets more through, and loses nothing
    monkeypatch.setattr(spelling, "MOST_BITS", 64 if block < 100 else 1 << 28)
    r = random.Random(8)
    letters = "abcdeéßÿ"
    base = ["".join(r.choice(letters) for _ in range(r.randint(7, 10))) for _ in range(12)]
    texts, ids = list(odd[0]), list(odd[1])
    for k in range(150):
        words = []
        for _ in range(40):
            w = r.choice(base[:3] + base)
            if r.random() < 0.1:
                at = r.randrange(len(w))
                w = r.choice([w[:at] + w[at + 1 :], w[:at] + r.choice(letters) + w[at + 1 :], w[:at] + r.choice(letters) + w[at:]])
            words.append(r.choice([w, w.upper(), w.title()]))
        texts.append(" ".join(words))
        ids.append(1000 + k)
    # A chain: each ten times as frequent as the one before.
    for word, times in (("chainword", 500), ("chainwordx", 40), ("chainwordxx", 3)):
        texts += [word] * times
        ids += range(10_000, 10_000 + times)
    n = 3000 if block > 100 else 30
    texts += ["long" * n, "long" * n, "long" * (n - 1) + "lon"] * 2
    ids += [None, None, None] * 2
    got = QUERIES["op13_spelling_variants"](spark, written(spark, tmp_path, texts, ids)).collect()
    assert {tuple(x[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for x in got} == plain_variants(texts, ids) and len({x["word"] for x in got}) == len(got)
    assert any(x["form"] and x["root"] != x["form"] for x in got)


def test_variants_of_nothing(spark):
    assert spelling.spelling_forms(docs(spark, [None, "", "short wd"])).count() == 0
    assert spelling.spelling_forms(docs(spark, ["a"]).where("doc_id < 0")).count() == 0


def test_neighbour_hashes_are_those_of_the_texts():
    words, alphabet = ["abca", "ddab"], np.array([ord(c) for c in "abdé"], np.uint32)
    seen = defaultdict(Counter)
    for edit, letter, h, counts in spelling.near_hashes(spelling.points(words), alphabet):
        for row, w in enumerate(words):
            for at in range(h.shape[1]):
                x = w[:at] + w[at + 1 :] if edit == "delete" else w[:at] + chr(letter) + w[at + (edit == "replace") :]
                assert spelling.hashed([x])[0] == h[row, at]
                seen[w][x] += int(counts[row, at])
    for w in words:  # each text once, the word itself never
        assert {x: n for x, n in seen[w].items() if n != 1} in ({w: 0}, {})


def test_parts_of_lines_and_marks_are_encoded_once():
    """Pairs of words with a line feed between them, and words with marks, are not encoded each (op11 took 428 CPU seconds a GB); ids are the library's."""
    import public_tokenizers

    model, asked = tiers.ByteIds(public_tokenizers.path("byte_bpe_50k.json")), []
    parts_of = model._encode_parts
    model._encode_parts = lambda parts: parts_of(asked.extend(parts) or parts)
    words = [f"w{chr(97 + i)}é" for i in range(20)]
    texts = ["".join(f" {a}.\n{b}$$" for b in words) for a in words]
    assert model.many(texts) == model._encode(texts) and len(asked) <= 2 * len(words) + 1  # and the empty one
    pick, letters = random.Random(3), "aZ9é ß ×÷ª²½  \n\n\t\r.,'s#$*-_ ᠎\u0085\x1c漢字٣́😀"
    odd = ["".join(pick.choice(letters) for _ in range(pick.randint(0, 40))) for _ in range(2000)] + ["", " ", "<|endoftext|> x y"]
    assert model.many(odd) == [model(t) for t in odd] == model._encode(odd) and model.many([]) == []
