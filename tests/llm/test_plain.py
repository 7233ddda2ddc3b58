"""Operators against plain versions of themselves on small tables."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tickloom.llm import decontaminate as dc
from tickloom.llm import langid, packing, secrets, simhash

R = random.Random(21)


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema).repartition(3)


# --- secrets


def test_forest_on_findings_apart_from_training(spark):
    model = secrets.train(secrets.labelled_findings(spark))
    apart = secrets.features(secrets.labelled_findings(spark, 4000, start=100_000))
    assert not set(r["candidate"] for r in secrets.labelled_findings(spark).where("label = 1").collect()) & set(r["candidate"] for r in apart.where("label = 1").collect())
    rows = model.transform(apart).groupBy("label", "prediction").count().collect()
    n = {(r["label"], r["prediction"]): r["count"] for r in rows}
    assert n[1.0, 1.0] / (n[1.0, 1.0] + n.get((1.0, 0.0), 0)) > 0.9  # recall
    assert n[1.0, 1.0] / (n[1.0, 1.0] + n.get((0.0, 1.0), 0)) > 0.9  # precision


def test_candidates_equal_a_plain_search(spark):
    import re

    pattern = re.compile(secrets.CANDIDATE)
    key = lambda n: "".join(R.choice("abcdefABCDEF0123456789") for _ in range(n))
    texts = [None, "", "short a1b2c3", f'x password="{key(14)}7a" end', f"a={key(32)}&b={key(32)}&a2={key(40)}", f"eyJ{key(30)}.{key(20)}.{key(10)}==", "x" * 19 + " " + "y" * 20, f"{key(24)} {key(24)}"]
    # Words of many candidates, of long ones and with long neighbours.
    texts += [":".join(key(R.choice([12, 13, 30, 200])) for _ in range(300)) for _ in range(3)] + ["q" * 5000 + "! " + ";".join(key(16) for _ in range(50)) + " " + "z:" * 4000]
    texts += [" ".join(R.choice(["the", key(R.randint(3, 40)), "token:", "2353820953013749", "a-b_c/d"]) for _ in range(30)) for _ in range(20)]
    want = []
    for i, t in enumerate(texts):
        words = re.split(r"\s+", t) if t is not None else []
        for at, w in enumerate(words):
            for m in pattern.finditer(w):
                two = " ".join([words[at - 2][-64:] if at > 1 else "", words[at - 1][-64:] if at else ""])
                want.append((i, at, m.group(), f"{two} {w[: m.start()][-64:]}", words[at + 1][:64] if at + 1 < len(words) else ""))
    docs = frame(spark, list(enumerate(texts))).withColumn("source", F.lit("s")).withColumn("words", F.lit("clash")).withColumn("near", F.lit(1))
    got = [(r["doc_id"], r["word_at"], r["candidate"], r["before"], r["after"]) for r in secrets.candidates(docs, "source").collect()]
    assert sorted(got) == sorted(want) and len(want) > 80


def test_a_long_text_without_spaces_costs_its_length(spark):
    key = lambda n: "".join(R.choice("abcdef0123456789") for _ in range(n))
    docs = frame(spark, [(1, ",".join(key(20) for _ in range(20_000)))]).withColumn("source", F.lit("s"))
    kept = secrets.candidates(docs, "source").agg(F.count("*").alias("n"), F.sum(F.length("before")).alias("chars")).first()
    assert kept["n"] == 20_000 and kept["chars"] <= 20_000 * (3 * secrets.BACK + 2)


# --- packing


def plain_best_fit(lengths, capacities, cost):
    """Each length, longest first, into the open bin with the least room, else into the cheapest new one."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    bins, where = [], {}
    for k, i in enumerate(order):
        n = lengths[i]
        fit = [b for b in range(len(bins)) if bins[b][0] - bins[b][1] >= n]
        if fit:
            room = min(bins[b][0] - bins[b][1] for b in fit)
            where[i] = [b for b in fit if bins[b][0] - bins[b][1] == room]
            b = room
            bins_of_room = where[i]
            chosen = max(bins_of_room, key=lambda x: bins[x][2])
            bins[chosen][1] += n
            bins[chosen][2] = k
        else:
            def price(c):
                rest = [lengths[j] for j in order[k + 1 :] if lengths[j] <= c - n]
                return (cost(c) / (n + min(c - n, sum(rest))), c)

            bins.append([min((price(c) for c in capacities if c >= n))[1], n, k])
    return sorted(min(c for c in capacities if c >= used) for _, used, _ in bins), sum(used for _, used, _ in bins)


@pytest.mark.parametrize("most", [60, 400, 512])
def test_best_fit_equals_the_plain_one(most):
    lengths = np.array([R.randint(1, most) for _ in range(150)])
    capacities = (64, 128, 256, 512)
    at, offset, caps = packing.best_fit(lengths, capacities)
    sizes, total = plain_best_fit(lengths.tolist(), capacities, packing.sequence_cost)
    assert sorted(caps.tolist()) == sizes and total == lengths.sum()
    for b in range(len(caps)):
        spans = sorted((int(offset[i]), int(offset[i] + lengths[i])) for i in np.flatnonzero(at == b))
        assert spans[0][0] == 0 and all(x[1] == y[0] for x, y in zip(spans, spans[1:], strict=False)) and spans[-1][1] <= caps[b]


def test_packing_on_odd_rows(spark, monkeypatch):
    rows = [(i % 7 if i % 3 else None, R.choice([None, 0, 5, 700, 10_000])) for i in range(300)] + [(None, 4096)] * 50
    docs = spark.createDataFrame(rows, "doc_id long, n_tokens int").withColumn("shard", F.lit("clash")).withColumn("n", F.lit(1)).withColumn("piece", F.lit("x")).repartition(3)
    out = packing.pack(docs).collect()
    assert sum(r["n_tokens"] for r in out) == sum(max(1, n or 1) for _, n in rows)
    held = defaultdict(list)
    for r in out:
        held[r["bin_id"]].append((r["bin_offset"], r["n_tokens"], r["bin_capacity"]))
    for spans in held.values():
        at = 0
        for o, n, c in sorted(spans):
            assert o == at
            at += n
        assert at <= spans[0][2] and all(at > c for c in packing.CAPACITIES if c < spans[0][2])
    assert packing.pack(docs.where("doc_id > 100")).count() == 0


# --- benchmark decontamination


def plain_distance(item, text):
    """The least edit distance of item to any part of text, by rows."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return min(row)


def test_matches_equal_all_items_in_all_documents(spark):
    word = lambda: "".join(R.choice("abcde") for _ in range(R.randint(2, 7)))
    items = [" ".join(word() for _ in range(n)) for n in (6, 9, 14, 14, 25)]
    items[3] = items[2][:-1] + "z"
    docs = []
    for k in range(45):
        body = list(R.choice(items))
        for _ in range(R.randint(0, 6)):
            at = R.randrange(len(body))
            body[at : at + R.randint(0, 1)] = R.choice(["", "x", "é", " "])
        docs.append(" ".join(word() for _ in range(R.randint(0, 12))) + " " + "".join(body) + " " + " ".join(word() for _ in range(R.randint(0, 12))))
    docs += ["", None, items[0], items[0].upper(), docs[0], "nothing of it"]
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in dc.matches(frame(spark, list(enumerate(docs))), frame(spark, list(enumerate(items)), "item_id long, text string")).collect()}
    want = {}
    for i, d in enumerate(docs):
        for k, item in enumerate(items):
            m = dc.normalised(item)
            if d is not None and plain_distance(m, dc.normalised(d)) <= len(m) // dc.CHARS_AN_EDIT:
                want[i, k] = plain_distance(m, dc.normalised(d))
    assert set(got) == set(want) and len(want) > 30
    assert all(got[x] >= want[x] for x in want) and sum(got[x] == want[x] for x in want) > 0.95 * len(want)
    kept = {r["doc_id"] for r in dc.decontaminate(frame(spark, list(enumerate(docs))).withColumn("distance", F.lit("clash")), frame(spark, list(enumerate(items)), "item_id long, text string")).collect()}
    assert kept == set(range(len(docs))) - {i for i, _ in want}


# --- fingerprints


def test_fingerprints_equal_plain_bits():
    texts = ["", "one", "A b C", "a b c d", "a b c d e a b c d e", "x\ty\nz  w v é ß", " ".join(R.choice("abcdefgh") for _ in range(300))]
    for text, fp in zip(texts, simhash.fingerprints_of([t.encode() for t in texts], 4), strict=True):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", low)]
        shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        assert int(fp) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


# --- language models


def plain_model(texts):
    """Interpolated Kneser-Ney of order 4 over characters, by dictionaries: bits(history, char)."""
    level = Counter()
    for t in texts:
        t = " " + langid.normalised(t).strip() + " "
        level.update(t[i - 3 : i + 1] for i in range(3, len(t)))
    tables = {}
    for k in range(4, 0, -1):
        n1, n2 = sum(n == 1 for n in level.values()), sum(n == 2 for n in level.values())
        d = min(0.95, max(0.05, n1 / (n1 + 2 * n2) if n1 else 0.5))
        sums = Counter()
        for g, n in level.items():
            sums[g[:-1]] += n
        p = {g: (n - min(d, n * 0.95)) / sums[g[:-1]] for g, n in level.items()}
        rest = Counter({c: 1.0 for c in sums})
        for g, x in p.items():
            rest[g[:-1]] -= x
        tables[k] = (p, rest, sums)
        level = Counter(g[1:] for g in level)

    def prob(history, c):
        out = 2.0**-langid.UNSEEN_BITS
        for k in range(1, min(3, len(history)) + 2):
            p, rest, sums = tables[k]
            context = history[len(history) - k + 1 :] if k > 1 else ""
            out = p.get(context + c, 0.0) + (rest[context] if context in sums else 1.0) * out
        return out

    return prob


def test_language_bits_equal_plain_kneser_ney(spark):
    make = lambda parts, n: " ".join("".join(R.choice(parts) for _ in range(R.randint(1, 4))) for _ in range(n))
    parts = {"en": ["the", "ing", "er", "on"], "de": ["sch", "ung", "ein", "ü"], "fr": ["eau", "oi", "ch", "é"]}
    train = [(i, make(parts[l], 60), l) for i, l in enumerate(list(parts) * 10)]
    model = langid.fit(frame(spark, train, "doc_id long, text string, lang string"))
    asked = [make(parts[l], 25) for l in parts] + [make(["the", "eau", "xq"], 20), "Zürich 12 is é", "a"]
    plain = {l: plain_model([t for _, t, k in train if k == l]) for l in parts}
    rows = {r["doc_id"]: r for r in langid.score(frame(spark, list(enumerate(asked))), model).collect()}
    for i, t in enumerate(asked):
        s = " " + langid.normalised(t).strip() + " "
        costs = {l: -sum(math.log2(p(s[max(0, j - 3) : j], s[j])) for j in range(1, len(s))) / (len(s) - 1) for l, p in plain.items()}
        best = min(costs, key=costs.get)
        assert rows[i]["lang_pred"] == best and rows[i]["entropy"] == pytest.approx(costs[best], rel=1e-3)


def test_junk_is_rejected_and_texts_are_not(spark):
    make = lambda parts, n: " ".join("".join(R.choice(parts) for _ in range(R.randint(1, 4))) for _ in range(n))
    parts = {"en": ["the", "ing", "er", "on", "at", "re"], "de": ["sch", "ung", "ein", "ü", "ge", "lich"]}
    train = frame(spark, [(i, make(parts[l], R.randint(20, 200)), l) for i, l in enumerate(list(parts) * 60)], "doc_id long, text string, lang string")
    letters = lambda n: " ".join("".join(R.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(R.randint(1, 9))) for _ in range(n))
    junk = [(1000 + i, letters(R.randint(30, 200)), None) for i in range(60)] + [(2000 + i, make(["przy", "szcz", "ów", "kół", "dzie"], 60), None) for i in range(40)] + [(3000, "12 ...", None)]
    model = langid.fit(train)
    every = train.unionByName(frame(spark, junk, "doc_id long, text string, lang string"))
    every = every.withColumn("med", F.lit("clash")).withColumn("mad", F.lit(1)).withColumn("Rejected", F.lit("clash"))
    out = langid.unlike(langid.score(every, model), F.col("doc_id") < 1000)
    assert set(out.columns) >= {"med", "mad"}
    rejected = {r["doc_id"] for r in out.where("rejected").select("doc_id").collect()}
    assert not {i for i in rejected if i < 1000} and len(rejected) >= 0.98 * len(junk)
