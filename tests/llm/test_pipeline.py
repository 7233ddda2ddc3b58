"""The pipeline's stages on a small table, against plain Python where the result is fixed."""

import random

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import lines


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(8)
    make = lambda parts, n=60: " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 4))) for _ in range(n))
    en, de = ["the", "ing", "er", "on", "at", "re"], ["sch", "ung", "ein", "ü", "ge", "lich"]
    texts = [(make(en) + "\n" + make(en), "en") for _ in range(25)] + [(make(de) + "\n" + make(de), "de") for _ in range(25)]
    item = make(en, 30)
    texts += [(make(en) + " " + item, "en"), ("123 456 ...", "en"), texts[3], (None, "en"), ("", "de")]
    rows = [(i, t, lang, "s", None if t is None else len(t)) for i, (t, lang) in enumerate(texts)]
    path = f"file://{tmp_path_factory.mktemp('tables')}"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    out = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, folder)
        assert out.columns == columns
        kept.append({r["doc_id"]: r["text"] for r in out.collect()})
    assert set(range(55)) - set(kept[0]) == {51, 53, 54}  # no letter
    assert kept[1][52] == "" and kept[1][3]  # the copy's lines are gone
    assert {50} == set(kept[2]) - set(kept[3])  # holds the item
    rows = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in rows} == set(kept[3])
    assert sum(r["n_tokens"] for r in rows) == sum(len(t.split()) + 1 for t in kept[3].values())


def test_no_rows(spark, folder):
    out = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, folder)
    assert out.count() == 0


def test_near_copies(spark):
    r = random.Random(3)
    words = lambda n: ["".join(r.choices("abcdefghij", k=6)) for _ in range(n)]
    shingles = lambda text: {tuple(text.split()[i : i + 5]) for i in range(len(text.split()) - 4)}
    texts, gone = [], set()
    for k, wanted in enumerate([0.70, 0.75, *[0.80 + 0.01 * i for i in range(16)]] * 2):
        own = words(204)
        broken = int(200 * (1 - wanted) / (1 + wanted))  # shingles lost on each side
        at = r.randrange(4, 180 - broken)
        copy = own[:at] + words(broken - 4) + own[at + broken - 4 :]
        a, b = shingles(" ".join(own)), shingles(" ".join(copy))
        assert abs(len(a & b) / len(a | b) - wanted) < 0.01
        texts += [" ".join(own), " ".join(copy)]
        if len(a & b) >= 0.8 * len(a | b):
            gone.add(2 * k + 1)
    assert len(gone) == 32
    base = words(300)  # a large group: every copy has one word of its own
    texts += [" ".join([*base[:i], "own" + str(i), *base[i + 1 :]]) for i in range(100, 200)]
    gone |= set(range(73, 172))
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    rows += [(r, t, "en", "s", 0) for r, t in ((200, None), (201, ""), (202, " "), (203, "two words"), (204, "Two  words"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in corpus_pipeline.remove_near_duplicates(spark, docs, "").collect()}
    assert set(range(172)) - kept == gone
    assert {200, 201, 202, 203, 204} & kept == {200, 203}


def test_repeated_runs(spark):
    run3 = ["a b c d", "e f g h", "", "i j k l"]  # twelve words, no block of 1, 2, 4 lines with ten but the whole
    run7 = [f"x{i} y{i}" for i in range(7)]
    tail = [" ".join(f"t{i}" for i in range(45)), "u v w", "x y z"]
    short = [f"s{i} r{i}" for i in range(4)]  # eight words
    bodies = [run3, run7, tail, short]
    texts = ["\n".join([f"own{k} line {j}", *body, f"end{k} line {j}"]) for k in range(3) for j, body in enumerate(bodies)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    out = {r["doc_id"]: (r["text"], r["n_removed"]) for r in lines.dedup_lines(docs, 10).collect()}
    for i, t in enumerate(texts):
        body = bodies[i % 4]
        if i < 4 or body is short:
            assert out[i] == (t, 0)
        else:
            assert out[i] == (f"own{i // 4} line {i % 4}\nend{i // 4} line {i % 4}", len(body))


def test_short_lines(spark):
    texts = [f"own words of document {i}\nLicensed under the Apache License, Version 2.0.\nall rights reserved\nthe end" for i in range(4)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r["doc_id"]: r["text"] for r in corpus_pipeline.remove_repeated_lines(spark, docs, "").collect()}
    assert out == {0: texts[0], **{i: f"own words of document {i}" for i in range(1, 4)}}


def test_stages_on_odd_rows(spark, folder):
    """Clashing columns, repeated rows, very long, empty and null texts in every stage."""
    r = random.Random(9)
    long = " ".join("".join(r.choice(["the", "ing", "er", "on", "at", "re"]) for _ in range(r.randint(1, 4))) for _ in range(60_000))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    more = spark.createDataFrame([(900, long, None, "s", 1), (901, long, "en", None, 2), (None, long[:400], "en", "s", None), (None, None, None, None, None)], docs.schema)
    docs = docs.unionByName(more).unionByName(docs.where("doc_id < 5")).unionByName(docs.where("doc_id IN (52, 53, 54)"))
    names = ["med", "mad", "rejected", "lang_pred", "entropy", "margin", "n_letters", "_row", "_doc", "_text", "_runs", "row", "key", "node", "least", "at", "n", "shard", "piece"]
    for k, name in enumerate(names):
        docs = docs.withColumn(name, F.lit(f"own {k}"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(x[n] == f"own {k}" for x in rows for k, n in enumerate(names)), name
        if name == "language ID":
            assert {x["lang"] for x in rows if x["doc_id"] == 900} == {"en"} and not [x for x in rows if not x["text"]]
            assert sum(x["doc_id"] is not None and x["doc_id"] < 5 for x in rows) == 10
        if name == "near-dedup":
            ids = [(x["doc_id"], x["text"]) for x in rows]
            assert len(ids) == len(set(ids)) and 901 not in {i for i, _ in ids}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert packed.select("doc_id", "piece", "start").count() >= docs.count()


def test_near_copies_meet_by_golay_codes():
    """The near-dedup's keys are codewords of SimHash sums; they meet at a likeness of 0.8, and unlike texts do not."""
    from tickloom.llm import similar
    from tickloom.llm.simhash import Golay

    g, r = Golay(), np.random.default_rng(5)
    word = np.arange(1 << 23)
    code = np.unique(word ^ g.error[g.low[word & 0xFFF] ^ g.high[word >> 12]])
    sums = r.normal(size=(2_000, 23)).astype(np.float32)
    signs = (code[:, None] >> np.arange(23) & 1) * 2 - 1
    assert len(code) == 1 << 12 and (code[(sums @ signs.T).argmax(1)] >> 11 == similar.codewords(sums)).mean() > 0.9
    some = lambda n: r.integers(1 << 64, size=n, dtype=np.uint64)
    met = 0
    for _ in range(200):
        a, new = some(252), some(28)
        keys, fp = similar.keys_of([a, np.append(a[:224], new), some(252)])  # 224 of 280 shared
        met += (keys[0] == keys[1]).any() and np.bitwise_count(fp[0] ^ fp[1]) <= similar.MOST_BITS
        assert np.bitwise_count(fp[0] ^ fp[2]) > 8
    assert met >= 198


def test_rows_of_a_key():
    """A key's rows stay if another is close; those of a crowded key stay all, over batches too."""
    import pyarrow as pa
    from tickloom.llm import similar

    key = [1, 2, 2, 3, 3, 4, 4, 4, *[5] * 1000, 6, 6]
    fp = [0, 0, 1, 0, -1, 0, -1, 3, *[0] * 1000, 0, 0]
    n = [9] * (len(key) - 1) + [99]
    whole = pa.RecordBatch.from_arrays([pa.array(key, pa.int32()), pa.array(range(len(key)), pa.int64()), pa.array(n, pa.int64()), pa.array(fp, pa.int64())], ["key", "node", "n", "fp"])
    for step in (1, 7, 300, 5000):
        batches = (whole.slice(at, step) for at in range(0, len(key), step))
        out = [x for b in similar._meeting(batches) for x in b.column(1).to_pylist()]
        assert out == [1, 2, 5, 7, *range(8, 1008)]
