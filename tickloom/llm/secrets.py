"""Secret scans: candidate strings judged by a random forest, in DataFrame functions only.

A candidate is a run of LEAST or more key characters, or of SHORT or more with a letter and a digit,
with what dots and equal signs join to it. A forest trained on labelled findings
tells secrets from false positives by length, character transitions, dictionary coverage,
the path and the neighbouring words.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

LEAST, SHORT = 20, 12
#: Characters that are looked at before a candidate, in its word and in the two words before.
BACK = 64
_KEY = r"A-Za-z0-9+/_\-"
CANDIDATE = rf"(?:[{_KEY}]{{{LEAST},}}|(?=[0-9+/_\-]*[A-Za-z])(?=[A-Za-z+/_\-]*[0-9])[{_KEY}]{{{SHORT},}})(?:[.=]+[{_KEY}]+)*=*"
#: The forest is fitted on so many labelled findings at most.
FINDINGS = 4_000
TREES, DEPTH, SEED = 30, 8, 7
THRESHOLD = 0.5

#: Letter groups and words whose share of a candidate is its dictionary coverage.
DICTIONARY = (
    "example sample dummy placeholder changeme password secret token test user admin name value data file path index default config "
    "http https www com org net src main build class public static void return import function object string number "
    "tion ing ment heit keit ung lich isch eit sch ein ich der die das und ver que eau aux tre ent ion les des est "
    "the and for that with this from have ere her hat ere ati ted ers ies all not are was out one our "
    "ado ción dad por para como los las una con ente eur oir ais ous ett ell and ere ter ver ber gen den nen ten er en in on an es re th st nd"
).split()
_WORDS = "|".join(sorted(set(DICTIONARY), key=lambda w: (-len(w), w)))

FEATURES = ("length", "digits", "uppers", "hex_only", "transitions", "distinct", "longest_letters", "vowels", "coverage", "key_word", "id_word", "assigned", "quoted", "test_path")


def features(findings: DataFrame) -> DataFrame:
    """findings (candidate, before, after, path) with FEATURES. Nulls count as empty strings."""
    text = {c: F.coalesce(F.col(c), F.lit("")) for c in ("candidate", "before", "after", "path")}
    x, before, n = text["candidate"], F.lower(text["before"]), F.greatest(F.length(text["candidate"]), F.lit(1))

    def share(pattern: str, of: Column = x) -> Column:
        return F.regexp_count(of, F.lit(pattern)) / n

    runs = F.transform(F.regexp_extract_all(x, F.lit("[A-Za-z]+"), 0), F.length)
    flag = lambda c: c.cast("double")
    return findings.withColumns(
        {
            "length": n.cast("double"),
            "digits": share("[0-9]"),
            "uppers": share("[A-Z]"),
            "hex_only": flag(x.rlike("^([0-9a-f]+|[0-9A-F]+)$") & x.rlike("[0-9]")),
            "transitions": share("(?<=[a-z])[A-Z0-9]|(?<=[A-Z])[a-z0-9]|(?<=[0-9])[A-Za-z]"),
            "distinct": F.size(F.array_distinct(F.split(x, ""))) / n,
            "longest_letters": F.coalesce(F.array_max(runs), F.lit(0)) / n,
            "vowels": share("[aeiouAEIOU]"),
            "coverage": 1 - F.length(F.regexp_replace(F.lower(x), _WORDS, "")) / n,
            "key_word": flag(before.rlike("token|secret|passw|pwd|key|auth|bearer|credential|private")),
            "id_word": flag(before.rlike("commit|sha|md5|hash|uuid|digest|checksum|revision|build|\\bid\\b")),
            "assigned": flag(before.rlike("[=:]\\W*$")),
            "quoted": flag(before.rlike("[\"'`]$")),
            "test_path": flag(F.lower(text["path"]).rlike("test|example|fixture|sample|mock|docs?/")),
        }
    )


def labelled_findings(spark: SparkSession, n: int = FINDINGS, start: int = 0) -> DataFrame:
    """Made findings (candidate, before, after, path, label), a bounded and repeatable set: numbers
    start to start + n, so that those beyond FINDINGS are apart from the training set.

    Secrets are random hex, base64 and mixed keys after words of assignment; false positives
    are long words, identifiers, commit and content hashes, paths and placeholders.
    """
    r = lambda k: F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(1 << 30))
    pick = lambda k, *xs: F.element_at(F.array(*map(F.lit, xs)), (r(k) % len(xs) + 1).cast("int"))
    hexed, b64 = F.sha1(F.concat(F.lit("s"), "id")), F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat(F.lit("b"), "id"), 256))), "=", "")
    syllable = lambda k: pick(k, "the", "tion", "ing", "er", "on", "heit", "schen", "ver", "ment", "eau", "aux", "ción", "ado", "an", "re", "st", "ung", "lich", "que", "and")
    word = F.regexp_replace(F.concat(*(syllable(100 + k) for k in range(9))), "ó", "o")
    secret = F.when(r(1) % 5 == 0, b64).when(r(1) % 5 == 1, F.substring(hexed, 1, 32)).when(r(1) % 5 == 2, F.upper(hexed)).when(r(1) % 5 == 3, F.concat(F.substring(b64, 1, 11), F.lit("7"), F.substring(b64, 12, 4))).otherwise(hexed)
    benign = F.when(r(2) % 6 == 0, word).when(r(2) % 6 == 1, F.when(r(16) % 2 == 0, word).otherwise(F.concat(syllable(17), syllable(18), syllable(19), F.lit("_"), (r(20) % 100 + 1960).cast("string")))).when(r(2) % 6 == 2, hexed).when(r(2) % 6 == 3, F.concat_ws("/", syllable(3), word, F.lit("index"))).when(r(2) % 6 == 4, F.concat_ws("_", syllable(4), F.lit("example"), syllable(5), F.lit("value"), F.lit("config"))).otherwise(F.repeat(pick(6, "0", "a", "x", "-", "_", "1234"), 24))
    keyed = F.concat(pick(7, "token", "api_key", "secret", "password", "AUTH_TOKEN", "private key", "client_secret"), pick(8, " = ", "=", ": ", " := "), pick(9, "\"", "'", "", "\""))
    plain = F.when(F.col("benign_hash"), F.concat(pick(10, "commit ", "sha1 ", "md5: ", "build ", "uuid=", "checksum "), pick(11, "", "\""))).otherwise(F.concat(word, F.lit(" "), syllable(12), pick(13, " ", " ", ": ", " (")))
    rows = spark.range(start, start + n).withColumns({"label": (F.pmod(F.xxhash64("id"), F.lit(2))).cast("double"), "benign_hash": r(2) % 6 == 2})
    return rows.select(
        "label",
        F.when(F.col("label") == 1, secret).otherwise(benign).alias("candidate"),
        F.when((F.col("label") == 1) | (~F.col("benign_hash") & (r(14) % 10 == 0)), keyed).otherwise(plain).alias("before"),
        F.lit("").alias("after"),
        F.when((F.col("label") == 0) & (r(15) % 3 == 0), "tests/fixture").otherwise("src").alias("path"),
    )


def train(findings: DataFrame) -> PipelineModel:
    """A forest fitted on FINDINGS labelled findings at most (label 1: a secret)."""
    forest = RandomForestClassifier(featuresCol="vector", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
    return Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="vector"), forest]).fit(features(findings.limit(FINDINGS)))


def candidates(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, word_at, candidate, before, after, path) of each candidate in docs' whole texts.

    before is the end of the two words before the candidate's word and of what stands before it there, BACK
    characters each at most: a word with any number of candidates, or a text without a space, costs its length.
    Only words with a candidate and their neighbours leave the text.
    """
    found = docs.where(F.col("text").rlike(CANDIDATE)).select("doc_id", F.col(path).alias("path"), F.split("text", r"\s+").alias("words"))
    end = lambda x: F.right(F.coalesce(x, F.lit("")), F.lit(BACK))
    near = lambda w, i: F.struct(i.alias("word_at"), w.alias("word"), F.concat_ws(" ", end(F.get("words", i - 2)), end(F.get("words", i - 1))).alias("near"), F.left(F.coalesce(F.get("words", i + 1), F.lit("")), F.lit(BACK)).alias("after"))
    hits = F.filter(F.transform("words", lambda w, i: F.when(w.rlike(CANDIDATE), near(w, i))), lambda x: x.isNotNull())
    found = found.select("doc_id", "path", F.inline(hits))
    found = found.withColumns({"all": F.regexp_extract_all("word", F.lit(CANDIDATE), 0), "between": F.split("word", CANDIDATE, -1)})
    # Candidates have SHORT characters, so the last few of them and what is between them fill BACK.
    few = range(-(-BACK // SHORT), 0, -1)
    head = lambda i: end(F.concat(*(x for k in few for x in (end(F.get("between", i - k)), end(F.get("all", i - k)))), end(F.get("between", i))))
    each = F.transform("all", lambda x, i: F.struct(x.alias("candidate"), head(i).alias("head")))
    found = found.select("doc_id", "path", "word_at", "near", "after", F.inline(each))
    return found.select("doc_id", "path", "word_at", "candidate", "after", F.concat_ws(" ", "near", "head").alias("before"))


def scan(docs: DataFrame, model: PipelineModel, path: str = "source", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, word_at, candidate, score, is_secret): every candidate with the forest's probability.

    docs has doc_id, text and the column named by path. Null texts hold none, a null path is
    an empty one; repeated rows and repeated candidates are all reported; a text without
    candidates adds no row. There is no shuffle: findings are made and judged where texts are read.
    """
    judged = model.transform(features(candidates(docs, path)))
    score = vector_to_array("probability")[1]
    return judged.select("doc_id", "word_at", "candidate", score.alias("score"), (score >= threshold).alias("is_secret"))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates of documents with their verdicts; a secret is shown by its ends and hash only.

    Null and empty texts have none, equal rows report theirs each, repeated candidates are all reported, a text without
    spaces is one word, an empty table gives no row.
    """
    found = scan(table(spark, sf_dir, "documents"), train(labelled_findings(spark)))
    shown = F.concat(F.substring("candidate", 1, 4), F.lit("..."), F.substring("candidate", -2, 2))
    return found.select("doc_id", "word_at", shown.alias("shown"), F.sha2("candidate", 256).alias("candidate_sha256"), F.round("score", 6).alias("score"), "is_secret")
