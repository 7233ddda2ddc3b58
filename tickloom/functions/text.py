"""Column expressions on text: lexicon relevance, story tokens and their overlap."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Term, weight and direction (1 bullish, -1 bearish, 0 neither).
LEXICON = (
    ("deliveries", 1.0, 0), ("delivery", 1.0, 0), ("deliver", 0.8, 0), ("production", 0.8, 0), ("q2", 0.6, 0), ("quarterly", 0.5, 0), ("vehicle", 0.4, 0),
    ("record", 0.5, 1), ("beat", 0.8, 1), ("crush", 0.8, 1), ("surge", 0.5, 1), ("miss", 0.8, -1), ("fall short", 0.8, -1), ("decline", 0.5, -1), ("drop", 0.4, -1),
    ("recall", 0.9, -1), ("nhtsa", 0.8, -1), ("investigation", 0.7, -1), ("probe", 0.6, -1), ("lawsuit", 0.6, -1), ("crash", 0.6, -1), ("death", 0.6, -1),
    ("downgrade", 1.0, -1), ("upgrade", 1.0, 1), ("price target", 0.9, 0), ("overweight", 0.6, 1), ("underweight", 0.6, -1), ("sell rating", 0.8, -1),
    ("musk", 0.5, 0), ("robotaxi", 0.7, 0), ("fsd", 0.6, 0), ("full self", 0.6, 0), ("autopilot", 0.5, 0), ("optimus", 0.5, 0), ("energy storage", 0.6, 0),
    ("guidance", 0.7, 0), ("margin", 0.6, 0), ("demand", 0.5, 0), ("tariff", 0.7, -1), ("subsidy", 0.6, 0), ("tax credit", 0.7, 0), ("ev credit", 0.7, 0),
    ("profit-taking", 0.6, -1), ("sell the news", 0.8, -1), ("valuation", 0.4, -1), ("jobs report", 0.8, 0), ("payrolls", 0.8, 0), ("nonfarm", 0.8, 0),
    ("unemployment", 0.7, 0), ("fed", 0.6, 0), ("cpi", 0.7, 0), ("inflation", 0.6, 0),
)
#: What a source's word counts for.
SOURCE_WEIGHTS = {"press_release": 1.0, "economic": 0.9, "analyst": 0.8, "stock_news": 0.6, "general_news": 0.4, "insider": 0.3}
#: Terms of a good and of a bad figure.
BEAT_TERMS = ("beat", "crush", "top", "record", "surpass", "exceed", "blowout")
MISS_TERMS = ("miss", "fall short", "fell short", "disappoint", "decline", "below")
STOP = ("the", "and", "for", "with", "its", "has", "are", "was", "will", "this", "that")


def relevance(text: str | Column, direction: int | Column, lexicon=LEXICON) -> Column:
    """0 to 1: the weights of contained terms over 4, up to 1, raised when the terms' direction agrees and lowered when not.

    Terms are looked for in the first 1,500 characters, whatever case; a null text has none."""
    low = F.lower(F.substring(F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit("")), 1, 1500))
    terms = F.array(*(F.struct(F.lit(t).alias("term"), F.lit(float(w)).alias("weight"), F.lit(float(w * d)).alias("lean")) for t, w, d in lexicon))
    none = F.struct(F.lit(0.0).alias("weight"), F.lit(0.0).alias("lean"))

    def add(total: Column, x: Column, body: Column) -> Column:
        more = F.struct((total["weight"] + x["weight"]).alias("weight"), (total["lean"] + x["lean"]).alias("lean"))
        return F.when(F.contains(body, x["term"]), more).otherwise(total)

    def rated(total: Column) -> Column:
        base = F.least(F.lit(1.0), total["weight"] / 4)
        lean = F.round(total["lean"] * direction, 9)
        return F.when(total["weight"] == 0, 0.0).when(lean > 0, F.least(F.lit(1.0), base * 1.15)).when(lean < 0, base * 0.75).otherwise(base)

    # Each step is bound to a variable, so that the text is lowered and its terms are added up once.
    totals = F.transform(F.array(low), lambda body: F.aggregate(terms, none, lambda total, x: add(total, x, body)))
    return F.get(F.transform(totals, rated), F.lit(0))


def story_tokens(text: str | Column, stop=STOP) -> Column:
    """Distinct six-character stems of words of three letters or more."""
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0), lambda w: (F.length(w) > 2) & ~w.isin(*stop))
    return F.array_distinct(F.transform(words, lambda w: F.substring(w, 1, 6)))


def same_story(a: Column, b: Column) -> Column:
    """Overlap of half the smaller token set or more; empty sets are no story."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least >= 0.5).otherwise(False)


def contains_any(text: Column, terms: tuple[str, ...]) -> Column:
    """Whether the lower-cased text holds one of the terms."""
    return F.coalesce(F.lower(text).rlike("|".join(t.replace(".", "\\.") for t in terms)), F.lit(False))


def verdict(beats: Column, misses: Column) -> Column:
    """beat, miss, mixed or unknown, from counts of texts of either kind."""
    return F.when((beats > 0) & (misses > 0), "mixed").when(beats > 0, "beat").when(misses > 0, "miss").otherwise("unknown")
