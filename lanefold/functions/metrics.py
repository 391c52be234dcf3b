"""Scalar metrics of answers and ranked lists as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lanefold.functions.text import strip

#: Fixed value: the F1 from which an answer counts as correct in the soft sense.
SOFT_F1 = 0.6
#: Fixed value: words of the prediction in which a yes or no is looked for.
YESNO_WORDS = 5
#: Fixed value: the ASCII punctuation that normalisation drops.
PUNCTUATION = r"[!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"
#: Phrases by which an answer declines.
ABSTENTION = [
    "i don't know", "i cannot", "i can not", "cannot determine", "not enough information", "insufficient",
    "no answer", "unknown", "the context does not", "the context doesn't",
]
#: The shorter list of the row comparison.
ABSTENTION_SHORT = ["i don't know", "i do not know", "cannot determine", "not enough information", "unknown"]
#: Bare yes or no answers.
YESNO_ANSWERS = [
    "yes", "no", "yes.", "no.", "yes, they are.", "no, they are not.", "yes, they were.", "no, they were not.",
]


def normalise_answer(c: Column) -> Column:
    """Lower case, articles to blanks, punctuation away, blanks collapsed; in this order. Null is empty."""
    text = F.lower(strip(F.coalesce(c, F.lit(""))))
    text = F.regexp_replace(text, r"\b(a|an|the)\b", " ")
    text = F.regexp_replace(text, PUNCTUATION, "")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def words(c: Column) -> Column:
    """The blank-separated words of a normalised text; none for an empty one."""
    return F.filter(F.split(c, " "), lambda w: w != "")


def exact_match(prediction: Column, gold: Column) -> Column:
    """Equality, a gold of several words as a whole phrase, or yes/no among the first words."""
    p, g = normalise_answer(prediction), normalise_answer(gold)
    phrase = g.contains(" ") & F.concat(F.lit(" "), p, F.lit(" ")).contains(F.concat(F.lit(" "), g, F.lit(" ")))
    yes_no = g.isin("yes", "no") & F.array_contains(F.slice(words(p), 1, YESNO_WORDS), g)
    return (g != "") & ((p == g) | phrase | yes_no)


def token_f1(prediction: Column, gold: Column) -> Column:
    """F1 of the two word multisets; 0 where either is empty."""
    p, g = words(normalise_answer(prediction)), words(normalise_answer(gold))
    times = lambda a, w: F.size(F.filter(a, lambda x: x == w))
    common = F.aggregate(F.array_distinct(p), F.lit(0), lambda acc, w: acc + F.least(times(p, w), times(g, w)))
    precision, recall = common / F.size(p), common / F.size(g)
    return F.when((F.size(p) == 0) | (F.size(g) == 0) | (common == 0), F.lit(0.0)).otherwise(2 * precision * recall / (precision + recall))


def collapse(c: Column) -> Column:
    """Blanks collapsed, trimmed, lower-cased."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def norm_title(c: Column) -> Column:
    """Lower-cased, without a leading dataset prefix (letters up to the first underscore, without a blank), blanks collapsed."""
    return collapse(F.regexp_replace(F.lower(F.trim(c)), r"^[^ _]+_(?=.)", ""))


def confidence_level(c: Column) -> Column:
    """High, medium or low as they are, anything else is error."""
    level = F.lower(strip(F.coalesce(c, F.lit(""))))
    return F.when(level.isin("high", "medium", "low"), level).otherwise(F.lit("error"))


def contains_any(c: Column, phrases: list[str]) -> Column:
    """Whether the text holds one of the phrases."""
    out = F.lit(False)
    for phrase in phrases:
        out = out | c.contains(phrase)
    return out


def recall_at(ranked: Column, gold: Column, k: int) -> Column:
    """Share of the gold ids among the first k; 0 without gold."""
    hit = F.size(F.array_intersect(F.slice(ranked, 1, k), gold))
    return F.when(F.size(gold) > 0, hit / F.size(gold)).otherwise(F.lit(0.0))


def dcg_at(ranked: Column, gold: Column, k: int) -> Column:
    """Sum of 1 / log2(rank + 1) over the gold ids among the first k."""
    gains = F.transform(F.slice(ranked, 1, k), lambda x, i: F.when(F.array_contains(gold, x), 1 / F.log2(i + F.lit(2.0))).otherwise(F.lit(0.0)))
    return F.aggregate(gains, F.lit(0.0), lambda acc, x: acc + x)


def ndcg_at(ranked: Column, gold: Column, k: int) -> Column:
    """DCG over that of a perfect ranking; 0 without gold."""
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.size(gold), F.lit(k)))), F.lit(0.0), lambda acc, i: acc + 1 / F.log2(i + F.lit(1.0)))
    return F.when(F.size(gold) > 0, dcg_at(ranked, gold, k) / ideal).otherwise(F.lit(0.0))


def reciprocal_rank(ranked: Column, gold: Column) -> Column:
    """1 / rank of the first gold id, 0 if none is ranked."""
    places = F.filter(F.transform(ranked, lambda x, i: F.when(F.array_contains(gold, x), i + 1)), lambda i: i.isNotNull())
    return F.when(F.size(places) > 0, 1 / F.array_min(places)).otherwise(F.lit(0.0))
