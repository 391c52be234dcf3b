"""Text as column expressions: blanks, tokens, identifiers and name normal forms. The patterns mean the same in RE2."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

EDGES = r"^[\s\p{Z}]+|[\s\p{Z}]+$"
WORD = r"[\p{L}\p{N}_]+"
#: The lexical lane's token pattern and stop words.
LEXICAL = r"[a-z0-9]+(?:['’][a-z]+)?"
LEXICAL_STOPS = (
    "a an and are as at be been by for from had has have he her his in into is it its of on or she that the their this "
    "to was were what when where which who whom whose will with would they them you your we our i"
).split()
#: Endings that keep their full stop, and types that lose a leading article.
ABBREVIATIONS = [" Inc.", " Ltd.", " Bros.", " Corp.", " Co.", " Jr.", " Sr.", " Dr."]
ARTICLE_TYPES = ["GPE", "LOCATION", "EVENT"]


def strip(c: Column) -> Column:
    """Without blanks of any kind at either end."""
    return F.regexp_replace(c, EDGES, "")


def strip_sql(c: str) -> str:
    return rf"regexp_replace({c}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def lexical_tokens(c: Column) -> Column:
    """Lower-cased ASCII tokens without stop words, in order; null has none."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(f"({LEXICAL})"), F.lit(1))
    return F.filter(tokens, lambda t: ~t.isin(LEXICAL_STOPS))


def word_tokens(c: Column) -> Column:
    """Unicode words, lower-cased."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(f"({WORD})"), F.lit(1))


def blank_tokens(c: Column) -> Column:
    """Lower-cased tokens between blanks."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"), lambda t: t != "")


def short_hash(c: Column, n: int) -> Column:
    """The first n hex digits of the SHA-256."""
    return F.substring(F.sha2(c, 256), 1, n)


def source_id(source: Column) -> Column:
    """S07."""
    return short_hash(source, 16)


def entity_id(name: Column, kind: Column) -> Column:
    """Id of a name as written, by type."""
    return short_hash(F.concat(F.lower(strip(name)), F.lit(":"), kind), 24)


def chunk_id(source: Column, position: Column, text: Column) -> Column:
    """C04."""
    return short_hash(F.concat_ws(":", source, position.cast("string"), F.substring(text, 1, 50)), 20)


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard of two token arrays' sets, 0 if either is empty."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def canonical_form(c: Column) -> Column:
    """E09 over a name that is already in NFKC: trailing parenthesis, honorific, suffix, possessive, final dot away."""
    s = strip(F.coalesce(c, F.lit("")))
    s = F.regexp_replace(s, r"\s*\([^)]*\)\s*$", "")
    s = F.regexp_replace(s, r"(?i)^(?:Mr|Mrs|Ms|Mx|Dr|Prof|Sir|Lord|Lady|Saint|St)\.?\s+", "")
    s = F.regexp_replace(s, r"(?i),?\s+(?:PhD|Ph\.D|MD|M\.D|Esq)\.?\s*$", "")
    s = F.regexp_replace(s, r"(?i)['’]s\b", "")
    s = F.regexp_replace(s, r"\.$", "")
    return F.replace(F.lower(F.trim(F.regexp_replace(s, r"\s+", " "))), F.lit("ß"), F.lit("ss"))


def canonical_sql(c: str) -> str:
    s = strip_sql(f"coalesce({c}, '')")
    for pattern in (r"\s*\([^)]*\)\s*$", r"(?i)^(?:Mr|Mrs|Ms|Mx|Dr|Prof|Sir|Lord|Lady|Saint|St)\.?\s+", r"(?i),?\s+(?:PhD|Ph\.D|MD|M\.D|Esq)\.?\s*$", r"(?i)[''’]s\b", r"\.$"):
        s = f"regexp_replace({s}, '{pattern}', '', 'g')"
    return f"replace(lower(trim(regexp_replace({s}, '\\s+', ' ', 'g'))), 'ß', 'ss')"


def normal_name(c: Column, kind: Column) -> Column:
    """Trailing marks away, final dot kept only behind an abbreviation, leading article away for places and events."""
    s = F.regexp_replace(strip(F.coalesce(c, F.lit(""))), r"[,;:]+$", "")
    keep = F.lit(False)
    for a in ABBREVIATIONS:
        keep = keep | s.endswith(a)
    s = F.when(s.endswith(".") & ~keep, F.regexp_replace(s, r"\.$", "")).otherwise(s)
    return F.when(kind.isin(ARTICLE_TYPES), F.regexp_replace(s, r"^(?:The|A|An) (?=..)", "")).otherwise(s)


@F.pandas_udf(StringType())
def nfkc(names: pd.Series) -> pd.Series:
    """Unicode compatibility composition, for which Spark has no built-in."""
    return names.map(lambda s: unicodedata.normalize("NFKC", s) if isinstance(s, str) else s)
