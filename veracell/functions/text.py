"""Normalisers, signatures and similarities of cell values, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens that profiles count as missing, and the shorter list that rules use.
PROFILE_MISSING = ("", "-", "--", "?", "n.a", "n/a", "na", "nan", "none", "not available", "null", "unknown")
RULE_MISSING = ("", "-", "?", "n/a", "na", "nan", "none", "null", "unknown")


def collapsed(v: Column) -> Column:
    """Trimmed, lower case, white space runs as one space."""
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(v, r"\s+", " "))), r"\s+", " ")


def signature(v: Column) -> Column:
    """Identity of a value; ``<na>`` for null and ``<empty>`` for nothing left."""
    text = collapsed(v)
    return F.when(v.isNull(), "<na>").when(text == "", "<empty>").otherwise(text)


def token(v: Column) -> Column:
    return F.coalesce(collapsed(v), F.lit(""))


def missing_like(v: Column, extra: tuple[str, ...] = ()) -> Column:
    return v.isNull() | token(v).isin(*RULE_MISSING, *extra)


def _shape(v: Column, keep: str, other: str | None) -> Column:
    # a placeholder keeps the digits' D from being read as a letter
    out = F.regexp_replace(F.trim(v), r"\p{Nd}", "\u0001")
    out = F.regexp_replace(out, r"\p{L}", "A")
    out = F.regexp_replace(out, r"\s", "S")
    if other is not None:
        out = F.regexp_replace(out, f"[^\u0001AS{keep}]", other)
    out = F.regexp_replace(out, "\u0001", "D")
    return F.when(v.isNull() | (out == ""), "<empty>").otherwise(out)


def shape(v: Column) -> Column:
    """Digits D, letters A, white space S, all else as it is."""
    return _shape(v, "", None)


def profile_shape(v: Column) -> Column:
    """As ``shape``, but signs other than - _ / become ?."""
    return _shape(v, r"\-_/", "?")


def explorer_shape(v: Column) -> Column:
    return _shape(v, r"\-_/.", "?")


def run_shape(v: Column) -> Column:
    """The shape with each run of D, A or S as one."""
    out = shape(v)
    for c in "DAS":
        out = F.regexp_replace(out, f"{c}+", c)
    return out


_DELIMITER = r"^[\-_/.:\s]"


def segment(s: Column) -> Column:
    """D, A, M or X with the length of a segment, or <sign:n> of a delimiter."""
    n = F.length(s).cast("string")
    first = F.when(F.substring(s, 1, 1).rlike(r"\s"), " ").otherwise(F.substring(s, 1, 1))
    return (F.when(s.rlike(_DELIMITER), F.concat(F.lit("<"), first, F.lit(":"), n, F.lit(">")))
            .when(s.rlike(r"^\p{Nd}+$"), F.concat(F.lit("D"), n))
            .when(s.rlike(r"^\p{L}+$"), F.concat(F.lit("A"), n))
            .when(s.rlike(r"^[\p{L}\p{Nd}]+$"), F.concat(F.lit("M"), n))
            .otherwise(F.concat(F.lit("X"), n)))


def grammar(v: Column) -> Column:
    """Segments between delimiters, with the delimiters."""
    parts = F.regexp_extract_all(F.trim(v), F.lit(r"([\-_/.:\s]+|[^\-_/.:\s]+)"), 1)
    out = F.array_join(F.transform(parts, segment), "|")
    return F.when(v.isNull() | (out == ""), "<empty>").otherwise(out)


def surface(v: Column) -> Column:
    """What kind of surface a value has."""
    t = F.coalesce(F.trim(v), F.lit(""))
    return (F.when(t.rlike(r"^[-+]?\d+(\.\d+)?\s*%$"), "numeric_percent_suffix")
            .when(t.rlike(r"^[-+]?\d+(\.\d+)?$"), "plain_numeric")
            .when(t.rlike(r"^[-+]?\d+(\.\d+)?\s+[^\d\s].*$"), "numeric_with_suffix")
            .when(t.rlike(r"^[\p{L}\s\-_/'().&]+$"), "lexical")
            .when(t.rlike(r"\p{Nd}") & t.rlike(r"\p{L}"), "mixed_alphanumeric")
            .otherwise("other"))


def full_match(v: Column, pattern: str) -> Column:
    return F.coalesce(v.rlike(f"^(?:{pattern})$"), F.lit(False))


def ngrams(v: Column, n: int = 3) -> Column:
    """Distinct character n-grams; a shorter value is its own only one."""
    low = F.lower(v)
    grams = F.transform(F.sequence(F.lit(1), F.length(low) - (n - 1)), lambda k: F.substring(low, k, n))
    return F.when(F.length(low) >= n, F.array_distinct(grams)).when(F.length(low) > 0, F.array(low)).otherwise(F.array().cast("array<string>"))


def words(v: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(v), F.lit("([a-z0-9]+)"), 1))


def jaccard(a: Column, b: Column) -> Column:
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / either).otherwise(0.0)


def similarity(a: Column, b: Column) -> Column:
    """0.55 edit + 0.25 trigrams + 0.20 words; 0 if either is empty."""
    longest = F.greatest(F.length(a), F.length(b))
    edit = 1 - F.levenshtein(F.lower(a), F.lower(b)) / longest
    mix = 0.55 * edit + 0.25 * jaccard(ngrams(a), ngrams(b)) + 0.20 * jaccard(words(a), words(b))
    return F.when((F.length(a) > 0) & (F.length(b) > 0), mix).otherwise(0.0)


def prototype_evidence(best: Column) -> tuple[Column, Column]:
    """(close, far) strengths of the best similarity to a prototype."""
    return (F.when(best >= 0.88, F.least(F.lit(1.0), 0.4 + 0.6 * best)).otherwise(0.0),
            F.when(best <= 0.35, F.least(F.lit(1.0), 0.5 + (0.35 - best))).otherwise(0.0))


def relation_holds(kind: str, value: Column, other: Column) -> Column:
    """Whether a value and another column's value of its row agree."""
    a, b = token(value), token(other)
    if kind == "prefix_match":
        return a.startswith(b)
    if kind == "contains":
        return a.contains(b)
    if kind == "stateavg_format":
        return a.startswith(F.concat(b, F.lit("_")))
    if kind == "zip_prefix":
        return F.substring(a, 1, 3) == F.substring(b, 1, 3)
    raise ValueError(f"unknown relation {kind}")


def typo_kind(dirty: Column, clean: Column) -> Column:
    """How a wrong value differs from the right one."""
    d, c = F.coalesce(dirty, F.lit("")), F.coalesce(clean, F.lit(""))
    distance = F.levenshtein(d, c)
    same = F.length(d) == F.length(c)
    return (F.when(same & (distance == 1), "char_substitution").when(same & (distance <= 3), F.concat(distance.cast("string"), F.lit("_char_typo")))
            .when(~same & (distance <= 3), "length_mismatch").otherwise("major_difference"))
