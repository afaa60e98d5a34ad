"""Operator 4: quality rules in a bitmask ledger, DataFrame functions only.

Each rule is evaluated once a document. The ledger keeps the measurements and
one integer whose bits say which rules failed. A policy is a version and a mask
of the rules it enforces, so a new policy, its verdicts and its ablations never
read a text again: they are bitwise operations on the ledger, and a histogram of
the distinct bit sets (at most 2 to the number of rules) answers all of them.

Words are runs without space, tab, line feed, vertical tab, form feed or
carriage return. Repeated windows are sought by hashes of five word hashes; in
the texts where a hash repeats, the words themselves are compared.

Defined results: a null or empty text has no words and fails the word count;
repeated rows get a row each; an empty table gives no rows; other columns are
unread and may have any name. Work is linear in a text's length but for one sort
of its window hashes, made only where some window repeats.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, id_and_text, quoted, spread, table

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """``failed`` is SQL over the measurements."""

    name: str
    failed: str


#: Bit k is rule k; rules are only ever appended.
RULES = (
    Rule("few_words", "n_words < 10"),
    Rule("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words and n_words > 0"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 25 * n_words"),
    Rule("repeated_lines", "2 * n_dup_lines > n_lines and n_dup_lines > 2"),
)
BIT = {rule.name: 1 << k for k, rule in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_windows"]


@dataclass(frozen=True)
class Policy:
    version: str
    mask: int


POLICIES = {p.version: p for p in (
    Policy("base", BASE),
    Policy("v1", BASE | BIT["symbols"] | BIT["short_words"] | BIT["long_words"]),
    Policy("v2", (1 << len(RULES)) - 1),
)}
CURRENT = "v2"


def settled(column: Column) -> Column:
    """The column, computed once: a filter on it, or what is made of it, is not
    pushed to where the column would be computed again for each array element."""
    return F.when(F.spark_partition_id() >= 0, column)


def repeated_words(starts: Column) -> Column:
    """Words under windows with these start positions, ascending."""
    gaps = F.transform(starts, lambda at, k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - at, F.lit(WINDOW))))
    return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda total, x: total + x)


def measure(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key``, n_words, word_chars, n_symbols, n_lines, n_dup_lines and
    n_repeat_words of (key, text); the key may be a struct, such as a whole row."""
    # one space for each other: the split then needs no pattern
    d = docs.select(F.col(key), F.coalesce("text", F.lit("")).alias("text")).withColumn("flat", settled(F.translate("text", SPACES, " " * len(SPACES))))
    d = d.select(
        key,
        settled(F.array_remove(F.split("flat", " "), "")).alias("words"),
        F.length(F.translate("flat", " ", "")).cast("bigint").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        settled(F.filter(F.split("text", "\n"), lambda line: F.length(F.translate(line, SPACES, "")) > 0)).alias("lines"),
    )
    d = d.select(
        key, "word_chars", "n_symbols", "words",
        F.size("words").cast("bigint").alias("n_words"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        settled(F.transform("words", lambda w: F.xxhash64(w))).alias("hashes"),
    )
    windows = F.transform(
        F.when(F.col("n_words") >= WINDOW, F.sequence(F.lit(0), (F.col("n_words") - WINDOW).cast("int"))).otherwise(F.array().cast("array<int>")),
        lambda k: F.xxhash64(*[F.get("hashes", k + j) for j in range(WINDOW)]))
    d = d.withColumn("windows", settled(windows)).drop("hashes")
    # most texts repeat no window: theirs need no sort
    pairs = F.when(F.size(F.array_distinct("windows")) < F.size("windows"),
                   F.sort_array(F.transform("windows", lambda h, k: F.struct(h.alias("h"), F.array_join(F.slice("words", k + 1, WINDOW), " ").alias("w"), k.alias("k")))))
    d = d.withColumn("pairs", settled(pairs)).drop("windows", "words")
    same = lambda p, k: F.get("pairs", k)["h"].eqNullSafe(p["h"]) & F.get("pairs", k)["w"].eqNullSafe(p["w"])
    starts = F.sort_array(F.transform(F.filter("pairs", lambda p, k: same(p, k - 1) | same(p, k + 1)), lambda p: p["k"]))
    d = d.withColumn("starts", settled(starts)).drop("pairs")
    return d.withColumn("n_repeat_words", settled(F.coalesce(repeated_words(F.col("starts")), F.lit(0).cast("bigint")))).drop("starts")


def ledger(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Measurements and ``fail_bits`` of (key, text)."""
    bits = F.lit(0).cast("bigint")
    for rule in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(rule.failed), F.lit(BIT[rule.name])).otherwise(F.lit(0)).cast("bigint"))
    return measure(docs, key).withColumn("fail_bits", bits)


def verdicts(book: DataFrame, version: str = CURRENT) -> DataFrame:
    """Adds ``base_failed`` and the policy's ``kept``; what the base forms
    reject no policy keeps."""
    mask = POLICIES[version].mask | BASE
    return book.withColumn("base_failed", F.col("fail_bits").bitwiseAND(F.lit(BASE)) != 0).withColumn(
        "kept", F.col("fail_bits").bitwiseAND(F.lit(mask)) == 0)


def kept_rows(docs: DataFrame, version: str = CURRENT) -> DataFrame:
    """The rows of ``docs``, with all their columns, that a policy keeps."""
    docs = spread(docs)
    whole = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"), F.col("text").cast("string").alias("text"))
    return verdicts(ledger(whole, "row"), version).where("kept").select("row.*")


def ablations(book: DataFrame, version: str = CURRENT) -> DataFrame:
    """For each rule of a policy: documents it fails, those it alone fails (they
    would be kept without it), and those kept with the whole policy. One
    aggregation by bit set; what follows has a row a set."""
    mask = POLICIES[version].mask
    sets = book.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = [F.struct(F.lit(r.name).alias("rule"), F.lit(BIT[r.name]).cast("bigint").alias("bit")) for r in RULES if BIT[r.name] & mask]
    each = sets.select("bits", "n", F.explode(F.array(*rules)).alias("r"))
    return each.groupBy(F.lit(version).alias("policy"), F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_failed_alone"),
        F.sum(F.when(F.col("bits") == 0, F.col("n")).otherwise(0)).alias("n_kept"))


def by_group(docs_book: DataFrame, key: str) -> DataFrame:
    """Which rules any and all documents of a group fail: bitwise or and and,
    combined before the shuffle."""
    return docs_book.groupBy(key).agg(F.bit_or("fail_bits").alias("any_failed"), F.bit_and("fail_bits").alias("all_failed"), F.count("*").alias("n"))


COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")


def stored(docs: DataFrame) -> DataFrame:
    """The ledger of (doc_id, text), written once; policies and ablations read it."""
    return Scratch(docs.sparkSession, "ledger").keep(ledger(docs), "rows")


def op4_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(stored(id_and_text(table(spark, sf_dir, "documents")))).select(*COLUMNS)


def ledger_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy fails, alone and in all: from the stored ledger."""
    book = stored(id_and_text(table(spark, sf_dir, "documents")))
    out = [ablations(book, version) for version in POLICIES]
    return reduce(DataFrame.unionByName, out)


_SQL_BITS = " | ".join(f"(CASE WHEN {r.failed} THEN {BIT[r.name]} ELSE 0 END)" for r in RULES)
_SQL_BOOK = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT rid, list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) AS win FROM w WHERE len(ws) >= 5),
u AS (SELECT rid, unnest(win) AS x, unnest(range(1, len(win) + 1)) AS pos FROM g),
r AS (SELECT rid, pos FROM (SELECT rid, pos, count(*) OVER (PARTITION BY rid, x) AS n FROM u) WHERE n > 1),
c AS (SELECT rid, count(DISTINCT pos + k) AS n FROM r, (SELECT unnest(range(0, 5)) AS k) GROUP BY rid),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN c USING (rid)),
b AS (SELECT *, CAST({_SQL_BITS} AS BIGINT) AS fail_bits FROM m)
"""
OP4_SQL = _SQL_BOOK + f"""SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (fail_bits & {BASE}) <> 0 AS base_failed, (fail_bits & {POLICIES[CURRENT].mask | BASE}) = 0 AS kept, fail_bits FROM b
"""
_SQL_RULES = " UNION ALL ".join(f"SELECT '{p.version}' AS policy, '{r.name}' AS rule, {BIT[r.name]} AS bit, {p.mask} AS mask" for p in POLICIES.values() for r in RULES if BIT[r.name] & p.mask)
ABLATIONS_SQL = _SQL_BOOK + f""", p AS ({_SQL_RULES})
SELECT policy, rule, CAST(count(*) FILTER ((fail_bits & bit) <> 0) AS BIGINT) AS n_failed, CAST(count(*) FILTER ((fail_bits & mask) = bit) AS BIGINT) AS n_failed_alone,
       CAST(count(*) FILTER ((fail_bits & mask) = 0) AS BIGINT) AS n_kept FROM b, p GROUP BY 1, 2
"""
