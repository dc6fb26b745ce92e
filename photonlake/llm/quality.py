"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once a document. The ledger keeps the measurements and one long whose bit k is set where rule
k fails. A policy is a version and the set of rules that reject; applying one, or comparing what each rule rejects
alone, reads the ledger and never the texts.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, let

WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """A rule's bit, its name, and the SQL condition over the ledger's measurements under which it fails."""

    bit: int
    name: str
    fails: str


#: The rules in order of their bits; a bit is never given to another rule.
RULES = (
    Rule(0, "few_words", "n_words < 10"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "duplicate_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule(4, "short_words", "word_chars < 2 * n_words"),
    Rule(5, "long_words", "word_chars > 15 * n_words"),
    Rule(6, "many_words", "n_words > 100000"),
)
BASE = ("few_words", "repeated_words")
#: Versioned policies: the rules that reject.
POLICIES: Mapping[str, tuple[str, ...]] = {
    "base": BASE,
    "v1": (*BASE, "symbols", "short_words", "long_words", "many_words"),
    "v2": (*BASE, "symbols", "duplicate_lines", "short_words", "long_words", "many_words"),
}
POLICY = "v1"


def mask(names: tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> int:
    return sum(1 << r.bit for r in rules if r.name in names)


def repeated_words(words: Column) -> Column:
    """The number of words in windows of 5 that occur twice or more.

    Windows are compared by a 64-bit hash. Only where some repeat, they are sorted with their places; each place whose
    neighbour in that order has the same hash covers 5 words, less those that the next such place covers too.
    """
    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))

    def covered(places: Column) -> Column:
        steps = F.zip_with(F.slice(places, 2, F.greatest(F.size(places) - 1, F.lit(0))), F.slice(places, 1, F.greatest(F.size(places) - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(WINDOW)))
        return F.when(F.size(places) == 0, 0).otherwise(F.aggregate(steps, F.lit(WINDOW), lambda acc, x: acc + x))

    def repeats(h: Column) -> Column:
        def among(s: Column) -> Column:
            return F.sort_array(
                F.transform(
                    F.filter(
                        F.transform(s, lambda x, k: F.struct(x["i"].alias("i"), ((x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"])).alias("twice"))),
                        lambda x: x["twice"],
                    ),
                    lambda x: x["i"],
                )
            )

        in_order = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(let(in_order, among), covered))

    return F.when(F.size(words) < WINDOW + 1, 0).otherwise(let(hashes, repeats))


def measurements(text: Column) -> Column:
    """A struct of the base measurements of a text; null text measures as empty.

    Words are the runs of other than white space, lines the pieces between line feeds that have a word.
    """

    def of_words(words: Column) -> Column:
        return F.struct(F.size(words).cast("long").alias("n_words"), repeated_words(words).cast("long").alias("n_repeat_words"))

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))

    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return F.struct(
        let(F.array_remove(F.split(text, SPACES), ""), of_words).alias("w"),
        let(lines, of_lines).alias("l"),
        F.char_length(F.regexp_replace(text, SPACES, "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
    )


def ledger(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the measurements, and failures: the bits of the rules that fail. One pass without a shuffle.

    Null and empty texts have measurements of 0 and fail few_words; repeated rows have a row each; an empty table gives
    no rows; further columns are ignored.
    """
    base = documents.select(documents["doc_id"], measurements(documents["text"]).alias("m"))
    flat = base.select("doc_id", "m.w.n_words", "m.word_chars", "m.n_symbols", "m.l.n_dup_lines", "m.w.n_repeat_words", "m.l.n_lines")
    bits = sum((F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(0).cast("long") for r in rules), F.lit(0).cast("long"))
    return flat.withColumn("failures", bits)


def apply_policy(entries: DataFrame, names: tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """entries with base_failed and kept.

    Entries come from ledger(), whose failures are never null; an entry that fails no rule of the policy is kept, repeated
    ones alike; no entries give no rows.
    """
    return entries.withColumns({"base_failed": F.col("failures").bitwiseAND(mask(BASE, rules)) != 0, "kept": F.col("failures").bitwiseAND(mask(names, rules)) == 0})


def ablation(entries: DataFrame, names: tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rule of a policy: rejected (documents that it fails), alone (that no other of the policy fails).

    Masks are counted first, so at most 2 ** len(rules) rows, whatever the corpus, are compared with each rule. Repeated
    entries count as often as they are there; a rule that nothing fails has zeros; no entries give no rows.
    """
    counts = entries.groupBy(F.col("failures").bitwiseAND(mask(names, rules)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    listed = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in rules if r.name in names]))
    each = counts.select("bits", "n", listed.alias("r")).select("bits", "n", "r.*")
    return each.groupBy("rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("rejected"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("alone"),
    )


def common_failures(entries: DataFrame, by: str) -> DataFrame:
    """For each value of a column, bits that every document fails and bits that any does.

    Null is a value of its own; counts are summed on the map side, so a value of very many entries is no hot group; no
    entries give no rows.
    """
    return entries.groupBy(by).agg(F.bit_and("failures").alias("all_fail"), F.bit_or("failures").alias("any_fail"), F.count(F.lit(1)).alias("n"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_policy(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")), POLICIES[POLICY])


def op9_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ablation(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")), POLICIES["v2"])


_W = r"[^\x20\x09-\x0D]+"
_LEDGER = rf"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents
), m AS (
  SELECT doc_id, r, t, regexp_extract_all(t, '{_W}') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_W}')) AS ls FROM w
), g AS (
  SELECT r, unnest(list_transform(range(1, greatest(len(ws) - 3, 1)), lambda i: {{'i': i, 'g': array_to_string(ws[i:i+4], ' ')}})) AS x FROM m WHERE len(ws) >= 5
), p AS (
  SELECT r, x.i AS i, count(*) OVER (PARTITION BY r, x.g) AS n FROM g
), c AS (
  SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM p WHERE n > 1
), q AS (
  SELECT r, CAST(sum(least(5, coalesce(nxt - i, 5))) AS BIGINT) AS n_repeat_words FROM c GROUP BY r
), e AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, CAST(len(ls) AS BIGINT) AS n_lines
  FROM m LEFT JOIN q USING (r)
), f AS (
  SELECT *, CAST({" + ".join(f"CASE WHEN {r.fails} THEN {1 << r.bit} ELSE 0 END" for r in RULES)} AS BIGINT) AS failures FROM e
)
"""
QUERIES = {"op9_quality": op9_quality, "op9b_ablation": op9_ablation}
ORACLE_SQL = {
    "op9_quality": _LEDGER + f"SELECT *, failures & {mask(BASE)} <> 0 AS base_failed, failures & {mask(POLICIES[POLICY])} = 0 AS kept FROM f",
    "op9b_ablation": _LEDGER
    + " UNION ALL ".join(
        f"SELECT '{r.name}' AS rule, count(*) FILTER (failures & {1 << r.bit} <> 0) AS rejected, count(*) FILTER (failures & {mask(POLICIES['v2'])} = {1 << r.bit}) AS alone FROM f"
        for r in RULES if r.name in POLICIES["v2"]
    ),
}
