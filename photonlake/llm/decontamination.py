"""Benchmark decontamination by winnowing, in DataFrame functions only.

Both sides are cut in words; each side's k-grams are hashed and the least hash of every window of `WINDOW - K + 1`
k-grams is kept. Two texts that share `WINDOW` words share such a minimum. A document's kept hashes that a benchmark
item has too are hits; around each, every stretch of `WINDOW` words that holds the k-gram is compared with the
benchmark's own. Stretches that occur are joined back on their words, so a hash never decides alone.

The benchmark's hashes are held in the plan up to MOST_IN_PLAN of them, which a count checks: that is a broadcast join
of proven size, and no document is shuffled. A larger benchmark is joined, which shuffles the kept hashes of the
documents; both ways give the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, ascii_lower, let

WINDOW = 10
K = 5
MOST_IN_PLAN = 50_000
#: The bytes between words, once A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def item_words(text: Column) -> Column:
    """The runs of digits, lower-case ASCII letters and other than ASCII; null text has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


def gram_hashes(words: Column, k: int) -> Column:
    """The hash of each run of k words, in order; empty if there are fewer."""
    return F.when(F.size(words) < k, F.array().cast("array<long>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(words) - (k - 1)), lambda i: F.xxhash64(F.slice(words, i, k))))


def minima(hashes: Column, window: int = WINDOW, k: int = K) -> Column:
    """The least hash of each window of k-grams, each once; empty for texts shorter than the window."""
    w = window - k + 1
    return F.when(F.size(hashes) < w, F.array().cast("array<long>")).otherwise(
        F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(hashes) - (w - 1)), lambda i: F.array_min(F.slice(hashes, i, w))))
    )


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, n and gram: every stretch of `window` words of each item; an item of fewer words is one stretch."""
    w = benchmark.select("item_id", item_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)))
    return w.select("item_id", F.least(F.size("w"), F.lit(window)).alias("n"), F.explode(F.transform(starts, lambda i: F.concat_ws(" ", F.slice("w", i, window)))).alias("gram")).distinct()


def _starts_around(words: Column, hits: Column, window: int, k: int) -> Column:
    """Where stretches of `window` words begin that hold the k-gram at one of the hits (from 1)."""
    around = F.transform(hits, lambda j: F.sequence(F.greatest(j - (window - k), F.lit(1)), F.least(j, F.size(words) - (window - 1))))
    return F.array_distinct(F.flatten(around))


def matched(documents: DataFrame, kept: list[int], windows: list[int], short: dict[int, list[int]], window: int = WINDOW, k: int = K) -> DataFrame:
    """doc_id, n_words and found (start, n, gram): every stretch of a document that may be a benchmark window.

    kept: the benchmark's winnowed hashes; windows: hashes of its stretches of full length; short: by length, those of
    items shorter than the window, which no winnowing of the full length covers and whose every place is compared.
    """

    def is_in(x: Column, values: list[int]) -> Column:
        return x.isin(values) if values else F.lit(False)

    def stretches(words: Column, starts: Column, n: int, values: list[int]) -> Column:
        at = F.filter(starts, lambda s: is_in(F.xxhash64(F.slice(words, s, n)), values))
        return F.transform(at, lambda s: F.struct(s.alias("start"), F.lit(n).alias("n"), F.concat_ws(" ", F.slice(words, s, n)).alias("gram")))

    def full(words: Column) -> Column:
        def of(h: Column) -> Column:
            def around(hits: Column) -> Column:
                places = F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(hits, x), i + 1)), lambda i: i.isNotNull())
                return let(_starts_around(words, places, window, k), lambda starts: stretches(words, starts, window, windows))

            hits = F.filter(minima(h, window, k), lambda x: is_in(x, kept))
            none = F.array().cast("array<struct<start:int,n:int,gram:string>>")
            return let(hits, lambda x: F.when(F.size(x) == 0, none).otherwise(around(x)))

        return let(gram_hashes(words, k), of)

    def everything(words: Column) -> Column:
        parts = [full(words)]
        for n, values in sorted(short.items()):
            places = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
            parts.append(stretches(words, places, n, values))
        return F.struct(F.size(words).cast("long").alias("n_words"), F.concat(*parts).alias("found"))

    return documents.select("doc_id", let(item_words(F.col("text")), everything).alias("x")).select("doc_id", "x.n_words", "x.found")


def _found(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K, most_in_plan: int = MOST_IN_PLAN) -> tuple[DataFrame, DataFrame]:
    """doc_id, n_words, found and row of all documents, and the benchmark's windows."""
    work = Workspace(documents.sparkSession, "winnow")
    grams = work.stage(benchmark_windows(benchmark.select("item_id", "text"), window), "windows")
    item = benchmark.select(item_words(F.col("text")).alias("w")).where(F.size("w") >= window)
    kept = work.stage(item.select(F.explode(let(gram_hashes(F.col("w"), k), lambda h: minima(h, window, k))).alias("h")).distinct(), "kept")
    hashed = grams.select("n", F.xxhash64(F.split("gram", " ")).alias("h")).distinct()
    if hashed.limit(most_in_plan + 1).count() > most_in_plan:
        short = benchmark.select(item_words(F.col("text")).alias("w")).where(F.size("w").between(1, window - 1))
        anchors = short.select(F.array_max(F.transform("w", lambda x: F.struct(F.length(x), x.alias("anchor"))))["anchor"].alias("anchor"), F.size("w").alias("n")).distinct()
        found = _matched_by_join(documents, kept, hashed, anchors, work, window, k)
    else:
        by_length: dict[int, list[int]] = {}
        for r in hashed.collect():
            by_length.setdefault(r.n, []).append(r.h)
        found = matched(documents, [r.h for r in kept.collect()], by_length.pop(window, []), by_length, window, k)
    return work.stage(found.withColumn("row", F.monotonically_increasing_id()), "found"), grams


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K, most_in_plan: int = MOST_IN_PLAN) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of all documents.

    Null texts and texts without words have no words and hits; items without words are never found; repeated documents
    have a row each, repeated items with equal item_id count once; with an empty benchmark nothing is hit; an empty
    table gives no rows; further columns are ignored.
    """
    found, grams = _found(documents, benchmark, window, k, most_in_plan)
    each = found.where(F.size("found") > 0).select("row", F.inline("found"))
    # items by window first: a window that very many items share is one row for each place that has it
    holders = grams.groupBy("n", "gram").agg(F.array_sort(F.collect_set("item_id")).alias("holders"))
    real = each.join(holders, ["n", "gram"])
    hit = real.groupBy("row").agg(
        F.array_distinct(F.flatten(F.collect_set("holders"))).alias("items"), F.array_sort(F.collect_set(F.struct("start", "n"))).alias("spans")
    )
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).alias("hit"), F.lit(0).alias("end")),
        lambda a, s: F.struct((a["hit"] + F.greatest(s["start"] + s["n"] - 1 - F.greatest(a["end"], s["start"] - 1), F.lit(0))).alias("hit"), F.greatest(a["end"], s["start"] + s["n"] - 1).alias("end")),
    )
    hit = hit.select("row", covered["hit"].cast("long").alias("n_hit"), F.array_sort(F.col("items").cast("array<string>")).alias("items"))
    n_hit, items = F.coalesce(F.col("n_hit"), F.lit(0)), F.coalesce(F.col("items"), F.array().cast("array<string>"))
    return found.drop("found").join(hit, "row", "left").select(
        "doc_id", "n_words", n_hit.cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


def clean_documents(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents, in all their columns, that no benchmark window occurs in.

    Hit documents leave by an anti-join on their doc_ids, of which there are few; rows with a null doc_id are known by
    the hash of their text. Null and empty texts have no window and stay; a very long text is searched whole; rows with
    one doc_id leave together where one of their texts is hit; an empty benchmark drops nothing, and an empty table gives
    no rows.
    """
    work = Workspace(documents.sparkSession, "decontaminated")
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(F.col("text"), F.lit("")))))
    found = contamination(documents.select(key.alias("doc_id"), "text"), benchmark, window)
    bad = work.stage(found.where("contaminated").select(F.col("doc_id").alias("__key")).distinct(), "hit")
    return documents.withColumn("__key", key).join(bad, "__key", "left_anti").select(*documents.columns)


def _matched_by_join(documents: DataFrame, kept: DataFrame, hashed: DataFrame, anchors: DataFrame, work: Workspace, window: int, k: int) -> DataFrame:
    """As matched(), with the benchmark's hashes in tables; only documents with a hit give their stretches.

    anchors: the longest word of each item shorter than the window, with the item's number of words. A document that
    has none of them has no such item, and one that has gives its stretches as hashes; the words of those that the
    benchmark has too are compared at the end, as for full windows.
    """
    base = work.stage(documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", item_words(F.col("text")).alias("w")), "words")
    hits = base.select("row", F.explode(let(gram_hashes(F.col("w"), k), lambda h: minima(h, window, k))).alias("h")).join(kept, "h", "left_semi").select("row").distinct()
    anchored = base.select("row", F.explode(F.array_distinct("w")).alias("anchor")).join(anchors, "anchor").select("row", "n").distinct()
    wanted = work.stage(hits.select("row", F.lit(window).alias("n")).union(anchored), "wanted")
    stretches = F.transform(F.sequence(F.lit(1), F.size("w") - (F.col("n") - 1)), lambda s: F.struct(s.alias("start"), F.xxhash64(F.slice("w", s, F.col("n"))).alias("h")))
    each = base.join(wanted, "row").where(F.size("w") >= F.col("n")).select("row", "n", F.inline(stretches)).join(hashed, ["n", "h"], "left_semi")
    at = each.groupBy("row").agg(F.collect_list(F.struct("start", "n")).alias("at"))
    none = F.array().cast("array<struct<start:int,n:int,gram:string>>")
    found = F.transform("at", lambda x: F.struct(x["start"].alias("start"), x["n"].alias("n"), F.concat_ws(" ", F.slice("w", x["start"], x["n"])).alias("gram")))
    return base.join(at, "row", "left").select("doc_id", F.size("w").cast("long").alias("n_words"), F.coalesce(found, none).alias("found"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_W = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
QUERIES = {"op6_decontamination": op6_decontamination}
ORACLE_SQL = {
    "op6_decontamination": rf"""
WITH b AS (
  SELECT item_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '{_W}') AS ws FROM benchmark
), g AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, unnest(list_transform(range(1, greatest(len(ws) - 8, 2)), lambda i: array_to_string(ws[i:i+9], ' '))) AS gram FROM b WHERE len(ws) > 0
), lengths AS (
  SELECT DISTINCT n FROM g
), d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '{_W}') AS ws FROM documents
), w AS (
  SELECT r, n, unnest(list_transform(range(1, len(ws) - n + 2), lambda i: {{'i': i, 'gram': array_to_string(ws[i:i+n-1], ' ')}})) AS x FROM d, lengths WHERE len(ws) >= n
), h AS (
  SELECT r, x.i AS i, w.n, item_id FROM w JOIN g ON g.n = w.n AND g.gram = x.gram
), places AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM h) GROUP BY r
), items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY r
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (r) LEFT JOIN items USING (r)
"""
}
