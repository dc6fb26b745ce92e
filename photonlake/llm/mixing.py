"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Each source has a rate, the copies expected of any of its documents. Documents of a source stand in a fixed order,
their expected copies are summed up to and with each one, and a document is emitted once for each whole number that
its stretch of the sum, moved by one random offset of the source, crosses. The order goes by size first, so that
the words taken keep near the target as well as the number of documents does.

The sum needs no sorted pass over a source: documents fall in cells (source, class of size, part of a hash). Cells
are counted with map-side sums, the counts are summed over the some 30,000 cells at most of a source, and only within a
cell are documents ranked. The hash is that of doc_id and text, so a source, a size, a doc_id or a text that holds a
third of all rows is spread over many tasks. Rows equal in all three are one with a count until the ranks are known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACES, Workspace

#: The weights of the sources in order of code point, null last, repeating.
WEIGHTS = (5, 2, 1)
MOST = 3.0
SEED = "mix-1"


def offset(source: Column, seed: str) -> Column:
    """A number from 0 to below 1 that source and seed decide."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """source, source_size, target: shares by weight of all sizes, none above `most` times its source's size.

    sizes has a row for each source. What sources at their ceiling leave is shared by weight among the others until
    none is above; the result is the level t with the sum of least(ceiling, t * weight) equal to all sizes. Sources
    in order of ceiling / weight: the first k are at their ceiling where the level left for the others is below the
    next one's ratio. The windows run over one row a source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ratio = Window.orderBy(F.col("ceiling") / F.col("weight"), F.col("place"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("place"), F.lit(len(weights))) + 1).cast("int")).cast("double")
    before, everything = ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("ceiling").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    return (
        sizes.withColumn("place", F.row_number().over(by_name) - 1)
        .withColumn("weight", weight)
        .withColumn("ceiling", F.col("source_size") * F.lit(most))
        .withColumn("level", level)
        .withColumn("t", F.min(F.when(F.col("level") * F.col("weight") <= F.col("ceiling"), F.struct(F.col("ceiling") / F.col("weight"), F.col("level")))).over(everything)["level"])
        .select("source", "source_size", F.least(F.col("ceiling"), F.coalesce(F.col("t"), F.lit(float("inf"))) * F.col("weight")).alias("target"))
    )


def with_copies(records: DataFrame, targets: DataFrame, seed: str = SEED) -> DataFrame:
    """source, doc_id, size, mark and whole with before, n, source_size, target, rate, u and most, a row for equal records.

    The n equal records stand at the places before + 1 to before + n of their source; copies_at() says what each takes.
    A source without words takes nothing. Rates are at most 3; the greatest number of copies is their ceiling.
    """
    size_class = F.when(F.col("size") > 0, F.floor(F.log2(F.col("size").cast("double")) * 8) + 1).otherwise(0).cast("int")
    part = F.substring(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("mark"))), 1, 2)
    cells = ["source_key", "size_class", "part"]
    alike = records.groupBy("source", "doc_id", "size", "mark", "whole").agg(F.count(F.lit(1)).alias("n"))
    keyed = alike.withColumns({"source_key": F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")), "size_class": size_class, "part": part})
    earlier = Window.partitionBy("source_key").orderBy("size_class", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        keyed.groupBy(*cells).agg(F.sum("n").alias("cell"))
        .withColumn("start", F.coalesce(F.sum("cell").over(earlier), F.lit(0)))
        .select(*cells, "start")
    )
    own = targets.select(
        F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("source_key"), "source_size", "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"),
        offset(F.col("source"), seed).alias("u"),
    )
    cell_start = starts.join(own, "source_key")
    until = F.sum("n").over(Window.partitionBy(*cells).orderBy("size", "doc_id", "mark", "whole").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        keyed.withColumn("until", until)
        .join(cell_start, cells)
        .withColumns({"before": F.col("start") + F.col("until") - F.col("n"), "most": F.ceil(F.col("rate"))})
        .drop("source_key", "size_class", "part", "until", "start")
    )


#: Places or copies of equal rows that one row stands for before it is spread over tasks.
BLOCK = 10_000


def spread(rows: DataFrame, n: Column) -> DataFrame:
    """rows, each n times, with __k from 0 to n - 1; those of one row go to many tasks, BLOCK at a time."""
    blocks = rows.withColumns({"__n": n, "__block": F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / BLOCK)))})
    dealt = blocks.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("__block", *rows.columns[:2]))
    first = F.col("__block") * BLOCK
    return dealt.withColumn("__k", F.explode(F.sequence(first, F.least(first + BLOCK, F.col("__n")) - 1))).drop("__n", "__block")


def copies_between(before: Column, n: Column) -> Column:
    """The copies of n documents at the places after before together."""
    rate, u = F.col("rate"), F.col("u")
    return F.least(F.floor((before + n) * rate + u) - F.floor(before * rate + u), n * F.col("most")).cast("long")


def copies_at(place: Column) -> Column:
    """The copies of the document at a place of its source: the whole numbers that its stretch of the sum crosses."""
    rate, u = F.col("rate"), F.col("u")
    return F.least(F.floor(place * rate + u) - F.floor((place - 1) * rate + u), F.col("most")).cast("long")


def mix_plan(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken (copies times size) of all documents.

    Null text and text without words have size 0; a very long text is one document; a null source is a source, the
    last; repeated rows are documents of their own, at places next to each other; an empty table gives no rows; further
    columns are ignored. Reruns give the same copies.
    """
    placed = _placed(documents, F.lit(0).cast("long"), weights, most, seed)
    each = spread(placed, F.col("n")).withColumn("place", F.col("before") + 1 + F.col("__k"))
    return each.withColumn("copies", copies_at(F.col("place"))).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _placed(documents: DataFrame, whole: Column, weights: tuple[int, ...], most: float, seed: str) -> DataFrame:
    """with_copies() of documents; mark is the text's hash, whole tells rows apart that have equal texts."""
    work = Workspace(documents.sparkSession, "mix")
    records = work.stage(documents.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("mark"), whole.alias("whole")), "records")
    targets = source_targets(records.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    return with_copies(records, targets, seed)


def word_count(text: Column) -> Column:
    """The number of runs of other than white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def mixed(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST, seed: str = SEED) -> DataFrame:
    """documents, each row as many times as the mix takes it, in all its columns.

    A row finds its copies by doc_id and a hash of all its columns. Rows equal in both are one row, with the copies that
    they take together, so reruns give the same rows. Nulls, very long texts, ties and empty tables are as in mix_plan().
    """
    work = Workspace(documents.sparkSession, "mixed")
    whole = F.xxhash64(*[F.col(f"`{c}`") for c in documents.columns])
    placed = _placed(documents, whole, weights, most, seed)
    together = copies_between(F.col("before"), F.col("n"))
    plan = work.stage(placed.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("__key"), F.col("whole").alias("__mark"), together.alias("__copies")), "plan")
    alike = documents.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("__key"), whole.alias("__mark"), F.struct(*documents.columns).alias("__row"))

    def taken(rows: DataFrame, plan: DataFrame) -> DataFrame:
        return rows.groupBy("__key", "__mark").agg(F.first("__row").alias("__row")).join(plan, ["__key", "__mark"])

    kept = taken(alike, plan.where(F.col("__copies").between(1, BLOCK)))
    out = kept.select("__row.*", F.explode(F.array_repeat(F.lit(1), F.col("__copies").cast("int"))).alias("__one")).drop("__one")
    many = plan.where(F.col("__copies") > BLOCK)
    if many.isEmpty():
        return out
    own = alike.join(many.select("__key", "__mark"), ["__key", "__mark"], "left_semi")
    return out.unionByName(spread(taken(own, many), F.col("__copies")).select("__row.*"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix_plan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


_WORDS = r"[^\x20\x09-\x0D]+"
QUERIES = {"op7_mixing": op7_mixing}
ORACLE_SQL = {
    "op7_mixing": f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS k, md5(coalesce(text, '')) AS mark, CAST(coalesce(len(regexp_extract_all(text, '{_WORDS}')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT k, any_value(source) AS source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY k
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
    source_size * 3.0::DOUBLE AS ceiling FROM s
), l AS (
  SELECT a.k, (SELECT sum(source_size) FROM w)::DOUBLE AS everything,
    coalesce(sum(b.ceiling), 0.0)::DOUBLE AS taken, (SELECT sum(weight) FROM w) - coalesce(sum(b.weight), 0.0) AS left_weight,
    any_value(a.ceiling) AS ceiling, any_value(a.weight) AS weight
  FROM w a LEFT JOIN w b ON b.ceiling / b.weight < a.ceiling / a.weight GROUP BY a.k
), t AS (
  SELECT min((everything - taken) / left_weight) FILTER ((everything - taken) / left_weight * weight <= ceiling) AS plain,
    arg_min((everything - taken) / left_weight, ceiling / weight) FILTER ((everything - taken) / left_weight * weight <= ceiling) AS level FROM l
), targets AS (
  SELECT k, source_size, least(ceiling, coalesce(level, 'inf'::DOUBLE) * weight) AS target,
    CASE WHEN source_size > 0 THEN least(ceiling, coalesce(level, 'inf'::DOUBLE) * weight) / source_size ELSE 0.0 END AS rate,
    CAST('0x' || substr(md5('{SEED}:' || k), 1, 8) AS BIGINT)::DOUBLE / 4294967296.0 AS u
  FROM w, t
), r AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY CASE WHEN size > 0 THEN floor(log2(size::DOUBLE) * 8) + 1 ELSE 0 END,
    substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || mark), 1, 2), size, doc_id NULLS FIRST, mark) AS place FROM d
)
SELECT doc_id, size, source_size, target,
  CAST(least(floor(place * rate + u) - floor((place - 1) * rate + u), ceil(rate)) AS BIGINT) * size AS taken
FROM r JOIN targets USING (k)
""",
}
