import math
from collections import Counter

from pyspark.sql import functions as F

from photonlake.llm import mixing

from .helpers import AWKWARD, clashing, documents


def water_level(sizes, weights, most=3.0):
    """Shares by weight; what is above a ceiling goes to the others until none is above."""
    out, rest = {}, sum(sizes.values())
    open_ = set(sizes)
    while open_:
        share = {s: rest * weights[s] / sum(weights[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > most * sizes[s]}
        if not full:
            return out | share
        for s in full:
            out[s] = most * sizes[s]
            rest -= out[s]
        open_ -= full
    return out


def test_targets_and_copies(spark):
    texts = AWKWARD + ["w " * (i % 40 + 1) for i in range(900)]
    docs = documents(spark, texts, ("b", "b", "b", "a", "b", "c", "b", "b", "b", None))
    got = mixing.mix_plan(clashing(docs)).toPandas()
    assert len(got) == len(texts)
    sizes = Counter()
    for r in docs.collect():
        sizes[r.source] += len((r.text or "").encode().split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    want = water_level(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)})
    for s, own in got.groupby(got.source.fillna("-")):
        s = None if s == "-" else s
        assert math.isclose(own.target.iloc[0], want[s]) and own.source_size.iloc[0] == sizes[s]
        assert abs(own.taken.sum() - want[s]) <= own["size"].max() + 0.01 * want[s]
    assert (got.taken <= 3 * got["size"]).all() and (got.taken == got.copies * got["size"]).all()


def test_each_boundary_emits_once(spark):
    docs = documents(spark, ["x y z"] * 1000, ("a", "b", "c", "d"))
    got = mixing.mix_plan(docs).toPandas()
    for _, own in got.groupby("source"):
        rate = own.target.iloc[0] / own.source_size.iloc[0]
        assert abs(own.copies.sum() - rate * len(own)) <= 1
        assert set(own.copies) <= {math.floor(rate), math.ceil(rate)}


def test_reruns_nulls_and_empty(spark):
    docs = documents(spark, [None, "", "a b", "a b", "c"] * 40)
    a, b = (mixing.mix_plan(d).toPandas().sort_values("doc_id").reset_index(drop=True) for d in (docs, docs.repartition(5)))
    assert a.equals(b)
    assert mixing.mix_plan(docs.limit(0)).count() == 0
    assert mixing.mix_plan(documents(spark, [None, ""])).toPandas().taken.sum() == 0


def test_mixed_rows_follow_the_plan(spark):
    docs = documents(spark, ["a b c", "d e", "f", None] * 30)
    docs = docs.union(docs.limit(3)).union(spark.createDataFrame([(None, "q r", "en", "a", 3)], docs.schema))
    want = Counter()
    for r in mixing.mix_plan(docs).collect():
        want[r.doc_id] += r.copies
    got = mixing.mixed(docs)
    assert got.columns == docs.columns
    assert Counter(r.doc_id for r in got.collect()) == +want


def test_a_doc_id_of_a_third_of_all_rows(spark):
    """Copies by brute force over each source in its order; half of the hot rows are equal in their texts too."""
    rows = [(7 if k % 3 == 0 else k, "same words here" if k % 2 else "w " * (k % 9), "en", "ab"[k % 2], k % 2) for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    plan = mixing.mix_plan(docs).collect()
    assert len(plan) == 900
    by_source = {}
    for r in plan:
        by_source.setdefault(r.source, []).append(r)
    for own in by_source.values():
        rate = own[0].target / own[0].source_size
        assert abs(sum(r.copies for r in own) - rate * len(own)) <= 1
        assert {r.copies for r in own} <= {math.floor(rate), math.ceil(rate)}
    want = Counter()
    for r in plan:
        want[r.doc_id] += r.copies
    one, two = ([tuple(r) for r in sorted(mixing.mixed(d).collect(), key=str)] for d in (docs, docs.repartition(7)))
    assert one == two and Counter(r[0] for r in one) == +want


def test_very_many_equal_rows_go_to_many_tasks(spark):
    docs = spark.range(1_000_000).selectExpr("7L AS doc_id", "'a b c' AS text", "'en' AS lang", "'s' AS source", "5L AS n_chars").union(documents(spark, ["x y z"] * 30, ("t",)))
    plan = mixing.mix_plan(docs).where("doc_id = 7 AND source = 's'")
    sizes = [r["count"] for r in plan.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 1_000_000 and len(sizes) > 4 and max(sizes) < 400_000
    copies = plan.agg(F.sum("copies")).first()[0]
    mixed = mixing.mixed(docs)
    rows = [r["count"] for r in mixed.where("doc_id = 7 AND source = 's'").groupBy(F.spark_partition_id()).count().collect()]
    assert sum(rows) == copies and max(rows) < 0.5 * copies and mixed.columns == docs.columns
