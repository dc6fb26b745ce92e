import numpy as np
from pyspark.sql import functions as F

from photonlake.llm import jaccard
from photonlake.llm.common import Workspace
from photonlake.llm.components import components

from .helpers import AWKWARD, clashing, documents


def shingle_set(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(texts):
    sets, root = [shingle_set(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        for j in range(i):
            both = len(s & sets[j])
            if both and 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def near_copies(rng, n, length, edits):
    base = [f"w{x}" for x in rng.integers(0, 10**6, length)]
    for _ in range(n):
        own = list(base)
        for k in rng.choice(length, rng.integers(0, edits + 1), replace=False):
            own[k] = f"x{rng.integers(0, 10**9)}"
        yield " ".join(own)


def test_against_brute_force(spark):
    rng = np.random.default_rng(7)
    texts = AWKWARD + ["a b c d", "A B  c\td", "one two three four five six seven eight nine ten", "one two three four five six seven eight nine ten eleven"]
    for length, edits, n in ((6, 1, 8), (12, 1, 12), (25, 2, 25), (60, 4, 60), (200, 12, 80), (900, 40, 15)):
        texts += list(near_copies(rng, n, length, edits))
    common = " ".join(f"c{i}" for i in range(40))
    texts += [f"{common} " + " ".join(f"u{rng.integers(0, 10**9)}" for _ in range(int(rng.integers(0, 30)))) for _ in range(60)]
    docs = clashing(documents(spark, texts)).repartition(5)
    for options in ({}, {"part_rows": 3, "most_full": 0.0}):
        rows = jaccard.near_duplicates(docs, **options).orderBy("doc_id").collect()
        assert [(r.n_shingles, r.component_id) for r in rows] == brute(texts)


def test_nulls_repeats_and_empty(spark):
    docs = spark.createDataFrame([(3, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (2, None), (5, "A b c d e f")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.near_duplicates(docs).collect())
    assert got == [("2", 0, "2"), ("3", 2, "3"), ("3", 2, "3"), ("5", 2, "3"), ("None", 2, "None")]
    assert jaccard.near_duplicates(docs.limit(0)).count() == 0


def test_one_doc_id_of_a_third_of_all_rows(spark):
    """Rows with one doc_id are one document: components by brute force over texts and doc_ids."""
    rng = np.random.default_rng(3)
    texts = [t for _ in range(30) for t in near_copies(rng, 4, 30, 1)]
    ids = [7 if k % 3 == 0 else int(rng.integers(10, 70)) for k in range(len(texts))]
    sets, root = [shingle_set(t) for t in texts], {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        for j in range(i):
            both = len(s & sets[j])
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                a, b = find(ids[i]), find(ids[j])
                root[max(a, b)] = min(a, b)
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(4)
    got = jaccard.near_duplicates(docs).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted((d, len(s), find(d)) for d, s in zip(ids, sets))
    one = jaccard.one_of_each(docs).collect()
    assert sorted(r.doc_id for r in one) == sorted({find(d) for d in ids})
    small = spark.createDataFrame([(2, "a b c d e"), (5, "a b c d e"), (3, "v w x y z"), (5, "v w x y z"), (5, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(small).collect()) == [(2, 1, 2), (3, 1, 2), (5, 0, 5), (5, 1, 2), (5, 1, 2)]


def test_classes_reach_every_size_that_may_link(spark):
    at = [(i << 32) + m for m in (1, 2, 5, 9, 40, 333) for i in range(0, m // 5 + 1)]
    rows = spark.createDataFrame([(x,) for x in at], "at long")
    a, b = rows.select(F.col("at").alias("x"), jaccard.classes_within_reach(F.col("at")).alias("classes")), rows.select(F.col("at").alias("y"), jaccard.size_class(F.col("at").bitwiseAND(0xFFFFFFFF)).alias("class"))
    lost = a.join(b, jaccard.may_link(F.col("x"), F.col("y")) & ~F.array_contains("classes", F.col("class")))
    assert a.join(b, jaccard.may_link(F.col("x"), F.col("y"))).count() > len(at) and lost.count() == 0


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(7, x) for x in range(300, 330)] + [(1, 2), (2, 1), (5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), Workspace(spark, "t")).collect()}
    assert got == {x: 100 for x in range(100, 141)} | {x: 7 for x in [7, *range(300, 330)]} | {1: 1, 2: 1}


def test_boundary_follows_the_cost():
    assert jaccard.choose_boundary({5: 10, 500: 10}, 0.0) < 10
    assert jaccard.choose_boundary({5: 10, 20: 1000, 128: 1}, 50.0) >= 20
