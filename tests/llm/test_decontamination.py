import hashlib
import re

import pytest

from photonlake.llm import decontamination

from .helpers import AWKWARD, clashing, documents


def words(t):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def brute(text, items):
    w, hit, ids = words(text), set(), set()
    for item, t in items:
        b = words(t)
        n = min(10, len(b))
        grams = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if b else set()
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in grams:
                hit.update(range(i, i + n))
                ids.add(str(item))
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("most_in_plan", [50_000, 0])
def test_against_brute_force(spark, most_in_plan):
    long = " ".join(f"w{i * 7 % 101}" for i in range(60))
    items = [(1, long), (2, "Only four Words here"), (10, "É a b c d e f g h i j k"), (3, None), (4, "..."), (5, " ".join(f"w{i * 7 % 101}" for i in range(15)))]
    pieces = long.split()
    texts = AWKWARD + [
        long, long.upper(), "x " + " ".join(pieces[3:13]) + " y", "x " + " ".join(pieces[3:12]) + " y", "Well, only four-words HERE: only four words here",
        "é a b c d e f g h i j k", "É a b c d e f g h i", " ".join(pieces[:10] + ["gap"] + pieces[5:25]), "word " * 30 + " ".join(pieces[20:45]) + " word" * 3000,
    ]
    bench = spark.createDataFrame([(i, t, "x") for i, t in [*items, (1, long)]], "item_id long, text string, n string")
    got = decontamination.contamination(clashing(documents(spark, texts)), bench, most_in_plan=most_in_plan).orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        assert tuple(r)[1:] == brute(t, items), t


def test_empty_tables(spark):
    docs = documents(spark, ["a b c", None])
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontamination.contamination(docs, none).collect()
    assert [r.contaminated for r in got] == [False, False] and {r.items_sha256 for r in got} == {hashlib.sha256(b"").hexdigest()}
    assert decontamination.contamination(docs.limit(0), none).count() == 0


def test_a_window_of_very_many_items(spark):
    shared = " ".join(f"s{k}" for k in range(12))
    items = [(k, f"{shared} own{k}") for k in range(10_000)]
    texts = [f"before {shared} after"] * 50 + [f"{shared} own{k}" for k in range(20)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contamination(documents(spark, texts), bench).collect()
    every = hashlib.sha256(",".join(sorted(str(k) for k, _ in items)).encode()).hexdigest()
    assert all((r.n_items, r.items_sha256) == (10_000, every) for r in got)
    assert {r.n_hit for r in got if r.doc_id < 50} == {12} and {r.n_hit for r in got if r.doc_id >= 50} == {13}
