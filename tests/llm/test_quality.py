import re
from collections import Counter

from photonlake.llm import quality

from .helpers import AWKWARD, clashing, documents


def brute(t):
    t = t or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(grams)
    covered = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_measurements_against_brute_force(spark):
    texts = AWKWARD + ["a b c d e f a b c d e g", "x x x x x x", "x x x x x", "p q r s t " * 2 + "u " * 9, "#$% a|b\n\na|b\n a|b\na|b", "é ü ö x", "l\r\nl\r\nl", " ".join(map(str, range(300))) + " 7 8 9 10 11 12"]
    got = quality.apply_policy(quality.ledger(clashing(documents(spark, texts))), quality.POLICIES["v1"]).orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        want = brute(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept)
    assert quality.ledger(documents(spark, texts).limit(0)).count() == 0


def test_policies_read_the_ledger_alone(spark):
    entries = spark.createDataFrame([(1, 0), (2, 1), (3, 4), (4, 5), (5, 8), (6, 4)], "doc_id long, failures long")
    kept = {r.doc_id for r in quality.apply_policy(entries, quality.POLICIES["v1"]).collect() if r.kept}
    assert kept == {1, 5}
    got = {r.rule: (r.rejected, r.alone) for r in quality.ablation(entries, quality.POLICIES["v2"]).collect()}
    assert got["few_words"] == (2, 1) and got["symbols"] == (3, 2) and got["duplicate_lines"] == (1, 1) and got["many_words"] == (0, 0)
    r = quality.common_failures(entries.where("doc_id IN (3, 4, 6)").selectExpr("*", "'s' AS source"), "source").first()
    assert (r.all_fail, r.any_fail, r.n) == (4, 5, 3)
