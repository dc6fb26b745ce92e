import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from photonlake.llm import imatch

from .helpers import AWKWARD, clashing, documents


def edited(texts, k):
    t, nxt = texts[k] or "", texts[(k + 1) % len(texts)] or ""
    q = len(t) // 4
    return t[: len(t) - q] + nxt[:q]


def terms(t):
    return {w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower()) if w}


def corpus(n, seed=0):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    return [" ".join(r.choice(words) for _ in range(r.choice((40, 120, 400)))) for _ in range(n)]


@pytest.mark.parametrize("piece_bytes", [50, 1 << 20])
def test_next_and_edited_texts_against_a_loop(spark, piece_bytes):
    texts = AWKWARD + corpus(60) + ["the same"] * 5 + ["x" * 300_000, "ende é"]
    got = imatch.fingerprints(clashing(documents(spark, texts)).repartition(6), piece_bytes).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(texts)))
    by = {r.doc_id: r for r in got}
    for k, t in enumerate(texts):
        assert by[k].n_chars == len(t or "")
        assert by[k].edited_sha256 == hashlib.sha256(edited(texts, k).encode()).hexdigest()
        assert 0 <= by[k].near_edited <= 1 and 0 <= by[k].near_next <= 1
        if (texts[(k + 1) % len(texts)] or "") == (t or ""):
            assert by[k].near_next == 1 and by[k].fingerprint == by[(k + 1) % len(texts)].fingerprint
        if edited(texts, k) == (t or ""):
            assert by[k].near_edited == 1 and by[k].fingerprint == by[k].edited_fingerprint


def test_likeness_follows_the_terms_in_common(spark):
    texts = corpus(400)
    got = {r.doc_id: r for r in imatch.fingerprints(documents(spark, texts)).collect()}
    told, true = [], []
    for k, t in enumerate(texts):
        a, b = terms(t), terms(edited(texts, k))
        told.append(got[k].near_edited)
        true.append(2 * len(a & b) / (len(a) + len(b)))
    assert abs(np.mean(told) - np.mean(true)) < 0.05 and np.mean(np.abs(np.array(told) - true)) < 0.12
    assert np.mean([r.near_next for r in got.values()]) < 0.12
    assert np.mean([r.near_edited > r.near_next for r in got.values()]) > 0.98


def test_repeated_words_and_short_texts_are_like_their_edits(spark):
    """Texts of few distinct words: likeness follows the numbered words in common, though few distinct ones are."""
    r = random.Random(5)
    plain = corpus(60, 2)
    again = ["".join(r.choice("klmnop") for _ in range(5)) for _ in range(60)]
    texts = [t for k, p in enumerate(plain) for t in (f"{again[k]} " * r.choice((60, 150)) + p[:30], p)] + ["spam", "eggs ham", "one two six", "bread and butter"]
    got = {r.doc_id: r for r in imatch.fingerprints(documents(spark, texts)).collect()}
    told, true = [], []
    for k in range(0, 120, 2):
        a, b = (Counter(re.findall(r"[a-z]+", x)) for x in (texts[k], edited(texts, k)))
        told.append(got[k].near_edited)
        true.append(2 * sum((a & b).values()) / (sum(a.values()) + sum(b.values())))
    assert abs(np.mean(told) - np.mean(true)) < 0.06 and np.mean(np.abs(np.array(told) - true)) < 0.12
    assert min(told) > 0.3 and np.mean([got[k].near_next for k in range(0, 120, 2)]) < 0.2
    assert all(got[k].near_edited > got[k].near_next for k in [*range(0, 120, 2), *range(120, 124)])


def test_repeats_are_numbered_within_their_text():
    column = pa.array([[3, 3, 3, 9], [3, 9, 9], [], [3, 3, 3, 9]], pa.list_(pa.int64()))
    got = imatch.Pairs.of(column, np.array([3, 9]))
    assert got.known.sizes.tolist() == [2, 2, 0, 2] and got.whole.sizes.tolist() == [4, 3, 0, 4]
    assert got.known.texts()[0] == got.known.texts()[1] and got.whole.texts()[0] != got.whole.texts()[1]
    assert got.texts()[0] == got.texts()[3]
    assert imatch.Pairs.of(column, np.array([], np.int64)).known.sizes.tolist() == [0, 0, 0, 0]


def test_lexicon_is_the_band(spark):
    texts = corpus(200) + ["common words here"] * 60
    got = set(imatch.lexicon(documents(spark, texts)).tolist())
    words = sorted(set().union(*map(terms, texts)))
    hashes = {r.w: r.h for r in spark.createDataFrame([(w,) for w in words], "w string").selectExpr("w", "xxhash64(w) AS h").collect()}
    n = {w: 0 for w in words}
    for t in texts:
        for w in terms(t):
            n[w] += 1
    assert got == {hashes[w] for w in words if 2 <= n[w] <= imatch.MOST_SHARE * len(texts)}
    few = imatch.lexicon(documents(spark, texts), most=1000)
    least = sum(n.values()) / 1000
    assert set(few.tolist()) == {hashes[w] for w in words if max(2, least) <= n[w] <= imatch.MOST_SHARE * len(texts)}


def test_ties_null_ids_and_empty_tables(spark):
    rows = [(None, "b first", "en", None, 7), (1, "one text of it", "en", None, 3), (1, "one text of it", "en", None, 3), (1, "another text", "en", None, 3), (2, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = imatch.fingerprints(df, 1).collect()
    assert len(got) == 5 and sorted(str(r.doc_id) for r in got) == ["1", "1", "1", "2", "None"]
    lasts = [r for r in got if r.doc_id == 2]
    assert lasts[0].n_chars == 0 and lasts[0].edited_sha256 == hashlib.sha256(b"").hexdigest()
    own = [r for r in got if r.n_chars == len("one text of it")]
    assert own[0].fingerprint == own[1].fingerprint and max(r.near_next for r in own) == 1
    assert imatch.fingerprints(df.limit(0)).count() == 0
    lone = imatch.fingerprints(df.where("doc_id = 1 AND text LIKE 'another%'")).first()
    assert lone.edited_sha256 == hashlib.sha256(edited(["another text"], 0).encode()).hexdigest()


def test_many_equal_rows_go_to_many_pieces(spark):
    df = spark.range(20_000).selectExpr("7L AS doc_id", "'a text that is there again' AS text")
    sizes = [r["count"] for r in imatch.with_next(df, 1 << 14).where("NOT last").groupBy("piece").count().collect()]
    assert sum(sizes) == 20_000 and len(sizes) > 16 and max(sizes) < 4_000
