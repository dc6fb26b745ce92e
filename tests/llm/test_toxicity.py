import math
import re
import zlib

import numpy as np

from photonlake.llm import common, toxicity

from .helpers import AWKWARD, clashing, documents


def corpus(n=400):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    texts, toxic = [], []
    for i in range(n):
        sentences = [" ".join(word() for _ in range(8)) for _ in range(rng.integers(1, 12))]
        bad = i % 8 == 0
        if bad:
            k = rng.integers(0, len(sentences))
            sentences[k] += " zox" + word() if i % 16 else " scoundrel"
        texts.append(". ".join(sentences) + ".")
        toxic.append(int(bad))
    return texts, toxic


def test_held_out_accuracy_and_location(spark):
    texts, toxic = corpus()
    docs = clashing(documents(spark, texts + AWKWARD))
    labels = spark.createDataFrame([(i, 1, y) for i, y in enumerate(toxic)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, labels).orderBy("doc_id").collect()
    assert [r.held_out for r in got] == [zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in got]
    held = [(r.predicted, y) for r, y in zip(got, toxic) if r.held_out]
    assert sum(p == y for p, y in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert not any(r.predicted for r in got[len(texts) :])
    model = toxicity.train(docs, labels)
    found = toxicity.offending_sentences(docs, model).collect()
    wrong = [r for r in found if "zox" not in r.sentence and "scoundrel" not in r.sentence]
    assert len(found) > 40 and len(wrong) <= 2
    assert toxicity.Model(model.weights, model.bias, model.leak).score(texts[0]) == got[0].score


def test_held_out_labels_are_not_read(spark):
    texts, toxic = corpus(120)
    docs = documents(spark, texts)
    out = [zlib.crc32(str(i).encode()) % 4 == 2 for i in range(120)]
    one, two = (spark.createDataFrame([(i, 1, 1 - y if flip and h else y) for i, (y, h) in enumerate(zip(toxic, out))], "doc_id long, quality int, toxic int") for flip in (False, True))
    assert toxicity.train(docs, one) == toxicity.train(docs, two)


def test_sample_is_bounded_and_labels_may_lack(spark):
    texts, toxic = corpus(200)
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, 1, y) for i, y in enumerate(toxic)] + [(3, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    work = common.Workspace(spark, "test")
    assert 20 < toxicity.training_rows(docs, labels, work, 50).count() < 80
    assert 10 < toxicity.training_rows(docs, labels, work, 8000, sum(map(len, texts)) // 4).count() < 70
    none = toxicity.toxicity(docs, labels.limit(0)).collect()
    assert {r.predicted for r in none} == {0}
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def noisy_or(text, model):
    """The score of a document word by word: each n-gram of each word of each sentence."""
    clean = 1 - model.leak
    for sentence in re.split("[.!?\n]+", (text or "").lower()):
        total, any_ = 0.0, False
        for word in sorted({w for w in re.findall(r"[^\W\d_]+", sentence)}):
            bounded = f"^{word}$"
            grams = {bounded} | {bounded[i : i + n] for n in (3, 4, 5, 6, 7) for i in range(len(bounded)) if i + n <= len(bounded)}
            for g in grams:
                if g in model.weights:
                    total, any_ = total + model.weights[g], True
        if any_:
            clean *= 1 - 1 / (1 + math.exp(-(model.bias + total)))
    return 1 - clean


def test_scores_by_brute_force(spark):
    texts, toxic = corpus(160)
    texts += [t.upper() for t in texts[:20]] + [t.replace(" ", "\n", 3) for t in texts[:20]]
    docs = documents(spark, texts + AWKWARD)
    labels = spark.createDataFrame([(i, 1, y) for i, y in enumerate(toxic)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    assert model.weights
    for r in toxicity.toxicity(docs, labels).collect():
        assert math.isclose(r.score, noisy_or((texts + AWKWARD)[r.doc_id], model), abs_tol=1e-9)


def test_a_doc_id_of_a_third_of_all_rows_trains_once(spark):
    texts, toxic = corpus(150)
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, f"{texts[0]} {k}") for k in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    own = toxicity.training_rows(docs, labels, common.Workspace(spark, "test")).collect()
    assert len(own) == len({r.doc_id for r in own}) and len(own) == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(150))
    assert toxicity.train(docs, labels) == toxicity.train(docs.repartition(5), labels)
    assert toxicity.toxicity(docs, labels).count() == len(rows)


def test_sentences_by_brute_force(spark):
    texts, toxic = corpus(160)
    texts = [t.replace(". ", "! " if k % 3 else "\n") for k, t in enumerate(texts)] + AWKWARD
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, 1, y) for i, y in enumerate(toxic)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    want = []
    for d, t in enumerate(texts):
        for k, s in enumerate(re.split("[.!?\n]+", t or "")):
            alone = toxicity.Model(model.weights, model.bias, 0.0)
            p = noisy_or(s, alone)
            if p >= toxicity.THRESHOLD:
                want.append((d, k, round(p, 9), s.strip()))
    got = [(r.doc_id, r.number, round(r.probability, 9), r.sentence) for r in toxicity.offending_sentences(docs, model).collect()]
    assert sorted(got) == sorted(want) and len(got) > 15


def test_sentences_of_texts_without_a_known_word_are_not_looked_at(monkeypatch):
    """They are most of all texts; what the others give stays the same."""
    model = toxicity.Model({"^bad$": 3.0}, 0.0, 0.01)
    looked = []
    plain = toxicity.Model.sentence_probability
    monkeypatch.setattr(toxicity.Model, "sentence_probability", lambda self, s: looked.append(s) or plain(self, s))
    assert model.offending("A fine day. And a good one!") == [] and model.offending(None) == [] and not looked
    assert [x[::2] for x in model.offending("Fine. BAD one!\nGood. bad")] == [(1, "BAD one"), (3, "bad")] and len(looked) == 4
    assert len(model.offending("Fine. Good.", 0.0)) == 2


def grams(text):
    """The features of a text, word by word."""
    bounded = {f"^{w}$" for w in re.findall(r"[^\W\d_]+", (text or "").lower())}
    return bounded | {b[i : i + n] for b in bounded for n in (3, 4, 5, 6, 7) for i in range(len(b) - n + 1)}


def plain_model(texts, toxic):
    """Weights by feature, bias and leak of all texts, fitted document by document."""
    own, n1 = [grams(t) for t in texts], sum(toxic)
    n0, kept = len(texts) - n1, []
    for f in sorted(set().union(*own)):
        a, c = (sum(f in x for x, y in zip(own, toxic) if y == k) for k in (1, 0))
        lift = (a + 0.1) / (n1 + 0.2) * (n0 + 0.2) / (c + 0.1)
        if a >= max(3, 0.01 * n1) and lift > 3 and (a / n1 - c / n0) / math.sqrt((a + c + 1) / (n1 + n0) / n1) > 5:
            kept.append(f)
    docs = []
    for t, y in zip(texts, toxic):
        each = [[kept.index(f) for w in set(re.findall(r"[^\W\d_]+", s)) for f in grams(w) if f in kept] for s in re.split("[.!?\n]+", (t or "").lower())]
        docs.append(([x for x in each if x], y))
    bare = [y for x, y in docs if not x]
    leak = min(0.25, (sum(bare) + 0.5) / (len(bare) + 1))
    theta, m, v = (np.append(np.zeros(len(kept)), b) for b in (-3.0, 0.0, 0.0))
    for step in range(1, 151):
        grad = np.append(0.01 * theta[:-1], 0.0)
        for x, y in docs:
            p = [1 / (1 + math.exp(-theta[-1] - sum(theta[i] for i in s))) for s in x]
            clean = (1 - leak) * math.prod(1 - q for q in p)
            for s, q in zip(x, p):
                slope = -clean / (1 - clean) * q if y else q
                np.add.at(grad, [*s, -1], slope)
        grad /= len(docs)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return dict(zip(kept, theta)), theta[-1], leak


def test_the_model_is_that_of_a_plain_fit(spark):
    texts, toxic = corpus(160)
    texts = [t.replace(". ", "! ") + "\nVermin verminous!" * (y and k % 3 > 0) for k, (t, y) in enumerate(zip(texts, toxic))] + AWKWARD
    toxic += [k % 2 for k in range(len(AWKWARD))]
    learned = [k for k in range(len(texts)) if zlib.crc32(str(k).encode()) % 4 != 2]
    weights, bias, leak = plain_model([texts[k] for k in learned], [toxic[k] for k in learned])
    model = toxicity.train(documents(spark, texts), spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int"))
    assert weights.keys() == model.weights.keys() and len(weights) > 20
    assert all(math.isclose(weights[f], w, abs_tol=1e-6) for f, w in model.weights.items())
    assert math.isclose(bias, model.bias, abs_tol=1e-6) and math.isclose(leak, model.leak, abs_tol=1e-12)


def test_all_labelled_documents_train_however_many(spark):
    """It was a sample of about 8,000 of them, or of 128 MiB."""
    n = 16_000
    bad = lambda k: k % 20 == 0
    docs = spark.createDataFrame([(k, f"fine day {k % 7}. {'scoundrel' if bad(k) and k % 400 else 'quiet'} night") for k in range(n)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(bad(k))) for k in range(n)], "doc_id long, toxic int")
    learned = [k for k in range(n) if zlib.crc32(str(k).encode()) % 4 != 2]
    assert toxicity.training_rows(docs, labels, common.Workspace(spark, "test")).count() == len(learned) > 11_000
    model = toxicity.train(docs, labels)
    bare = [bad(k) for k in learned if not bad(k) or k % 400 == 0]
    assert math.isclose(model.leak, (sum(bare) + 0.5) / (len(bare) + 1), rel_tol=1e-12) and "^scoundrel$" in model.weights


def test_the_fit_is_the_same_in_many_tasks(spark, monkeypatch):
    texts, toxic = corpus(200)
    docs, labels = documents(spark, texts), spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    one = toxicity.train(docs, labels)
    tasks = []
    monkeypatch.setattr(toxicity, "ENTRIES", 1)
    plain = toxicity.descend
    monkeypatch.setattr(toxicity, "descend", lambda slopes, *x: tasks.append(1) or plain(slopes, *x))
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(rows, 2)
    try:
        assert toxicity.train(docs.repartition(5), labels) == one and one.weights and tasks
    finally:
        spark.conf.unset(rows)


def test_numbers_of_words_are_those_of_their_features(monkeypatch):
    """Also where one word ends as another begins, features come twice in a word, and words met are forgotten."""
    monkeypatch.setattr(toxicity, "MOST_CACHED", 3)
    number = {f: k for k, f in enumerate(["^an", "nan", "anan", "an$", "^nan$", "ßé$"])}
    own = toxicity.Numbers(number)
    for met in ({"banana", "nan", "anan"}, {"ananan", "x"}, {"nan", "straßé", "anan", "b"}, set(), {"nan", "q", "ananan"}):
        assert sorted(x.tolist() for x in own.of(met)) == sorted(x for w in met if (x := sorted(number[f] for f in toxicity.features(w) if f in number)))
