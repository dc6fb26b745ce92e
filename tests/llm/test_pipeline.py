import corpus_pipeline
from photonlake.llm import decontamination, jaccard, toxicity

from .helpers import clashing, documents


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_records"]


def test_decisions_take_effect(spark, tmp_path):
    from collections import Counter

    import numpy as np

    rng = np.random.default_rng(3)
    text = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), 6)) for _ in range(n)) + "."
    texts = [text(60) for _ in range(160)]
    toxic = {i for i in range(0, 160, 4)}
    texts = [t + " you utter zounds." if i in toxic else t for i, t in enumerate(texts)]
    item = text(30)
    texts += [texts[1], texts[2] + " tail", item, "x " + item, None, ""]
    docs = clashing(documents(spark, texts, ("a", "b")))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    d, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        d = stage(spark, d, str(tmp_path))
        d.write.parquet(f"{tmp_path}/{k}")
        d = spark.read.parquet(f"{tmp_path}/{k}")
        if name != "token_records":
            assert d.columns == docs.columns
        seen[name] = Counter(r.doc_id for r in d.select("doc_id").collect())
    clean = set(range(160)) - toxic
    assert set(seen["toxicity"]) == clean | set(range(160, 166))
    assert set(seen["near_duplicates"]) == (clean | {162, 163, 164, 165}) - {163} | ({163} if len(item.split()) + 1 < 30 else set())
    assert set(seen["decontamination"]) == clean | {164, 165}
    assert set(seen["mixing"]) <= set(seen["decontamination"]) and seen["token_records"] == seen["mixing"]
    assert Counter(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == seen["mixing"]


def test_empty_and_null_rows(spark):
    docs = documents(spark, ["a b c d e f", "a b c d e f", None])
    nothing = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.clean_documents(docs, nothing).count() == 3
    assert toxicity.clean_documents(docs.limit(0), nothing).count() == 0
    nulls = docs.union(spark.createDataFrame([(None, "q", "en", None, 1), (None, "bench mark", "en", None, 1)], docs.schema))
    assert sorted(str(r.doc_id) for r in jaccard.one_of_each(nulls).collect()) == ["0", "2", "None", "None"]
    bench = spark.createDataFrame([(1, "bench mark")], "item_id long, text string")
    assert sorted(str(r.doc_id) for r in decontamination.clean_documents(nulls, bench).collect()) == ["0", "1", "2", "None"]


def run_on(spark, folder, docs):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "some bench mark")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return corpus_pipeline.run(spark, str(folder)).collect()


def test_empty_tables_run_through(spark, tmp_path):
    assert run_on(spark, tmp_path, documents(spark, ["a"]).limit(0)) == []


def test_null_ids_and_equal_rows_run_through(spark, tmp_path):
    """The result against the texts that the mix took: order, starts and checksums."""
    import zlib

    from tokenizers import Tokenizer

    from photonlake.llm import mixing, records

    docs = documents(spark, [f"text number {k} of these" for k in range(30)] + [None, "", "some bench mark"], ("a", "b", None))
    docs = docs.union(spark.createDataFrame([(None, "without a number", "en", "a", 3), (5, "text number 5 of these", "en", None, 3)], docs.schema))
    got = run_on(spark, tmp_path, docs)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path))
    taken = mixing.mixed(corpus_pipeline.drop_contaminated(spark, kept, str(tmp_path))).collect()
    order = sorted((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in taken)
    tokenizer, start, want = Tokenizer.from_file(records.tokenizer_file()), 0, []
    for there, d, t in order:
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 0]
        want.append((d if there else None, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    assert [tuple(r)[:4] for r in sorted(got, key=lambda r: r.start)] == want and not any("bench" in t for _, _, t in order)
