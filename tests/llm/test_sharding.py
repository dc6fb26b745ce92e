import zlib

from photonlake.llm import sharding

from .helpers import AWKWARD, clashing, documents


def brute(rows, slots):
    """Bytes and rows of each shard, and of each slot, counted one row at a time; rows: (virtual_slot, size)."""
    shard_bytes, shard_rows, slot_bytes = [0] * slots.n_shards, [0] * slots.n_shards, [0] * len(slots.shard)
    for slot, size in rows:
        shard_bytes[slots.shard[slot]] += size
        shard_rows[slots.shard[slot]] += 1
        slot_bytes[slot] += size
    return shard_bytes, shard_rows, slot_bytes


def test_places_are_gapless_and_sizes_right(spark):
    texts = AWKWARD + [f"text number {i} " * (i % 17 + 1) for i in range(500)]
    got = sharding.shard_documents(clashing(documents(spark, texts)), n_shards=5).toPandas()
    assert sorted(got.doc_id) == list(range(len(texts)))
    for r in got.itertuples():
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 8, zlib.crc32(data))
    for _, own in got.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    loads = got.groupby("shard")["size"].sum()
    assert loads.max() <= max(got["size"].max(), 1.02 * loads.mean())


def test_rows_of_a_slot_stay_together_and_reruns_agree(spark):
    docs = documents(spark, [f"t{i}" for i in range(300)])
    one, two = (sharding.shard_documents(d, 4).toPandas().sort_values("doc_id").reset_index(drop=True) for d in (docs, docs.repartition(3)))
    assert one.equals(two)
    assert (one.groupby("virtual_slot").shard.nunique() == 1).all()


def test_nulls_repeats_and_empty(spark):
    docs = spark.createDataFrame([(None, "a"), (None, "b"), (1, "c"), (1, "c"), (2, None)], "doc_id long, text string")
    got = sharding.shard_documents(docs, 3).toPandas()
    assert len(got) == 5 and got["size"].sum() == 4 + 5 * 8
    assert sharding.shard_documents(docs.limit(0), 3).count() == 0


def test_map_versions(spark, tmp_path):
    sizes, rows = [(i * 37) % 101 + 1 for i in range(400)], [1] * 400
    one = sharding.first_map(sizes, rows, 6)
    assert max(one.loads()) - min(one.loads()) <= 2
    two = sharding.rebalanced(one, sizes, rows, 7)
    moved = [i for i in range(400) if one.shard[i] != two.shard[i]]
    assert all(two.shard[i] == 6 for i in moved) and len(moved) < 400 / 5
    assert max(two.loads()) <= 1.03 * sum(sizes) / 7
    sharding.save_map(spark, one, str(tmp_path / "m"))
    sharding.save_map(spark, two, str(tmp_path / "m"))
    assert sharding.load_map(spark, str(tmp_path / "m"), 1) == one and sharding.load_map(spark, str(tmp_path / "m"), 2) == two


def test_a_doc_id_of_a_third_of_all_rows(spark, tmp_path):
    """Half of its rows are equal in their texts too; the shards stay near equal, by the map as written and by brute force."""
    rows = [(7 if k % 3 == 0 else k, "same" if k % 2 else f"text {k}") for k in range(6000)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 8, 512, str(tmp_path / "m")).toPandas()
    slots = sharding.load_map(spark, str(tmp_path / "m"), 1)
    shard_bytes, shard_rows, slot_bytes = brute(zip(got.virtual_slot, got["size"]), slots)
    assert len(got) == 6000 and slots.split and tuple(slot_bytes) == slots.bytes
    assert got.groupby("shard")["size"].sum().tolist() == shard_bytes and got.groupby("shard").size().tolist() == shard_rows
    assert max(shard_bytes) <= 1.02 * min(shard_bytes)
    assert got.groupby("virtual_slot").size().max() < 100
    for _, own in got.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))


def test_rebalancing_moves_whole_slots_to_new_shards(spark, tmp_path):
    docs = documents(spark, AWKWARD + [f"text number {i} " * (i % 17 + 1) for i in range(3000)])
    got = sharding.grown(docs, 4, 5, 512, str(tmp_path / "m")).toPandas()
    assert (got.grown_shard[got.moved] == 4).all() and not got.moved.all() and (got.groupby("virtual_slot").grown_shard.nunique() == 1).all()
    second = sharding.load_map(spark, str(tmp_path / "m"), 2)
    shard_bytes, _, _ = brute(zip(got.virtual_slot, got["size"]), second)
    assert got.groupby("grown_shard")["size"].sum().tolist() == shard_bytes == second.loads()
    assert max(shard_bytes) <= 1.05 * sum(shard_bytes) / 5 or max(shard_bytes) <= 80000
    assert sharding.grown(docs.limit(0), 4, 5).count() == 0
