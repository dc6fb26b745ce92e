import zlib

import numpy as np
import pytest

from photonlake.llm import records

from .helpers import AWKWARD, clashing, documents


def crc32c(data):
    crc = 0xFFFFFFFF
    for b in data:
        crc ^= b
        for _ in range(8):
            crc = crc >> 1 ^ (0x82F63B78 if crc & 1 else 0)
    crc ^= 0xFFFFFFFF
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def test_checksum_of_every_length():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 2**32, 4000, dtype=np.uint32)
    starts, lengths = np.array([0, 5, 300, 600, 1200]), np.array([0, 3, 256, 512, 777])
    for got, s, n in zip(records.masked_crc32c(words, starts, lengths), starts, lengths):
        assert got == crc32c(words[s : s + n].tobytes())


def test_round_trip_against_the_library(spark, tmp_path):
    from tokenizers import Tokenizer

    texts = AWKWARD + [f"Some more text, number {i}. " * (i % 9) for i in range(60)]
    root = f"file://{tmp_path}/r"
    docs = clashing(documents(spark, texts)).repartition(7)
    got = records.token_records(docs, root).orderBy("doc_id").toPandas()
    tok, start = Tokenizer.from_file(records.tokenizer_file()), 0
    for r, t in zip(got.itertuples(), texts, strict=True):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    manifest = spark.read.parquet(f"{root}/manifest").collect()
    f = max(manifest, key=lambda r: r.records)
    backwards = list(range(f.records))[::-1]
    shuffled = list(records.read_shuffled(root, f.file_no, backwards))
    assert [d for d, _ in shuffled] == sorted((d for d, _ in shuffled), reverse=True) and len(shuffled) == f.records
    assert records.token_records(docs.limit(0)).count() == 0


def test_null_ids_repeats_and_damage(spark, tmp_path):
    docs = spark.createDataFrame([(3, "c"), (None, "n"), (3, "c"), (1, None)], "doc_id long, text string")
    got = [tuple(r) for r in records.token_records(docs, f"file://{tmp_path}/r").orderBy("start").collect()]
    assert [r[0] for r in got] == [None, 1, 3, 3] and got[2][2:] == got[3][2:]
    data, _ = records.frames([1], [np.arange(5, dtype=np.uint16)], False)
    bad = bytearray(data)
    bad[30] ^= 1
    import io

    with pytest.raises(ValueError):
        list(records.read_frames(io.BytesIO(bytes(bad))))
    with pytest.raises(ValueError):
        list(records.read_frames(io.BytesIO(data[:-2])))
    wide, _ = records.frames([7, None], [np.array([70000, 2]), np.array([], int)], True)
    (found,) = records.read_frames(io.BytesIO(wide))
    assert [(d, list(x)) for d, x in found] == [(7, [70000, 2]), (None, [])]
