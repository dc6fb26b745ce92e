import gzip
import re

import pytest
from pyspark.errors import PySparkException

from photonlake.llm import warc

from .helpers import clashing


def test_round_trip(spark, tmp_path):
    rows = [(1, "http://a/1", "same"), (7, "http://a/7", "same"), (5, None, "same"), (2, "u\r\nv", None), (3, "http://b", ""), (4, "x", "é" * 40000), (6, "y", "other\r\n\r\nbody"), (None, "n", "same"), (6, "y", "other\r\n\r\nbody")]
    pages = clashing(spark.createDataFrame(rows, "page_id long, url string, html string")).repartition(5)
    root = f"file://{tmp_path}/w"
    got = warc.archive_pages(pages, root).toPandas()
    assert len(got) == len(rows)
    want = {1: ("revisit", 7), 5: ("revisit", 7), 7: ("response", None), 2: ("revisit", 3), 3: ("response", None), 4: ("response", None), 6: ("response", None), None: ("response", None)}
    text = {k: (t or "").encode() for k, _, t in rows}
    for r in got.itertuples():
        key = None if r.page_id != r.page_id else int(r.page_id)
        refers = None if r.refers_to != r.refers_to else int(r.refers_to)
        assert (r.record_type, refers) == want[key]
        assert (r.payload_bytes, r.payload_digest) == (len(text[key]), warc.sha1_base32(text[key]))
    data = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "w").glob("*.warc.gz")))
    assert data.count(b"WARC/1.1\r\n") == len(rows) and data.count(b"same") == 2
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_repeated_page_ids(spark):
    """Rows of one page_id with equal and different html against brute force; a third of all rows has one page_id."""
    rows = [(7, "u", "A"), (7, "u", "B"), (9, "v", "A"), (12, "w", "B"), (7, "u", "A"), (12, "w", "C"), (3, None, None), (4, None, "")]
    rows += [(k if k % 3 else 5, f"h{k}", f"text {k % 17}") for k in range(20, 320)]
    got = warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)).collect()
    top = {}
    for p, _, t in rows:
        top[t or ""] = max(p, top.get(t or "", p))
    want = sorted((p, len(t or ""), warc.sha1_base32((t or "").encode()), "response" if top[t or ""] == p else "revisit", None if top[t or ""] == p else top[t or ""]) for p, _, t in rows)
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want


def test_headers_are_shuffled_without_payloads(spark):
    pages = spark.createDataFrame([(1, "u", "x" * 1000), (2, "u", "x" * 1000)], "page_id long, url string, html string")
    assert "html" not in warc.SPOOLED and "payload" not in warc.SPOOLED
    assert {r.record_type for r in warc.archive_pages(pages).collect()} == {"response", "revisit"}


def test_ids_are_unique_and_a_wrong_one_is_found(spark, tmp_path):
    rows = [(7, "u", "same"), (7, "v", "same"), (9, "w", "same"), (9, "w", "same"), (3, "x", "other"), (2, "y", "other"), (None, "z", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    root = f"file://{tmp_path}/w"
    assert {(r.page_id, r.refers_to) for r in warc.archive_pages(pages, root).collect()} == {(7, 9), (9, None), (3, None), (2, 3), (None, None)}
    headers = warc.read_archives(spark, root)
    ids = [r.record_id for r in headers.collect()]
    assert len(set(ids)) == len(ids) == 7
    for path in (tmp_path / "w").glob("*.warc.gz"):
        data = gzip.decompress(path.read_bytes())
        if b"WARC-Page-ID: 2\r\n" in data:
            records = [x for x in re.split(rb"(?=WARC/1\.1\r\n)", data) if x]
            wrong = next(x for x in ids if x != re.search(rb"WARC-Refers-To: (\S+)", next(r for r in records if b"WARC-Page-ID: 2\r\n" in r))[1].decode())
            records = [re.sub(rb"WARC-Refers-To: \S+", b"WARC-Refers-To: " + wrong.encode(), r) if b"WARC-Page-ID: 2\r\n" in r else r for r in records]
            path.write_bytes(b"".join(map(gzip.compress, records)))
    with pytest.raises(PySparkException, match="refers to no response"):
        warc.resolved(warc.read_archives(spark, root)).collect()
