from photonlake.operators.edit import write_images


def test_equal_names_in_two_folders(spark, tmp_path):
    rows = [("file:/a/IMG_0001.jpg", b"one"), ("file:/b/IMG_0001.jpg", b"two"), ("file:/b/none", b"three"), ("file:/b/null.jpg", None)]
    got = write_images(spark.createDataFrame(rows, "path string, content binary"), f"file://{tmp_path}/out").collect()
    assert {r.path: (open(r.target.removeprefix("file://"), "rb").read(), r.bytes) for r in got} == {p: (c, len(c)) for p, c in rows if c}
    assert all(r.target.rpartition("/")[2].startswith("IMG_0001-") and r.target.endswith(".jpg") for r in got if "IMG" in r.path)
    assert len(list((tmp_path / "out").iterdir())) == 3
