import gzip
import hashlib
import random
import uuid

import pytest

from lodestack.llm import warc
from lodestack.llm.workspace import shared_dir

SCHEMA = "page_id long, url string, html string, payload string"


def rows():
    rng = random.Random(1)
    out = [(i, f"http://h/{i} x", "".join(rng.choices("abc<é日", k=rng.choice([0, 5, 400, 1200, 5000]))), "z") for i in range(150)]
    for i in range(150, 220):
        out.append((i, None, out[rng.randrange(20)][2], None))
    out += [(300, "u", None, None), (301, "a\r\nb", "", None), (302, "x", "q" * 999, None), (303, "x", "q" * 999, None), (304, "x", "q" * 1000, None), (305, "x", "q" * 1000, None)]
    out += [(400, "w", "<p>\r\n\r\nWARC/1.0 \x1f�" * 40_000, None)]
    return out


def expected(source):
    data = {i: (h or "").encode() for i, _, h, _ in source}
    out = {}
    for i, p in data.items():
        last = max(j for j, q in data.items() if q == p) if len(p) >= 1000 else i
        out[i] = (len(p), hashlib.sha1(p).hexdigest(), "response" if last == i else "revisit", None if last == i else last, True)
    return out


def folder(spark):
    return f"{shared_dir(spark)}/warc-test-{uuid.uuid4().hex}"


@pytest.mark.parametrize("size", ["64m", "3000"])
def test_round_trip(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        source = rows()
        out = warc.round_trip(spark.createDataFrame(source, SCHEMA), folder(spark)).collect()
        assert len(out) == len(source)
        assert {r["page_id"]: tuple(r[1:]) for r in out} == expected(source)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("size", ["100m", "300", "1500"])
def test_magics_inside_members_are_no_members(spark, tmp_path, size):
    """Stored members hold magics and whole gzip members of other kinds."""
    rng = random.Random(2)
    noise = [b"".join(rng.choice([warc.MAGIC, bytes([rng.randrange(256)]) * 7, gzip.compress(b"not a record")]) for _ in range(rng.randrange(60))) for _ in range(12)]
    data = b"".join(warc.member(i, "u", p, hashlib.sha1(p).hexdigest(), None, level=0) for i, p in enumerate(noise))
    (tmp_path / "a.warc").write_bytes(data)
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        out = {r["record_id"]: bytes(r["payload"]) for r in warc.read_warc(spark, f"file://{tmp_path}/a.warc").collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert out == {f"urn:page:{i}": p for i, p in enumerate(noise)}


def test_files_are_plain_gzip(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.write_warc(spark.createDataFrame([(1, "u", "hello", None), (2, None, None, None)], SCHEMA).coalesce(1), path)
    (part,) = (tmp_path / "w").glob("part-*")
    text = gzip.decompress(part.read_bytes())
    assert text.count(b"WARC/1.0\r\n") == 2 and b"hello" in text


def test_empty_table_and_null_ids(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA), folder(spark)).count() == 0
    twice = [(None, "u", "x" * 2000, None), (7, "u", "x" * 2000, None), (7, "u", "x" * 2000, None), (None, "u", "y" * 2000, None), (None, "u", "y" * 2000, None)]
    out = warc.round_trip(spark.createDataFrame(twice, SCHEMA), folder(spark)).collect()
    assert sorted((str(r["page_id"]), r["record_type"], str(r["refers_to"])) for r in out) == [
        ("7", "response", "None"), ("7", "response", "None"), ("None", "response", "None"), ("None", "response", "None"), ("None", "revisit", "7")
    ]
