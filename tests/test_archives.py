import gzip
import io
import json
import os
import tarfile
import zipfile

import pytest
from lodestack.operators import transfer
from lodestack.sources import archives
from pyspark.sql import functions as F

YAML = "metadata:\n  name: {}\n  version: {}\n"
ENTRIES = "name string, version string, hash string, content string, manifest string, other int"


def entries(spark, n, parts=3):
    rows = [(f"org/s{i}", f"1.{i}.0", f"h{i}", "text é " * (i % 7) + str(i), YAML.format(f"org/s{i}", f"1.{i}.0"), i) for i in range(n)]
    return spark.createDataFrame(rows, ENTRIES).repartition(parts)


def tar_of(path, members):
    with tarfile.open(path, "w:gz") as tar:
        for name, data in members:
            info = tarfile.TarInfo(name)
            if data is None:
                info.type, info.linkname = tarfile.SYMTYPE, "/etc/passwd"
                tar.addfile(info)
            else:
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))


def skill(name, version, manifest=None, content=b"x"):
    folder = f"skills/{name}@{version}"
    return [(f"{folder}/{f}", d) for f, d in (("SKILL.md", content), ("skill.yaml", (manifest or YAML.format(name, version)).encode())) if d is not None]


def index(*keys):
    return ("index.json", json.dumps([{"name": n, "version": v} for n, v in keys]).encode())


@pytest.mark.parametrize("kind", ["tar.gz", "zip"])
def test_round_trip(spark, tmp_path, kind):
    df, path = entries(spark, 50), f"file://{tmp_path}/a"
    summary = archives.export_archives(df, path, kind).first()
    rows = df.collect()
    assert tuple(summary) == (50, sum(len(r["content"].encode()) + len(r["manifest"].encode()) for r in rows))
    files = os.listdir(tmp_path / "a")
    assert len(files) == 3 and all(f.endswith(kind) for f in files)
    out = transfer.import_path(spark, path, spark.createDataFrame([], "name string, version string"), "v1", "gov").collect()
    assert {(r["name"], r["version"], r["status"], bytes(r["content"]).decode(), bytes(r["manifest"]).decode()) for r in out} == {(r["name"], r["version"], "imported", r["content"], r["manifest"]) for r in rows}
    archives.export_archives(entries(spark, 4, 1), path, kind, overwrite=True)
    assert len(os.listdir(tmp_path / "a")) == 1
    own = tarfile.open if kind == "tar.gz" else zipfile.ZipFile
    assert len((own(next((tmp_path / "a").iterdir())).getnames if kind == "tar.gz" else own(next((tmp_path / "a").iterdir())).namelist)()) == 9


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    bad = entries(spark, 20).withColumn("content", F.when(F.col("other") == 13, F.raise_error(F.lit("lost"))).otherwise(F.col("content")))
    with pytest.raises(Exception, match="lost"):
        archives.export_archives(bad, f"file://{tmp_path}/a")
    assert not (tmp_path / "a").exists() or os.listdir(tmp_path / "a") == []


def test_members(spark, tmp_path):
    tar_of(tmp_path / "a.tgz", [("ok.txt", b"1"), ("/abs", b"2"), ("d/../x", b"3"), ("link", None), ("big", b"z" * 200), ("empty", b"")])
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        for i in range(40):
            z.writestr(f"m{i}", "y" * 100)
    (tmp_path / "c.tar.gz").write_bytes(gzip.compress(b"no tar at all" * 100)[:60])
    (tmp_path / "d.zip").write_bytes(b"PK no zip")
    (tmp_path / "e.txt").write_text("not an archive")
    rows = archives.read_archives(spark, f"file://{tmp_path}", largest=150, split=500).collect()
    got = {(os.path.basename(r["archive"]), r["member"], r["status"], None if r["content"] is None else len(r["content"])) for r in rows}
    assert {x for x in got if x[0] == "a.tgz"} == {("a.tgz", "ok.txt", "ok", 1), ("a.tgz", "/abs", "unsafe", None), ("a.tgz", "d/../x", "unsafe", None), ("a.tgz", "link", "unsafe", None), ("a.tgz", "big", "large", None), ("a.tgz", "empty", "ok", 0)}
    assert {x for x in got if x[0] == "b.zip"} == {("b.zip", f"m{i}", "ok", 100) for i in range(40)} and len(rows) == 48
    assert {x[1:3] for x in got if x[0] in ("c.tar.gz", "d.zip")} == {(None, "corrupt")}
    parts = archives.ArchiveReader({"path": f"file://{tmp_path}/b.zip", "split": 500}).partitions()
    assert len(parts) > 5


def test_import_statuses(spark, tmp_path):
    tar_of(tmp_path / "a.tar.gz", [*skill("o/a", "1.0.0"), *skill("o/b", "1.0.0"), *skill("o/dup", "1.0.0"), *skill("o/nomd", "1.0.0", content=None), *skill("o/bad", "1.0.0", manifest="a: b: c"),
                                   ("skills/o/noyaml@1.0.0/SKILL.md", b"x"), *skill("o/text", "1.0.0", content=b"\xff\xfe"), index(*[(f"o/{n}", "1.0.0") for n in ("a", "b", "dup", "nomd", "bad", "noyaml", "gone", "text")])])
    tar_of(tmp_path / "b.tgz", [*skill("o/dup", "1.0.0"), *skill("o/own", "2.0.0"), index(("o/dup", "1.0.0"), ("o/own", "2.0.0"))])
    tar_of(tmp_path / "c.tgz", [*skill("o/c", "1.0.0"), ("../evil", b"x"), index(("o/c", "1.0.0"))])
    tar_of(tmp_path / "d.tgz", skill("o/d", "1.0.0"))
    tar_of(tmp_path / "e.tgz", [("index.json", b"{no json")])
    (tmp_path / "f.zip").write_bytes(b"broken")
    known = spark.createDataFrame([("o/b", "1.0.0"), ("o/b", "1.0.0")], "name string, version string")
    out = transfer.import_path(spark, f"file://{tmp_path}", known, "v1", "gov").collect()
    assert sorted((os.path.basename(r["archive"]), str(r["name"]), r["status"], str(r["error"])) for r in out) == sorted([
        ("a.tar.gz", "o/a", "imported", "None"), ("a.tar.gz", "o/b", "skipped", "None"), ("a.tar.gz", "o/dup", "imported", "None"), ("a.tar.gz", "o/nomd", "error", "SKILL.md not found in archive"),
        ("a.tar.gz", "o/bad", "error", "E_INVALID_YAML"), ("a.tar.gz", "o/noyaml", "error", "skill.yaml not found in archive"), ("a.tar.gz", "o/gone", "error", "skill.yaml not found in archive"), ("a.tar.gz", "o/text", "imported", "None"),
        ("b.tgz", "o/dup", "skipped", "None"), ("b.tgz", "o/own", "imported", "None"), ("c.tgz", "None", "refused", "E_INVALID_ARCHIVE: unsafe path"), ("d.tgz", "None", "refused", "E_INVALID_ARCHIVE: no index.json"),
        ("e.tgz", "None", "refused", "E_INVALID_ARCHIVE: bad index.json"), ("f.zip", "None", "refused", "E_INVALID_ARCHIVE: corrupt")])


def test_no_archives(spark, tmp_path):
    assert archives.read_archives(spark, f"file://{tmp_path}").count() == 0
    archives.export_archives(entries(spark, 3).limit(0), f"file://{tmp_path}/a")
    assert archives.read_archives(spark, f"file://{tmp_path}/a").count() == 0


def test_exported_parts_are_many_archives(spark, tmp_path):
    import pandas as pd
    from lodestack.plans.stores import archive_round_trip

    parts = pd.DataFrame({"p_partkey": range(80), "p_name": "n", "p_brand": "Brand#1", "p_type": ["ECONOMY", "SMALL"] * 40, "p_size": 1, "p_retailprice": 9.5})
    spark.createDataFrame(parts).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    seen = []
    spark_read = archives.read_archives
    try:
        transfer.read_archives = lambda s, path, **o: seen.append(spark_read(s, path, **o)) or seen[-1]
        assert archive_round_trip(spark, str(tmp_path)).where("status = 'imported'").count() == 80
    finally:
        transfer.read_archives = spark_read
    assert seen[0].rdd.getNumPartitions() >= 8
