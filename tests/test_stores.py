import os
import random
import time

import pytest
from lodestack.operators import history, ledger
from lodestack.operators.changelog import ChangeLog
from lodestack.sources.tables import Bucketed
from lodestack.streaming import ledger_append, repository
from pyspark.sql import functions as F

ROW = "k long, a string, b long"


@pytest.mark.parametrize("seed", [1, 2])
def test_change_log_agrees_with_a_dictionary(spark, tmp_path, seed):
    rng, model, past = random.Random(seed), {}, {}
    log = ChangeLog(spark, f"file://{tmp_path}/log", ROW, "k", buckets=3)
    for step in range(7):
        rows = [(rng.randrange(20), rng.choice(["x", "y", None]), rng.randrange(100)) for _ in range(8)]
        df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], ROW + ", at int")
        op = rng.choice(["put", "put", "delete", "update", "compact", "new"])
        if op == "put":
            assert log.put(df, F.col("at")) == len({r[0] for r in rows})
            model |= {r[0]: r for r in rows}
        elif op == "delete":
            assert log.delete(df) == len({r[0] for r in rows} & model.keys())
            model = {k: v for k, v in model.items() if k not in {r[0] for r in rows}}
        elif op == "update":
            last = {r[0]: r for r in rows}
            log.update(spark.createDataFrame(list(last.values()), ROW), ["b"])
            model |= {k: (k, model[k][1], r[2]) for k, r in last.items() if k in model}
        elif op == "new":
            got = log.put_new(df.select("k", "a", "b")).collect()
            new = {}
            for r in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or "", r[2])):
                if r[0] not in model:
                    new.setdefault(r[0], r)
            assert len(got) == len(rows) and sorted(r["k"] for r in got if r["status"] == "added") == sorted(new)
            model |= new
        else:
            assert log.compact() == len(model)
        past[step] = dict(model)
        assert {r["k"]: tuple(r) for r in log.read().collect()} == model, op
    for at, rows in past.items():
        assert {r["k"]: tuple(r) for r in log.read(at).collect()} == rows
    again = ChangeLog(spark, log.path, ROW, "k", buckets=3)
    keys = list(model)[:2] + [999]
    assert {r["k"]: tuple(r) for r in again.among(keys).collect()} == {k: model[k] for k in keys if k in model}


def test_a_change_that_broke_off_is_not_seen(spark, tmp_path, monkeypatch):
    log = ChangeLog(spark, f"file://{tmp_path}/log", ROW, "k", buckets=2)
    df = spark.createDataFrame([(1, "a", 1), (None, "b", 2)], ROW)
    monkeypatch.setattr(ChangeLog, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        log.put(df)
    monkeypatch.undo()
    assert log.read().count() == 0


def test_lookups_read_their_buckets(spark, tmp_path):
    table = Bucketed(spark, f"file://{tmp_path}/t", ROW, "k", 8)
    table.append(spark.range(500).select(F.col("id").alias("k"), F.lit("x").alias("a"), F.col("id").alias("b")))
    table.append(spark.range(500, 600).select(F.col("id").alias("k"), F.lit("y").alias("a"), F.col("id").alias("b")), spread_by="b", spread=3)
    assert sorted(r["k"] for r in table.among([3, 550, 9999]).collect()) == [3, 550]
    assert table.among([3]).select(F.input_file_name().alias("f")).distinct().count() == 1
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    assert "SelectedBucketsCount: 1 out of 8" in table.among([3])._jdf.queryExecution().toString()
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    found = table.lookup(spark.range(590, 700).select(F.col("id").alias("k")))
    assert sorted(r["k"] for r in found.collect()) == list(range(590, 600))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(k") <= 2 and "Bucketed: true" in plan  # only the keys are shuffled


@pytest.mark.parametrize("seed", [3, 4])
def test_as_of_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    times = [f"2024-01-{d:02d} {h:02d}:00:00" for d in (1, 2, 5) for h in (0, 1, 23)] + [None]
    versions = [(rng.choice("ab"), rng.choice(times), rng.randrange(9)) for _ in range(25)] + [(None, times[0], 1)]
    rows = [(i, rng.choice(["a", "b", "c", None]), rng.choice(times)) for i in range(60)]
    cast = F.col("t").cast("timestamp")
    v = spark.createDataFrame(versions, "k string, t string, v long").withColumn("t", cast)
    out = history.as_of(spark.createDataFrame(rows, "i long, k string, t string").withColumn("t", cast), v, "k", "t", ["v"]).collect()
    best = lambda k, t: max(((u, x) for w, u, x in versions if w == k and u is not None and t is not None and u <= t), default=(None, None))[1]
    assert sorted((r["i"], r["v"]) for r in out) == sorted((i, best(k, t) if k else None) for i, k, t in rows)
    ends = history.intervals(v.where("k = 'a' AND t IS NOT NULL"), "k", "t").collect()
    assert sum(r["valid_to"] is None for r in ends) == 1 and all(r["valid_to"] >= r["t"] for r in ends if r["valid_to"])


def test_listed_versions_and_history(spark):
    rows = [("s", 1, {"a": "1", "b": "1"}), ("s", 2, {"a": "1", "b": "2", "c": "1"}), ("s", 3, {"c": "1"}), ("t", 1, {})]
    out = history.listed_versions(spark.createDataFrame(rows, "k string, t long, h map<string,string>"), "k", "t", "h").collect()
    assert sorted(tuple(r) for r in out) == [("s", 1, 1, 2, 2, 0, 0), ("s", 2, 2, 3, 1, 1, 0), ("s", 3, 3, 1, 0, 0, 2), ("t", 1, 1, 0, 0, 0, 0)]
    texts = spark.createDataFrame([('[{"score": 3}, {"score": 4, "x": 1}]',), ("{bad",), ("[1",), (None,), ("{}",)], "text string")
    assert [[e["score"] for e in r["entries"]] for r in history.load_history(texts, "score: long").collect()] == [[3, 4], [], [], [], []]


def test_cycles_are_replaced_alone(spark, tmp_path):
    path = f"file://{tmp_path}/runs"
    history.write_cycles(spark.createDataFrame([("r1", 0, 0.5), ("r1", 1, 0.7), ("r2", 0, 0.1)], "run_id string, cycle int, score double"), path)
    kept = {f: os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(tmp_path) for f in fs if f.endswith(".parquet") and "cycle=1" not in d}
    history.write_cycles(spark.createDataFrame([("r1", 1, 0.9)], "run_id string, cycle int, score double"), path)
    after = {f: os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(tmp_path) for f in fs if f.endswith(".parquet") and "cycle=1" not in d}
    assert kept == after and len(kept) == 2
    one = history.read_cycles(spark, path, (F.col("run_id") == "r1") & (F.col("cycle") == 1))
    assert [r["score"] for r in one.collect()] == [0.9] and len(one.inputFiles()) >= 1 and "PartitionFilters: [isnotnull(run_id" in one._jdf.queryExecution().toString()
    assert {tuple(r) for r in history.runs(history.read_cycles(spark, path), "score").collect()} == {("r1", 2, 0.5, 0.9, 0.9, 1), ("r2", 1, 0.1, 0.1, 0.1, 0)}


def test_signed_stream_goes_on_after_a_restart(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    key, source, path = b"k" * 10, f"file://{tmp_path}/events", f"file://{tmp_path}/log"
    old = ledger_append.sign
    schema = "chain string, at long, payload string"
    first = spark.createDataFrame([("a", 0, "a0"), ("b", 0, "b0")], schema)
    seed = spark.createDataFrame([("a", 4, "sig-a"), ("a", 3, "older")], "chain string, seq long, signature string")
    for batch in range(2):
        events = first if batch == 0 else spark.createDataFrame([("a", 9 - i, f"a{9 - i}") for i in range(5)] + [("c", 1, "c1")], schema)
        events.write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        ledger_append.append(old(stream, key, ["at"], seed), path, f"file://{tmp_path}/checkpoint").awaitTermination()
    log = spark.read.parquet(path)
    rows = sorted((r["chain"], r["seq"], r["payload"]) for r in log.collect())
    assert rows == [("a", 5, "a0")] + [("a", 6 + i, f"a{5 + i}") for i in range(5)] + [("b", 0, "b0"), ("c", 0, "c1")]
    known = spark.createDataFrame([("a", 4, None, None, "sig-a")], ledger_append.ENTRY)
    checked = ledger.integrity(log.where("chain <> 'a'"), "chain", "seq", ledger_append.signed(), key)
    assert {tuple(r) for r in checked.collect()} == {("b", 1, 0, 0), ("c", 1, 0, 0)}
    linked = ledger.verify(log.unionByName(known), "chain", "seq", ledger_append.signed(), key).where("chain = 'a' AND seq > 4")
    assert all(r["good_signature"] and r["good_link"] for r in linked.collect()) and linked.count() == 6
    page = ledger_append.review(log.where("chain = 'b'"), checked)
    assert [r["intact"] for r in page.collect()] == [True]


def test_only_new_and_changed_files_are_read(spark, tmp_path):
    root = tmp_path / "tree"
    for n in ("a", "b"):
        (root / "skills/ns" / n / "1.0.0").mkdir(parents=True)
        (root / "skills/ns" / n / "1.0.0" / "SKILL.md").write_text(n)
    index = repository.file_index(spark, f"file://{tmp_path}/index", buckets=2)
    run = lambda: repository.follow(spark, f"file://{root}", index, f"file://{tmp_path}/check").awaitTermination()
    run()
    assert index.read().count() == 2 and index.commits.read().count() == 1
    run()
    assert index.commits.read().count() == 1
    (root / "skills/ns/c/2.0.0").mkdir(parents=True)
    (root / "skills/ns/c/2.0.0/SKILL.md").write_text("c")
    run()
    assert [r["n"] for r in index.commits.read().orderBy("seq").collect()] == [2, 1]
    assert {tuple(r)[:3] for r in repository.skills(index, f"file://{root}").collect()} == {("ns", "a", "1.0.0"), ("ns", "b", "1.0.0"), ("ns", "c", "2.0.0")}
    assert repository.rescan(spark, f"file://{root}", index) == {"read": 0, "removed": 0}
    (root / "skills/ns/a/1.0.0/SKILL.md").write_text("changed")
    os.utime(root / "skills/ns/a/1.0.0/SKILL.md", (time.time() + 5, time.time() + 5))
    (root / "skills/ns/b/1.0.0/SKILL.md").unlink()
    assert repository.rescan(spark, f"file://{root}", index) == {"read": 1, "removed": 1}
    assert index.read().count() == 2
