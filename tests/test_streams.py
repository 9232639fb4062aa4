"""Streams against batches of the same rows."""

import random

import pytest
from pyspark.sql import functions as F

from tests_support import make
from tracequarry.functions.timeparse import SECOND, UNIX_EPOCH
from tracequarry.operators import sessions
from tracequarry.streaming import sessions as streams


@pytest.fixture
def store(spark):
    before = {k: spark.conf.get(k) for k in streams.STORE}
    for k, v in streams.STORE.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def run(df, tmp_path, name):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(200)
    assert q.exception() is None
    return df.sparkSession.table(name)


def test_closed_sessions_equal_the_batch(spark, store, tmp_path):
    rng = random.Random(5)
    rows = sorted(((UNIX_EPOCH + 10**15 + rng.randrange(300) * SECOND, rng.choice([4624, 4624, 4634, 4647, 4672, 1]), rng.choice("ab"), rng.choice(["H1", "h1.dom", "H2"])) for _ in range(400)), key=lambda r: r[0])
    rows = [(t, n, {"SubjectLogonId" if n == 4672 else "TargetLogonId": x, "LogonType": "3"}, c) for t, n, x, c in rows]
    fields = ["TargetLogonId", "SubjectLogonId", "LogonType", "TargetUserName", "TargetDomainName"]
    events = make(spark, rows, fields)
    boots = spark.createDataFrame([("H1", [rows[150][0]])], "host string, boots array<bigint>")
    data = events.df.drop(*[c for c in events.df.columns if c.startswith("_")])
    for k in range(4):  # files in order of time
        data.where(F.col("id").between(100 * k, 100 * k + 99)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(data.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = run(streams.logons(events.with_df(stream), boots), tmp_path, "closed")
    names = ["id", "host", "logon_id", "type", "start_ft", "end_ft", "end_id", "boot"]
    want = sessions.logons(events, boots).where("end_id is not null")
    assert sorted(map(tuple, found.select(*names).collect())) == sorted(map(tuple, want.select(*names).collect())) and want.count() > 50


def test_logons_that_never_end_are_let_go(spark, store, tmp_path):
    day = 86_400 * SECOND
    rows = [(UNIX_EPOCH + 10**15 + k * day, 4624, {"TargetLogonId": "x"}, "H") for k in (0, 40, 80)]
    events = make(spark, rows, ["TargetLogonId"])
    data = events.df
    for k in range(3):
        data.where(F.col("id") == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(data.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = run(streams.logons(events.with_df(stream), spark.createDataFrame([], "host string, boots array<bigint>")), tmp_path, "let_go")
    assert sorted((r["id"], r["end_ft"]) for r in found.collect()) == [(0, None), (1, None)]


def test_a_repeated_record_counts_once(spark, tmp_path):
    t = UNIX_EPOCH + 10**15
    spark.createDataFrame([(1, "H", "Security", t), (1, "H", "Security", t), (2, "H", "Security", t), (1, "K", "Security", t)], "record_id long, computer string, channel string, ts_ft long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("record_id long, computer string, channel string, ts_ft long").parquet(str(tmp_path / "in"))
    assert run(streams.once(stream), tmp_path, "once").count() == 3
