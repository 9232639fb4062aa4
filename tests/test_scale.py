"""Deep process trees and running values of hot keys, against plain loops and plain windows."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tests_support import make
from tracequarry.functions.timeparse import SECOND
from tracequarry.operators import explore, proctree, sessions
from tracequarry.operators import running as R
from tracequarry.stages import stored as _stored

NODE = "key string, parent string, image string, command_line string, start_ft long, id long"


def chain(spark, n, name="x"):
    """A chain of n nodes in mixed order, and a bush beside it."""
    i = F.col("id")
    return spark.range(n).repartition(4, F.hash("id")).select(F.concat(F.lit("k"), i).alias("key"), F.when(i > 0, F.concat(F.lit("k"), i - 1)).alias("parent"), F.concat(F.lit(f"c:\\{name}"), i % 10).alias("image"), F.concat(F.lit("run "), i).alias("command_line"), (i + 1).alias("start_ft"), "id")


def test_chain_of_5000_has_all_its_paths(spark):
    n = 5000
    settings = lambda: [spark.conf.get(f"spark.sql.{k}") for k in ("cteRecursionLevelLimit", "cteRecursionRowLimit", "shuffle.partitions", "adaptive.enabled")]
    before = settings()
    got = proctree.trees(chain(spark, n)).select("key", "depth", "root", F.length("path").alias("p"), F.length("order").alias("o"), F.right("path", F.lit(12)).alias("tail")).collect()
    assert {r["key"]: (r["depth"], r["root"]) for r in got} == {f"k{i}": (i, "k0") for i in range(n)}
    assert all(r["p"] == 2 + 5 * r["depth"] and r["o"] == 33 + 34 * r["depth"] for r in got)
    assert next(r["tail"] for r in got if r["depth"] == 4999) == "x7 › x8 › x9"
    assert settings() == before


def test_chain_of_100000(spark):
    n = 100_000
    rows = chain(spark, n)
    got = proctree.totals(proctree.depths(rows)).first()
    assert (got["nodes"], got["roots"], got["depth"]) == (n, 1, n - 1)
    found = proctree.search_paths(rows, "run 9999", None).where("command_line in ('run 9999', 'run 99990')").collect()
    for r in found:
        names = r["path"].split(proctree.PATH)
        assert len(names) == r["depth"] + 1 == int(r["key"][1:]) + 1 and names == [f"x{i % 10}" for i in range(len(names))] and r["root"] == "k0"
    assert len(found) == 2


def plain_tree(rows):
    nodes = {r[0]: r for r in rows}
    out = {}
    for key, parent, image, _, start, id in rows:
        line, at = [key], parent
        while at is not None and at in nodes and at not in line:
            line.append(at)
            at = nodes[at][1]
        line = [key] if at is not None else line[::-1]
        out[key] = (len(line) - 1, line[0], proctree.PATH.join(nodes[k][2] for k in line))
    return out


def test_forests_with_cycles_and_lost_parents(spark):
    rng = random.Random(4)
    rows = [(f"n{i}", f"n{rng.randrange(max(1, i))}" if i and rng.random() < 0.9 else None, f"p{i % 7}", "", i, i) for i in range(400)]
    rows += [(f"c{i}", f"c{(i + 1) % 7}", "cyc", "", 1, 1000 + i) for i in range(7)] + [(f"d{i}", f"d{i - 1}" if i else "c3", "below", "", 1, 1100 + i) for i in range(20)]
    rows += [("lost", "gone", "z", "", 3, 2000), ("under", "lost", "z", "", 3, 2001), ("self", "self", "z", "", 3, 2002)]
    nodes = spark.createDataFrame(rows, NODE).repartition(5)
    want = plain_tree(rows)
    assert {r["key"]: (r["depth"], r["root"], r["path"]) for r in proctree.trees(nodes).collect()} == want
    assert {r["key"]: (r["depth"], r["root"]) for r in proctree.depths(nodes).collect()} == {k: v[:2] for k, v in want.items()}
    found = {r["key"]: (r["depth"], r["root"], r["path"]) for r in proctree.search_paths(nodes, "P", None).collect()}
    assert found == {k: v for k, v in want.items() if k.startswith("n")}
    assert {r["key"] for r in proctree.search_paths(nodes, "z", None).collect()} == {"lost", "under", "self"}
    assert proctree.trees(nodes.limit(0)).count() == 0 == proctree.depths(nodes.limit(0)).count()


def test_few_rows_move_however_deep_the_chain(spark, monkeypatch):
    """All levels of contraction together move a few times the nodes; doubling moves them all in each of 11 rounds."""
    n, rows = 2000, []
    monkeypatch.setattr(proctree, "FEW", 400)
    real = proctree.stored

    def counting(df, label):
        out = real(df, label)
        rows.append(out.count())
        return out

    monkeypatch.setattr(proctree, "stored", counting)
    got = proctree.depths(chain(spark, n)).collect()
    assert {r["key"]: (r["depth"], r["root"]) for r in got} == {f"k{i}": (i, "k0") for i in range(n)}
    assert sum(rows) < 7 * n


def test_contracted_forests_equal_plain_ones(spark, monkeypatch):
    monkeypatch.setattr(proctree, "FEW", 200)
    test_forests_with_cycles_and_lost_parents(spark)


def test_siblings_in_order_of_time(spark):
    """A node without a start takes its earliest child's; children without one do not count."""
    rows = [("a", None, "a", "", None, 1), ("a1", "a", "a1", "", None, 2), ("a2", "a", "a2", "", 50, 3), ("b", None, "b", "", 10, 4), ("c", None, "c", "", 90, 5), ("z", None, "z", "", 0, 6)]
    got = [r["key"] for r in proctree.trees(spark.createDataFrame(rows, NODE)).orderBy("order").collect()]
    assert got == ["z", "b", "a", "a1", "a2", "c"]


def values():
    v = F.col("v")
    return [R.Running("s", "sum", v, before=True), R.Running("t2", "sum", v), R.Running("m", "max", v), R.Running("l", "last", F.when(v % 5 == 0, v), before=True), R.lag("g", v)]


@pytest.mark.parametrize(("keys", "least"), [(["k"], 100), (["k", "j"], 100), ([], 100), (["k"], 10_000), (["k"], 0)])
def test_running_equals_the_window(spark, keys, least):
    """A third of the rows in one key, another third in the null key, ties in time, null values."""
    rows = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, (F.col("id") % 50).cast("string")).alias("k"), (F.col("id") % 2).alias("j"), ((F.col("id") * 7919) % 60).alias("t"), F.when(F.col("id") % 4 > 0, F.hash("id") % 1000).alias("v"))
    order = [F.desc("t"), "id"]
    got = R.running(rows, keys, order, values(), least_hot=least)
    own = Window.partitionBy(*keys).orderBy(*order)
    so_far, ahead = own.rowsBetween(Window.unboundedPreceding, 0), own.rowsBetween(Window.unboundedPreceding, -1)
    v = F.col("v")
    want = rows.withColumns({"s": F.sum(v).over(ahead), "t2": F.sum(v).over(so_far), "m": F.max(v).over(so_far), "l": F.last(F.when(v % 5 == 0, v), True).over(ahead), "g": F.when(F.lag("id").over(own).isNotNull(), F.struct(F.lag(v).over(own).alias("v")))})
    names = ["id", "s", "t2", "m", "l"]
    assert Counter(map(tuple, got.select(*names).collect())) == Counter(map(tuple, want.select(*names).collect()))
    assert {r["id"]: r["g"] for r in got.collect()} == {r["id"]: r["g"] for r in want.collect()}


def test_no_task_holds_a_hot_key(spark, monkeypatch):
    """One key of 200,000 rows is cut into slices of about a partition, and says what the window says."""
    seen = []
    monkeypatch.setattr(R, "stored", lambda df, label: seen.append((label, out := _stored(df, label))) or out)
    rows = spark.range(200_000).select("id", F.lit("k").alias("k"), F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id") * 31 % 1000).alias("t"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = R.running(rows, ["k"], ["t", "id"], [R.Running("n", "sum", F.lit(1))])
        slices = [r["count"] for r in dict(seen)["slices"].groupBy("_slice").count().collect()]
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert len(slices) == parts and max(slices) < 2 * 200_000 / parts
        assert [r["n"] for r in got.orderBy("t", "id").limit(1000).collect()] == list(range(1, 1001)) and got.agg(F.max("n")).first()[0] == 200_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_analytics_of_hot_keys_equal_the_plain_ones(spark, monkeypatch):
    rng = random.Random(9)
    rows = sorted(((rng.randrange(400) * SECOND, rng.choice([4624, 4634, 4672]), {}, rng.choice(["H1", "H1", "H2"])) for _ in range(900)), key=lambda r: r[0])
    rows = [(t, n, {"SubjectLogonId" if n == 4672 else "TargetLogonId": rng.choice(("0x3e7", "0x3e7", "a"))}, c) for t, n, _, c in rows]
    pids = [(t * SECOND, 4688, {"NewProcessId": hex(t % 3), "ProcessId": hex(t % 4), "NewProcessName": "a"}, "H") if t % 5 else (t * SECOND, 4689, {"ProcessId": str(t % 3)}, "H") for t in range(500)]
    rdp = [(t * SECOND, rng.choice((21, 22, 23, 24)), {"SessionID": rng.choice("112")}, "H") for t in range(500)]
    fields = ["TargetLogonId", "SubjectLogonId", "NewProcessId", "ProcessId", "NewProcessName", "SessionID"]
    table = lambda df: sorted(map(repr, df.collect()))

    def all_of():
        events = make(spark, rows, fields)
        out = [table(sessions.logons(events)), table(proctree.pid_nodes(make(spark, pids, fields))), table(sessions.rdp_chains(make(spark, rdp, fields, sessions.RDP_CHANNEL)))]
        return [*out, table(explore.timeline(events.df.select("id", F.when(F.col("id") % 9 > 0, F.col("ts_ft") * 997).alias("ts_ft"))))]

    plain = all_of()
    monkeypatch.setattr(R.running, "__defaults__", (20,))
    assert all_of() == plain and all(plain)


@pytest.mark.parametrize("n", [2000, 8000])
def test_slices_do_not_grow_with_the_table(spark, monkeypatch, n):
    """More rows make more slices, not larger ones, and keys of more rows than a task takes are cut, whatever the number of partitions."""
    monkeypatch.setattr(R, "TASK_ROWS", 200)
    cut = []
    monkeypatch.setattr(R, "stored", lambda df, label: cut.append((label, _stored(df, label))) or cut[-1][1])
    rows = spark.range(n).select("id", F.when(F.col("id") % 4 > 0, F.lit(0)).otherwise(F.col("id") % 12).alias("k"), (F.col("id") * 7 % 101).alias("v"))
    want = rows.withColumn("t", F.sum("v").over(Window.partitionBy("k").orderBy("id")))
    got = R.running(rows, ["k"], ["id"], [R.Running("t", "sum", F.col("v"))], 20)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    sliced = next(df for label, df in cut if label == "slices")
    assert sliced.groupBy("_slice").count().agg(F.max("count")).first()[0] <= 600 and sliced.groupBy("k").count().count() > 0


def test_pages_and_places_read_few_files(spark):
    ids = sorted(random.Random(3).sample(range(100_000), 20_000))
    rows = spark.createDataFrame([(i, i * 2) for i in ids], "id long, v long").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        own = explore.Ranked.of(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert own.ranges.count() == 4
    for after, size in ((None, 256), (-1, 10), (ids[9_990], 300), (ids[-3], 256), (ids[-1], 5), (ids[100], 20_000)):
        got = own.page(after, size)
        at = 0 if after is None else sum(i <= after for i in ids)
        assert [r["id"] for r in got.collect()] == ids[at : at + size]
        if size <= 300:
            assert len(got.inputFiles()) <= 2
    for id in (0, ids[0], ids[777], ids[777] + 1, ids[-1], 10**9):
        assert own.position(id).first()["n"] == sum(i < id for i in ids)
    scanned = own.page(ids[100], 5)
    assert len(scanned.inputFiles()) == 2 and spark.read.parquet(*scanned.inputFiles()).count() < 10_200
    assert explore.Ranked.of(rows.limit(0)).page().count() == 0 == explore.Ranked.of(rows.limit(0)).position(5).first()["n"]
