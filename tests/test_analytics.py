import random

import pytest
from pyspark.sql import functions as F

from tests_support import make
from tracequarry.functions import labels, names
from tracequarry.functions.net import ip_key_of
from tracequarry.functions.timeparse import SECOND
from tracequarry.operators import chips, entities, explore, proctree, sessions

def test_boots_are_anchored(spark):
    rows = [(t * SECOND, 12, {"@provider": "Microsoft-Windows-Kernel-General", "@channel": "System"}, "h.x") for t in (0, 100, 250, 301, 500, 602)]
    e = make(spark, rows, [])
    assert [x // SECOND for x in sessions.boot_times(e).first()["boots"]] == [0, 301, 602]


def test_logons_equal_the_loop(spark):
    rng = random.Random(3)
    rows = sorted(((rng.randrange(40) * SECOND, rng.choice([4624, 4624, 4634, 4647, 4672]), {"l": rng.choice("ab")}, rng.choice(["H1", "h1.dom", "H2"])) for _ in range(300)), key=lambda r: r[0])
    rows = [(t, n, {"SubjectLogonId" if n == 4672 else "TargetLogonId": f["l"]}, c) for t, n, f, c in rows]
    got = {r["id"]: (r["end_id"], r["privileged"]) for r in sessions.logons(make(spark, rows, ["TargetLogonId", "SubjectLogonId"])).collect()}
    host = lambda c: c.split(".")[0].upper()
    used, expected = set(), {}
    special = {(host(c), f.get("SubjectLogonId")) for _, n, f, c in rows if n == 4672}
    for i, (t, n, f, c) in enumerate(rows):
        if n == 4624:
            end = next((j for j, (u, m, g, d) in enumerate(rows) if m in (4634, 4647) and j not in used and u >= t and host(d) == host(c) and g["TargetLogonId"] == f["TargetLogonId"]), None)
            used.add(end)
            expected[i] = (end, (host(c), f["TargetLogonId"]) in special)
    assert got == expected
    e = make(spark, rows, ["TargetLogonId", "SubjectLogonId"])
    t = sessions.logon_totals(e, sessions.logons(e)).first()
    assert t["sessions"] == len(expected) and t["closed"] == sum(x is not None for x, _ in expected.values()) and t["hosts_without_boot"] == 2


def test_rdp_chains(spark):
    ids = [21, 22, 24, 25, 40, 23, 22, 21, 21, 39]
    rows = [(i * SECOND, n, {"SessionID": "1", "User": "u" if i else None, "Reason": "5"}, "H") for i, n in enumerate(ids)]
    got = sessions.rdp_chains(make(spark, rows, ["SessionID", "User", "Reason", "Session", "Address"], sessions.RDP_CHANNEL)).orderBy("start_ft").collect()
    assert [(list(r["events"]), r["end_ft"]) for r in got] == [([0, 1, 2, 3, 4, 5], 5 * SECOND), ([6, ], None), ([7], None), ([8, 9], None)] and got[0]["user"] == "u" and "40 disconnect (code 5)" in got[0]["steps"]
    assert sessions.search(sessions.rdp_chains(make(spark, rows, ["SessionID", "User"], sessions.RDP_CHANNEL)), "U", ("user",)).count() == 4


def test_pid_tree_equals_the_search(spark):
    rng = random.Random(8)
    rows = []
    for t in sorted(rng.randrange(60) for _ in range(250)):
        pid, parent = rng.randrange(8), rng.randrange(8)
        rows.append((t * SECOND, 4688, {"NewProcessId": hex(pid), "ProcessId": hex(parent), "NewProcessName": f"c:\\p{pid}.exe", "ParentProcessName": "x\\q.exe"}, "H") if rng.random() < 0.6 else (t * SECOND, 4689, {"ProcessId": str(pid)}, "H"))
    nodes = proctree.pid_nodes(make(spark, rows, ["NewProcessId", "ProcessId", "NewProcessName", "ParentProcessName"]))
    got = {r["id"]: (r["parent"] if r["linked_by_pid"] else None, r["end_ft"]) for r in nodes.where("not synthetic").collect()}
    made = [(i, t, int(f["NewProcessId"], 16), int(f["ProcessId"], 16)) for i, (t, n, f, _) in enumerate(rows) if n == 4688]
    exits = [(t, int(f["ProcessId"])) for t, n, f, _ in rows if n == 4689]
    end = {i: min((u for u, p in exits if p == pid and u >= t), default=None) for i, t, pid, _ in made}
    for i, t, _pid, parent in made:
        before = [j for j, u, p, _ in made if p == parent and (u, j) < (t, i)]
        link = f"pid|{before[-1]}" if before and (end[before[-1]] is None or end[before[-1]] >= t) else None
        assert got[i] == (link, end[i]), i
    walked = proctree.trees(nodes)
    assert walked.count() == nodes.count() and walked.agg(F.max("depth")).first()[0] > 1
    assert proctree.search_paths(nodes, "P3.EXE").where("path like '%p3.exe'").count() > 0


def test_trees_with_cycles(spark):
    rows = [(f"n{i}", f"n{i - 1}" if i else None, "a.exe", i + 1, i) for i in range(12)] + [("c0", "c1", "x.exe", 1, 900), ("c1", "c0", "y.exe", 2, 901), ("lost", "gone", "z.exe", 3, 902)]
    got = {r["key"]: (r["depth"], r["root"]) for r in proctree.trees(spark.createDataFrame(rows, "key string, parent string, image string, start_ft long, id long")).collect()}
    assert got == {f"n{i}": (i, "n0") for i in range(12)} | {k: (0, k) for k in ("c0", "c1", "lost")}


def test_sysmon_tree(spark):
    rows = [(1, 1, {"ProcessGuid": "{a}", "Image": "c:\\a.exe"}, "H"), (2, 1, {"ProcessGuid": "{B}", "ParentProcessGuid": "{A}", "Image": "b.exe"}, "H"), (3, 1, {"ProcessGuid": "{b}", "ParentProcessGuid": "{A}"}, "H"), (4, 1, {"ProcessGuid": "{c}", "ParentProcessGuid": "{zz}", "ParentImage": "z\\z.exe"}, "H"), (5, 5, {"ProcessGuid": "{A}"}, "H"), (6, 5, {"ProcessGuid": "{A}"}, "H"), (7, 1, {"ProcessGuid": "{s}", "ParentProcessGuid": "{S}"}, "H")]
    nodes = proctree.sysmon_nodes(make(spark, rows, ["ProcessGuid", "ParentProcessGuid", "Image", "ParentImage", "CommandLine", "User", "ProcessId", "ParentProcessId", "ParentCommandLine"], proctree.SYSMON))
    got = {r["key"]: r for r in nodes.collect()}
    assert got["{A}"]["end_ft"] == 6 and got["{B}"]["repeats"] == 1 and got["{ZZ}"]["synthetic"] and got["{ZZ}"]["image"] == "z\\z.exe" and got["{S}"]["parent"] is None
    paths = {r["key"]: r["path"] for r in proctree.trees(nodes).collect()}
    assert paths["{B}"] == "a.exe › b.exe" and paths["{C}"] == "z.exe › (unknown)"


def test_entities(spark):
    sid = "S-1-5-21-1-2-3-1001"
    rows = [
        (1, 4624, {"TargetUserName": "Bob", "TargetDomainName": "corp.local", "TargetUserSid": sid, "IpAddress": "::ffff:10.0.0.5", "WorkstationName": "\\\\ws1.corp"}, "dc1.corp.local"), (2, 4624, {"TargetUserName": "bob", "TargetDomainName": "CORP", "IpAddress": "127.0.0.1"}, "DC1"),
        (3, 4624, {"TargetUserName": "WS9$", "IpAddress": "-"}, "DC1"), (4, 4624, {"SubjectUserName": "ann@x.org", "@sid": "S-1-5-18"}, "DC1"), (5, 6011, {"@provider": "EventLog", "@channel": "System", "Data": "x"}, "LOCALHOST"),
    ]
    e = make(spark, rows, ["TargetUserName", "TargetDomainName", "TargetUserSid", "SubjectUserName", "SubjectDomainName", "IpAddress", "WorkstationName"])
    r = entities.build(e)
    got = {x["entity"]: x for x in r.entities.collect()}
    assert set(got) == {f"user|sid:{sid}", "host|DC1", "host|WS1", "host|WS9", "ip|10.0.0.5", "user|name:X\\ann", "user|sid:S-1-5-18"}
    bob = got[f"user|sid:{sid}"]
    assert bob["events"] == 2 and bob["aliases"] == ["Bob", "bob"] and bob["domain"] == "CORP" and got["user|sid:S-1-5-18"]["builtin"]
    links = {(x["a"], x["b"]): x["count"] for x in r.links.collect()}
    assert links[("host|DC1", f"user|sid:{sid}")] == 2 and links[("host|DC1", "host|WS9")] == 1 and ("host|DC1", "host|WS1") in links
    assert [x["role"] for x in r.mentions.where("entity = 'host|WS9'").collect()] == ["account"]
    assert entities.lookup(r, "user", "CORP\\bob").count() == 1 and entities.lookup(r, "host", "dc1.other").count() == 1 and entities.lookup(r, "ip", "[10.0.0.5]").count() == 1
    assert entities.common_events(r, "host|DC1", f"user|sid:{sid}").count() == 2 and entities.links_of(r, "host|DC1").count() == 6
    assert [x["display"] for x in entities.listed(r, "host").collect()][0] == "DC1" and entities.listed(r, "user", "BO", True).count() == 1
    from dataclasses import replace

    from tracequarry.operators import engine

    q = lambda s: [x["id"] for x in engine.run(replace(e, entities=r.for_queries()), s).events.collect()]
    assert q("anyuser = BOB") == [0, 1] and q("anyuser != bob and not anyhost in (ws9)") == [3, 4]


def test_names(spark):
    rows = [("\\\\SRV.x.y",), ("pc$",), ("10.1.2.3",), ("::1",), ("localhost",), ("-",), ("..",), (None,)]
    assert [r[0] for r in spark.createDataFrame(rows, "v string").select(names.host_key(F.col("v"))).collect()] == ["SRV", "PC", None, None, None, None, None, None]
    users = spark.createDataFrame([("A\\b", "c"), ("b@d.e", None), ("b", "-"), ("@x", None), ("nt\\", None)], "u string, d string")
    n, d = names.split_user(F.col("u"), F.col("d"))
    assert [tuple(r) for r in users.select(n, d).collect()] == [("b", "A"), ("b", "D"), ("b", None), ("@x", None), (None, None)]
    own = spark.createDataFrame([(v,) for v in ("[::1]", "0:0:0:0:0:FFFF:10.0.0.1", "FE80::1", "x")], "v string").select(ip_key_of(F.col("v")))
    assert [r[0] for r in own.collect()] == [None, "10.0.0.1", "fe80::1", None]


@pytest.mark.parametrize("n", [0, 1, 7, 1500])
def test_histogram(spark, n):
    rng = random.Random(n)
    times = sorted([rng.randrange(10**9) * SECOND for _ in range(n)] + ([0] if n > 1000 else []))
    got = explore.histogram(spark.createDataFrame([(t,) for t in times], "ts_ft bigint")).orderBy("start").collect()
    if not times:
        assert not got
        return
    cut = len(times) // 1000 if len(times) > 1000 else 0
    lo, hi = times[cut], times[len(times) - 1 - cut]
    width = next(w * SECOND for w in explore.WIDTHS if w * SECOND * 160 >= hi - lo)
    first, last = lo // width, hi // width
    assert [r["start"] // width for r in got] == list(range(first, last + 1)) and got[0]["width"] == width
    assert [r["count"] for r in got] == [sum(t // width == k for t in times) for k in range(first, last + 1)]
    assert (got[0]["before"], got[0]["after"]) == (sum(t // width < first for t in times), sum(t // width > last for t in times))


def test_timeline_and_chips(spark):
    df = spark.createDataFrame([(0, 0), (1, 3600 * SECOND), (2, 3601 * SECOND), (3, 86_400 * SECOND), (4, 86_400 * SECOND * 3)], "id bigint, ts_ft bigint")
    assert [(r["gap"], r["new_day"]) for r in explore.timeline(df).orderBy("id").collect()] == [(False, False), (True, False), (False, False), (True, True), (True, True)]
    assert [r["id"] for r in explore.timeline(df, "-01:00").where("new_day").orderBy("id").collect()] == [1, 4]
    e = make(spark, [(1, 1, {"a": "x"}, "H"), (2, 2, {"a": "Y"}, "H"), (3, 1, {}, "K")], ["a"])
    ids = lambda *c: [r["id"] for r in chips.evaluate(e, list(c)).orderBy("id").collect()]
    assert ids(chips.Chip("a", "X"), chips.Chip("a", "y")) == [0, 1] and ids(chips.Chip("zz", "1")) == [] and ids(chips.Chip("zz", "1", True)) == [0, 1, 2] and ids(chips.Chip("a", "x", True), chips.Chip("host", "h")) == [1]
    assert chips.log_view(["2"], [], "a = 1") == "level in (2) and (a = 1) | sort by time desc" and chips.with_field(e, "a").count() == 2


def test_labels(spark):
    e = make(spark, [(1, 4624, {"TargetUserName": "bob", "TargetDomainName": "D", "LogonType": "10", "IpAddress": "1.2.3.4"}, "H"), (2, 4728, {"SubjectUserName": "s", "MemberName": "CN=Ann B,OU=x", "TargetUserName": "grp"}, "H"), (3, 9999, {}, "H")], ["TargetUserName", "TargetDomainName", "LogonType", "IpAddress", "WorkstationName", "SubjectUserName", "MemberName"])
    assert [r[0] for r in e.df.orderBy("id").select(labels.describe(e)).collect()] == ["D\\bob logged on (remote desktop) from 1.2.3.4 ?", "s added Ann B to grp", None]
    one = spark.range(1)
    assert one.select(labels.parameters(F.lit("%%1842 x %%1"))).first()[0] == "Yes x %%1"
    assert one.select(labels.level_label(F.lit(0), F.lit(labels.AUDIT_FAILURE))).first()[0] == "audit failure" and one.select(labels.level_label(F.lit(None).cast("int"), F.lit(0))).first()[0] == "information"
    pairs = F.array(*[F.struct(F.lit(k).alias("name"), F.lit(v).alias("value")) for k, v in (("a", "1"), ("b", "-"), ("c", "x" * 100), ("d", ""))])
    assert one.select(labels.summary(pairs)).first()[0] == "a: 1; c: " + "x" * 90 + "…"
    assert explore.logs(spark.createDataFrame([("a/Microsoft-Windows-Sysmon%4Operational.evtx",), ("Security.evtx",)], "source string")).orderBy("log").collect()[0]["group"] == "Sysmon"


def test_numbering_slices_stay_even_with_far_times_and_one_hot_time(spark):
    """A zero time, a far one, a third of all rows at one time and a third without a time: no slice holds them all."""
    from pyspark.sql import functions as F

    from tracequarry.model import numbered, sliced

    n = 60_000
    at = F.when(F.col("k") % 3 == 0, F.lit(5 * 10**15)).when(F.col("k") % 3 == 1, F.lit(None)).otherwise(10**15 + F.col("k") * 10**7)
    rows = spark.range(n).select(((F.col("id") * 7919) % n).alias("k")).withColumn("ts_ft", F.when(F.col("k") == 2, 0).when(F.col("k") == 5, 2**62).otherwise(at).cast("bigint"))
    sizes = [r["count"] for r in sliced(rows, ["ts_ft", "k"]).groupBy(F.shiftright("_row", 33).alias("p")).count().collect()]
    assert sum(sizes) == n and max(sizes) < 3 * n / len(sizes)
    got = [(r["ts_ft"], r["k"]) for r in numbered(rows, ["ts_ft", "k"]).orderBy("id").collect()]
    assert got == sorted(got, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    assert [r["id"] for r in numbered(rows, ["ts_ft", "k"]).select("id").orderBy("id").collect()] == list(range(n))
    assert numbered(rows.limit(0), ["ts_ft", "k"]).count() == 0


def test_histogram_range_is_exact_with_far_times(spark):
    from tracequarry.operators import explore

    times = sorted([0, 1, 2**61, 2**61 + 5] + [10**17 + i * i * 9_999_991 for i in range(3000)])
    got = explore.histogram(spark.createDataFrame([(t,) for t in times] + [(None,)], "ts_ft bigint")).orderBy("start").collect()
    lo, hi = times[len(times) // 1000], times[len(times) - 1 - len(times) // 1000]
    width = got[0]["width"]
    assert width == next(w * explore.SECOND for w in explore.WIDTHS if w * explore.SECOND * explore.BINS >= hi - lo)
    assert [r["start"] for r in got] == list(range(lo // width * width, hi // width * width + 1, width))
    assert [r["count"] for r in got] == [sum(r["start"] <= t < r["start"] + width for t in times) for r in got]
    assert {(r["before"], r["after"]) for r in got} == {(sum(t < got[0]["start"] for t in times), sum(t >= got[-1]["start"] + width for t in times))}


def test_histogram_runs_no_job_before_the_action(spark):
    df = spark.range(5000).select((F.col("id") * 7 * SECOND).alias("ts_ft"))
    spark.sparkContext.setJobGroup("histogram", "")
    try:
        plan = explore.histogram(df)
        assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("histogram")) == []
        assert plan.count() > 0 and list(spark.sparkContext.statusTracker().getJobIdsForGroup("histogram"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
