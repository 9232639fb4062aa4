import csv
import io
import json
import random
import zipfile
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F
from tests_support import make

from tracequarry.model import EVENTS, EventSet
from tracequarry.operators import detections, engine
from tracequarry.plans import printer, sigma
from tracequarry.plans.parser import parse_filter
from tracequarry.sinks import export
from tracequarry.sources import rules

HEAD = "title: t\nid: i\nlevel: high\nauthor: A\nlicense: DRL\nlogsource:\n  product: windows\n"
NAMES = {"Image", "CommandLine", "ParentImage", "NewProcessName", "ParentProcessName", "MandatoryLabel", "Port", "Other", "@EventID", "@Channel", "@Level", "a.b"}


def query(detection, names=NAMES, source=HEAD, **more):
    text = source + "detection:\n" + "\n".join("  " + line for line in detection.splitlines())
    rule = rules.parse_rule(text, "r.yml", **more)
    assert not rule.failure, rule.failure
    compiled = sigma.compile_rule(rule, set(names), {"Alias": "Event.EventData.Image", "Msg": "Event.EventData", "Ud": "Event.UserData.Top.a.b", "Sys": "Event.System.Execution_attributes.ProcessID", "Eid": "Event.System.EventID"})
    shown = printer.expression(compiled.filter)
    assert parse_filter(shown) == compiled.filter
    return shown


def why(detection, **more):
    with pytest.raises(sigma.Unsupported) as e:
        query(detection, **more)
    return str(e.value)


def test_values_and_modifiers():
    q = lambda item: query(f"s:\n  {item}\ncondition: s")
    assert q("Image: cmd.exe") == "Image = cmd.exe" and q("Image: '*\\cmd.exe'") == "Image endswith \\cmd.exe" and q("Image: 'a*b'") == "Image like a*b" and q("Image: '*'") == "Image exists" and q("Image: ''") == 'Image = ""'
    assert q("Image|contains: 'x y'") == 'Image contains "x y"' and q("Image|startswith: [a, b]") == "Image startswith a or Image startswith b" and q("CommandLine|contains|all: [a, b]") == "CommandLine contains a and CommandLine contains b"
    assert q("Image|contains: 'a*b'") == "Image like *a*b*" and q(r"Image: 'a\*b'") == r'Image matches "(?s)\\Aa\\*b\\z"'
    assert q("Image: null") == "Image not exists" and q("Image|exists: false") == "Image not exists" and q("Port|gte: 1024") == "Port >= 1024" and q("Port: 0x17") == "Port = 0x17"
    assert q("Image|re: '^A'") == 'Image matches "(?-iu)^A"' and q("Image|re|i|m: '^A'") == 'Image matches "(?m)^A"' and q("Other|cidr: 10.0.0.0/8") == "Other cidr 10.0.0.0/8"
    assert q("Image|cased: Cmd") == "Image == Cmd" and q("Image|fieldref: Other") == "Image = `Other`" and q("Image|fieldref|endswith: Other") == "Image endswith `Other`"
    assert q("CommandLine|base64|contains: foo") == "CommandLine contains Zm9v" and q("CommandLine|wide|base64offset|contains: ab").count("contains") == 3
    assert sigma.base64_offsets(b"foobar") == ["Zm9vYmFy", "Zvb2Jhc", "mb29iYX"]
    assert q("CommandLine|windash|contains: ' -f'").count("contains") == 5 and len(sigma.dashed("a -b -c")) == 25 and sigma.dashed("x-y") == ["x-y"]
    assert q("EventID: 1") == "@EventID = 1" and query("s:\n  Ud: 1\n  Eid: 4\ncondition: s") == "false"
    text = rules.parse_rule(HEAD + "detection:\n  s:\n    Ud: 1\n    Eid: 4\n    Msg: word\n  condition: s", "p", "hayabusa")
    assert printer.expression(sigma.compile_rule(text, NAMES, {"Ud": "Event.UserData.Top.a.b", "Eid": "Event.System.EventID", "Msg": "Event.EventData"}).filter) == 'a.b = 1 and @EventID = 4 and "word"'


def test_conditions_and_absence():
    d = "sel_a:\n  Image: a\nsel_b:\n  Image: b\n_x:\n  Image: x\nkw:\n  - one\n  - '*two*'\ncondition: "
    assert query(d + "1 of sel_* and not kw") == '(Image = a or Image = b) and not ("one" or "two")' and query(d + "all of sel_*") == "Image = a and Image = b" and query(d + "1 of them") == 'Image = a or Image = b or "one" or "two"'
    assert query(d + "(sel_a or sel_b) and _x") == "(Image = a or Image = b) and Image = x" and query("s:\n  - Image: a\n    Other: b\n  - Image: c\ncondition:\n  - s\n  - not s") == "(Image = a and Other = b) or Image = c or not ((Image = a and Other = b) or Image = c)"
    assert query("s:\n  Gone: x\ncondition: s") == "false" and query("s:\n  Gone: null\n  Image: a\ncondition: s") == "Image = a" and query("s:\n  Gone|exists: false\ncondition: not s") == "false"
    for bad in ("2 of sel_*", "sel_a | count() > 3", "nope", "(sel_a", "1 of zz*", "sel_a sel_b"):
        assert why(d + bad), bad
    for bad in ("Image|utf16: a", "Image|expand: a", "Image|frob: a", "Image|re: '('", "Port|gt: x", "Image|wide: a"):
        assert why(f"s:\n  {bad}\ncondition: s")
    assert why("s:\n  Image:\n    x: y\ncondition: s") and why("s:\n  - 'a*b'\ncondition: s")


def test_log_sources():
    own = lambda s: "title: t\nlogsource:\n" + "".join(f"  {k}: {v}\n" for k, v in s.items())
    d = "s:\n  Image: x\n  IntegrityLevel: High\ncondition: s"
    q = query(d, NAMES | {"IntegrityLevel"}, own({"category": "process_creation", "product": "windows"}))
    assert "@Channel = Microsoft-Windows-Sysmon/Operational and @EventID = 1 and Image = x and IntegrityLevel = High" in q and "NewProcessName = x and MandatoryLabel = S-1-16-12288" in q
    assert "@EventID in (17, 18)" in query("s:\n  Image: x\ncondition: s", source=own({"category": "pipe_created"})) and "@Channel = Security and" in query("s:\n  Image: x\ncondition: s", source=own({"service": "security"}))
    assert "Security-Mitigations*" in query("s:\n  Image: x\ncondition: s", source=own({"service": "security-mitigations"}))
    for bad in ({"product": "linux"}, {"category": "nope"}, {"service": "nope"}, {"definition": "x"}):
        assert why("s:\n  Image: x\ncondition: s", source=own(bad))


def test_loading(tmp_path):
    assert rules.parse_rule("a: 1\n---\nb: 2").failure and rules.parse_rule("title: x").failure and rules.parse_rule("title: x\ndetection:\n  s: {}").failure and rules.parse_rule("detection: {condition: s}").failure and rules.parse_rule("title: [").failure and rules.parse_rule("title: x\ncorrelation: {}\ndetection: {condition: s}").failure and rules.parse_rule("").failure
    r = rules.parse_rule("title: x\ndetection:\n  s:\n    a: 0x17\n    b: null\n    c: 'null'\n    d: ~\n    e:\n  condition: s\n  timeframe: 5m")
    assert r.detection["s"] == {"a": "0x17", "b": rules.NULL, "c": "null", "d": rules.NULL, "e": rules.NULL} and "timeframe" not in r.detection
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "z.yaml").write_text(HEAD + "detection:\n  s:\n    a: 1\n  condition: s\n")
    (tmp_path / "a.YML").write_text("title: [")
    (tmp_path / "n.txt").write_text("x")
    found = rules.folder(str(tmp_path))
    assert len(found.rules) == 2 and sorted(bool(r.failure) for r in found.rules) == [False, True] and rules.write_pack(str(tmp_path / "p.json"), {"hayabusa": str(tmp_path / "b")}, {"A": "Event.EventData.a"}) == 1
    again = rules.pack(str(tmp_path / "p.json"))
    assert again.rules[0].title == "t" and again.rules[0].source == "hayabusa" and found.merge(again).aliases == {"A": "Event.EventData.a"} and again.rules[0].author == "A"


def test_run(spark):
    rng = random.Random(1)
    images = ["c:\\cmd.exe", "C:\\CMD.EXE", "c:\\calc.exe", None, ""]
    rows = [(k, rng.choice([1, 4688, 7]), {"Image": rng.choice(images), "CommandLine": rng.choice(["a -enc x", "b", None])}, f"H{k % 3}") for k in range(80)]
    e = make(spark, rows, ["Image", "CommandLine"], "Microsoft-Windows-Sysmon/Operational")
    bodies = ["s:\n  Image|endswith: \\cmd.exe\ncondition: s", "s:\n  CommandLine|contains: ' -enc'\nf:\n  Image: null\ncondition: s and not f", "s:\n  Gone: x\ncondition: s", "s:\n  Image|frob: x\ncondition: s"]
    texts = [f"title: r{i}\nlevel: {lv}\nlogsource:\n  product: windows\ndetection:\n" + "\n".join("  " + x for x in b.splitlines()) for i, (b, lv) in enumerate(zip(bodies, ("high", "low", "medium", "low"), strict=True))]
    texts.append(texts[0].replace("title: r0", "title: sysmon").replace("product: windows", "category: process_creation"))
    run = detections.run(e, rules.RuleSet(tuple(map(rules.parse_rule, texts)) + (rules.parse_rule("title: ["),)), batch=1)
    assert (run.meta["evaluated"], run.meta["unsupported"], run.meta["failed"]) == (4, 1, 1)
    hits = {}
    for r in run.hits.collect():
        hits.setdefault(r["rule"], set()).add(r["id"])
    cmd = {i for i, r in enumerate(rows) if (r[2]["Image"] or "").lower().endswith("\\cmd.exe")}
    assert hits[0] == cmd and hits[1] == {i for i, r in enumerate(rows) if r[2]["CommandLine"] == "a -enc x" and r[2]["Image"] is not None} and 2 not in hits and hits[4] == {i for i in cmd if rows[i][1] == 1}
    s = {r["title"]: r for r in run.summary().collect()}
    assert s["r0"]["hits"] == len(cmd) and s["r0"]["hosts"] == len({i % 3 for i in cmd}) and s["r0"]["first_ft"] == min(cmd) and s["r3"]["state"] == "unsupported" and list(s["r2"]["absent"]) == ["Gone"]
    assert run.hit_events().first()["n"] == len(set().union(*hits.values())) and {r["level"]: r["rules"] for r in run.by_level().collect()} == {"high": 2, "low": 1}
    from tracequarry.operators.verify import verify

    own = rules.RuleSet(tuple(map(rules.parse_rule, texts)) + (rules.parse_rule("title: ["),))
    assert verify(e, own, run).count() == 0
    wrong = detections.Run(run.rules, run.hits.where(f"not (rule = 0 and id = {min(cmd)})").union(spark.createDataFrame([(1, 79, "x", 1)] if 79 not in hits[1] else [(4, min(set(range(80)) - cmd), "x", 1)], "rule int, id bigint, computer string, ts_ft bigint")), run.meta)
    assert sorted(r["problem"] for r in verify(e, own, wrong).collect()) == ["extra", "missing"]
    one = next(iter(hits[0] & hits[4]))
    assert [r["title"] for r in run.rules_of_event(one).collect()][:2] == ["r0", "sysmon"] and run.listed("problems").count() == 2 and run.listed("evaluated", "medium").count() == 3 and run.listed("hits", text="SYS").count() == 1
    q = lambda t: {r["id"] for r in engine.run(detections.attach(e, run), t).events.collect()}
    assert q("rule = r0") == cmd and q("rule contains sys") == hits[4] and q("rulelevel < medium") == hits[1] and q("rule not in (r0, r1, sysmon)") == set(range(80)) - cmd - hits[1] and q("rule exists") == cmd | hits[1] and q("rule = 1") == hits[1]


def test_second_evaluator(spark):
    """Each modifier by both evaluators over random events."""
    rng = random.Random(6)
    images = ["c:\\cmd.exe", "C:\\CMD.EXE", "a -f x", "a /f x", "a –f x", "Zm9vYmFy", "10.1.2.3", "fe80::1", "17", "0x20", "x*y", "", None]
    rows = [(k, 1, {"Image": rng.choice(images), "CommandLine": rng.choice(images)}, "H") for k in range(150)]
    e = make(spark, rows, ["Image", "CommandLine"], "Microsoft-Windows-Sysmon/Operational")
    items = ["Image: '*cmd*'", "Image|contains: MD.", "Image|cased|contains: MD.", "Image|windash|contains: ' -f'", "Image|base64offset|contains: oba", "Image|cidr: [10.0.0.0/8, 'fe80::/10']", "Image|gt: 16", "Image|lte: 0x20", "Image: null", "Image|exists: true", "Image|re: ^[A-C]", "Image|re|i: ^[A-C]", "Image|fieldref: CommandLine", "Image|fieldref|startswith: CommandLine", r"Image: 'x\*y'", "Image: ''", "Image|contains|all: [a, x]", "Image: [17, '10*']"]
    own = rules.RuleSet(tuple(rules.parse_rule(f"title: t{i}\nlogsource:\n  category: process_creation\ndetection:\n  s:\n    {item}\n  k:\n    - 'foo'\n  condition: s and not k") for i, item in enumerate(items)))
    run = detections.run(e, own)
    assert run.meta["evaluated"] == len(items), run.rules.where("state <> 'evaluated'").select("title", "reason").collect()
    assert verify_rows(e, own, run) == [] and run.hits.select("rule").distinct().count() >= len(items) - 2


def verify_rows(e, own, run):
    from tracequarry.operators.verify import verify

    return [(own.rules[r["rule"]].title, r["id"], r["problem"]) for r in verify(e, own, run).collect()]


def test_exports(spark, tmp_path):
    rows = [(i, 132_000_000_000_000_000 + i, "S1.evtx", -1 if i == 1 else i, 4624, 4, f"H{i}", "=cmd|x" if i == 2 else 'a"b;c,d\n', 4 | 1, [("u", "x", 1), ("u", "y", 1), ("v", "<&>\x01" + "z" * (40_000 if i == 0 else 1), 1)], {"u": ["x", "y"], "v": ["1"]}) for i in range(3)]
    df = spark.createDataFrame(rows, "id bigint, ts_ft bigint, source string, record_id bigint, event_id int, level smallint, computer string, provider string, flags int, fields array<struct<name: string, value: string, type: smallint>>, f map<string,array<string>>").withColumn("source_id", F.lit(0))
    for name, t in EVENTS.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(t))
    e = EventSet.from_events(df, ["u", "v"])
    sources = spark.createDataFrame([(0, "ff", "/x/S1.evtx")], "source_id int, sha256 string, path string")
    out = tmp_path / "a.csv"
    assert export.export_csv(e, df, str(out), ["u", "zz"], "+03:00", sources=sources) == 3
    raw = out.read_bytes()
    assert not raw.startswith(b"\xef\xbb\xbf") and raw.count(b"\r\n") == 4
    table = list(csv.reader(io.StringIO(raw.decode(), newline="")))
    assert table[0][0] == "Time (UTC+03:00)" and table[1][1].endswith("Z") and table[2][8] == "18446744073709551615" and table[1][10] == "ff" and table[0][9:12] == ["SourceFile", "SourceSHA256", "Flags"] and table[1][11] == "beyondHeader headerCrcMismatch" and table[1][12] == "x" and table[1][13] == "" and table[2][14].startswith("u: x | u: y | v: <&>")
    export.export_csv(e, df, str(out), [], excel=True)
    text = out.read_text("utf-8-sig")
    assert out.read_bytes().startswith(b"\xef\xbb\xbf") and ";'=cmd|x;" in text and '"a""b;c,d' in text
    assert export.export_jsonl(e, df, str(tmp_path / "a.jsonl"), sources=sources) == 3
    first = json.loads((tmp_path / "a.jsonl").read_text().splitlines()[0])
    assert first["data"] == {"u": ["x", "y"], "v": "1"} and first["flags"] == ["beyondHeader", "headerCrcMismatch"] and first["event_id"] == 4624 and first["source_file"] == "/x/S1.evtx"
    counts = export.export_xlsx(e, df, str(tmp_path / "a.xlsx"), ["u"], info=[("case", "x")])
    assert counts["rows"] == 3 and counts["cut"] == 1
    with pytest.raises(export.TooManyRows):
        export.export_xlsx(e, spark.range(export.MOST_ROWS + 1), str(tmp_path / "b.xlsx"))
    assert not (tmp_path / "b.xlsx").exists()
    with zipfile.ZipFile(tmp_path / "a.xlsx") as z:
        sheet = ElementTree.fromstring(z.read("xl/worksheets/sheet1.xml"))
        ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
        assert len(sheet.findall(".//m:row", ns)) == 4 and [c.find("m:v", ns).text for c in sheet.findall(".//m:c", ns) if c.find("m:v", ns) is not None][:2] == ["4624", "4"]
        assert max(len(t.text) for t in sheet.iter("{%s}t" % ns["m"])) == export.MOST_CHARS and b"case" in z.read("xl/worksheets/sheet2.xml")
    assert export.column_letters(0) == "A" and export.column_letters(701) == "ZZ" and export.column_letters(702) == "AAA"
    one = "0 as source_id, 'a\tb' as source, 65536L as size, 'ff' as sha256, '3.1' as version, 3 as header, 2 as chunks, 3L as physical_chunks, 1L as empty_chunks, 1L as beyond_new, 0L as beyond_stale, 0L as header_crc_chunks, 2L as data_crc_chunks, 9L as tail, 5L as records, 1L as carved, 0L as copies, 132000000000000000L as first_ft, cast(null as bigint) as last_ft, '/x/a' as path"
    health = spark.range(1).selectExpr(*one.split(", "))
    marks = spark.createDataFrame([("a\tb", "stale", 2), ("a\tb", "carved", 1)], "source string, flag string, count long")
    assert export.export_info(health, marks, str(tmp_path / "i.tsv")) == 1
    report = [x.split("\t") for x in (tmp_path / "i.tsv").read_text().splitlines()]
    assert report[0] == list(export.INFO_COLUMNS) and report[1][:13] == ["a b", "65536", "ff", "3.1", "yes", "2 / 3", "1", "1 / 0", "0 / 2", "9", "5", "1", "0"] and report[1][14:] == ["—", "carved 1, stale 2", "/x/a"]
    many = spark.range(500).select("id", (F.col("id") * 7).alias("ts_ft"), F.lit("s").alias("source"), F.lit(1).cast("bigint").alias("record_id"), F.lit(0).alias("flags"), *[F.lit(None).cast("string").alias(c) for c in ("computer", "channel", "provider", "user_sid")], F.lit(1).alias("event_id"), F.lit(4).alias("level"), F.lit(None).cast("array<struct<name:string,value:string>>").alias("fields"), F.create_map(F.lit("n"), F.array(F.col("id").cast("string"))).alias("f"))
    many = EventSet.from_events(many.repartition(5), ["n"], frozenset(["n"]))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert export.export_csv(many, many.df, str(tmp_path / "parts"), ["n"], one_file=False) == 500
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted((tmp_path / "parts").glob("part-*"))
    assert parts[0].name == "part-00000" and len(parts) > 2
    assert [r[12] for r in csv.reader(io.StringIO("".join(f.read_bytes().decode() for f in parts)))] == ["n", *map(str, range(500))]
    assert export.export_csv(many, many.df, str(tmp_path / "whole.csv"), ["n"]) == 500 and (tmp_path / "whole.csv").read_bytes() == b"".join(f.read_bytes() for f in parts) and not list(tmp_path.glob("*.parts-*"))


def test_streaming(spark, tmp_path):
    from tracequarry.streaming import rules as streaming

    spark.createDataFrame([(i, i * 10, "cmd.exe" if i % 2 else "x") for i in range(10)], "id bigint, ts_ft bigint, Image string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id bigint, ts_ft bigint, Image string").parquet(str(tmp_path / "in"))
    own = rules.RuleSet((rules.parse_rule("title: t\nlogsource:\n  product: windows\ndetection:\n  s:\n    Image|startswith: CMD\n  condition: s"), rules.parse_rule("title: [")))
    e = EventSet(stream, EventSet.from_dataframe(spark.createDataFrame([], "Image string"), id=F.lit(0), fields=["Image"]).keys)
    assert list(streaming.screened(e, own)[1]) == [1]
    with pytest.warns(UserWarning, match="1 of 2 rules"):
        found = streaming.hits(e, own)
    q = found.writeStream.format("memory").queryName("hits").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["id"] for r in spark.table("hits").collect()) == [1, 3, 5, 7, 9]
    timed = spark.readStream.schema("id bigint, ts_ft bigint, Image string").parquet(str(tmp_path / "in")).withColumn("ts", F.timestamp_seconds(F.col("ts_ft") * 600))
    q = streaming.counts(timed, "ts", ["Image"]).writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sum(r["count"] for r in spark.table("windows").collect()) == 10


def test_cli(spark, tmp_path, capsys):
    from evtx_maker import log
    from test_evtx import chunk

    from tracequarry import cli

    (tmp_path / "Security.evtx").write_bytes(log([chunk(3).done()]))
    case = str(tmp_path / "case")
    run = lambda *a: (cli.main(list(a)), capsys.readouterr().out)[1]
    assert json.loads(run("ingest", case, str(tmp_path)))["events"] == 3
    assert run("dql", case, "TargetUserName = ALICE | group by eventid").count("\n") == 3 and run("query", case, "TargetUserName=alice", "eventid!=4625").count("\n") == 2
    (tmp_path / "r.yml").write_text("title: Rule\nlevel: high\nauthor: Me\nlicense: DRL\nlogsource:\n  service: security\ndetection:\n  s:\n    TargetUserName: alice\n  condition: s\n")
    assert '"hits": 3' in run("sigma", case, str(tmp_path), "--export", str(tmp_path / "d.csv")) and "Me" in (tmp_path / "d.csv").read_text()
    table = list(csv.reader((tmp_path / "d.csv").open()))
    assert table[0] == ["Level", "Rule", "Events", "Hosts", "First (UTC)", "Last (UTC)", "FirstUTC", "LastUTC", "Author", "RuleSet", "RulePath", "RuleID", "Status", "Tags", "References", "License", "DQL"] and table[1][:4] == ["high", "Rule", "3", "1"]
    assert run("dql", case, "rule = Rule and rulelevel >= high").count("\n") == 3 and "HOST1" in run("entities", case) and run("dql", case, "anyuser = alice").count("\n") == 3
    assert run("export", case, str(tmp_path / "o.csv"), "--query", "time >= 2024-03-01 | limit 2").strip() == "2" and run("sessions", case) == "" and "sha256" in run("stats", case) and run("processes", case) == "" and run("sessions", case, "--rdp") == ""
    assert "<EventID>4624</EventID>" in run("xml", str(tmp_path / "Security.evtx"), "--limit", "1") and run("json", str(tmp_path / "Security.evtx")).count("\n") == 3 and run("carve", str(tmp_path / "Security.evtx")) == ""




def test_a_pack_at_once_equals_rule_by_rule(spark):
    """Random rules of every kind of search and condition, over events with repeated, missing and odd values."""
    from tracequarry.operators import rulepack

    rng = random.Random(12)
    texts = ["c:\\cmd.exe", "C:\\CMD.EXE", "a -f x", "10.1.2.3", "fe80::1", "17", "0x20", "x*y", "İx", "straße", "ab", "z", "", None, "powershell -enc aGk="]
    rows = [(k, rng.choice((1, 3, 5)), {"Image": rng.choice(texts), "CommandLine": rng.choice(texts)}, f"H{k % 3}") for k in range(200)]
    e = make(spark, rows, ["Image", "CommandLine"], "Microsoft-Windows-Sysmon/Operational")
    df = e.df.withColumns({"Many": F.array_distinct(F.array("Image", "CommandLine")), "Num": F.col("id") % 7})
    e = EventSet.from_dataframe(df, id="id", fields=["Image", "CommandLine", "Many", "Num"], system={"@EventID": F.col("n"), "@Channel": "channel", "@Computer": "computer"}).with_df(df)
    pieces = ["Image: '*cmd*'", "Image|contains: MD.", "Image|cased|contains: MD.", "CommandLine|startswith: a", "CommandLine|endswith: [x, e, '3']", "Many: [ab, z, 'x\\*y']", "Many|contains|all: [c, m]", "Num: [1, 3]", "Num|gte: 4", "Image: null", "Image|exists: true", "CommandLine: ''", "Image|cidr: [10.0.0.0/8, 'fe80::/10']", "CommandLine|re: '^[a-c]'", "Image|fieldref: CommandLine", "CommandLine|gt: 16", "Image: '?b'", "Image|contains: ß", "Many|contains: i", "Image|windash|contains: ' -f'", "CommandLine|base64offset|contains: hi", "Gone: x", "EventID: 3", "Image: '*'"]
    conditions = ["a", "not a", "a and b", "a or b", "a and not b", "not a and not b", "not (a and b) or c", "1 of them", "all of them", "(a or b) and not c", "not 1 of them", "a or not b", "kw or a", "not kw and b"]
    own = []
    for k in range(120):
        searches = "".join(f"  {n}:\n" + "".join(f"    {p}\n" for p in {p.split(":")[0]: p for p in rng.sample(pieces, rng.choice((1, 1, 2)))}.values()) for n in "abc")
        source = rng.choice(("product: windows", "category: process_creation", "service: sysmon"))
        own.append(rules.parse_rule(f"title: t{k}\nlogsource:\n  {source}\ndetection:\n{searches}  kw:\n    - 'cmd'\n    - z\n  condition: {rng.choice(conditions)}"))
    own += [rules.parse_rule("title: ["), rules.parse_rule("title: u\nlogsource:\n  product: windows\ndetection:\n  a:\n    Image|re: '('\n  condition: a")]
    pack = rules.RuleSet(tuple(own))
    one, other = detections.run(e, pack), rulepack.run(e, pack)
    assert {k: v for k, v in one.meta.items() if k != "compile_seconds"} == {k: v for k, v in other.meta.items() if k != "compile_seconds"}
    hits = lambda r: sorted(map(tuple, r.hits.select("rule", "id", "computer", "ts_ft").collect()))
    want = hits(one)
    assert hits(other) == want and len({r for r, *_ in want}) > 60
    assert rulepack.run(e, rules.RuleSet()).hits.count() == 0 and rulepack.run(e.with_df(df.limit(0)), pack).hits.count() == 0
