import struct

import pytest
from evtx_maker import EVENT, ChunkMaker, log, values

from tracequarry.functions.timeparse import parse_time
from tracequarry.model import BIT, flag_names
from tracequarry.sources import binxml, evtx, files, ingest
from tracequarry.sources.case import Case

T = parse_time("2024-03-01 10:00:00.1234567Z")


def chunk(n=3, first=1, base=T, number=77, **more):
    m = ChunkMaker(first)
    for k in range(n):
        m.add(number, EVENT, values(4624 + k, base + k, first + k, **more), base + k)
    return m


def test_clean_chunk():
    events, summary = evtx.read_chunk(chunk().done(), 0)
    assert summary["live"] == 3 and summary["carved"] == 0 and summary["flags"] == 0
    e = events[0]
    assert (e["event_id"], e["channel"], e["computer"], e["user_sid"], e["provider"], e["level"], e["pid"]) == (4624, "Security", "HOST1.example", "S-1-5-18", "Test-Provider", 4, 4)
    assert e["ts_ft"] == T and e["flags"] == 0 and e["keywords"] == 0x8020000000000000 - (1 << 64)
    assert [(n, v) for n, v, _ in e["fields"]] == [("TargetUserName", "alice"), ("LogonType", "3"), ("Data", "one"), ("Data", "two"), ("Blob", "AB01")]


def test_null_attribute_is_left_out():
    m = ChunkMaker()
    m.add(1, EVENT, values(1, T, 1, sid=b""), T)
    data = m.done()
    e = evtx.read_chunk(data, 0)[0][0]
    assert e["user_sid"] is None and e["flags"] == 0
    c = evtx.Chunk.read(data)
    assert "UserID" not in evtx.xml(c, next(c.records()))


def test_damage_is_flagged():
    assert evtx.read_chunk(chunk().done(bad_header=True), 0)[0][0]["flags"] == BIT["headerCrcMismatch"]
    assert evtx.read_chunk(chunk().done(bad_data=True), 0)[0][0]["flags"] == BIT["crcMismatch"]
    m = chunk(1)
    at = m.add(77, EVENT, values(9, T, 2), T)
    m.add(77, EVENT, values(10, T, 3), T)
    m.body[at : at + 4] = b"\0\0\0\0"
    events, _ = evtx.read_chunk(m.done(), 0, carve=False)
    assert [e["event_id"] for e in events] == [4624, 10] and events[1]["flags"] == BIT["afterGap"]
    m = chunk(1)
    m.add(77, EVENT, values(5, T + 10**10, 2), T, copy=1)
    assert evtx.read_chunk(m.done(), 0)[0][1]["flags"] == BIT["sizeMismatch"] | BIT["timeSkew"]


def test_carved_records():
    m = chunk(2)
    free = len(m.body)
    m.add(77, EVENT, values(4700, T, 9), T, record_id=9)
    events, summary = evtx.read_chunk(m.done(free=free), 0)
    assert summary["carved"] == 1 and events[-1]["event_id"] == 4700 and events[-1]["flags"] & BIT["carved"]
    assert evtx.read_chunk(m.done(free=free), 0, carve=False)[1]["carved"] == 0


def test_foreign_and_missing_templates():
    m = ChunkMaker()
    m.add(500, None, values(4800, T, 1), T, offset=60_000)
    data = m.done()
    e = evtx.read_chunk(data, 0)[0][0]
    assert e["flags"] & BIT["missingTemplate"] and ("Value[15]", "alice") in [(n, v) for n, v, _ in e["fields"]]
    other = chunk(1, number=500).done()
    c = evtx.Chunk.read(other)
    library = c.load_templates()
    e = evtx.read_chunk(data, 0, library=library)[0][0]
    assert e["flags"] & BIT["foreignTemplate"] and e["event_id"] == 4800 and "<EventID>4800</EventID>" in e["xml"]


def test_values():
    r = binxml.render
    assert r(10, struct.pack("<Q", 2**64 - 1)) == str(2**64 - 1) and r(0x15, struct.pack("<Q", 255)) == "0xff" and r(13, b"\1\0\0\0") == "true"
    assert r(15, bytes(range(16))) == "{03020100-0504-0706-0809-0A0B0C0D0E0F}" and r(8, b"\1") == "01" and r(2, b"\xe9\0") == "é"
    assert r(17, struct.pack("<q", T)) == "2024-03-01T10:00:00.1234567Z"
    assert binxml.items(0x81, "a\0\0b\0".encode("utf-16-le")) == ["a", "", "b"] and binxml.items(0x88, struct.pack("<II", 1, 2)) == ["1", "2"]
    assert evtx.hex_dump(b"AB\0").startswith("00000000  41 42 00")


def test_headers():
    h = evtx.file_header(log([chunk().done()])[:128])
    assert h.chunks == 1 and h.crc_ok and not h.dirty
    for bad in (b"", b"\0" * 128, b"\x30\0\0\0LfLe" + b"\0" * 120):
        with pytest.raises(evtx.NotALog):
            evtx.file_header(bad)


def test_case(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    newer, older = chunk(1, first=50, base=T + 100).done(), chunk(1, first=1, base=T - 100).done()
    (logs / "Security.evtx").write_bytes(log([chunk(3, first=10).done(), older, newer], counted=1, tail=b"x" * 99))
    (logs / "Copy.evtx").write_bytes(log([chunk(3, first=10).done()]))
    (logs / "bad.evtx").write_bytes(b"nothing")
    (logs / ".hidden.evtx").write_bytes(b"")
    (logs / "noext").write_bytes(log([chunk(1, first=90, base=T + 10**12, user="böb").done()]))
    case = Case.create(spark, [str(logs)], str(tmp_path / "case"))
    rows = case.table("events").orderBy("id").collect()
    assert [r["id"] for r in rows] == list(range(6)) and [r["ts_ft"] for r in rows] == sorted(r["ts_ft"] for r in rows)
    flags = {r["record_id"]: r["flags"] for r in rows}
    assert flags[1] == BIT["beyondHeader"] | BIT["stale"] and flags[50] == BIT["beyondHeader"] and flags[10] == BIT["hasCopies"]
    assert case.table("dups").count() == 3 and case.manifest["events"] == 6 and len(case.manifest["failed"]) == 1
    found = case.events()
    from tracequarry.operators.engine import run

    assert run(found, "TargetUserName = BÖB and eventid = 4624").events.count() == 1
    assert run(found, "Data = two and flag = beyondHeader | group by file").groups.collect()[0]["count"] == 2
    assert run(found, 'keywords = 0x8020000000000000 and level = information and "ab01"').events.count() == 6
    case.annotate(2, "red", "look")
    case.annotate(3, "blue")
    case.annotate(3, None)
    assert [r["id"] for r in run(case.events(), "tag = red").events.collect()] == [2] and run(case.events(), "tag exists").events.count() == 1
    assert case.source_record(2)[0] == "loaded" and files.reread(spark, str(logs / "gone"), 0, 512, 1)[0] == "missing"
    with pytest.raises(FileExistsError):
        Case.create(spark, [str(logs)], str(tmp_path / "case"))
    stats = {r["source"]: r for r in case.table("sources").collect()}
    assert stats["Security.evtx"]["tail"] == 99 and stats["Security.evtx"]["beyond_new"] + stats["Security.evtx"]["beyond_stale"] == 2 and stats["Security.evtx"]["version"] == "3.1" and stats["Copy.evtx"]["records"] == 3
    assert spark.range(1).select(flag_names(__import__("pyspark.sql.functions", fromlist=["lit"]).lit(3)).alias("f")).first()["f"] == ["beyondHeader", "stale"]


def test_data_source(spark, tmp_path):
    from tracequarry.sources.datasource import register

    (tmp_path / "a.evtx").write_bytes(log([chunk(2).done(), chunk(2, first=5).done()]))
    register(spark)
    rows = spark.read.format("evtx").load(str(tmp_path / "a.evtx")).orderBy("record_id").collect()
    assert [r["record_id"] for r in rows] == [1, 2, 5, 6] and rows[0]["f"]["Data"] == ["one", "two"]


def test_labels():
    assert ingest.unique_labels(["/a/x/s.evtx", "/b/x/s.evtx", "/c/t.evtx"]) == {"/a/x/s.evtx": "a/x/s.evtx", "/b/x/s.evtx": "b/x/s.evtx", "/c/t.evtx": "t.evtx"}


def test_files_through_the_shared_store(spark, tmp_path):
    """The same list by path and by URI; hidden files, links and other files are left out; states of records read again."""
    (tmp_path / "a" / ".hidden").mkdir(parents=True)
    data = log([chunk(3).done()])
    for name in ("a/S.EVTX", "a/noext", "a/.x.evtx", "a/.hidden/y.evtx", "top.evtx"):
        (tmp_path / name).write_bytes(data)
    (tmp_path / "a" / "other").write_bytes(b"not a log")
    (tmp_path / "a" / "empty").write_bytes(b"")
    (tmp_path / "a" / "z.txt").write_bytes(data)
    want = [f"file:{tmp_path}/{n}" for n in ("a/S.EVTX", "a/noext", "top.evtx")]
    assert files.discover(spark, [str(tmp_path)]) == want == files.discover(spark, [f"file:{tmp_path}"])
    assert files.discover(spark, [f"{tmp_path}/a/z.txt"]) == [f"file:{tmp_path}/a/z.txt"]
    state, raw = files.reread(spark, want[0], 0, 512, 1)
    assert state == "loaded" and raw[:4] == b"**\0\0" and len(raw) == int.from_bytes(raw[4:8], "little")
    again = lambda *a: files.reread(spark, *a)[0]
    assert [again(want[0], 0, 512, 99), again(want[0], 0, 513, 1), again(want[0], 7, 512, 1), again(want[0], None, 1, 1), again(f"{tmp_path}/a/other", 0, 512, 1)] == ["mismatch", "unreadable", "unreadable", "no-location", "unreadable"]


def test_progress_by_phases(spark, tmp_path):
    """An import shows its phases; another thread stops one that would not end."""
    import threading
    import time

    from pyspark.sql import functions as F

    from tracequarry.operators.progress import Progress

    (tmp_path / "S.evtx").write_bytes(log([chunk(3).done()]))
    progress = Progress(spark)
    Case.create(spark, [str(tmp_path)], str(tmp_path / "case"), progress=progress)
    states = {s.phase: s for s in progress.states()}
    assert list(states) == ["scanning", "parsing", "sorting", "writing", "finishing"] and all(s.ended and s.running == 0 for s in states.values())
    assert states["parsing"].jobs > 0 and states["writing"].done > 0 and states["writing"].failed == 0
    seen, failed = Progress(spark), []

    def work():
        try:
            with seen.phase("endless"):
                spark.range(0, 10**15, 1, 8).agg(F.sum(F.sin("id"))).collect()
        except Exception as e:
            failed.append(e)

    thread = threading.Thread(target=work)
    thread.start()
    for _ in range(200):
        if any(s.running for s in seen.states()):
            break
        time.sleep(0.1)
    assert [(s.phase, s.running, s.ended) for s in seen.states()] == [("endless", 1, False)]
    seen.cancel("endless")
    thread.join(60)
    assert not thread.is_alive() and failed and seen.states()[0].ended
