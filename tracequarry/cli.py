"""Command line: python -m tracequarry COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def session() -> SparkSession:
    return SparkSession.builder.appName("tracequarry").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def _pairs(texts: list[str]):
    from .operators.chips import Chip

    out = []
    for t in texts:
        key, _, value = t.partition("!=") if "!=" in t else t.partition("=")
        out.append(Chip(key, value, "!=" in t))
    return out


def _show(df, limit: int) -> None:
    for r in df.limit(limit).toLocalIterator():
        print(json.dumps({k: v for k, v in r.asDict(True).items() if not k.startswith("_")}, ensure_ascii=False, default=str))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("tracequarry")
    sub = p.add_subparsers(dest="command", required=True)
    add = lambda name, *args: [c := sub.add_parser(name), [c.add_argument(*a[0], **a[1]) for a in args]]
    arg = lambda *names, **more: (names, more)
    case, limit, zone = arg("case"), arg("--limit", type=int, default=100), arg("--zone", default="UTC")
    add("ingest", case, arg("inputs", nargs="+"), arg("--no-carve", action="store_true"), arg("--no-hash", action="store_true"), arg("--no-merge", action="store_true"))
    add("query", case, arg("filters", nargs="*"), limit)
    add("dql", case, arg("query"), limit, zone)
    add("entities", case, arg("--kind", default="host"), arg("--find", default=""), limit)
    add("sigma", case, arg("rules", nargs="+"), arg("--export"), limit)
    add("export", case, arg("output"), arg("--query", default=""), arg("--format", choices=["csv", "excel", "jsonl", "xlsx"], default="csv"), arg("--fields", default=""), zone)
    add("sessions", case, arg("--rdp", action="store_true"), limit)
    add("processes", case, arg("--find", default=""), limit)
    add("stats", case, arg("--export", default=""))
    for name in ("carve", "xml", "json"):
        add(name, arg("file"), limit)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command in ("carve", "xml", "json"):
        return dump(a)
    from .sources import ingest
    from .sources.case import Case

    spark = session()
    if a.command == "ingest":
        print(json.dumps(ingest.build(spark, a.inputs, a.case, ingest.Options(not a.no_carve, not a.no_hash, not a.no_merge))))
        return 0
    case = Case.open(spark, a.case)
    events = case.events()
    if a.command == "query":
        from .operators import chips

        _show(chips.evaluate(events, _pairs(a.filters)).orderBy("id").drop("fields"), a.limit)
    elif a.command == "dql":
        from .operators import engine

        _show(engine.run(events, a.query, a.zone).rows(), a.limit)
    elif a.command == "entities":
        from .operators import entities

        _show(entities.listed(case.build_entities(), a.kind, a.find), a.limit)
    elif a.command == "sigma":
        from .sinks import export
        from .sources import rules

        found = rules.RuleSet()
        for path in a.rules:
            found = found.merge(rules.pack(path) if path.endswith(".json") else rules.folder(path))
        run = case.detect(found)
        print(json.dumps(run.meta))
        if a.export:
            export.export_detections(run, a.export)
        _show(run.listed().select("title", "level", "hits", "hosts", "author", "license"), a.limit)
    elif a.command == "export":
        from .operators import engine
        from .sinks import export

        df = engine.run(events, a.query, a.zone).events if a.query else events.df
        fields = [f for f in a.fields.split(",") if f]
        sources = case.table("sources")
        if a.format == "jsonl":
            n = export.export_jsonl(events, df, a.output, a.zone, sources)
        elif a.format == "xlsx":
            n = export.export_xlsx(events, df, a.output, fields, a.zone, sources, case.info())
        else:
            n = export.export_csv(events, df, a.output, fields, a.zone, a.format == "excel", sources)
        print(n)
    elif a.command == "sessions":
        from .operators import sessions

        _show(sessions.rdp_chains(events) if a.rdp else sessions.logons(events).orderBy("start_ft"), a.limit)
    elif a.command == "processes":
        from .operators import proctree

        nodes = proctree.sysmon_nodes(events).unionByName(proctree.pid_nodes(events))
        _show(proctree.search_paths(nodes, a.find) if a.find else proctree.trees(nodes).orderBy("order"), a.limit)
    elif a.command == "stats":
        for k, v in case.info():
            print(f"{k}\t{v}")
        if a.export:
            from .sinks import export

            export.export_info(case.table("sources"), ingest.flag_counts(case.table("events")), a.export)
        _show(ingest.flag_counts(case.table("events")).orderBy("source", F.desc("count")), 1000)
    return 0


def dump(a: argparse.Namespace) -> int:
    """Records of one file without a case: XML, JSON lines, or what slack space holds."""
    from .sources import evtx

    with open(a.file, "rb") as f:
        data = f.read()
    header, n = evtx.file_header(data[:128]), 0
    for k in range((len(data) - header.header_size) // evtx.CHUNK):
        at = header.header_size + k * evtx.CHUNK
        chunk = evtx.Chunk.read(data[at : at + evtx.CHUNK])
        chunk.load_templates()
        for r in chunk.carve() if a.command == "carve" else chunk.records():
            if n >= a.limit:
                return 0
            n += 1
            if a.command == "xml":
                print(evtx.xml(chunk, r))
            else:
                print(json.dumps({"chunk": k, "offset": r.at, "record": r.number, **{x: y for x, y in evtx.event(chunk, r).items() if x not in ("off", "xml")}}, ensure_ascii=False))
    return 0


if __name__ == "__main__":
    sys.exit(main())
