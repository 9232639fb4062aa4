"""Export events in order: CSV, CSV for spreadsheets, JSON Lines and XLSX; detections and case information.

Tasks make the lines and write them, range by range of the order; where one file is wanted, the parts are joined as bytes. A
sheet alone is made in one place, as its archive is one stream of at most MOST_ROWS rows.
"""

from __future__ import annotations

import re
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.timeparse import iso_text, local_text, zone_label
from ..model import EXPORTED_FLAGS, EventSet, flag_names

MOST_ROWS, MOST_CHARS = 1_048_575, 32_767
NOTE = " [cut]"
# Columns of the exports.
SYSTEM = ("TimeUTC", "Computer", "Channel", "Provider", "EventID", "Level", "UserSID", "RecordID", "SourceFile", "SourceSHA256", "Flags")
_BAD_XML = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿\ud800-\udfff]")


#: What a spreadsheet takes for the start of a formula.
_FORMULA = ("=", "+", "-", "@", "\t", "\r")


def excel_safe(text: str) -> str:
    """A leading quote before what a spreadsheet would take for a formula."""
    return "'" + text if text[:1] in _FORMULA and text else text


def csv_cell(text: str, separator: str = ",") -> str:
    return '"' + text.replace('"', '""') + '"' if any(c in text for c in (separator, '"', "\n", "\r")) else text


def rows(events: EventSet, df: DataFrame, fields: list[str], zone: str = "UTC", sources: DataFrame | None = None) -> DataFrame:
    """The exported strings of each event in order: local time, system columns, chosen fields, all event data."""
    out = df
    sha = F.lit("")
    if sources is not None:
        out = out.join(sources.select("source_id", F.coalesce("sha256", F.lit("")).alias("_sha")), "source_id", "left")
        sha = F.coalesce("_sha", F.lit(""))
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    unsigned = F.conv(F.hex("record_id"), 16, 10)
    columns = [local_text(F.col("ts_ft"), zone), iso_text(F.col("ts_ft")), *[text(F.col(c)) for c in ("computer", "channel", "provider", "event_id", "level", "user_sid")], text(unsigned), text(F.col("source")), sha, F.array_join(flag_names(F.col("flags"), EXPORTED_FLAGS), " ")]
    columns += [text(events.keys[f].first) if f in events.keys else F.lit("") for f in fields]
    columns.append(F.array_join(F.transform("fields", lambda p: F.concat_ws(": ", p["name"], F.coalesce(p["value"], F.lit("")))), " | "))
    return out.select("id", F.array(*columns).alias("cells")).orderBy("id")


def header(fields: list[str], zone: str) -> list[str]:
    return [f"Time ({zone_label(zone)})", *SYSTEM, *fields, "EventData"]


def cell_text(v: Column, separator: str, excel: bool) -> Column:
    """A cell as it stands in a file."""
    if excel:
        v = F.when(F.substring(v, 1, 1).isin(*_FORMULA), F.concat(F.lit("'"), v)).otherwise(v)
    quoted = F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(v.rlike(f'[{separator}"\\n\\r]'), quoted).otherwise(v)


def csv_line(head: list[str], excel: bool = False) -> str:
    """The first line of a file, with the mark of the encoding for spreadsheets."""
    separator = ";" if excel else ","
    return "\ufeff" * excel + separator.join(csv_cell(excel_safe(x) if excel else x, separator) for x in head)


def write_lines(lines: DataFrame, path: str, head: str | None = None, end: str = "\n", one_file: bool = True) -> int:
    """Write the ordered column ``line`` and return the number of rows.

    Tasks write part files, in order of their names. ``one_file`` then joins them, bytes by bytes, behind the head; without it
    the folder of parts is left at the path, with the head as a part before all others.
    """
    spark, seen = lines.sparkSession, Observation()
    parts = f"{path}.parts-{uuid.uuid4().hex}" if one_file else path
    lines.observe(seen, F.count(F.lit(1)).alias("n")).select("line").write.option("lineSep", end).text(parts)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(parts)
    fs = folder.getFileSystem(conf)
    first = jvm.org.apache.hadoop.fs.Path(path) if one_file else jvm.org.apache.hadoop.fs.Path(folder, "part-00000")
    out = fs.create(first, True)
    try:
        if head is not None:
            out.write((head + end).encode())
        if one_file:
            names = sorted(str(f.getPath()) for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-"))
            for name in names:
                part = fs.open(jvm.org.apache.hadoop.fs.Path(name))
                try:
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, conf, False)
                finally:
                    part.close()
    finally:
        out.close()
    if one_file:
        fs.delete(folder, True)
    return seen.get["n"]


def export_csv(events: EventSet, df: DataFrame, path: str, fields: list[str] = [], zone: str = "UTC", excel: bool = False, sources: DataFrame | None = None, one_file: bool = True) -> int:
    separator = ";" if excel else ","
    own = rows(events, df, fields, zone, sources)
    lines = own.select(F.array_join(F.transform("cells", lambda v: cell_text(v, separator, excel)), separator).alias("line"))
    return write_lines(lines, path, csv_line(header(fields, zone), excel), "\r\n", one_file)


def json_rows(events: EventSet, df: DataFrame, zone: str = "UTC", sources: DataFrame | None = None) -> DataFrame:
    """line: each event as a JSON object, in order. A field with one value is a text, one with several a list."""
    out = df
    if sources is not None:
        out = out.join(sources.select("source_id", F.col("sha256").alias("_sha"), F.col("path").alias("_path")), "source_id", "left")
    text = lambda c: F.coalesce(c, F.lit(""))
    sha, file = (text(F.col("_sha")), text(F.col("_path"))) if sources is not None else (F.lit(""), text(F.col("source")))
    record = F.struct(
        local_text(F.col("ts_ft"), zone).alias("time"), iso_text(F.col("ts_ft")).alias("time_utc"), "computer", "channel", "provider", "event_id", "level", "user_sid",
        F.conv(F.hex("record_id"), 16, 10).cast("decimal(20,0)").alias("record_id"), file.alias("source_file"), sha.alias("source_sha256"), flag_names(F.col("flags"), EXPORTED_FLAGS).alias("flags"),
    )
    listed = lambda xs: F.to_json(xs, {"ignoreNullFields": "false"})
    bare = lambda xs: F.substring(xs, F.lit(2), F.length(xs) - 2)
    pair = lambda e: F.concat(bare(listed(F.array(e["key"]))), F.lit(":"), F.when(F.size(e["value"]) == 1, bare(listed(e["value"]))).otherwise(listed(e["value"])))
    data = F.array_join(F.transform(F.map_entries(F.coalesce("f", F.create_map().cast("map<string,array<string>>"))), pair), ",")
    whole = listed(record)
    return out.orderBy("id").select(F.concat(F.substring(whole, F.lit(1), F.length(whole) - 1), F.lit(',"data":{'), data, F.lit("}}")).alias("line"))


def export_jsonl(events: EventSet, df: DataFrame, path: str, zone: str = "UTC", sources: DataFrame | None = None, one_file: bool = True) -> int:
    return write_lines(json_rows(events, df, zone, sources), path, one_file=one_file)


def column_letters(n: int) -> str:
    """Spreadsheet letters of a column counted from 0."""
    out = ""
    n += 1
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


class TooManyRows(ValueError):
    """More rows than a sheet holds; CSV and JSON Lines hold any number."""


def xml_text(text: str) -> str:
    return escape(_BAD_XML.sub("�", text))


def _sheet(head: list[str], cells: Iterable[list[str]], numeric: set[int], counts: dict) -> Iterator[str]:
    last = column_letters(len(head) - 1)
    yield '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews><sheetData>'
    number = 0
    for row in [head, *()] if cells is None else _chain(head, cells):
        if number > MOST_ROWS:
            raise TooManyRows(f"a sheet holds {MOST_ROWS} rows")
        number += 1
        yield f'<row r="{number}">'
        for i, v in enumerate(row):
            if v == "":
                continue
            ref = f"{column_letters(i)}{number}"
            if number > 1 and i in numeric and re.fullmatch(r"-?\d{1,15}", v):
                yield f'<c r="{ref}"><v>{v}</v></c>'
                continue
            if len(v) > MOST_CHARS:
                counts["cut"] = counts.get("cut", 0) + 1
                v = v[: MOST_CHARS - len(NOTE)] + NOTE
            yield f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{xml_text(v)}</t></is></c>'
        yield "</row>"
    counts["rows"] = max(0, number - 1)
    yield f'</sheetData><autoFilter ref="A1:{last}{max(number, 1)}"/></worksheet>'


def _chain(head: list[str], cells: Iterable[list[str]]) -> Iterator[list[str]]:
    yield head
    yield from cells


def write_xlsx(path: str, head: list[str], cells: Iterable[list[str]], info: list[tuple[str, str]], numeric: set[int] = frozenset()) -> dict:
    """Two sheets, events and information, streamed into the archive. Returns rows and cut cells; raises on more rows than a sheet holds."""
    counts: dict = {}
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        with z.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as f:
            for part in _sheet(head, cells, set(numeric), counts):
                f.write(part.encode())
        notes = [(k, str(v)) for k, v in counts.items()]
        with z.open("xl/worksheets/sheet2.xml", "w") as f:
            for part in _sheet(["Name", "Value"], [list(x) for x in [*info, *notes]], set(), {}):
                f.write(part.encode())
        z.writestr("[Content_Types].xml", '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/><Override PartName="/xl/worksheets/sheet2.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", '<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Events" sheetId="1" r:id="rId1"/><sheet name="Info" sheetId="2" r:id="rId2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet2.xml"/></Relationships>')
    return counts


def export_xlsx(events: EventSet, df: DataFrame, path: str, fields: list[str] = [], zone: str = "UTC", sources: DataFrame | None = None, info: list[tuple[str, str]] = []) -> dict:
    if (n := df.count()) > MOST_ROWS:
        raise TooManyRows(f"{n} rows are more than the {MOST_ROWS} of a sheet: narrow the query, or export CSV or JSON Lines")
    cells = (r["cells"] for r in rows(events, df, fields, zone, sources).toLocalIterator(True))
    return write_xlsx(path, header(fields, zone), cells, info, {5, 6, 8})


# Columns of the detections report, and rule sets under the Detection Rule License.
DETECTION_COLUMNS = ("Level", "Rule", "Events", "Hosts", "First ({zone})", "Last ({zone})", "FirstUTC", "LastUTC", "Author", "RuleSet", "RulePath", "RuleID", "Status", "Tags", "References", "License", "DQL")
LICENSED, LICENSE = ("SigmaHQ", "Hayabusa"), "Detection Rule License (DRL) 1.1"


def detection_rows(run, zone: str = "UTC") -> DataFrame:
    """rule, and cells in the order of DETECTION_COLUMNS, for each rule with hits."""
    license = F.when(F.col("source").isin(*LICENSED), LICENSE).otherwise("")
    times = [f(F.col(c)) for f in (lambda t: local_text(t, zone), iso_text) for c in ("first_ft", "last_ft")]
    names = [F.col(c) for c in ("author", "source", "path", "rule_id", "status")]
    cells = [F.col("level"), F.col("title"), F.col("hits"), F.col("hosts"), *times, *names, F.array_join("tags", " "), F.array_join("references", " "), license, F.col("query")]
    return run.summary().where("hits > 0").select("rule", F.array(*[F.coalesce(c.cast("string"), F.lit("")) for c in cells]).alias("cells"))


def export_detections(run, path: str, excel: bool = False, zone: str = "UTC") -> int:
    """One row per rule with hits, with author and licence."""
    separator = ";" if excel else ","
    head = [c.format(zone=zone_label(zone)) for c in DETECTION_COLUMNS]
    lines = detection_rows(run, zone).orderBy("rule").select(F.array_join(F.transform("cells", lambda v: cell_text(v, separator, excel)), separator).alias("line"))
    return write_lines(lines, path, csv_line(head, excel), "\r\n")


# What the report says of each source file.
INFO_COLUMNS = ("File", "Size", "SHA-256", "Version", "Dirty", "Chunks (header / physical)", "Empty", "Beyond header: new / stale", "CRC header / data", "Tail, bytes", "Events", "Carved", "Copies merged", "First", "Last", "Record flags", "Path")


def info_rows(sources: DataFrame, flags: DataFrame, zone: str = "UTC") -> DataFrame:
    """source_id, and cells in the order of INFO_COLUMNS; flags: (source, flag, count)."""
    named = flags.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("flag", "count"))), lambda x: F.concat_ws(" ", x["flag"], x["count"].cast("string"))), ", ").alias("_flags"))
    text = lambda c: F.coalesce(c.cast("string"), F.lit("—"))
    two = lambda a, b: F.concat(text(F.col(a)), F.lit(" / "), text(F.col(b)))
    cells = [
        F.col("source"), F.col("size"), F.nullif(F.coalesce("sha256", F.lit("")), F.lit("")), F.col("version"), F.when(F.col("header").bitwiseAND(2) != 0, "yes").otherwise("no"), two("chunks", "physical_chunks"), F.col("empty_chunks"), two("beyond_new", "beyond_stale"),
        two("header_crc_chunks", "data_crc_chunks"), F.col("tail"), F.col("records"), F.col("carved"), F.col("copies"), local_text(F.col("first_ft"), zone), local_text(F.col("last_ft"), zone), F.nullif("_flags", F.lit("")), F.col("path"),
    ]
    return sources.join(named, "source", "left").select("source_id", F.array(*map(text, cells)).alias("cells"))


def export_info(sources: DataFrame, flags: DataFrame, path: str, zone: str = "UTC") -> int:
    """A table of the source files, separated by tabs."""
    own = info_rows(sources, flags, zone).orderBy("source_id")
    lines = own.select(F.array_join(F.transform("cells", lambda v: F.regexp_replace(v, r"[\t\r\n]+", " ")), "\t").alias("line"))
    return write_lines(lines, path, "\t".join(INFO_COLUMNS))
