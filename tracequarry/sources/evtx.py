"""Event log files: headers, 64 KiB chunks, records, slack space, and events.

Every physical chunk is read, not only those the header counts. Damage is flagged, never fatal.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

from ..functions.timeparse import parse_time
from ..model import BIT
from . import binxml

CHUNK, HEADER = 65_536, 4096
RECORD_MAGIC = b"\x2a\x2a\x00\x00"
FIRST_RECORD = 512
SKEW = 60 * 10_000_000


@dataclass(frozen=True)
class FileHeader:
    chunks: int
    first_chunk: int
    last_chunk: int
    next_record: int
    header_size: int
    major: int
    minor: int
    dirty: bool
    full: bool
    crc_ok: bool


#: What a log file begins with.
MAGIC = b"ElfFile\0"


class NotALog(ValueError):
    pass


def file_header(data: bytes) -> FileHeader:
    """The header of a file; other files and the old .evt format are refused."""
    if data[4:8] == b"LfLe":
        raise NotALog("an old .evt log")
    if len(data) < 128 or data[:8] != MAGIC:
        raise NotALog("not an event log")
    first, last, record = struct.unpack_from("<QQQ", data, 8)
    _, minor, major, block, chunks = struct.unpack_from("<IHHHH", data, 32)
    flags, crc = struct.unpack_from("<II", data, 120)
    return FileHeader(chunks, first, last, record, block or HEADER, major, minor, bool(flags & 1), bool(flags & 2), zlib.crc32(data[:120]) == crc)


def discover(paths: list[str]) -> list[str]:
    """Files as given; folders recursively for *.evtx and for files that start as logs do; hidden ones and linked folders are left out."""
    out = []
    for path in paths:
        if not os.path.isdir(path):
            out.append(path)
            continue
        for at, dirs, names in os.walk(path):
            dirs[:] = [d for d in dirs if not d.startswith(".")]
            for name in names:
                file = os.path.join(at, name)
                if name.startswith(".") or not os.path.isfile(file):
                    continue
                if name.lower().endswith(".evtx") or "." not in name and _starts_as_log(file):
                    out.append(file)
    return sorted(dict.fromkeys(out))


def _starts_as_log(file: str) -> bool:
    try:
        with open(file, "rb") as f:
            return f.read(8) == MAGIC
    except OSError:
        return False


@dataclass
class Record:
    at: int
    size: int
    number: int
    written: int
    flags: int


@dataclass
class Chunk:
    """One chunk and what its header says."""

    data: bytes
    flags: int = 0
    valid: bool = True
    free: int = FIRST_RECORD
    ids: tuple[int, int] = (0, 0)
    empty: bool = False
    parser: binxml.Parser = field(default=None, repr=False)

    @staticmethod
    def read(data: bytes, library: dict[int, binxml.Template] | None = None) -> Chunk:
        out = Chunk(data, parser=binxml.Parser(data, library))
        out.empty = not any(data[:8])
        out.valid = data[:8] == b"ElfChnk\0" and len(data) == CHUNK
        if not out.valid:
            return out
        first, last = struct.unpack_from("<QQ", data, 24)
        out.ids = (first, last)
        _, _, free, data_crc = struct.unpack_from("<IIII", data, 40)
        (crc,) = struct.unpack_from("<I", data, 124)
        out.free = free if FIRST_RECORD <= free <= CHUNK else CHUNK
        if zlib.crc32(data[:120] + data[128:512]) != crc:
            out.flags |= BIT["headerCrcMismatch"]
        if zlib.crc32(data[FIRST_RECORD : out.free]) != data_crc:
            out.flags |= BIT["crcMismatch"]
        return out

    def record(self, at: int, strict: bool, end: int) -> Record | None:
        """The record that starts here; strict ones have a matching copy of their size."""
        if at + 28 > end or self.data[at : at + 4] != RECORD_MAGIC:
            return None
        size, number, written = struct.unpack_from("<IQQ", self.data, at + 4)
        if size < 28 or size > CHUNK or at + size > len(self.data) or at + size > end and strict:
            return None
        (copy,) = struct.unpack_from("<I", self.data, at + size - 4)
        if copy != size:
            return None if strict else Record(at, size, number, written, BIT["sizeMismatch"])
        return Record(at, size, number, written, 0)

    def records(self) -> Iterator[Record]:
        """Live records; after damage reading goes on at the next sound record, and the rest is flagged."""
        at, after = FIRST_RECORD, 0
        end = self.free if self.valid else FIRST_RECORD
        while at < end:
            r = self.record(at, bool(after), end)
            if r is None:
                after = BIT["afterGap"]
                at = (at + 8) & ~7
                while at < end and self.record(at, True, end) is None:
                    at += 8
                continue
            r.flags |= after | self.flags
            yield r
            at += r.size

    def carve(self) -> Iterator[Record]:
        """Sound records in slack space, written between 1990 and 2100."""
        at = (self.free + 7) & ~7 if self.valid else FIRST_RECORD
        while at < len(self.data):
            r = self.record(at, True, len(self.data))
            if r is not None and _EARLIEST <= r.written <= _LATEST:
                r.flags |= BIT["carved"] | self.flags
                yield r
                at = (at + r.size + 7) & ~7
            else:
                at += 8

    def load_templates(self) -> dict[int, binxml.Template]:
        """Templates that the chunk's pointer table lists, and all chained after them."""
        if self.valid:
            for k in range(32):
                (where,) = struct.unpack_from("<I", self.data, 384 + 4 * k)
                seen = set()
                while FIRST_RECORD <= where < CHUNK - 24 and where not in seen:
                    seen.add(where)
                    try:
                        self.parser.template_at(where)
                    except (binxml.BadXml, IndexError, RecursionError):
                        break
                    (where,) = struct.unpack_from("<I", self.data, where)
        return dict(self.parser.templates.values())


_EARLIEST, _LATEST = parse_time("1990-01-01Z"), parse_time("2100-01-01Z")

SYSTEM_COLUMNS = ("record_id", "event_id", "qualifiers", "version", "level", "task", "opcode", "keywords", "provider", "channel", "computer", "user_sid", "pid", "tid")


def _int(text: str | None, bits: int = 64) -> int | None:
    """A number as a signed bit pattern."""
    try:
        n = int(text, 0)
    except (TypeError, ValueError):
        return None
    return n - (1 << bits) if n >= 1 << bits - 1 else n


def event(chunk: Chunk, r: Record) -> dict:
    """An event of a record; what could be read before an error is kept, with a flag."""
    walker, flags, plain = binxml.Walker(chunk.parser), r.flags, []
    chunk.parser.invalid_text = False
    try:
        nodes, _ = chunk.parser.nodes(r.at + 24, r.at + r.size - 4)
        plain = walker.document(nodes)
        if not plain:
            flags |= BIT["parseError"]
    except (binxml.BadXml, IndexError, struct.error, RecursionError, UnicodeError):
        flags |= BIT["parseError"]
    flags |= walker.foreign * BIT["foreignTemplate"] | walker.missing * BIT["missingTemplate"] | chunk.parser.invalid_text * BIT["invalidText"]
    out = {"record_id": _int(str(r.number)), "written_ft": r.written, "fields": [], "xml": None}
    if plain:
        out |= extract(plain[0])
        if flags & (BIT["foreignTemplate"] | BIT["missingTemplate"]):
            out["xml"] = binxml.to_xml(plain[0])
    created = out.pop("created", None)
    out["ts_ft"] = r.written if created is None else created
    if created is not None and abs(created - r.written) > SKEW:
        flags |= BIT["timeSkew"]
    return out | {"flags": flags, "off": r.at}


def xml(chunk: Chunk, r: Record) -> str:
    try:
        nodes, _ = chunk.parser.nodes(r.at + 24, r.at + r.size - 4)
        return "\n".join(binxml.to_xml(p) for p in binxml.Walker(chunk.parser).document(nodes))
    except (binxml.BadXml, IndexError, struct.error) as e:
        return f"<!-- the record is damaged: {e} -->"


def extract(root: binxml.Plain) -> dict:
    out: dict = {"fields": []}
    for section in root.children:
        if section.name == "System":
            out |= system(section)
        elif section.name == "EventData":
            for d in section.children:
                name = next((v for k, v in d.attributes if k == "Name"), None)
                if d.name != "Data" or d.children:
                    flatten(d, d.name, out["fields"])
                else:
                    out["fields"].append((name or "Data", d.text, d.kind & 0x7F))
        elif section.name == "UserData":
            for top in section.children:
                for k, v in top.attributes:
                    if not k.startswith("xmlns"):
                        out["fields"].append((k, v, 1))
                for d in top.children:
                    flatten(d, d.name, out["fields"])
        else:
            flatten(section, section.name, out["fields"])
    return out


def flatten(e: binxml.Plain, path: str, out: list) -> None:
    for k, v in e.attributes:
        if not k.startswith("xmlns"):
            out.append((f"{path}.{k}", v, 1))
    if e.children:
        for c in e.children:
            flatten(c, f"{path}.{c.name}", out)
    else:
        out.append((path, e.text, e.kind & 0x7F))


def system(section: binxml.Plain) -> dict:
    out: dict = {}
    numbers = {"EventID": "event_id", "Version": "version", "Level": "level", "Task": "task", "Opcode": "opcode", "Keywords": "keywords", "EventRecordID": "record_id"}
    for e in section.children:
        own = dict(e.attributes)
        if e.name in numbers and (n := _int(e.text or None)) is not None:
            out[numbers[e.name]] = n
        if e.name == "EventID":
            out["qualifiers"] = _int(own.get("Qualifiers"))
        elif e.name == "Provider":
            out["provider"] = own.get("Name")
        elif e.name == "TimeCreated":
            out["created"] = _system_time(own.get("SystemTime", ""))
        elif e.name == "Execution":
            out["pid"], out["tid"] = _int(own.get("ProcessID")), _int(own.get("ThreadID"))
        elif e.name == "Channel":
            out["channel"] = e.text
        elif e.name == "Computer":
            out["computer"] = e.text
        elif e.name == "Security":
            out["user_sid"] = own.get("UserID") or None
    return out


def _system_time(text: str) -> int | None:
    return parse_time(text)


def read_chunk(data: bytes, index: int, carve: bool = True, library: dict[int, binxml.Template] | None = None) -> tuple[list[dict], dict]:
    """All events of a chunk, and a summary of it."""
    chunk = Chunk.read(data, library)
    chunk.load_templates()
    live = [event(chunk, r) for r in chunk.records()]
    # records in slack may need templates of any live record, which are loaded by now
    slack = [event(chunk, r) for r in chunk.carve()] if carve and not chunk.empty else []
    summary = {"chunk": index, "valid": chunk.valid, "empty": chunk.empty, "flags": chunk.flags, "last_id": chunk.ids[1] if chunk.valid else None, "live": len(live), "carved": len(slack)}
    return [e | {"chunk": index} for e in live + slack], summary


def raw_bytes(data: bytes, r: Record) -> bytes:
    return data[r.at : r.at + r.size]


def hex_dump(data: bytes, width: int = 16) -> str:
    lines = []
    for i in range(0, len(data), width):
        part = data[i : i + width]
        text = "".join(chr(b) if 32 <= b < 127 else "." for b in part)
        lines.append(f"{i:08x}  {part.hex(' '):<{3 * width - 1}}  {text}")
    return "\n".join(lines)


def record_again(data: bytes, off: int, record_id: int | None) -> tuple[str, bytes | None]:
    """A record of a chunk read again: loaded with its bytes, unreadable, or mismatch where it has another number."""
    r = Chunk.read(data).record(off, False, len(data))
    if r is None:
        return "unreadable", None
    if record_id is not None and _int(str(r.number)) != record_id:
        return "mismatch", None
    return "loaded", raw_bytes(data, r)
