"""Makes small event log files, byte by byte, for tests."""

from __future__ import annotations

import struct
import zlib

CHUNK = 65_536


def u16(text: str) -> bytes:
    return text.encode("utf-16-le")


class ChunkMaker:
    def __init__(self, first_id: int = 1) -> None:
        self.body = bytearray(512)
        self.names: dict[str, int] = {}
        self.templates: dict[int, int] = {}
        self.first, self.next = first_id, first_id

    def name(self, text: str, out: bytearray, base: int) -> None:
        """A name reference; the first use carries the name itself."""
        here = base + len(out)
        if text in self.names:
            out += struct.pack("<I", self.names[text])
            return
        self.names[text] = here + 4
        out += struct.pack("<I", here + 4) + struct.pack("<IHH", 0, 0, len(text)) + u16(text) + b"\0\0"

    def element(self, spec: tuple, out: bytearray, base: int) -> None:
        """spec: (name, {attribute: text or (index, type)}, [children: text, (index, type, optional) or spec])."""
        name, attributes, children = spec
        out += bytes([0x41 if attributes else 0x01]) + struct.pack("<HI", 0xFFFF, 0)
        self.name(name, out, base)
        if attributes:
            at = len(out)
            out += b"\0\0\0\0"
            for k, v in attributes.items():
                out += b"\x06"
                self.name(k, out, base)
                self.content(v, out)
            struct.pack_into("<I", out, at, len(out) - at - 4)
        if not children:
            out += b"\x03"
            return
        out += b"\x02"
        for c in children:
            if isinstance(c, tuple) and isinstance(c[0], str):
                self.element(c, out, base)
            else:
                self.content(c, out)
        out += b"\x04"

    @staticmethod
    def content(v, out: bytearray) -> None:
        if isinstance(v, str):
            out += b"\x05\x01" + struct.pack("<H", len(v)) + u16(v)
        else:
            out += bytes([0x0E if len(v) < 3 or v[2] else 0x0D]) + struct.pack("<HB", v[0], v[1])

    def instance(self, number: int, spec: tuple | None, values: list[tuple[int, bytes]], base: int, offset: int | None = None) -> bytes:
        """A template instance; a template's first use carries its definition."""
        out = bytearray(b"\x0f\x01\x01\x00")
        out += b"\x0c\x01" + struct.pack("<I", number)
        here = base + len(out) + 4
        if number in self.templates or offset is not None:
            out += struct.pack("<I", self.templates.get(number, offset))
        else:
            self.templates[number] = here
            out += struct.pack("<I", here) + struct.pack("<I", 0) + struct.pack("<I", number) + b"\x11" * 12
            at = len(out)
            out += b"\0\0\0\0\x0f\x01\x01\x00"
            self.element(spec, out, base)
            out += b"\0"
            struct.pack_into("<I", out, at, len(out) - at - 4)
        out += struct.pack("<I", len(values))
        for kind, data in values:
            out += struct.pack("<HBB", len(data), kind, 0)
        for _, data in values:
            out += data
        return bytes(out)

    def add(self, number: int, spec: tuple | None, values: list[tuple[int, bytes]], written: int, record_id: int | None = None, copy: int | None = None, offset: int | None = None) -> int:
        """Append a record; returns its offset."""
        at = len(self.body)
        xml = self.instance(number, spec, values, at + 24, offset)
        size = (28 + len(xml) + 7) & ~7
        record_id = self.next if record_id is None else record_id
        self.next = record_id + 1
        self.body += b"\x2a\x2a\0\0" + struct.pack("<IQQ", size, record_id, written) + xml.ljust(size - 28, b"\0") + struct.pack("<I", size if copy is None else copy)
        return at

    def done(self, free: int | None = None, bad_header: bool = False, bad_data: bool = False) -> bytes:
        free = len(self.body) if free is None else free
        data = bytearray(self.body.ljust(CHUNK, b"\0"))
        struct.pack_into("<8sQQQQIIII", data, 0, b"ElfChnk\0", 1, max(1, self.next - self.first), self.first, self.next - 1, 128, 0, free, zlib.crc32(data[512:free]) ^ bad_data)
        for k, where in enumerate(self.templates.values()):
            struct.pack_into("<I", data, 384 + 4 * (k % 32), where)
        struct.pack_into("<I", data, 124, zlib.crc32(data[:120] + data[128:512]) ^ bad_header)
        return bytes(data)


def log(chunks: list[bytes], counted: int | None = None, tail: bytes = b"") -> bytes:
    n = len(chunks) if counted is None else counted
    head = bytearray(4096)
    struct.pack_into("<8sQQQIHHHH", head, 0, b"ElfFile\0", 0, max(0, n - 1), 1, 128, 1, 3, 4096, n)
    struct.pack_into("<II", head, 120, 0, zlib.crc32(head[:120]))
    return bytes(head) + b"".join(chunks) + tail


EVENT = ("Event", {"xmlns": "http://schemas.microsoft.com/win/2004/08/events/event"}, [
    ("System", {}, [
        ("Provider", {"Name": (0, 1)}, []), ("EventID", {"Qualifiers": (1, 6)}, [(2, 6)]), ("Version", {}, [(3, 4)]), ("Level", {}, [(4, 4)]), ("Task", {}, [(5, 6)]), ("Opcode", {}, [(6, 4)]), ("Keywords", {}, [(7, 0x15)]),
        ("TimeCreated", {"SystemTime": (8, 0x11)}, []), ("EventRecordID", {}, [(9, 10)]), ("Execution", {"ProcessID": (10, 8), "ThreadID": (11, 8)}, []), ("Channel", {}, [(12, 1)]), ("Computer", {}, [(13, 1)]), ("Security", {"UserID": (14, 0x13)}, []),
    ]),
    ("EventData", {}, [("Data", {"Name": "TargetUserName"}, [(15, 1)]), ("Data", {"Name": "LogonType"}, [(16, 8)]), ("Data", {}, [(17, 0x81)]), ("Data", {"Name": "Blob"}, [(18, 0x0E)])]),
])
SID = bytes([1, 1, 0, 0, 0, 0, 0, 5]) + struct.pack("<I", 18)


def values(event_id: int, created: int, record_id: int, user: str = "alice", computer: str = "HOST1.example", channel: str = "Security", words: tuple[str, ...] = ("one", "two"), sid: bytes = SID) -> list[tuple[int, bytes]]:
    return [
        (1, u16("Test-Provider")), (0, b""), (6, struct.pack("<H", event_id)), (4, b"\1"), (4, b"\4"), (6, struct.pack("<H", 7)), (4, b"\0"), (0x15, struct.pack("<Q", 0x8020000000000000)), (0x11, struct.pack("<q", created)), (10, struct.pack("<Q", record_id)),
        (8, struct.pack("<I", 4)), (8, struct.pack("<I", 5)), (1, u16(channel)), (1, u16(computer)), (0x13, sid) if sid else (0, b""), (1, u16(user)), (8, struct.pack("<I", 3)), (0x81, b"".join(u16(w) + b"\0\0" for w in words)), (0x0E, b"\xab\x01"),
    ]
