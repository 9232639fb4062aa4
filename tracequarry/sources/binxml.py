"""Binary XML of event logs: templates, values and documents, after the public format descriptions.

A document is a tree of Element nodes. Templates are trees with Sub nodes, which an instance fills with typed
values. Offsets are within the 64 KiB chunk.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

from ..functions.timeparse import iso

MOST_DEPTH, MOST_NESTED = 64, 12
EOF, OPEN, CLOSE_START, CLOSE_EMPTY, END, VALUE, ATTRIBUTE, CDATA, CHAR_REF, ENTITY_REF, PI_TARGET, PI_DATA, TEMPLATE, SUB, OPTIONAL_SUB, FRAGMENT = range(16)
NULL_T, STRING_T, ANSI_T, BINXML_T, ARRAY_FLAG = 0, 1, 2, 0x21, 0x80
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}


class BadXml(ValueError):
    pass


@dataclass
class Sub:
    index: int
    kind: int
    optional: bool


@dataclass
class Instance:
    """A template used with values."""

    template: Template | None
    values: list[Value]
    known: str = "own"  # own, foreign, missing


@dataclass
class Element:
    name: str
    attributes: list[tuple[str, list]] = field(default_factory=list)
    children: list = field(default_factory=list)  # str, Sub, Element, Instance


@dataclass
class Template:
    guid: str
    nodes: list
    kinds: tuple[int, ...] = ()


@dataclass
class Value:
    kind: int
    data: bytes
    at: int  # where data starts in the chunk


def guid_text(b: bytes) -> str:
    a, c, d = struct.unpack_from("<IHH", b)
    return f"{{{a:08X}-{c:04X}-{d:04X}-{b[8:10].hex().upper()}-{b[10:16].hex().upper()}}}"


def sid_text(b: bytes) -> str:
    revision, n = b[0], b[1]
    if len(b) < 8 + 4 * n:
        return b.hex().upper()
    return "-".join(["S", str(revision), str(int.from_bytes(b[2:8], "big")), *map(str, struct.unpack_from(f"<{n}I", b, 8))])


_NUMBERS = {3: "b", 4: "B", 5: "h", 6: "H", 7: "i", 8: "I", 9: "q", 10: "Q", 11: "f", 12: "d"}


def utf16(b: bytes) -> tuple[str, bool]:
    """Text, and whether all of it was valid."""
    try:
        return b.decode("utf-16-le"), True
    except UnicodeDecodeError:
        return b[: len(b) // 2 * 2].decode("utf-16-le", "replace"), False


def render(kind: int, b: bytes) -> str:
    """Text of one value. A size that does not fit its type is shown as hex."""
    if kind == NULL_T:
        return ""
    if kind == STRING_T:
        return utf16(b)[0].rstrip("\0")
    if kind == ANSI_T:
        return b.decode("latin-1").rstrip("\0")
    if kind in _NUMBERS and len(b) == struct.calcsize(_NUMBERS[kind]):
        n = struct.unpack("<" + _NUMBERS[kind], b)[0]
        return repr(n) if kind in (11, 12) else str(n)
    if kind == 13 and len(b) in (1, 4):
        return "true" if any(b) else "false"
    if kind == 15 and len(b) == 16:
        return guid_text(b)
    if kind in (16, 20, 21) and len(b) in (4, 8):
        return f"0x{int.from_bytes(b, 'little'):x}"
    if kind == 17 and len(b) == 8:
        return iso(struct.unpack("<q", b)[0])
    if kind == 18 and len(b) == 16:
        y, mo, _, d, h, mi, s, ms = struct.unpack("<8H", b)
        return f"{y:04d}-{mo:02d}-{d:02d}T{h:02d}:{mi:02d}:{s:02d}.{ms:03d}Z"
    if kind == 19 and len(b) >= 8:
        return sid_text(b)
    return b.hex().upper()


_WIDTHS = {3: 1, 4: 1, 5: 2, 6: 2, 7: 4, 8: 4, 9: 8, 10: 8, 11: 4, 12: 8, 13: 4, 15: 16, 17: 8, 18: 16, 20: 4, 21: 8}
_WIDTHS[16] = 8


def items(kind: int, b: bytes) -> list[str]:
    """Texts of an array value."""
    base = kind & 0x7F
    if base in (STRING_T, ANSI_T):
        if not b:
            return []
        text = utf16(b)[0] if base == STRING_T else b.decode("latin-1")
        return (text[:-1] if text.endswith("\0") else text).split("\0")
    if base == 19:
        out, i = [], 0
        while i + 8 <= len(b):
            n = 8 + 4 * b[i + 1]
            out.append(sid_text(b[i : i + n]))
            i += n
        return out
    if not (width := _WIDTHS.get(base)) or len(b) % width:
        return [b.hex().upper()] if b else []
    return [render(base, b[i : i + width]) for i in range(0, len(b), width)]


class Parser:
    """Reads nodes of one chunk. library: templates by id that other chunks define."""

    def __init__(self, chunk: bytes, library: dict[int, Template] | None = None) -> None:
        self.chunk, self.library = chunk, library or {}
        self.names: dict[int, str] = {}
        self.templates: dict[int, tuple[int, Template]] = {}  # by offset: (id, template)
        self.invalid_text = False

    def unpack(self, form: str, at: int) -> tuple:
        try:
            return struct.unpack_from("<" + form, self.chunk, at)
        except struct.error:
            raise BadXml(f"data ends at {at}") from None

    def name(self, at: int) -> tuple[str, int]:
        """The name that an offset at this place refers to, and the place after it (an inline name is skipped)."""
        (where,) = self.unpack("I", at)
        if where not in self.names:
            (n,) = self.unpack("H", where + 6)
            raw = self.chunk[where + 8 : where + 8 + 2 * n]
            if len(raw) < 2 * n:
                raise BadXml("a name is cut short")
            self.names[where] = utf16(raw)[0]
        end = at + 4
        if where == end:
            (n,) = self.unpack("H", where + 6)
            end = where + 8 + 2 * n + 2
        return self.names[where], end

    def nodes(self, at: int, end: int, dependent: bool = True, depth: int = 0) -> tuple[list, int]:
        """Nodes up to an end tag, an end of file or the end."""
        if depth > MOST_DEPTH:
            raise BadXml("elements nest too deep")
        out: list = []
        while at < end:
            token = self.chunk[at]
            kind = token & 0xBF
            if kind == EOF:
                return out, at + 1
            if kind == END:
                return out, at + 1
            if kind == FRAGMENT:
                at += 4
            elif kind == OPEN:
                element, at = self.element(at, end, dependent, depth)
                out.append(element)
            elif kind == TEMPLATE:
                instance, at = self.instance(at, end)
                out.append(instance)
            elif kind == VALUE:
                text, at = self.text(at)
                out.append(text)
            elif kind == CDATA:
                (n,) = self.unpack("H", at + 1)
                out.append(utf16(self.chunk[at + 3 : at + 3 + 2 * n])[0])
                at += 3 + 2 * n
            elif kind == CHAR_REF:
                out.append(chr(self.unpack("H", at + 1)[0]))
                at += 3
            elif kind == ENTITY_REF:
                name, at = self.name(at + 1)
                out.append(ENTITIES.get(name, f"&{name};"))
            elif kind == PI_TARGET:
                _, at = self.name(at + 1)
            elif kind == PI_DATA:
                at += 3 + 2 * self.unpack("H", at + 1)[0]
            elif kind in (SUB, OPTIONAL_SUB):
                index, value = self.unpack("HB", at + 1)
                out.append(Sub(index, value, kind == OPTIONAL_SUB))
                at += 4
            else:
                raise BadXml(f"unknown token {token:#x} at {at}")
        return out, at

    def text(self, at: int) -> tuple[str, int]:
        kind, n = self.unpack("BH", at + 1)
        if kind != STRING_T:
            raise BadXml(f"a literal of type {kind}")
        raw = self.chunk[at + 4 : at + 4 + 2 * n]
        text, fine = utf16(raw)
        self.invalid_text |= not fine
        return text, at + 4 + 2 * n

    def element(self, at: int, end: int, dependent: bool, depth: int) -> tuple[Element, int]:
        has_attributes = self.chunk[at] & 0x40
        at += 3 if dependent else 1
        at += 4  # size
        name, at = self.name(at)
        out = Element(name)
        if has_attributes:
            (size,) = self.unpack("I", at)
            at += 4
            stop = at + size
            while at < min(stop, end) and self.chunk[at] & 0xBF == ATTRIBUTE:
                key, at = self.name(at + 1)
                value: list = []
                while at < end and (kind := self.chunk[at] & 0xBF) in (VALUE, SUB, OPTIONAL_SUB, CHAR_REF, ENTITY_REF):
                    if kind == VALUE:
                        part, at = self.text(at)
                    elif kind in (SUB, OPTIONAL_SUB):
                        index, value_kind = self.unpack("HB", at + 1)
                        part, at = Sub(index, value_kind, kind == OPTIONAL_SUB), at + 4
                    elif kind == CHAR_REF:
                        part, at = chr(self.unpack("H", at + 1)[0]), at + 3
                    else:
                        entity, at = self.name(at + 1)
                        part = ENTITIES.get(entity, f"&{entity};")
                    value.append(part)
                out.attributes.append((key, value))
        if at >= end:
            raise BadXml("an element is cut short")
        token = self.chunk[at] & 0xBF
        if token == CLOSE_EMPTY:
            return out, at + 1
        if token != CLOSE_START:
            raise BadXml(f"token {token} where a start tag ends")
        out.children, at = self.nodes(at + 1, end, dependent, depth + 1)
        return out, at

    def template_at(self, where: int) -> tuple[int, Template, int]:
        """(id, template, end) of a definition."""
        if where in self.templates:
            number, template = self.templates[where]
            return number, template, where + 24 + self.unpack("I", where + 20)[0]
        guid = self.chunk[where + 4 : where + 20]
        (size,) = self.unpack("I", where + 20)
        end = where + 24 + size
        if len(guid) < 16 or end > len(self.chunk) or not size:
            raise BadXml("a template definition is cut short")
        try:
            nodes, _ = self.nodes(where + 24, end)
        except BadXml:
            nodes, _ = self.nodes(where + 24, end, dependent=False)
        number = struct.unpack("<I", guid[:4])[0]
        template = Template(guid_text(guid), nodes, kinds_of(nodes))
        self.templates[where] = (number, template)
        return number, template, end

    def instance(self, at: int, end: int) -> tuple[Instance, int]:
        number, where = self.unpack("II", at + 2)
        at += 10
        known, template = "own", None
        try:
            found, template, stop = self.template_at(where)
            if where == at:
                at = stop
            elif found != number:
                template = None
        except BadXml:
            if where == at:
                raise
        if template is None:
            template, known = self.library.get(number), "foreign"
            if template is None:
                known = "missing"
        (count,) = self.unpack("I", at)
        if count > 4096:
            raise BadXml("too many values")
        at += 4
        heads = [self.unpack("HB", at + 4 * i) for i in range(count)]
        at += 4 * count
        values = []
        for size, kind in heads:
            if at + size > end:
                raise BadXml("a value is cut short")
            values.append(Value(kind, self.chunk[at : at + size], at))
            at += size
        return Instance(template, values, known), at


def kinds_of(nodes: list) -> tuple[int, ...]:
    """Declared types of a template's substitutions by index."""
    found: dict[int, int] = {}

    def walk(xs: list) -> None:
        for x in xs:
            if isinstance(x, Sub):
                found.setdefault(x.index, x.kind)
            elif isinstance(x, Element):
                for _, v in x.attributes:
                    walk(v)
                walk(x.children)

    walk(nodes)
    return tuple(found.get(i, 0) for i in range(max(found, default=-1) + 1))


@dataclass
class Plain:
    """An element with all substitutions made; text is all there is between its tags."""

    name: str
    attributes: list[tuple[str, str]] = field(default_factory=list)
    children: list = field(default_factory=list)
    text: str = ""
    kind: int = STRING_T


class Walker:
    """Resolves templates to plain elements and notes what was unusual: foreign, missing, invalid."""

    def __init__(self, parser: Parser) -> None:
        self.parser, self.foreign, self.missing = parser, False, False

    def document(self, nodes: list) -> list[Plain]:
        return [p for n in nodes for p in self.node(n, None, 0) if isinstance(p, Plain)]

    def node(self, n, values: list[Value] | None, nested: int) -> list:
        if isinstance(n, str):
            return [n]
        if isinstance(n, Instance):
            if n.template is None:
                self.missing = True
                return [Plain("Event", [], [Plain("EventData", [], [Plain("Data", [("Name", f"Value[{i}]")], [], self.one(v)) for i, v in enumerate(n.values)])])]
            self.foreign |= n.known == "foreign"
            return [p for x in n.template.nodes for p in self.node(x, n.values, nested)]
        if isinstance(n, Sub):
            v = self.value(n, values)
            if v is None:
                return []
            if v.kind & 0x7F == BINXML_T:
                if nested >= MOST_NESTED:
                    raise BadXml("fragments nest too deep")
                inner, _ = self.parser.nodes(v.at, v.at + len(v.data))
                return [p for x in inner for p in self.node(x, values, nested + 1)]
            return [self.one(v)]
        return self.element(n, values, nested)

    def value(self, s: Sub, values: list[Value] | None) -> Value | None:
        """The value of a substitution, or none for null."""
        if values is None or s.index >= len(values):
            return None
        v = values[s.index]
        return None if v.kind == NULL_T or not v.data and s.optional else v

    def one(self, v: Value) -> str:
        if v.kind & ARRAY_FLAG:
            return ", ".join(items(v.kind, v.data))
        if v.kind == STRING_T:
            text, fine = utf16(v.data)
            self.parser.invalid_text |= not fine
            return text.rstrip("\0")
        return render(v.kind, v.data)

    def element(self, e: Element, values: list[Value] | None, nested: int) -> list:
        attributes = []
        for name, parts in e.attributes:
            if len(parts) == 1 and isinstance(parts[0], Sub) and self.value(parts[0], values) is None:
                continue
            attributes.append((name, "".join(p if isinstance(p, str) else "" if (v := self.value(p, values)) is None else self.one(v) for p in parts)))
        if len(e.children) == 1 and isinstance(e.children[0], Sub):
            v = self.value(e.children[0], values)
            if v is not None and v.kind & ARRAY_FLAG:
                return [Plain(e.name, list(attributes), [], x, v.kind & 0x7F) for x in items(v.kind, v.data)]
            if v is not None and v.kind != BINXML_T:
                return [Plain(e.name, attributes, [], self.one(v), v.kind)]
        parts = [p for c in e.children for p in self.node(c, values, nested)]
        return [Plain(e.name, attributes, [p for p in parts if isinstance(p, Plain)], "".join(p for p in parts if isinstance(p, str)))]


def escape(text: str, attribute: bool = False) -> str:
    out = text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    return out.replace('"', "&quot;") if attribute else out


def to_xml(p: Plain, indent: int = 0) -> str:
    """Indented XML of an element."""
    pad = "  " * indent
    head = p.name + "".join(f' {k}="{escape(v, True)}"' for k, v in p.attributes)
    if p.children:
        return f"{pad}<{head}>\n" + "\n".join(to_xml(c, indent + 1) for c in p.children) + f"\n{pad}</{p.name}>"
    return f"{pad}<{head}>{escape(p.text)}</{p.name}>" if p.text else f"{pad}<{head}/>"
