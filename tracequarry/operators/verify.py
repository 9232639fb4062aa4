"""Check a detection run with a second evaluator that reads rules directly, event by event.

It shares no code with the compiler: values are matched in Python, straight from the rule's text. Differences in
either direction are rows; an event whose regular expression runs out of time is inconclusive.
"""

from __future__ import annotations

import base64
import ipaddress
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import EventSet
from ..plans.sigma import INTEGRITY, RENAMES_4688, SERVICES, SYSMON, SYSMON_IDS, SYSTEM_FIELDS
from ..sources.rules import Null, Rule, RuleSet
from .detections import Run

#: Seconds for one regular expression on one value.
BUDGET = 2.0


class Inconclusive(Exception):
    pass


class Skipped(Exception):
    """The rule is beyond this evaluator."""


def _mask(value: str) -> str:
    """A pattern for a value with wildcards, from its source text."""
    out, i = "", 0
    while i < len(value):
        two = value[i : i + 2]
        if two in ("\\*", "\\?", "\\\\"):
            out, i = out + re.escape(two[1]), i + 2
        else:
            out, i = out + {"*": ".*", "?": "."}.get(value[i], re.escape(value[i])), i + 1
    return out


def _number(text: str) -> int | None:
    try:
        n = int(text, 16) if text[:2].lower() == "0x" else int(text) if re.fullmatch("-?[0-9]+", text) else None
    except ValueError:
        return None
    if n is None or len(text) > 20:
        return None
    return n - 2**64 if 2**63 <= n < 2**64 and text[:2].lower() == "0x" else n if -(2**63) <= n < 2**63 else None


def _one(mods: list[str], value: str, text: str) -> bool:
    if "re" in mods:
        try:
            flags = (regex.I if "i" in mods else 0) | (regex.M if "m" in mods else 0) | (regex.S if "s" in mods else 0)
            return regex.search(value, text, flags, timeout=BUDGET) is not None
        except TimeoutError:
            raise Inconclusive from None
    if "cidr" in mods:
        try:
            a, net = ipaddress.ip_address(text.strip().strip("[]").split("%")[0]), ipaddress.ip_network(value, strict=False)
        except ValueError:
            return False
        a = a.ipv4_mapped or a if a.version == 6 and net.version == 4 else a
        return a.version == net.version and a in net
    for name, test in (("gt", int.__gt__), ("gte", int.__ge__), ("lt", int.__lt__), ("lte", int.__le__)):
        if name in mods:
            n = _number(text)
            return n is not None and test(n, _number(value))
    values = [value]
    pattern = _mask
    if "base64" in mods or "base64offset" in mods:
        data = value.encode("utf-16-le" if {"wide", "utf16le"} & set(mods) else "utf-8")
        if "base64" in mods:
            values = [base64.b64encode(data).decode()]
        else:
            values = []
            for shift in range(3):
                code = base64.b64encode(b"\0" * shift + data).decode().rstrip("=")
                whole = (len(data) + shift) * 8 // 6
                values.append(code[-(-shift * 8 // 6) : whole])
        pattern = re.escape
    elif "windash" in mods:
        spots = [m.start() for m in re.finditer(r"\B[-/]\b", value)][:4]
        values = []
        for dashes in itertools.product("-/–—―", repeat=len(spots)):
            letters = list(value)
            for at, d in zip(spots, dashes, strict=True):
                letters[at] = d
            values.append("".join(letters))
        values.append(value)
    head, tail = ("contains" in mods or "endswith" in mods), ("contains" in mods or "startswith" in mods)
    flags = re.S | (0 if "cased" in mods else re.I)
    return any(re.fullmatch((".*" * head) + pattern(v) + (".*" * tail), text, flags) is not None for v in values)


def _item(spec: str, body, event: dict, renames: dict) -> bool:
    name, *mods = spec.split("|")
    values = body if isinstance(body, list) else [body]
    if not name:
        return (all if "all" in mods else any)(_keyword(v, event) for v in values)
    level = name == "IntegrityLevel" and bool(renames)
    name = renames.get(name, name)
    texts = event.get(SYSTEM_FIELDS.get(name, name).lower(), [])

    def test(v) -> bool:
        if isinstance(v, Null):
            return not texts
        if "exists" in mods:
            return bool(texts) == (v.lower() == "true")
        if level:
            v = INTEGRITY.get(v.lower(), v)
        if "fieldref" in mods:
            other = event.get(SYSTEM_FIELDS.get(v, v).lower(), [])
            if not texts or not other:
                return False
            x, y = (texts[0], other[0]) if "cased" in mods else (texts[0].lower(), other[0].lower())
            return y in x if "contains" in mods and y else x.startswith(y) if "startswith" in mods and y else x.endswith(y) if "endswith" in mods and y else x == y
        return any(_one(mods, v, t) for t in texts)

    return (all if "all" in mods else any)(test(v) for v in values)


def _keyword(text: str, event: dict) -> bool:
    literal = re.sub(r"\\([*?\\])", r"\1", text.strip("*"))
    return bool(literal) and any(literal.lower() in t.lower() for ts in event.values() for t in ts)


def _search(body, event: dict, renames: dict) -> bool:
    if isinstance(body, dict):
        return all(_item(k, v, event, renames) for k, v in body.items())
    if isinstance(body, list):
        return any(_search(x, event, renames) if isinstance(x, dict) else _keyword(x, event) for x in body)
    return _keyword(body, event)


def _condition(text: str, searches: dict[str, bool]) -> bool:
    """Evaluate a condition by writing it as a Python expression of constants."""
    words = re.findall(r"\(|\)|[^\s()]+", text)
    out, i = [], 0
    while i < len(words):
        w = words[i]
        if i + 2 < len(words) and words[i + 1].lower() == "of":
            shape = words[i + 2]
            names = [n for n in searches if not n.startswith("_")] if shape.lower() == "them" else [n for n in searches if re.fullmatch(shape.replace("*", ".*"), n)]
            out.append(str((all if w.lower() == "all" else any)(searches[n] for n in names)))
            i += 3
        else:
            out.append(w.lower() if w.lower() in ("and", "or", "not") or w in "()" else str(searches[w]))
            i += 1
    return _boolean(out)


def _boolean(words: list[str]) -> bool:
    def either(i: int) -> tuple[bool, int]:
        v, i = both(i)
        while i < len(words) and words[i] == "or":
            x, i = both(i + 1)
            v = v or x
        return v, i

    def both(i: int) -> tuple[bool, int]:
        v, i = unary(i)
        while i < len(words) and words[i] == "and":
            x, i = unary(i + 1)
            v = v and x
        return v, i

    def unary(i: int) -> tuple[bool, int]:
        if words[i] == "not":
            v, i = unary(i + 1)
            return not v, i
        if words[i] == "(":
            v, i = either(i + 1)
            return v, i + 1
        return words[i] == "True", i + 1

    return either(0)[0]


def _bases(rule: Rule, event: dict) -> Iterator[dict]:
    """Renames of each log source that the event belongs to."""
    channel, number = (event.get("@channel") or [""])[0].lower(), (event.get("@eventid") or [""])[0]
    category, service = rule.logsource.get("category", "").lower(), rule.logsource.get("service", "").lower()
    if service and not any(re.fullmatch(_mask(c), channel, re.I) for c in SERVICES[service]):
        return
    if not category:
        yield {}
        return
    if category not in SYSMON_IDS:
        raise Skipped(category)
    if channel == SYSMON.lower() and number in map(str, SYSMON_IDS[category]):
        yield {}
    if category == "process_creation" and channel == "security" and number == "4688":
        yield RENAMES_4688


def holds(rule: Rule, event: dict) -> bool:
    """event: lower-case key to values."""
    conditions = rule.detection["condition"]
    for renames in _bases(rule, event):
        searches = {k: _search(v, event, renames) for k, v in rule.detection.items() if k != "condition"}
        if any(_condition(c, searches) for c in (conditions if isinstance(conditions, list) else [conditions])):
            return True
    return False


def verify(events: EventSet, rules: RuleSet, run: Run) -> DataFrame:
    """Rows (rule, id, problem) where the run and this evaluator differ: missing, extra or inconclusive. No rows: they agree.

    Every event is read once against every evaluated rule.
    """
    states = {r["rule"]: r["state"] for r in run.rules.select("rule", "state").collect()}  # one row per rule
    wanted = [(n, r) for n, r in enumerate(rules.rules) if states.get(n) == "evaluated"]
    keys = sorted(events.keys)
    columns = [(F.transform(k.text, lambda v: v) if k.many else F.when(k.text.isNotNull(), F.array(k.text))).alias(f"k{i}") for i, k in enumerate(events.keys[n] for n in keys)]

    def look(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = []
            for row in batch.to_pylist():
                event = {n.lower(): row[f"k{i}"] for i, n in enumerate(keys) if row[f"k{i}"]}
                for number, rule in wanted:
                    try:
                        if holds(rule, event):
                            found.append((number, row["id"], None))
                    except Inconclusive:
                        found.append((number, row["id"], "inconclusive"))
                    except Skipped:
                        continue
            rules_, ids, problems = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(rules_, pa.int32()), pa.array(ids, pa.int64()), pa.array(problems, pa.string())], names=["rule", "id", "problem"])

    own = events.df.select(F.col("id").cast("bigint").alias("id"), *columns).mapInArrow(look, "rule int, id bigint, problem string")
    both = own.withColumn("ours", F.lit(True)).join(run.hits.select("rule", "id", F.lit(True).alias("theirs")), ["rule", "id"], "full")
    problem = F.coalesce("problem", F.when(F.col("theirs").isNull(), "missing").when(F.col("ours").isNull(), "extra"))
    return both.select("rule", "id", problem.alias("problem")).where("problem is not null")
