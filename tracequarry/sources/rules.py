"""Sigma rules from YAML text, folders and JSON packs. Authors and licences stay with each rule."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field

import yaml


@dataclass(frozen=True)
class Null:
    """A plain null, as opposed to the text null."""


NULL = Null()


@dataclass(frozen=True)
class Rule:
    path: str
    source: str = "folder"
    id: str = ""
    title: str = ""
    level: str = ""
    status: str = ""
    author: str = ""
    license: str = ""
    description: str = ""
    tags: tuple[str, ...] = ()
    references: tuple[str, ...] = ()
    logsource: dict = field(default_factory=dict, hash=False)
    detection: dict = field(default_factory=dict, hash=False)
    failure: str = ""


@dataclass(frozen=True)
class RuleSet:
    rules: tuple[Rule, ...] = ()
    aliases: dict = field(default_factory=dict, hash=False)
    sources: dict = field(default_factory=dict, hash=False)

    def merge(self, other: RuleSet) -> RuleSet:
        """Rules of both; the first meaning of an alias stays."""
        return RuleSet(self.rules + other.rules, {**other.aliases, **self.aliases}, {**other.sources, **self.sources})


class RuleError(ValueError):
    pass


def _plain(node: yaml.Node):
    """Scalars keep their source text; only a plain null is null."""
    if isinstance(node, yaml.MappingNode):
        return {str(_plain(k)): _plain(v) for k, v in node.value}
    if isinstance(node, yaml.SequenceNode):
        return [_plain(x) for x in node.value]
    if node.style is None and node.value in ("", "~", "null", "Null", "NULL"):
        return NULL
    return node.value


def parse_rule(text: str, path: str = "", source: str = "folder") -> Rule:
    """A rule, or a rule with a failure that says what is wrong with it."""
    try:
        return _parsed(text, path, source)
    except (RuleError, yaml.YAMLError) as e:
        return Rule(path, source, title=os.path.basename(path), failure=str(e).split("\n")[0] or type(e).__name__)


def _parsed(text: str, path: str, source: str) -> Rule:
    nodes = list(yaml.compose_all(text, Loader=yaml.SafeLoader))
    if len(nodes) != 1:
        raise RuleError("a file holds one rule" if nodes else "the file is empty")
    doc = _plain(nodes[0])
    if not isinstance(doc, dict):
        raise RuleError("a rule is a mapping")
    if "correlation" in doc:
        raise RuleError("correlation rules are not evaluated")
    text_of = lambda k: v if isinstance(v := doc.get(k, ""), str) else ""
    if not text_of("title"):
        raise RuleError("the rule has no title")
    detection = doc.get("detection")
    if not isinstance(detection, dict):
        raise RuleError("the rule has no detection")
    if "condition" not in detection:
        raise RuleError("the detection has no condition")
    many = lambda k: tuple(x for x in v if isinstance(x, str)) if isinstance(v := doc.get(k, []), list) else ()
    logsource = doc.get("logsource")
    logsource = {k: v for k, v in logsource.items() if isinstance(v, str)} if isinstance(logsource, dict) else {}
    return Rule(path, source, text_of("id"), text_of("title"), text_of("level").lower(), text_of("status"), text_of("author"), text_of("license"), text_of("description"), many("tags"), many("references"), logsource, {k: v for k, v in detection.items() if k != "timeframe"})


def folder(path: str) -> RuleSet:
    """All .yml and .yaml files below a folder, in order of path; what cannot be read is a failed rule."""
    rules = []
    for at, dirs, names in os.walk(path):
        dirs.sort()
        for name in sorted(names):
            if name.lower().endswith((".yml", ".yaml")):
                file = os.path.join(at, name)
                try:
                    with open(file, encoding="utf-8") as f:
                        rules.append(parse_rule(f.read(), file))
                except (OSError, UnicodeDecodeError) as e:
                    rules.append(Rule(file, title=name, failure=f"cannot be read: {e}"))
    return RuleSet(tuple(sorted(rules, key=lambda r: r.path)))


def pack(path: str) -> RuleSet:
    """A JSON pack: sources, aliases, rules with source, path and yaml."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    rules = tuple(parse_rule(r["yaml"], r.get("path", ""), r.get("source", "pack")) for r in data.get("rules", []))
    return RuleSet(rules, data.get("aliases", {}), data.get("sources", {}))


def write_pack(path: str, folders: dict[str, str], aliases: dict[str, str] | None = None, sources: dict | None = None) -> int:
    """Make a pack from rule folders by source name; returns the number of rules."""
    rules = []
    for source, root in sorted(folders.items()):
        for r in folder(root).rules:
            with open(r.path, encoding="utf-8") as f:
                rules.append({"source": source, "path": os.path.relpath(r.path, root), "yaml": f.read()})
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"sources": sources or {}, "aliases": aliases or {}, "rules": rules}, f, ensure_ascii=False)
    return len(rules)
