"""More queries by item, over rows that tell: each has values that hit and values that do not."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import _BOOTS, _E, _FT, _LOGONS, _P, _add, _t, boots, events, logon_events, pid_events, rule_set, sysmon_events
from .functions import labels
from .functions.timeparse import SECOND, UNIX_EPOCH
from .model import EventSet, Key
from .operators import chips, detections, engine, entities, proctree, sessions
from .operators.running import Running, lag, running
from .plans.compile import Compiler
from .plans.sigma import CATEGORIES, SERVICES
from .sources.rules import RuleSet, parse_rule

# processes


def ended_processes(spark: SparkSession, sf: str) -> EventSet:
    """Orders as creations of a process for each customer, finished orders as its ends."""
    n = F.when(F.col("o_orderstatus") == "F", 5).otherwise(1)
    df = _t(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("g"), F.col("o_custkey").cast("string")).alias("ProcessGuid"), n.alias("n"), F.lit(proctree.SYSMON).alias("channel"), F.lit("H").alias("computer"), F.timestamp_seconds(F.col("o_orderkey") % 1000 + 1_700_000_000).alias("at"))
    return EventSet.from_dataframe(df, id="o_orderkey", time="at", fields=["ProcessGuid"], system={"@EventID": F.col("n"), "@Channel": "channel", "@Computer": "computer"})


_AT = f"((o_orderkey % 1000 + 1700000000) * {SECOND} + {UNIX_EPOCH})"
_add(
    "pt02_ends",
    lambda s, d: proctree.sysmon_nodes(ended_processes(s, d)).select("key", "id", "end_ft"),
    f"WITH c AS (SELECT upper('g' || o_custkey) AS key, min(o_orderkey) AS id FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1), x AS (SELECT upper('g' || o_custkey) AS key, arg_max({_AT}, o_orderkey) AS end_ft FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) SELECT c.key, id, end_ft FROM c LEFT JOIN x ON x.key = c.key",
)
_add(
    "pt07_synthetic",
    lambda s, d: proctree.pid_nodes(pid_events(s, d), boots(s, d)).where("synthetic").select("key", "host", "pid", "id"),
    f"""{_BOOTS}, e AS (SELECT event_id AS id, {_FT} AS t, 'H' || (user_id % 3) AS host, user_id AS pid, event_type FROM events WHERE event_type IN ('view', 'purchase')),
    x AS (SELECT e.*, (SELECT count(*) FROM k WHERE k.host = e.host AND k.t <= e.t) AS boot FROM e),
    c AS (SELECT x.*, (SELECT min(y.t) FROM x y WHERE y.event_type = 'purchase' AND y.host = x.host AND y.boot = x.boot AND y.pid = x.pid AND y.t >= x.t) AS end_ft FROM x WHERE event_type = 'view'),
    m AS (SELECT c.id, c.t, c.host, c.boot, c.pid + 1 AS ppid, p.id AS pid_, p.end_ft AS pend, row_number() OVER (PARTITION BY c.id ORDER BY p.t DESC, p.id DESC) AS r FROM c LEFT JOIN c p ON p.host = c.host AND p.boot = c.boot AND p.pid = c.pid + 1 AND (p.t < c.t OR p.t = c.t AND p.id < c.id))
    SELECT 'synthetic|' || host || '|' || boot || '||' || ppid AS key, host, ppid AS pid, min(id) AS id FROM m WHERE r = 1 AND (pid_ IS NULL OR pend < t) GROUP BY host, boot, ppid""",
)
_add(
    "pt08_order",
    lambda s, d: proctree.trees(proctree.sysmon_nodes(sysmon_events(s, d))).select("key", "order"),
    f"""WITH RECURSIVE c AS ({_P}), raw AS (SELECT k, p, k AS id FROM c UNION ALL SELECT p, NULL, min(k) FROM c WHERE p IS NOT NULL AND p NOT IN (SELECT k FROM c) GROUP BY p),
    n AS (SELECT k, p, lpad(CAST((CASE WHEN k IN (SELECT k FROM c) THEN k ELSE id END + 1700000000) * {SECOND} + {UNIX_EPOCH} AS VARCHAR), 20, '0') || '.' || lpad(CAST(id AS VARCHAR), 12, '0') AS step FROM raw),
    w AS (SELECT k, step AS "order" FROM n WHERE p IS NULL UNION ALL SELECT n.k, w."order" || '/' || n.step FROM w JOIN n ON n.p = w.k) SELECT CAST(k AS VARCHAR) AS key, "order" FROM w""",
)


def order_chains(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as chains of 5,000 processes."""
    k = F.col("o_orderkey")
    return _t(spark, sf, "orders").select(k.cast("string").alias("key"), F.when(k % 5000 > 0, (k - 1).cast("string")).alias("parent"))


_add("pt08_chains", lambda s, d: proctree.depths(order_chains(s, d)), "SELECT CAST(o_orderkey AS VARCHAR) AS key, o_orderkey % 5000 AS depth, CAST(o_orderkey - o_orderkey % 5000 AS VARCHAR) AS root FROM orders")

# running values of hot keys: three flags share all line items


def _running(spark: SparkSession, sf: str) -> DataFrame:
    rows = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", F.col("l_quantity").cast("long").alias("q"), "l_discount", "l_shipdate")
    values = [Running("total", "sum", F.col("q"), before=True), Running("most", "max", F.col("l_partkey")), Running("last_free", "last", F.when(F.col("l_discount") == 0, F.col("l_partkey")), before=True), lag("before", F.col("q"))]
    out = running(rows, ["l_returnflag"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"], values)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "total", "most", "last_free", F.col("before.v").alias("q_before"))


_add(
    "w05_hot_keys",
    _running,
    """SELECT l_orderkey, l_linenumber, l_partkey, CAST(sum(CAST(l_quantity AS BIGINT)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT) AS total, max(l_partkey) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS most,
    last_value(CASE WHEN l_discount = 0 THEN l_partkey END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_free, lag(CAST(l_quantity AS BIGINT)) OVER w AS q_before
    FROM lineitem WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey)""",
)

# sessions


def detailed_logons(spark: SparkSession, sf: str) -> DataFrame:
    """Logons with all their details."""
    u = F.col("user_id").cast("string")
    more = {
        "TargetUserName": F.concat(F.lit("u"), u), "TargetDomainName": F.when(F.col("user_id") % 4 > 0, "DOM"), "TargetUserSid": F.concat(F.lit("S-1-5-21-"), u), "WorkstationName": F.concat(F.lit("WS"), u),
        "IpAddress": F.concat(F.when(F.col("user_id") % 2 == 0, "::ffff:").otherwise(""), F.lit("10.0.0."), u), "AuthenticationPackageName": F.when(F.col("user_id") % 3 == 0, "-").otherwise("NTLM"), "LogonProcessName": F.lit(" User32 "),
        "ElevatedToken": F.when(F.col("user_id") % 2 == 0, "%%1842").otherwise("%%1843"), "TargetLinkedLogonId": F.lit("0x0"),
    }
    e = logon_events(spark, sf)
    df = e.df.withColumns(more)
    return sessions.logons(EventSet.from_dataframe(df, id="id", fields=[*more, "TargetLogonId", "SubjectLogonId", "LogonType"], system={"@EventID": F.col("event_number"), "@Channel": "channel", "@Provider": "provider", "@Computer": "computer"}).with_df(df), boots(spark, sf))


_add(
    "s04_columns",
    lambda s, d: detailed_logons(s, d).select("id", "user", "sid", "workstation", "ip", "package", "process", "elevated", "linked", "duration", "privileged"),
    f"""{_LOGONS} SELECT f.id, CASE WHEN user_id % 4 > 0 THEN 'DOM\\' ELSE '' END || 'u' || user_id AS "user", 'S-1-5-21-' || user_id AS sid, 'WS' || user_id AS workstation, '10.0.0.' || user_id AS ip, CASE WHEN user_id % 3 > 0 THEN 'NTLM' END AS package, 'User32' AS process,
    CASE WHEN user_id % 2 = 0 THEN 'Yes' ELSE 'No' END AS elevated, '0x0' AS linked, end_ft - start_ft AS duration, privileged FROM full_s f JOIN events ON event_id = f.id""",
)

# entities: names in every form


def named(spark: SparkSession, sf: str) -> EventSet:
    """Customers as events: machine accounts, SIDs in names, domains, dashes, mapped and loopback addresses, remote connections."""
    k, kind = F.col("c_custkey"), F.col("c_custkey") % 7
    small = (k % 50).cast("string")
    user = F.when(kind == 0, F.concat(F.lit("pc"), small, F.lit("$"))).when(kind == 1, F.concat(F.lit("%{S-1-5-21-"), small, F.lit("}"))).when(kind == 2, F.concat(F.lit("Dom\\u"), small)).when(kind == 3, "-").when(kind == 4, F.concat(F.lit("U"), small, F.lit("@dom.local"))).when(kind == 5, None).otherwise("")
    ip = F.when(kind == 0, "127.0.0.1").when(kind == 1, F.concat(F.lit("::FFFF:10.0.0."), small)).when(kind == 2, F.concat(F.lit("[fe80:0:0:0::"), small, F.lit("]"))).when(kind == 3, "::1").when(kind == 4, F.concat(F.lit("10.0.1."), small)).when(kind == 6, "host.name")
    host = F.when(kind == 3, "LOCALHOST").when(kind == 4, "10.9.9.9").when(kind == 1, F.concat(F.lit("\\\\n"), small, F.lit(".corp.x"))).otherwise(F.concat(F.lit("N"), small))
    remote = kind == 5
    df = _t(spark, sf, "customer").select(
        "c_custkey", user.alias("TargetUserName"), ip.alias("IpAddress"), host.alias("computer"), F.when(remote, 1149).otherwise(1).alias("n"), F.when(remote, "Microsoft-Windows-TerminalServices-RemoteConnectionManager/Operational").otherwise("Security").alias("channel"),
        F.concat(F.lit("r"), small).alias("Param1"), F.when(k % 2 == 0, "Dom.x").alias("Param2"), F.concat(F.lit("10.2.0."), small).alias("Param3"),
    )
    return EventSet.from_dataframe(df, id="c_custkey", fields=["TargetUserName", "IpAddress", "Param1", "Param2", "Param3"], system={"@EventID": F.col("n"), "@Channel": "channel", "@Computer": "computer"})


_NAMED = """WITH e AS (SELECT c_custkey AS id, c_custkey % 7 AS kind, c_custkey % 50 AS s FROM customer),
    m AS (SELECT id, 'host|N' || s AS entity, 'logging' AS role FROM e WHERE kind IN (0, 1, 2, 5, 6)
    UNION ALL SELECT id, 'host|PC' || s, 'account' FROM e WHERE kind = 0
    UNION ALL SELECT id, 'user|sid:S-1-5-21-' || s, 'target' FROM e WHERE kind = 1
    UNION ALL SELECT id, 'user|name:DOM\\u' || s, 'target' FROM e WHERE kind IN (2, 4)
    UNION ALL SELECT id, 'ip|' || CASE kind WHEN 1 THEN '10.0.0.' || s WHEN 2 THEN 'fe80::' || s WHEN 4 THEN '10.0.1.' || s ELSE '10.2.0.' || s END, 'source' FROM e WHERE kind IN (1, 4, 5) OR kind = 2 AND s > 0
    UNION ALL SELECT id, 'ip|fe80::', 'source' FROM e WHERE kind = 2 AND s = 0)"""


def _roles(spark: SparkSession, sf: str, wanted: str) -> DataFrame:
    return entities.roles(entities.build(named(spark, sf)).mentions).where(wanted).select("entity", "role", "events")


_COUNTED = "SELECT entity, role, count(DISTINCT id) AS events FROM m"
_add("en04_addresses", lambda s, d: _roles(s, d, "entity like 'ip|%'"), f"{_NAMED} {_COUNTED} WHERE entity LIKE 'ip|%' GROUP BY 1, 2")
_add("en05_machines", lambda s, d: _roles(s, d, "entity like 'host|%'"), f"{_NAMED} {_COUNTED} WHERE entity LIKE 'host|%' GROUP BY 1, 2")
_add("en06_sids", lambda s, d: _roles(s, d, "entity like 'user|sid:%'"), f"{_NAMED} {_COUNTED} WHERE entity LIKE 'user|sid:%' GROUP BY 1, 2")
_add("en07_domains", lambda s, d: _roles(s, d, "entity like 'user|name:DOM\\\\\\\\u%'"), f"{_NAMED} {_COUNTED} WHERE entity LIKE 'user|name:DOM%' GROUP BY 1, 2")
_add(
    "en02_remote",
    lambda s, d: entities.build(named(s, d)).mentions.where("entity like 'user|name:%r%' and role = 'target'").select("id", "entity"),
    "WITH e AS (SELECT c_custkey AS id, c_custkey % 50 AS s, c_custkey % 2 = 0 AS dom FROM customer WHERE c_custkey % 7 = 5), d AS (SELECT s, bool_or(dom) AS has FROM e GROUP BY 1) SELECT id, 'user|name:' || CASE WHEN has THEN 'DOM' ELSE '' END || '\\r' || e.s AS entity FROM e JOIN d ON d.s = e.s",
)


def renamed_hosts(spark: SparkSession, sf: str) -> EventSet:
    """Suppliers as hosts; each tenth event renames a host to the next one, three in a row."""
    k = F.col("s_suppkey")
    rename = k % 10 < 3
    df = _t(spark, sf, "supplier").select("s_suppkey", F.when(rename, 6011).otherwise(1).alias("n"), F.when(rename, "EventLog").otherwise("p").alias("provider"), F.when(rename, F.array(F.concat(F.lit("S"), k), F.concat(F.lit("S"), k + 1))).otherwise(F.array().cast("array<string>")).alias("Data"), F.concat(F.lit("s"), k, F.lit(".x")).alias("computer"))
    return EventSet.from_dataframe(df, id="s_suppkey", fields=["Data"], system={"@EventID": F.col("n"), "@Provider": "provider", "@Computer": "computer"})


_FINAL = "'host|S' || CASE WHEN s_suppkey % 10 < 3 AND s_suppkey - s_suppkey % 10 + 3 <= (SELECT max(s_suppkey) + 1 FROM supplier) THEN s_suppkey - s_suppkey % 10 + 3 ELSE s_suppkey END"
_add("en03_renames", lambda s, d: entities.build(renamed_hosts(s, d)).mentions.select("id", "entity"), f"SELECT s_suppkey AS id, {_FINAL} AS entity FROM supplier")


def met(spark: SparkSession, sf: str) -> EventSet:
    k = F.col("l_orderkey")
    df = _t(spark, sf, "lineitem").where("l_linenumber = 1").select("l_orderkey", F.concat(F.lit("u"), k % 7).alias("TargetUserName"), F.concat(F.lit("10.0.0."), k % 11).alias("IpAddress"))
    return EventSet.from_dataframe(df, id="l_orderkey", fields=["TargetUserName", "IpAddress"])


_add("j10_met", lambda s, d: entities.common_events(entities.build(met(s, d)), "user|name:\\u3", "ip|10.0.0.5"), "SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_linenumber = 1 AND l_orderkey % 7 = 3 AND l_orderkey % 11 = 5")

# chips with rows that tell

_add("ch01_cases", lambda s, d: (e := events(s, d)).df.select("id", *[chips.matching(Compiler(e), "event_type", v, exact=x).alias(n) for n, v, x in (("same", "view", True), ("other", "VIEW", True), ("any_case", "VIEW", False))]), f"SELECT event_id AS id, event_type = 'view' AS same, false AS other, event_type = 'view' AS any_case {_E}")


def marked(spark: SparkSession, sf: str) -> EventSet:
    """Documents with their quality, where they have a label."""
    marks = _t(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return EventSet.from_dataframe(_t(spark, sf, "documents").select("doc_id", "source").join(marks, "doc_id", "left"), id="doc_id")


_add("ch02_labelled", lambda s, d: chips.with_field(marked(s, d), "quality").select("id"), "SELECT doc_id AS id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality IS NOT NULL)")
_add("f25_natural", lambda s, d: engine.run(marked(s, d), "sort by source | limit 300").events.select("id"), "SELECT doc_id AS id FROM documents ORDER BY CAST(substr(source, 4) AS INTEGER), doc_id LIMIT 300")

# labels: all templates and codes


def all_templates(spark: SparkSession, sf: str) -> EventSet:
    """Events of each kind that has a template in turn; every field's value is its name and the user."""
    fields = sorted({f for t in labels.TEMPLATES.values() for f in re.findall(r"\{([\w ]+)\}", t)})
    kinds = F.array(*[F.struct(F.lit(f"X-{ending}").alias("c"), F.lit(n).alias("n")) for ending, n in labels.TEMPLATES])
    kind = F.get(kinds, (F.col("event_id") % len(labels.TEMPLATES)).cast("int"))
    df = _t(spark, sf, "events").select("event_id", "user_id", kind["c"].alias("channel"), kind["n"].alias("n"))
    e = EventSet.from_dataframe(df, id="event_id", fields=[], system={"@EventID": F.col("n"), "@Channel": "channel", "@Provider": F.lit("p")})
    return EventSet(e.df, e.keys | {f: Key(f, F.concat(F.lit(f"{f}#"), F.col("user_id"))) for f in fields})


def _text_of(template: str) -> str:
    parts = [f"'{x[1:-1]}#' || user_id" if x.startswith("{") else "'" + x.replace("'", "''") + "'" for x in re.findall(r"\{[\w ]+\}|[^{]+", template)]
    return " || ".join(parts)


_add(
    "fn05_templates",
    lambda s, d: (e := all_templates(s, d)).df.select("id", labels.describe(e).alias("line")),
    f"SELECT event_id AS id, CASE event_id % {len(labels.TEMPLATES)} " + " ".join(f"WHEN {k} THEN {_text_of(t)}" for k, t in enumerate(labels.TEMPLATES.values())) + f" END AS line {_E}",
)
_CODES = list(labels.PARAMETERS)
_add(
    "fn07_codes",
    lambda s, d: _t(s, d, "events").select("event_id", labels.parameters(F.concat(F.lit("x "), F.get(F.array(*map(F.lit, [*_CODES, "%%1", "%"])), (F.col("event_id") % (len(_CODES) + 2)).cast("int")), F.lit(" y"))).alias("text")),
    f"SELECT event_id, 'x ' || CASE event_id % {len(_CODES) + 2} " + " ".join(f"WHEN {k} THEN '{t}'" for k, t in enumerate([*labels.PARAMETERS.values(), "%%1", "%"])) + f" END || ' y' AS text {_E}",
)

# rules: all log sources, searches of every form


def source_events(spark: SparkSession, sf: str) -> EventSet:
    """Events of each channel and event id that a service or category reads, in turn."""
    spots = sorted({(c.replace("*", "/x"), i) for kinds in CATEGORIES.values() for cs, ids in kinds for c in cs for i in ids} | {(c.replace("*", "/x"), 7777) for cs in SERVICES.values() for c in cs})
    kind = F.get(F.array(*[F.struct(F.lit(c).alias("c"), F.lit(n).alias("n")) for c, n in spots]), (F.col("event_id") % len(spots)).cast("int"))
    df = _t(spark, sf, "events").select("event_id", "user_id", kind["c"].alias("channel"), kind["n"].alias("n"))
    return EventSet.from_dataframe(df, id="event_id", fields=["user_id"], system={"@EventID": F.col("n"), "@Channel": "channel"})


def source_rules() -> RuleSet:
    own = [("service", k) for k in SERVICES] + [("category", k) for k in CATEGORIES]
    return RuleSet(tuple(parse_rule(f"title: {kind} {k}\nlogsource:\n  {kind}: {k}\ndetection:\n  s:\n    user_id|gte: 20\n  condition: s") for kind, k in own))


def _source_sql() -> str:
    spots = sorted({(c.replace("*", "/x"), i) for kinds in CATEGORIES.values() for cs, ids in kinds for c in cs for i in ids} | {(c.replace("*", "/x"), 7777) for cs in SERVICES.values() for c in cs})
    spot = ", ".join(f"({k}, '{c}', {n})" for k, (c, n) in enumerate(spots))
    reads = [f"('service {k}', '{c.replace('*', '/x')}', NULL)" for k, cs in SERVICES.items() for c in cs] + [f"('category {k}', '{c}', {i})" for k, kinds in CATEGORIES.items() for cs, ids in kinds for c in cs for i in ids]
    return f"WITH p(k, c, n) AS (VALUES {spot}), r(title, c, n) AS (VALUES {', '.join(reads)}) SELECT title, event_id AS id FROM events JOIN p ON p.k = event_id % {len(spots)} JOIN r ON lower(r.c) = lower(p.c) AND (r.n IS NULL OR r.n = p.n) WHERE user_id >= 20"


def _titled(found: detections.Run) -> DataFrame:
    return found.hits.join(found.rules.select("rule", "title"), "rule").select("title", "id")


_add("sg02_sources", lambda s, d: _titled(detections.run(source_events(s, d), source_rules())), _source_sql())

SEARCHES = {
    "keywords": ("kw:\n    - urch\n    - '*\"k\": 7}*'\n  condition: kw", "event_type LIKE '%urch%' OR props LIKE '%\"k\": 7}%'"),
    "maps": ("sel:\n    - event_type: view\n      user_id: 3\n    - event_type: click\n      user_id|lt: 2\n  condition: sel", "event_type = 'view' AND user_id = 3 OR event_type = 'click' AND user_id < 2"),
    "escaped": ("sel:\n    props|contains: '\\*'\n  other:\n    event_type: 'err?r'\n  condition: sel or other", "props LIKE '%*%' OR event_type LIKE 'err_r'"),
    "system": ("sel:\n    EventID: 1\n    event_type: view\n  condition: not sel and 1 of sel*", "false"),
    "lists": ("a:\n    event_type: view\n  b:\n    user_id: [1, 2]\n  condition:\n    - a and b\n    - b and not a", "user_id IN (1, 2)"),
}


def searches() -> RuleSet:
    return RuleSet(tuple(parse_rule(f"title: {n}\nlevel: low\nlogsource:\n  product: windows\ndetection:\n  {body}\n") for n, (body, _) in SEARCHES.items()))


_FOUND = " UNION ALL ".join(f"SELECT '{n}' AS title, event_id AS id {_E} WHERE {sql}" for n, (_, sql) in SEARCHES.items())
_add("sg06_searches", lambda s, d: _titled(detections.run(events(s, d), searches())), _FOUND)


def _by_text(spark: SparkSession, sf: str) -> DataFrame:
    """The text shown for each rule, run as a query."""
    e, out = events(spark, sf), None
    for r in detections.run(e, searches()).rules.where("query <> 'false'").collect():  # a row for each rule
        own = engine.run(e, r["query"]).filtered.select(F.lit(r["title"]).alias("title"), "id")
        out = own if out is None else out.union(own)
    return out


_add("sg13_texts", _by_text, _FOUND)
_add("sg17_rules_of", lambda s, d: detections.run(events(s, d), rule_set()).hits.join(_t(s, d, "events").where("event_type = 'purchase'").select(F.col("event_id").alias("id")), "id", "left_semi").groupBy("id").agg(F.count_distinct("rule").alias("rules")), "SELECT id, count(*) AS rules FROM (SELECT event_id AS id FROM events WHERE event_type = 'purchase' AND user_id >= 10 UNION ALL SELECT event_id FROM events WHERE event_type = 'purchase') GROUP BY 1")
_add("sg18_listed", lambda s, d: detections.run(events(s, d), rule_set()).listed("hits", "medium", "A").select("title", "hits"), f"SELECT title, count(*) AS hits FROM (SELECT 'plain' AS title {_E} WHERE event_type = 'purchase' AND user_id >= 10 UNION ALL SELECT 'masks' {_E} WHERE (event_type LIKE 'v%' OR event_type LIKE '%ck') AND user_id NOT IN (1, 2, 3) UNION ALL SELECT 'all' {_E} WHERE event_type LIKE '%u%' AND event_type LIKE '%p%' UNION ALL SELECT 'absent' {_E} WHERE event_type = 'signup') GROUP BY 1")
