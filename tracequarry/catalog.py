"""Queries over the driver's tables, one per operator, and the SQL that says what each must return."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import labels
from .functions.timeparse import SECOND, UNIX_EPOCH, parse_time
from .model import BIT, EXPORTED_FLAGS, EventSet, flag_names
from .operators import chips, detections, engine, entities, explore, proctree, rulepack, sessions
from .plans.compile import Compiler
from .sources.rules import RuleSet, parse_rule

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        SQL[name] = sql


def events(spark: SparkSession, sf: str) -> EventSet:
    return EventSet.from_dataframe(_t(spark, sf, "events"), id="event_id", time="ts", fields=["event_id", "user_id", "event_type", "value", "props"], json_fields={"props": ["k"]})


def plain(table: str, key: str) -> Callable[[SparkSession, str], EventSet]:
    return lambda spark, sf: EventSet.from_dataframe(_t(spark, sf, table), id=key)


def labelled(spark: SparkSession, sf: str) -> EventSet:
    """documents with their label, where they have one; language and quality only."""
    marks = _t(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return EventSet.from_dataframe(_t(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars").join(marks, "doc_id", "left"), id="doc_id")


def _dql(name: str, source: Callable[[SparkSession, str], EventSet], query: str, columns: list[str], sql: str, most_groups: int | None = engine.MOST_GROUPS) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        found = engine.run(source(spark, sf), query, most_groups=most_groups)
        rows = found.groups if found.groups is not None else found.events
        return rows.select(*columns)

    _add(name, run, sql)


# 2.3 and 2.4: the query language

_part, _orders, _lineitem, _supplier = plain("part", "p_partkey"), plain("orders", "o_orderkey"), plain("lineitem", "l_orderkey"), plain("supplier", "s_suppkey")
_E = "FROM events"

_dql("q07_flagship", events, "event_type = purchase and user_id > 5 | group by user_id | sort count desc | limit 20", ["user_id", "count"], "SELECT CAST(user_id AS VARCHAR) AS user_id, count(*) AS count FROM events WHERE lower(event_type) = 'purchase' AND user_id > 5 GROUP BY 1 ORDER BY count DESC, user_id LIMIT 20")
_dql("f01_eq", events, "event_type = PURCHASE", ["id", "event_type", "value"], f"SELECT event_id AS id, event_type, value {_E} WHERE lower(event_type) = 'purchase'")
_dql("f01_mask", _part, 'p_type = "*o?o*"', ["id", "p_type"], "SELECT p_partkey AS id, p_type FROM part WHERE lower(p_type) LIKE '%o_o%'")
_dql("f03_eq_exact", events, "event_type == purchase and user_id = 5", ["id", "event_type"], f"SELECT event_id AS id, event_type {_E} WHERE event_type = 'purchase' AND user_id = 5")
_dql("f04_ne_missing", labelled, "quality != 1 and lang != en", ["id", "lang", "quality"], "SELECT d.doc_id AS id, lang, quality FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l ON d.doc_id = l.doc_id WHERE (quality IS NULL OR quality <> 1) AND (lang IS NULL OR lower(lang) <> 'en')")
_dql("f05_lt", _lineitem, "l_quantity < 3 and l_discount >= 0.05", ["l_orderkey", "l_linenumber", "l_quantity", "l_discount"], "SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem WHERE l_quantity < 3 AND l_discount >= 0.05")
_dql("f06_between", _orders, "o_totalprice between 150000 and 100000", ["id", "o_totalprice"], "SELECT o_orderkey AS id, o_totalprice FROM orders WHERE o_totalprice BETWEEN 100000 AND 150000")
_dql("f07_in", _orders, "o_orderstatus in (f, O) and o_orderpriority in ('1-urgent', '*low*')", ["id", "o_orderstatus", "o_orderpriority"], "SELECT o_orderkey AS id, o_orderstatus, o_orderpriority FROM orders WHERE lower(o_orderstatus) IN ('f', 'o') AND (lower(o_orderpriority) = '1-urgent' OR lower(o_orderpriority) LIKE '%low%')")
_dql("f07_not_in", events, "event_type not in (view, click) and user_id in (1, 2, 3)", ["id", "event_type", "user_id"], f"SELECT event_id AS id, event_type, user_id {_E} WHERE lower(event_type) NOT IN ('view', 'click') AND user_id IN (1, 2, 3)")
_dql("f08_contains", _part, "p_name contains AN", ["id", "p_name"], "SELECT p_partkey AS id, p_name FROM part WHERE contains(lower(p_name), 'an')")
_dql("f09_not_contains", _part, "p_type !~ promo", ["id", "p_type"], "SELECT p_partkey AS id, p_type FROM part WHERE NOT contains(lower(p_type), 'promo')")
_dql("f10_startswith", _part, "p_type startswith promo", ["id", "p_type"], "SELECT p_partkey AS id, p_type FROM part WHERE starts_with(lower(p_type), 'promo')")
_dql("f11_endswith", _part, "p_type endswith ARD", ["id", "p_type"], "SELECT p_partkey AS id, p_type FROM part WHERE ends_with(lower(p_type), 'ard')")
_dql("f12_like", _part, 'p_brand like "brand#?3"', ["id", "p_brand"], "SELECT p_partkey AS id, p_brand FROM part WHERE lower(p_brand) LIKE 'brand#_3'")
_dql("f13_regex", _part, 'p_type matches "^(economy|promo)"', ["id", "p_type"], "SELECT p_partkey AS id, p_type FROM part WHERE regexp_matches(lower(p_type), '^(economy|promo)')")


def _addresses(spark: SparkSession, sf: str) -> EventSet:
    df = _t(spark, sf, "supplier").withColumn("ip", F.format_string("10.%d.0.%d", F.col("s_suppkey") % 4, F.col("s_suppkey") % 256))
    return EventSet.from_dataframe(df, id="s_suppkey")


_dql("f14_cidr", _addresses, "ip cidr 10.2.0.0/15", ["id", "ip"], "SELECT s_suppkey AS id, '10.' || (s_suppkey % 4) || '.0.' || (s_suppkey % 256) AS ip FROM supplier WHERE s_suppkey % 4 IN (2, 3)")
_dql("f15_exists", labelled, "quality exists", ["id", "quality"], "SELECT DISTINCT d.doc_id AS id, l.quality FROM documents d JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL")


def _paired(spark: SparkSession, sf: str) -> EventSet:
    lines = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus")
    return EventSet.from_dataframe(lines.join(_t(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus"), "l_orderkey"), id="l_orderkey")


_dql("f16_field_compare", _paired, "o_orderstatus = `l_linestatus`", ["l_orderkey", "l_linenumber", "o_orderstatus"], "SELECT l_orderkey, l_linenumber, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE lower(o_orderstatus) = lower(l_linestatus)")
_dql("f17_time_range", events, 'time >= "2024-01-05" and time < "2024-01-06 12:00"', ["id", "event_type"], f"SELECT event_id AS id, event_type {_E} WHERE ts >= '2024-01-05' AND ts < '2024-01-06 12:00'")
_dql("f18_time_eq", events, 'time = "2024-01-01 00:00:07"', ["id"], f"SELECT event_id AS id {_E} WHERE ts >= '2024-01-01 00:00:07' AND ts < '2024-01-01 00:00:08'")
_dql("f20_text", _part, '"and"', ["id"], "SELECT p_partkey AS id FROM part WHERE contains(lower(p_name), 'and') OR contains(lower(p_brand), 'and') OR contains(lower(p_type), 'and')")
_dql("f26_bool", labelled, "not (quality = 1 or lang = en) or (source = src1 and not n_chars < 2000)", ["id"], "SELECT d.doc_id AS id FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l ON d.doc_id = l.doc_id WHERE NOT (coalesce(quality = 1, false) OR coalesce(lower(lang) = 'en', false)) OR (coalesce(lower(source) = 'src1', false) AND NOT coalesce(n_chars < 2000, false))")
_dql("q06_select", events, "event_type = error | select event_type, k | limit 50", ["id", "event_type"], f"SELECT event_id AS id, event_type {_E} WHERE event_type = 'error' ORDER BY ts, event_id LIMIT 50")
_dql("q07_group2", events, "group by event_type, user_id", ["event_type", "user_id", "count"], f"SELECT event_type, CAST(user_id AS VARCHAR) AS user_id, count(*) AS count {_E} GROUP BY 1, 2", most_groups=None)
_dql("q08_cap", _lineitem, "group by l_orderkey, l_partkey", ["l_orderkey", "l_partkey", "count"], "SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_partkey AS VARCHAR) AS l_partkey, count(*) AS count FROM lineitem GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 20000")
_dql("q09_group_sort", _part, "group by p_type | sort p_type desc | limit 10", ["p_type", "count"], "SELECT p_type, count(*) AS count FROM part GROUP BY 1 ORDER BY lower(p_type) DESC, p_type LIMIT 10")
_dql("q11_sort_field", events, "event_type = view | sort by value desc | limit 40", ["id", "value"], f"SELECT event_id AS id, value {_E} WHERE event_type = 'view' ORDER BY value DESC NULLS LAST, event_id LIMIT 40")
_dql("q12_limit", events, "event_type = click | limit 25", ["id"], f"SELECT event_id AS id {_E} WHERE event_type = 'click' ORDER BY event_id LIMIT 25")
_dql("q12_limit_newest", events, "event_type = click | sort time desc | limit 25", ["id"], f"SELECT event_id AS id {_E} WHERE event_type = 'click' ORDER BY event_id DESC LIMIT 25")
_add("q17_group_events", lambda s, d: engine.drill_down(e := events(s, d), engine.run(e, "value > 50 | group by event_type"), {"event_type": "error"}).select("id"), f"SELECT event_id AS id {_E} WHERE value > 50 AND event_type = 'error'")
_add("ch03_chips", lambda s, d: chips.evaluate(events(s, d), [chips.Chip("event_type", "view"), chips.Chip("event_type", "error"), chips.Chip("user_id", "7", True), chips.Chip("user_id", "8", True, False)], parse_time("2024-01-03"), parse_time("2024-01-20")).select("id"), f"SELECT event_id AS id {_E} WHERE event_type IN ('view', 'error') AND user_id <> 7 AND ts >= '2024-01-03' AND ts <= '2024-01-20'")

# 2.5 to 2.8: counts, windows, sets

_add("a02_facet", lambda s, d: explore.facet(events(s, d), "event_type"), f"SELECT event_type AS value, count(*) AS count {_E} GROUP BY 1")
_add("a02_facet_many", lambda s, d: explore.facet(EventSet.from_dataframe(_t(s, d, "part").withColumn("word", F.split("p_type", " ")), id="p_partkey", fields=["word"]), "word"), "SELECT value, count(*) AS count FROM (SELECT DISTINCT p_partkey, unnest(string_split(p_type, ' ')) AS value FROM part) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 200")
_add("a03_distinct", lambda s, d: explore.distinct_values(events(s, d), "user_id"), f"SELECT count(DISTINCT user_id) AS n {_E}")
_FT = f"(epoch_us(ts) * 10 + {UNIX_EPOCH})"
_add(
    "a04_histogram",
    lambda s, d: explore.histogram(events(s, d).df).select("start", "width", "count", "before", "after"),
    f"""WITH e AS (SELECT {_FT} AS t, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS n FROM events),
    b AS (SELECT min(CASE WHEN i = (CASE WHEN n > 1000 THEN n // 1000 ELSE 0 END) THEN t END) AS lo, min(CASE WHEN i = n - 1 - (CASE WHEN n > 1000 THEN n // 1000 ELSE 0 END) THEN t END) AS hi FROM e),
    w AS (SELECT lo, hi, (SELECT min(CAST(x AS BIGINT) * {SECOND}) FROM unnest({list(explore.WIDTHS)}) AS u(x) WHERE CAST(x AS BIGINT) * {SECOND} * 160 >= hi - lo) AS width FROM b),
    r AS (SELECT width, lo // width * width AS first, hi // width * width AS last FROM w),
    bins AS (SELECT unnest(range(first // width, last // width + 1)) * width AS start, width, first, last FROM r)
    SELECT start, width, (SELECT count(*) FROM e WHERE t >= start AND t < start + width) AS count, (SELECT count(*) FROM e WHERE t < first) AS before, (SELECT count(*) FROM e WHERE t >= last + width) AS after FROM bins""",
)
_add("w01_timeline_gaps", lambda s, d: explore.timeline(events(s, d).df.where("event_type = 'error'")).where("gap or new_day").select("id", "gap", "new_day"), f"WITH e AS (SELECT event_id AS id, ts, lag(ts) OVER (ORDER BY event_id) AS p FROM events WHERE event_type = 'error') SELECT id, coalesce(epoch_us(ts) - epoch_us(p) >= 3600000000, false) AS gap, (p IS NOT NULL AND CAST(ts AS DATE) <> CAST(p AS DATE)) AS new_day FROM e WHERE coalesce(epoch_us(ts) - epoch_us(p) >= 3600000000, false) OR (p IS NOT NULL AND CAST(ts AS DATE) <> CAST(p AS DATE))")


def _two(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = events(spark, sf)
    return engine.run(e, "value > 40").filtered, engine.run(e, "event_type in (view, click)").filtered


_A, _B = "SELECT event_id AS id FROM events WHERE value > 40", "SELECT event_id AS id FROM events WHERE event_type IN ('view', 'click')"
_add("j02_semi", lambda s, d: explore.intersect(*_two(s, d)).select("id", "value"), f"SELECT event_id AS id, value FROM events WHERE value > 40 AND event_id IN ({_B})")
_add("j02_anti", lambda s, d: explore.subtract(*_two(s, d)).select("id", "value"), f"SELECT event_id AS id, value FROM events WHERE value > 40 AND event_id NOT IN ({_B})")
_add("so01_intersect", lambda s, d: explore.intersect(*_two(s, d)).select("id"), f"{_A} INTERSECT {_B}")
_add("so02_union", lambda s, d: explore.union(*_two(s, d)), f"{_A} UNION {_B}")
_add("so03_except", lambda s, d: explore.subtract(*_two(s, d)).select("id"), f"{_A} EXCEPT {_B}")
_add("so04_complement", lambda s, d: explore.complement(events(s, d).df, _two(s, d)[0]).select("id"), f"SELECT event_id AS id FROM events EXCEPT {_A}")
_add("so05_range", lambda s, d: explore.clamp(_two(s, d)[0], 100, 400).select("id"), f"{_A} AND event_id BETWEEN 100 AND 400")
_add("so05_common", lambda s, d: explore.common_count(*_two(s, d)), f"SELECT count(*) AS n FROM ({_A} INTERSECT {_B})")
_add("o04_page", lambda s, d: explore.Ranked.of(_two(s, d)[0].select("id")).page(200), f"{_A} AND event_id > 200 ORDER BY event_id LIMIT 256")
_add("o05_position", lambda s, d: explore.Ranked.of(_two(s, d)[0].select("id")).position(500), f"SELECT count(*) AS n FROM ({_A}) WHERE id < 500")
_add("a13_log_counts", lambda s, d: _t(s, d, "events").select(explore.short_channel(F.concat(F.lit("Microsoft-Windows-"), "event_type")).alias("log")).groupBy("log").agg(F.count("*").alias("count")), "SELECT event_type AS log, count(*) AS count FROM events GROUP BY 1")


def catalog_of(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).catalog().select("name", F.col("n_events").cast("bigint"), F.col("n_values").cast("bigint"))


_FIELDS = {**{c: c for c in ("event_id", "user_id", "event_type", "value", "props")}, "k": "json_extract_string(props, '$.k')"}
_add("m01_catalog", catalog_of, " UNION ALL ".join(f"SELECT '{n}' AS name, count({c}) AS n_events, count({c}) AS n_values FROM events" for n, c in _FIELDS.items()))

# 2.9 and 2.10: sessions and processes over events with other labels


def _host() -> Column:
    return F.concat(F.lit("H"), (F.col("user_id") % 3).cast("string"))


def relabelled(spark: SparkSession, sf: str, ids: dict[str, int], channel: str, provider: str, fields: dict) -> EventSet:
    n = F.create_map(*[F.lit(x) for kv in ids.items() for x in kv])[F.col("event_type")]
    df = _t(spark, sf, "events").withColumns({"event_number": n, "channel": F.lit(channel), "provider": F.lit(provider), "computer": _host(), **fields}).where("event_number is not null")
    return EventSet.from_dataframe(df, id="event_id", time="ts", fields=list(fields), system={"@EventID": F.col("event_number"), "@Channel": "channel", "@Provider": "provider", "@Computer": "computer"})


def boot_events(spark: SparkSession, sf: str) -> EventSet:
    return relabelled(spark, sf, {"signup": 12}, "System", "Microsoft-Windows-Kernel-General", {})


BOOT_GAP = 6 * 3600 * SECOND


def boots(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.boot_times(boot_events(spark, sf), BOOT_GAP)


_S = f"SELECT 'H' || (user_id % 3) AS host, {_FT} AS t FROM events WHERE event_type = 'signup'"
_BOOTS = f"WITH RECURSIVE s AS MATERIALIZED ({_S}), k AS (SELECT host, min(t) AS t FROM s GROUP BY host UNION ALL SELECT k.host, min(s.t) FROM k JOIN s ON s.host = k.host AND s.t > k.t + {BOOT_GAP} GROUP BY k.host, k.t)"
_add("s01_boots", lambda s, d: boots(s, d).select("host", F.posexplode("boots").alias("n", "boot_ft")).select("host", (F.col("n") + 1).alias("n"), "boot_ft"), f"{_BOOTS} SELECT host, row_number() OVER (PARTITION BY host ORDER BY t) AS n, t AS boot_ft FROM k")


def logon_events(spark: SparkSession, sf: str) -> EventSet:
    logon = F.concat(F.lit("0x"), F.lower(F.hex("user_id")))
    return relabelled(spark, sf, {"view": 4624, "purchase": 4634, "error": 4672}, "Security", "Microsoft-Windows-Security-Auditing", {"TargetLogonId": logon, "SubjectLogonId": logon, "LogonType": (F.col("user_id") % 5).cast("string")})


_LOGONS = f"""{_BOOTS},
    e AS (SELECT event_id AS id, {_FT} AS t, 'H' || (user_id % 3) AS host, '0x' || lower(to_hex(user_id)) AS logon, user_id % 5 AS type, event_type FROM events WHERE event_type IN ('view', 'purchase', 'error')),
    x AS (SELECT e.*, (SELECT count(*) FROM k WHERE k.host = e.host AND k.t <= e.t) AS boot FROM e),
    n AS (SELECT x.*, row_number() OVER (PARTITION BY host, boot, logon, event_type ORDER BY t, id) - 1 AS i, count(*) FILTER (event_type = 'purchase') OVER (PARTITION BY host, boot, logon ORDER BY t, CASE event_type WHEN 'view' THEN 0 ELSE 1 END, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lb FROM x WHERE event_type <> 'error'),
    st AS (SELECT *, i + max(lb - i) OVER (PARTITION BY host, boot, logon ORDER BY t, id) AS q FROM n WHERE event_type = 'view'),
    full_s AS (SELECT st.id, st.host, st.logon AS logon_id, CAST(st.type AS VARCHAR) AS type, st.t AS start_ft, en.t AS end_ft, en.id AS end_id, st.boot, EXISTS (SELECT 1 FROM x WHERE event_type = 'error' AND x.host = st.host AND x.boot = st.boot AND x.logon = st.logon) AS privileged
      FROM st LEFT JOIN (SELECT * FROM n WHERE event_type = 'purchase') en ON en.host = st.host AND en.boot = st.boot AND en.logon = st.logon AND en.i = st.q)"""


def logons(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.logons(logon_events(spark, sf), boots(spark, sf))


_add("s02_logons", lambda s, d: logons(s, d).select("id", "host", "logon_id", "type", "start_ft", "end_ft", "end_id", "boot"), f"{_LOGONS} SELECT id, host, logon_id, type, start_ft, end_ft, end_id, boot FROM full_s")
_add("s03_privileged", lambda s, d: logons(s, d).where("privileged").select("id"), f"{_LOGONS} SELECT id FROM full_s WHERE privileged")
_add("a11_by_type", lambda s, d: sessions.by_type(logons(s, d)), f"{_LOGONS} SELECT type, count(*) AS count FROM full_s GROUP BY 1")


def rdp_events(spark: SparkSession, sf: str) -> EventSet:
    return relabelled(spark, sf, {"signup": 21, "view": 22, "click": 24, "error": 25, "purchase": 23}, sessions.RDP_CHANNEL, "lsm", {"SessionID": (F.col("user_id") % 5).cast("string"), "User": F.col("user_id").cast("string")})


_add(
    "s06_rdp",
    lambda s, d: sessions.rdp_chains(rdp_events(s, d)).select("host", "session", "user", "start_ft", "end_ft", F.size("events").alias("n")),
    f"""WITH e AS (SELECT event_id AS id, {_FT} AS t, 'H' || (user_id % 3) AS host, CAST(user_id % 5 AS VARCHAR) AS session, CAST(user_id AS VARCHAR) AS u, CASE event_type WHEN 'signup' THEN 21 WHEN 'view' THEN 22 WHEN 'click' THEN 24 WHEN 'error' THEN 25 ELSE 23 END AS n FROM events WHERE event_type IN ('signup', 'view', 'click', 'error', 'purchase')),
    p AS (SELECT *, lag(n) OVER (PARTITION BY host, session ORDER BY t, id) AS b FROM e), c AS (SELECT *, sum(CASE WHEN n = 21 OR b IS NULL OR b = 23 THEN 1 ELSE 0 END) OVER (PARTITION BY host, session ORDER BY t, id) AS chain FROM p)
    SELECT host, session, min_by(u, (t, id)) AS user, min(t) AS start_ft, CASE WHEN max_by(n, (t, id)) = 23 THEN max(t) END AS end_ft, count(*) AS n FROM c GROUP BY host, session, chain""",
)


def sysmon_events(spark: SparkSession, sf: str) -> EventSet:
    """Parts as processes: the parent of part k is k div 3; every seventh part is never created."""
    df = _t(spark, sf, "part").where("p_partkey % 7 <> 3 or p_partkey = 3").withColumns({"ProcessGuid": F.col("p_partkey").cast("string"), "ParentProcessGuid": F.when(F.floor(F.col("p_partkey") / 3) > 0, F.floor(F.col("p_partkey") / 3).cast("string")), "Image": F.concat(F.lit("C:\\x\\p"), F.col("p_partkey").cast("string"), F.lit(".exe")), "CommandLine": F.col("p_name"), "n": F.lit(1), "channel": F.lit(proctree.SYSMON), "computer": F.lit("H"), "at": F.timestamp_seconds(F.col("p_partkey") + 1_700_000_000)})
    return EventSet.from_dataframe(df, id="p_partkey", time="at", fields=["ProcessGuid", "ParentProcessGuid", "Image", "CommandLine"], system={"@EventID": F.col("n"), "@Channel": "channel", "@Computer": "computer"})


_P = "SELECT p_partkey AS k, CASE WHEN p_partkey // 3 > 0 THEN p_partkey // 3 END AS p FROM part WHERE p_partkey % 7 <> 3 OR p_partkey = 3"
_add("pt03_tree_edges", lambda s, d: proctree.sysmon_nodes(sysmon_events(s, d)).select("key", "parent", "synthetic"), f"WITH c AS ({_P}) SELECT CAST(k AS VARCHAR) AS key, CAST(p AS VARCHAR) AS parent, false AS synthetic FROM c UNION ALL SELECT DISTINCT CAST(p AS VARCHAR), NULL, true FROM c WHERE p IS NOT NULL AND p NOT IN (SELECT k FROM c)")
_TREE = f"WITH RECURSIVE c AS ({_P}), nodes AS (SELECT k, p, 'p' || k || '.exe' AS name FROM c UNION ALL SELECT DISTINCT p, NULL, '(unknown)' FROM c WHERE p IS NOT NULL AND p NOT IN (SELECT k FROM c)), w AS (SELECT k, 0 AS depth, k AS root, name AS path FROM nodes WHERE p IS NULL UNION ALL SELECT n.k, w.depth + 1, w.root, w.path || '{proctree.PATH}' || n.name FROM w JOIN nodes n ON n.p = w.k)"
_add("pt09_paths", lambda s, d: proctree.trees(proctree.sysmon_nodes(sysmon_events(s, d))).select("key", "depth", "root", "path"), f"{_TREE} SELECT CAST(k AS VARCHAR) AS key, depth, CAST(root AS VARCHAR) AS root, path FROM w")
_add("a12_tree_totals", lambda s, d: proctree.totals(proctree.depths(proctree.sysmon_nodes(sysmon_events(s, d)))), f"{_TREE} SELECT count(*) AS nodes, count(*) FILTER (depth = 0) AS roots, max(depth) AS depth FROM w")


def pid_events(spark: SparkSession, sf: str) -> EventSet:
    pid, parent = F.col("user_id").cast("string"), (F.col("user_id") + 1).cast("string")
    own = F.when(F.col("event_type") == "view", parent).otherwise(pid)
    return relabelled(spark, sf, {"view": 4688, "purchase": 4689}, "Security", "audit", {"NewProcessId": F.when(F.col("event_type") == "view", pid), "ProcessId": own, "NewProcessName": F.concat(F.lit("p"), pid)})


_add(
    "pt05_pid_parent",
    lambda s, d: proctree.pid_nodes(pid_events(s, d), boots(s, d)).where("not synthetic").select("id", "end_ft", "linked_by_pid", F.when(F.col("linked_by_pid"), F.regexp_replace("parent", "^pid.", "").cast("bigint")).alias("parent_id")),
    f"""{_BOOTS}, e AS (SELECT event_id AS id, {_FT} AS t, 'H' || (user_id % 3) AS host, user_id AS pid, event_type FROM events WHERE event_type IN ('view', 'purchase')),
    x AS (SELECT e.*, (SELECT count(*) FROM k WHERE k.host = e.host AND k.t <= e.t) AS boot FROM e),
    c AS (SELECT x.*, (SELECT min(y.t) FROM x y WHERE y.event_type = 'purchase' AND y.host = x.host AND y.boot = x.boot AND y.pid = x.pid AND y.t >= x.t) AS end_ft FROM x WHERE event_type = 'view'),
    m AS (SELECT c.id, c.t, c.end_ft, p.id AS pid_, p.end_ft AS pend, row_number() OVER (PARTITION BY c.id ORDER BY p.t DESC, p.id DESC) AS r FROM c LEFT JOIN c p ON p.host = c.host AND p.boot = c.boot AND p.pid = c.pid + 1 AND (p.t < c.t OR p.t = c.t AND p.id < c.id))
    SELECT id, end_ft, (pid_ IS NOT NULL AND (pend IS NULL OR pend >= t)) AS linked_by_pid, CASE WHEN pend IS NULL OR pend >= t THEN pid_ END AS parent_id FROM m WHERE r = 1""",
)

# 2.11: entities


def entity_events(spark: SparkSession, sf: str) -> EventSet:
    df = _t(spark, sf, "customer").join(_t(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    df = df.select("c_custkey", F.translate("c_name", "#", "").alias("TargetUserName"), "n_name", F.format_string("10.%d.0.%d", F.col("c_nationkey"), F.col("c_custkey") % 256).alias("IpAddress"))
    return EventSet.from_dataframe(df, id="c_custkey", fields=["TargetUserName", "IpAddress"], system={"@Computer": "n_name"})


_CN = "SELECT c_custkey AS id, 'user|name:\\' || lower(translate(c_name, '#', '')) AS u, 'host|' || upper(n_name) AS h, 'ip|10.' || c_nationkey || '.0.' || (c_custkey % 256) AS i FROM customer JOIN nation ON c_nationkey = n_nationkey"
_add("en01_roles", lambda s, d: entities.roles(entities.build(entity_events(s, d)).mentions).select("entity", "role", "events"), f"WITH x AS ({_CN}) SELECT entity, role, count(DISTINCT id) AS events FROM (SELECT id, u AS entity, 'target' AS role FROM x UNION ALL SELECT id, h, 'logging' FROM x UNION ALL SELECT id, i, 'source' FROM x) GROUP BY 1, 2")
_add("en09_links", lambda s, d: entities.build(entity_events(s, d)).links.select("a", "b", "count"), f"WITH x AS ({_CN}), m AS (SELECT id, u AS e FROM x UNION SELECT id, h FROM x UNION SELECT id, i FROM x) SELECT p.e AS a, q.e AS b, count(*) AS count FROM m p JOIN m q ON p.id = q.id AND p.e < q.e GROUP BY 1, 2")


def _any_host(spark: SparkSession, sf: str) -> DataFrame:
    e = entity_events(spark, sf)
    e = replace(e, entities=entities.build(e).for_queries())
    return engine.run(e, "anyhost in (nation_1, NATION_3) and not anyip = 10.0.0.1").events.select("id")


_add("f22_anyhost", _any_host, f"WITH x AS ({_CN}) SELECT id FROM x WHERE h IN ('host|NATION_1', 'host|NATION_3') AND i <> 'ip|10.0.0.1'")

# 2.12: rules

RULES = {
    "plain": ("detection:\n  sel:\n    event_type: purchase\n    user_id|gte: 10\n  condition: sel", "event_type = 'purchase' AND user_id >= 10"),
    "masks": ("detection:\n  sel:\n    event_type:\n      - 'v*'\n      - '*ck'\n  flt:\n    user_id: [1, 2, 3]\n  condition: sel and not flt", "(event_type LIKE 'v%' OR event_type LIKE '%ck') AND user_id NOT IN (1, 2, 3)"),
    "of": ("detection:\n  sel_a:\n    event_type|startswith: err\n  sel_b:\n    event_type|endswith: up\n  condition: 1 of sel_*", "event_type LIKE 'err%' OR event_type LIKE '%up'"),
    "all": ("detection:\n  sel:\n    event_type|contains|all: [u, p]\n  condition: all of them", "event_type LIKE '%u%' AND event_type LIKE '%p%'"),
    "regex": ("detection:\n  sel:\n    event_type|re: ^(view|error)$\n    user_id|lt: 20\n  condition: sel", "event_type IN ('view', 'error') AND user_id < 20"),
    "absent": ("detection:\n  sel:\n    nowhere: null\n    event_type: signup\n  bad:\n    nowhere: x\n  condition: sel and not bad", "event_type = 'signup'"),
}


def rule_set() -> RuleSet:
    return RuleSet(tuple(parse_rule(f"title: {name}\nlevel: high\nauthor: us\nlogsource:\n  product: windows\n{body}\n", name) for name, (body, _) in RULES.items()))


def sigma(spark: SparkSession, sf: str) -> DataFrame:
    found = detections.run(events(spark, sf), rule_set())
    return found.hits.join(found.rules.select("rule", "title"), "rule").select("title", "id")


_add("sg_run", sigma, " UNION ALL ".join(f"SELECT '{name}' AS title, event_id AS id FROM events WHERE {sql}" for name, (_, sql) in RULES.items()))
_add("a06_rule_summary", lambda s, d: detections.run(events(s, d), rule_set()).summary().select("title", "hits"), "SELECT title, count(*) AS hits FROM (" + SQL["sg_run"] + ") GROUP BY 1")


def _rule_query(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf)
    e = detections.attach(e, detections.run(e, rule_set()))
    return engine.run(e, "rule in (plain, 'reg*') and rulelevel >= medium").events.select("id")


_add("f24_rule", _rule_query, f"SELECT event_id AS id FROM events WHERE ({RULES['plain'][1]}) OR ({RULES['regex'][1]})")

# SG-15: a pack of 2,700 rules, of six shapes

PACK = 2700


def pack_rule(r: int) -> str:
    """Rule r of the pack, of shape r mod 6."""
    n, body = r // 6, ""
    match r % 6:
        case 0:
            body = f"sel:\n    event_type: purchase\n    user_id: {n % 97}\n  condition: sel"
        case 1:
            body = f"sel:\n    props|contains: '\"k\": {n % 100}}}'\n    event_type|startswith: [vi, pur]\n  condition: sel"
        case 2:
            body = f"sel:\n    value|endswith: '.{n % 100}'\n  flt:\n    user_id: [1, 2, 3, {n % 50}]\n  condition: sel and not flt"
        case 3:
            body = f"sel_a:\n    event_type: error\n    k: {n % 100}\n  sel_b:\n    props|contains|all: [k, '{n % 90 + 10}']\n  flt_a:\n    user_id|lt: 5\n  flt_b:\n    event_type: click\n    value|startswith: '1'\n  condition: 1 of sel_* and not 1 of flt_*"
        case 4:
            body = f"sel:\n    props|re: ': {n % 10}.}}$'\n    user_id: [{n % 60}, {n % 60 + 1}]\n  condition: sel"
        case 5:
            body = f"sel:\n    user_id|gte: {n % 50 + 10}\n    value|startswith: '{n % 90 + 10}.'\n    event_type: '*ew'\n  condition: sel"
    return f"title: r{r}\nlevel: high\nlogsource:\n  product: windows\ndetection:\n  {body}\n"


_PACK_SQL = f"""WITH e AS (SELECT event_id, event_type, user_id AS u, props, CAST(value AS VARCHAR) AS v, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events), r AS (SELECT r, r // 6 AS n FROM range({PACK}) AS t(r)),
    h(r, id) AS (SELECT r, event_id FROM r JOIN e ON r % 6 = 0 AND event_type = 'purchase' AND u = n % 97
    UNION ALL SELECT r, event_id FROM r JOIN e ON r % 6 = 1 AND contains(props, '"k": ' || (n % 100) || '}}') AND (event_type LIKE 'vi%' OR event_type LIKE 'pur%')
    UNION ALL SELECT r, event_id FROM r JOIN e ON r % 6 = 2 AND suffix(v, '.' || (n % 100)) AND u NOT IN (1, 2, 3) AND u <> n % 50
    UNION ALL SELECT r, event_id FROM r JOIN e ON r % 6 = 3 AND (event_type = 'error' AND k = n % 100 OR contains(props, 'k') AND contains(props, CAST(n % 90 + 10 AS VARCHAR))) AND u >= 5 AND NOT (event_type = 'click' AND v LIKE '1%')
    UNION ALL SELECT r, event_id FROM r JOIN e ON r % 6 = 4 AND props LIKE '%: ' || (n % 10) || '_}}' AND u IN (n % 60, n % 60 + 1)
    UNION ALL SELECT r, event_id FROM r JOIN e ON r % 6 = 5 AND u >= n % 50 + 10 AND v LIKE (n % 90 + 10) || '.%' AND event_type LIKE '%ew')
    SELECT 'r' || r AS title, count(*) AS hits FROM h GROUP BY 1"""


def rule_pack(spark: SparkSession, sf: str) -> DataFrame:
    own = RuleSet(tuple(parse_rule(pack_rule(r), f"r{r}") for r in range(PACK)))
    return rulepack.run(events(spark, sf), own).summary().where("hits > 0").select("title", "hits")


_add("sg15_pack", rule_pack, _PACK_SQL)

# more of rules: every modifier, levels

MODIFIERS = {
    "cidr": ("IpAddress|cidr: 10.3.0.0/16", "n = 3"),
    "cidr_list": ("IpAddress|cidr: [10.1.0.0/16, 10.2.0.0/20]", "n IN (1, 2)"),
    "exists": ("Phone|exists: true", "phone IS NOT NULL"),
    "exists_not": ("Phone|exists: false", "phone IS NULL"),
    "gt": ("Balance|gt: 9000", "bal > 9000"),
    "lte": ("Balance|lte: -900", "bal <= -900"),
    "cased": ("Segment|cased: BUILDING", "seg = 'BUILDING'"),
    "cased_miss": ("Segment|cased: building", "false"),
    "contains_all": ("Segment|contains|all: [mach, ine]", "seg = 'MACHINERY'"),
    "fieldref": ("Key|fieldref: Nation", "k = n"),
    "base64": ("Coded|base64|contains: BUILDING", "seg = 'BUILDING'"),
    "base64offset": ("Shifted|base64offset|contains: HOUSEHOLD", "seg = 'HOUSEHOLD'"),
    "wide": ("Wide|wide|base64offset|contains: FURNITURE", "seg = 'FURNITURE'"),
    "windash": ("Switch|windash|contains: ' -b'", "seg IN ('BUILDING', 'AUTOMOBILE')"),
    "re_i": ("Segment|re|i: ^auto.*e$", "seg = 'AUTOMOBILE'"),
    "single_mask": ("Segment: 'HOUSE?OLD'", "seg = 'HOUSEHOLD'"),
}


def modifier_events(spark: SparkSession, sf: str) -> EventSet:
    seg = F.col("c_mktsegment")
    df = _t(spark, sf, "customer").select(
        "c_custkey", F.format_string("10.%d.0.1", "c_nationkey").alias("IpAddress"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).alias("Phone"), F.col("c_acctbal").alias("Balance"), seg.alias("Segment"),
        F.col("c_custkey").alias("Key"), F.col("c_nationkey").alias("Nation"), F.base64(F.encode(seg, "UTF-8")).alias("Coded"), F.base64(F.encode(F.concat(F.lit("x"), seg), "UTF-8")).alias("Shifted"),
        F.base64(F.encode(seg, "UTF-16LE")).alias("Wide"), F.concat(F.lit("run"), F.when(seg == "BUILDING", " /b").when(seg == "AUTOMOBILE", " -b").otherwise(" +b")).alias("Switch"),
    )
    return EventSet.from_dataframe(df, id="c_custkey", fields=[c for c in df.columns if c != "c_custkey"])


def modifiers(spark: SparkSession, sf: str) -> DataFrame:
    made = tuple(parse_rule(f"title: {name}\nlevel: low\nlogsource:\n  product: windows\ndetection:\n  sel:\n    {body}\n  condition: sel\n", name) for name, (body, _) in MODIFIERS.items())
    found = detections.run(modifier_events(spark, sf), RuleSet(made))
    return found.hits.join(found.rules.select("rule", "title"), "rule").select("title", "id")


_M = "WITH c AS (SELECT c_custkey AS k, c_nationkey AS n, c_acctbal AS bal, c_mktsegment AS seg, CASE WHEN c_custkey % 3 = 0 THEN c_name END AS phone FROM customer)"
_add("sg07_modifiers", modifiers, f"{_M} " + " UNION ALL ".join(f"SELECT '{name}' AS title, k AS id FROM c WHERE {sql}" for name, (_, sql) in MODIFIERS.items()))
_add("a07_rules_by_level", lambda s, d: detections.run(events(s, d), rule_set()).by_level(), "SELECT 'high' AS level, count(DISTINCT title) AS rules FROM (" + SQL["sg_run"] + ") HAVING count(*) > 0")
_add("sg14_rule_hosts", lambda s, d: detections.run(logon_events(s, d), _logon_rules()).summary().select("title", "hits", "hosts", "first_ft", "last_ft"), f"SELECT 'type three' AS title, count(*) AS hits, count(DISTINCT user_id % 3) AS hosts, min({_FT}) AS first_ft, max({_FT}) AS last_ft FROM events WHERE event_type = 'view' AND user_id % 5 = 3")
_add("a06_hit_events", lambda s, d: detections.run(events(s, d), rule_set()).hit_events(), "SELECT count(DISTINCT id) AS n FROM (" + SQL["sg_run"] + ")")


def _logon_rules() -> RuleSet:
    return RuleSet((parse_rule("title: type three\nlevel: low\nlogsource:\n  product: windows\n  service: security\ndetection:\n  sel:\n    EventID: 4624\n    LogonType: 3\n  condition: sel\n", "t"),))


# more of chips, text search, tags, flags and logs

_add("ch01_matching", lambda s, d: (e := events(s, d)).df.where(chips.matching(Compiler(e), "event_type", "VIEW")).select("id"), f"SELECT event_id AS id {_E} WHERE lower(event_type) = 'view'")
_add("ch01_exact", lambda s, d: (e := events(s, d)).df.where(chips.matching(Compiler(e), "event_type", "VIEW", exact=True)).select("id"), f"SELECT event_id AS id {_E} WHERE event_type = 'VIEW'")
_add("ch02_with_field", lambda s, d: chips.with_field(events(s, d), "k").select("id"), f"SELECT event_id AS id {_E} WHERE json_extract_string(props, '$.k') IS NOT NULL")
_add("ch04_log_view", lambda s, d: engine.run(levelled(s, d), chips.log_view(["warning", "info"], [], "event_type = view")).events.select("id"), f"SELECT event_id AS id {_E} WHERE user_id % 6 IN (0, 3, 4) AND event_type = 'view'")
_dql("q05_search", events, "search \"purchase\" | where value > 20", ["id"], f"SELECT event_id AS id {_E} WHERE value > 20 AND (lower(event_type) LIKE '%purchase%' OR lower(props) LIKE '%purchase%')")
_add("q13_filtered", lambda s, d: engine.run(events(s, d), "value > 60 | limit 5").filtered.select("id"), f"SELECT event_id AS id {_E} WHERE value > 60")
_add("q18_group_text", lambda s, d: engine.run(e := events(s, d), engine.drill_text("value > 50 | group by event_type, user_id", {"event_type": "click", "user_id": "7"})).events.select("id"), f"SELECT event_id AS id {_E} WHERE value > 50 AND event_type = 'click' AND user_id = 7")


def levelled(spark: SparkSession, sf: str) -> EventSet:
    return EventSet.from_dataframe(_t(spark, sf, "events").withColumn("lv", F.col("user_id") % 6), id="event_id", time="ts", fields=["event_type"], system={"@Level": "lv"})


def _tagged(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf)
    marks = e.df.where("id % 7 = 0").select("id", F.when(F.col("id") % 2 == 0, "Red").otherwise("blue").alias("colour"), F.lit("").alias("note"))
    return engine.run(replace(e, annotations=marks), "tag = red and not event_type = view").events.select("id")


_add("f23_tag", _tagged, f"SELECT event_id AS id {_E} WHERE event_id % 14 = 0 AND event_type <> 'view'")


def flagged(spark: SparkSession, sf: str) -> DataFrame:
    bits = F.when(F.col("user_id") % 2 == 0, F.lit(BIT["carved"])).otherwise(0).bitwiseOR(F.when(F.col("user_id") % 3 == 0, F.lit(BIT["timeSkew"])).otherwise(0))
    return _t(spark, sf, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("C:\\logs\\Microsoft-Windows-"), "event_type", F.lit("%4Operational.evtx")).alias("source"), bits.alias("flags"))


_FILE = "'C:\\logs\\Microsoft-Windows-' || event_type || '%4Operational.evtx'"
_add("a05_flag_counts", lambda s, d: explore.flag_counts(flagged(s, d)), f"SELECT {_FILE} AS source, flag, count(*) AS count FROM (SELECT event_type, 'carved' AS flag {_E} WHERE user_id % 2 = 0 UNION ALL SELECT event_type, 'timeSkew' {_E} WHERE user_id % 3 = 0) GROUP BY 1, 2")
_add("fn04_flag_names", lambda s, d: flagged(s, d).select("id", F.array_join(flag_names(F.col("flags"), EXPORTED_FLAGS), ",").alias("flags")), f"SELECT event_id AS id, concat_ws(',', CASE WHEN user_id % 2 = 0 THEN 'carved' END, CASE WHEN user_id % 3 = 0 THEN 'timeSkew' END) AS flags {_E}")
_add("fn15_logs", lambda s, d: explore.logs(flagged(s, d)), f"SELECT event_type AS \"group\", 'Microsoft-Windows-' || event_type || '/Operational' AS log, count(*) AS count {_E} GROUP BY ALL")
_add("fn03_levels", lambda s, d: _t(s, d, "events").select("event_id", labels.level_label(F.col("user_id") % 6, F.when(F.col("user_id") % 4 == 1, F.lit(labels.AUDIT_FAILURE)).when(F.col("user_id") % 4 == 2, F.lit(labels.AUDIT_SUCCESS)).otherwise(F.lit(0))).alias("label")), f"SELECT event_id, CASE user_id % 4 WHEN 1 THEN 'audit failure' WHEN 2 THEN 'audit success' ELSE CASE user_id % 6 WHEN 1 THEN 'critical' WHEN 2 THEN 'error' WHEN 3 THEN 'warning' WHEN 5 THEN 'verbose' ELSE 'information' END END AS label {_E}")
_add("fn07_params", lambda s, d: _t(s, d, "events").select("event_id", labels.parameters(F.concat(F.lit("a %%"), (F.col("user_id") % 3 + 1842).cast("string"), F.lit(" b"))).alias("text")), f"SELECT event_id, 'a ' || CASE user_id % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'No' ELSE '%%1844' END || ' b' AS text {_E}")
_add("fn05_describe", lambda s, d: _described(s, d), f"SELECT event_id AS id, CASE event_type WHEN 'view' THEN 'd\\u' || user_id || ' logged on (' || CASE user_id % 3 WHEN 0 THEN 'interactive' WHEN 1 THEN 'network' ELSE 'batch' END || ') from ? ?' WHEN 'error' THEN 'special rights for u' || user_id END AS line {_E} WHERE event_type IN ('view', 'error', 'click')")


def _described(spark: SparkSession, sf: str) -> DataFrame:
    who = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    e = relabelled(spark, sf, {"view": 4624, "error": 4672, "click": 9}, "Security", "Microsoft-Windows-Security-Auditing", {"TargetUserName": who, "SubjectUserName": who, "TargetDomainName": F.lit("d"), "LogonType": (F.col("user_id") % 3 + 2).cast("string")})
    return e.df.select("id", labels.describe(e).alias("line"))


# more of the registry, sessions and processes

_add("en02_registry", lambda s, d: entities.build(entity_events(s, d)).entities.select("entity", "kind", "display", "events"), f"WITH x AS ({_CN}), m AS (SELECT id, u AS entity, 'user' AS kind FROM x UNION ALL SELECT id, h, 'host' FROM x UNION ALL SELECT id, i, 'ip' FROM x) SELECT entity, kind, CASE kind WHEN 'user' THEN (SELECT min(translate(c_name, '#', '')) FROM customer WHERE 'user|name:\\' || lower(translate(c_name, '#', '')) = entity) WHEN 'host' THEN substr(entity, 6) ELSE substr(entity, 4) END AS display, count(DISTINCT id) AS events FROM m GROUP BY 1, 2")
_add("en10_listed", lambda s, d: entities.listed(entities.build(entity_events(s, d)), "host", "1").select("key", "events"), f"WITH x AS ({_CN}) SELECT substr(h, 6) AS key, count(*) AS events FROM x WHERE h LIKE '%1%' GROUP BY 1")
_add("en11_events_of", lambda s, d: entities.events_of(entities.build(entity_events(s, d)), "host|NATION_1", "logging"), f"WITH x AS ({_CN}) SELECT id FROM x WHERE h = 'host|NATION_1'")
_add("en12_links_of", lambda s, d: entities.links_of(entities.build(entity_events(s, d)), "host|NATION_1").select("other", "count"), f"WITH x AS ({_CN}) SELECT other, count(*) AS count FROM (SELECT u AS other FROM x WHERE h = 'host|NATION_1' UNION ALL SELECT i FROM x WHERE h = 'host|NATION_1') GROUP BY 1")
_add("j10_common_events", lambda s, d: entities.common_events(entities.build(entity_events(s, d)), "host|NATION_1", "ip|10.1.0.7"), f"WITH x AS ({_CN}) SELECT id FROM x WHERE h = 'host|NATION_1' AND i = 'ip|10.1.0.7'")
_add("en13_lookup", lambda s, d: entities.lookup(entities.build(entity_events(s, d)), "host", "nation_2").select("entity"), f"WITH x AS ({_CN}) SELECT DISTINCT h AS entity FROM x WHERE h = 'host|NATION_2'")


def sid_events(spark: SparkSession, sf: str) -> EventSet:
    """Customers as logons: every second event names the user without the SID that the others give."""
    df = _t(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("TargetUserName"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("S-1-5-21-1-2-3-"), F.col("o_custkey").cast("string"))).alias("TargetUserSid"))
    return EventSet.from_dataframe(df, id="o_orderkey", fields=["TargetUserName", "TargetUserSid"])


_add("j11_name_to_sid", lambda s, d: entities.build(sid_events(s, d)).entities.select("entity", "display", "events"), "WITH s AS (SELECT DISTINCT o_custkey AS c FROM orders WHERE o_orderkey % 2 = 0) SELECT CASE WHEN c IS NULL THEN 'user|name:\\u' || o_custkey ELSE 'user|sid:S-1-5-21-1-2-3-' || o_custkey END AS entity, 'u' || o_custkey AS display, count(*) AS events FROM orders LEFT JOIN s ON c = o_custkey GROUP BY o_custkey, c")
_add("s09_search", lambda s, d: sessions.search(logons(s, d), "h1", ("host",)).select("id", "host"), f"{_LOGONS} SELECT id, host FROM full_s WHERE host = 'H1'")
_add("s05_totals", lambda s, d: sessions.logon_totals(logon_events(s, d), logons(s, d), boots(s, d)).select("sessions", "closed", "open", "privileged", "unmatched_ends"), f"{_LOGONS} SELECT count(*) AS sessions, count(end_ft) AS closed, count(*) - count(end_ft) AS open, count(*) FILTER (privileged) AS privileged, (SELECT count(*) FROM events WHERE event_type = 'purchase') - count(end_ft) AS unmatched_ends FROM full_s")
_add("s04_durations", lambda s, d: logons(s, d).select("id", "duration", "user", "privileged"), f"{_LOGONS} SELECT id, end_ft - start_ft AS duration, CAST(NULL AS VARCHAR) AS user, privileged FROM full_s")
_add("s06_rdp_steps", lambda s, d: sessions.rdp_chains(rdp_events(s, d)).select("host", "session", "start_ft", F.array_join(F.transform("events", lambda x: x.cast("string")), ",").alias("ids")), f"""WITH e AS (SELECT event_id AS id, {_FT} AS t, 'H' || (user_id % 3) AS host, CAST(user_id % 5 AS VARCHAR) AS session, CASE event_type WHEN 'signup' THEN 21 WHEN 'purchase' THEN 23 ELSE 22 END AS n FROM events WHERE event_type IN ('signup', 'view', 'click', 'error', 'purchase')),
    p AS (SELECT *, lag(n) OVER (PARTITION BY host, session ORDER BY t, id) AS b FROM e), c AS (SELECT *, sum(CASE WHEN n = 21 OR b IS NULL OR b = 23 THEN 1 ELSE 0 END) OVER (PARTITION BY host, session ORDER BY t, id) AS chain FROM p)
    SELECT host, session, min(t) AS start_ft, string_agg(CAST(id AS VARCHAR), ',' ORDER BY t, id) AS ids FROM c GROUP BY host, session, chain""")  # fmt: skip
_add("pt01_repeats", lambda s, d: proctree.sysmon_nodes(repeated_processes(s, d)).where("not synthetic").select("key", "id", "repeats"), "SELECT upper('g' || (o_custkey)) AS key, min(o_orderkey) AS id, count(*) - 1 AS repeats FROM orders GROUP BY o_custkey")
_add("pt09_search", lambda s, d: proctree.search_paths(proctree.sysmon_nodes(sysmon_events(s, d)), "\\P12", None).select("key", "depth"), f"{_TREE} SELECT CAST(k AS VARCHAR) AS key, depth FROM w WHERE k IN (SELECT k FROM c) AND CAST(k AS VARCHAR) LIKE '12%'")


def repeated_processes(spark: SparkSession, sf: str) -> EventSet:
    """Orders as creations of one process per customer."""
    df = _t(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("g"), F.col("o_custkey").cast("string")).alias("ProcessGuid"), F.lit(1).alias("n"), F.lit(proctree.SYSMON).alias("channel"), F.lit("H").alias("computer"), F.timestamp_seconds(F.col("o_orderkey") + 1_700_000_000).alias("at"))
    return EventSet.from_dataframe(df, id="o_orderkey", time="at", fields=["ProcessGuid"], system={"@EventID": F.col("n"), "@Channel": "channel", "@Computer": "computer"})


def copied(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as records: lines of one order are copies of one record from several sources."""
    return _t(spark, sf, "lineitem").select(F.lit(5).cast("bigint").alias("ts_ft"), F.lit("Pc").alias("computer"), F.lit("Log").alias("channel"), F.col("l_orderkey").alias("record_id"), F.lit(1).alias("event_id"), F.when(F.col("l_linenumber") == 1, F.lit(BIT["carved"])).otherwise(0).alias("flags"), F.col("l_linenumber").alias("source_id"), F.lit(0).alias("chunk"), F.col("l_partkey").alias("off"))


def _merged(spark: SparkSession, sf: str) -> DataFrame:
    from .sources.ingest import merge_copies

    first, copies = merge_copies(copied(spark, sf))
    cols = [F.col("record_id").cast("bigint").alias("record_id"), F.col("source_id").cast("int").alias("source_id")]
    marked = F.col("flags").bitwiseAND(F.lit(BIT["hasCopies"])) != 0
    return first.select(*cols, F.lit(True).alias("kept"), marked.alias("marked")).unionByName(copies.select(*cols, F.lit(False).alias("kept"), F.lit(False).alias("marked")))


_add("ing03_merge", _merged, "WITH r AS (SELECT l_orderkey AS record_id, l_linenumber AS source_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber = 1, l_linenumber, l_partkey) AS i, count(*) OVER (PARTITION BY l_orderkey) AS c FROM lineitem) SELECT record_id, source_id, i = 1 AS kept, i = 1 AND c > 1 AS marked FROM r")

# SRC-19: ids by a distributed sort


def _numbered(spark: SparkSession, sf: str) -> DataFrame:
    return EventSet.from_dataframe(_t(spark, sf, "orders"), time="o_orderdate").df.select("id", "o_orderkey")


_add("src19_numbered", _numbered, "SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey, o_custkey) - 1 AS id, o_orderkey FROM orders")


def _more() -> None:
    from . import catalog_more  # registers its queries with _add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _more()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _more()
    return dict(SQL)
