"""Boots, logon sessions and remote-desktop chains, by windows instead of loops over events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import parameters
from ..functions.names import host_key
from ..functions.timeparse import SECOND
from ..model import EventSet
from .running import Running, lag, running

BOOT_GAP = 300 * SECOND
RDP_CHANNEL = "Microsoft-Windows-TerminalServices-LocalSessionManager/Operational"
ARROW = " → "
RDP_STEPS = {21: "21 logon", 22: "22 shell", 23: "23 logoff", 24: "24 disconnect", 25: "25 reconnect", 39: "39 replaced by another session"}


def event_id(events: EventSet) -> Column:
    key = events.keys["@EventID"]
    return key.number if key.number is not None else key.first.try_cast("bigint")


def on_channel(events: EventSet, *channels: str) -> Column:
    return F.lower(events.raw("@Channel")).isin(*[c.lower() for c in channels])


def boot_times(events: EventSet, gap: int = BOOT_GAP) -> DataFrame:
    """host, boots: times of start events, each more than the gap after the last one kept.

    Keeping is anchored, so a fold over a host's sorted times decides; a host has few of them.
    """
    n, provider, channel = event_id(events), F.lower(events.raw("@Provider")), F.lower(events.raw("@Channel"))
    starts = (n == 12) & (provider == "microsoft-windows-kernel-general") | (n == 6005) & (provider == "eventlog") | (n == 4608) & (channel == "security")
    rows = events.df.where(starts).select(host_key(events.raw("@Computer")).alias("host"), events.time.alias("t")).where("host is not null")
    keep = lambda kept, t: F.when((F.size(kept) == 0) | (t - F.element_at(kept, -1) > gap), F.array_append(kept, t)).otherwise(kept)
    none = F.array().cast("array<bigint>")
    fold = F.aggregate(F.array_sort(F.collect_list("t")), none, lambda kept, t: F.when(F.size(kept) == 0, F.array(t)).otherwise(keep(kept, t)))
    return rows.groupBy("host").agg(fold.alias("boots"))


def with_boot(rows: DataFrame, boots: DataFrame, time: str = "ts_ft", host: str = "host") -> DataFrame:
    """Add boot: how many boots of the host lie at or before the event. One row per host is joined."""
    own = boots.withColumnRenamed("host", "_h")
    joined = rows.join(own, rows[host] == F.col("_h"), "left").drop("_h")
    return joined.withColumn("boot", F.coalesce(F.size(F.filter("boots", lambda b: b <= F.col(time))), F.lit(0))).drop("boots")


#: Details of a logon and the fields that hold them.
DETAILS = {
    "sid": "TargetUserSid", "type": "LogonType", "workstation": "WorkstationName", "ip": "IpAddress", "package": "AuthenticationPackageName",
    "process": "LogonProcessName", "elevated": "ElevatedToken", "linked": "TargetLinkedLogonId", "name": "TargetUserName", "domain": "TargetDomainName",
}


def logon_rows(events: EventSet, boots: DataFrame) -> DataFrame:
    """Starts (kind s), ends (e) and privileges (p) of logons, with key: host, boot and logon id. It holds no state, so a stream may be read too."""
    n = event_id(events)
    kind = F.when(n == 4624, "s").when(n.isin(4634, 4647), "e").when(n == 4672, "p")
    logon = F.when(n == 4672, events.value("SubjectLogonId")).otherwise(events.value("TargetLogonId"))
    rows = events.df.where(on_channel(events, "Security") & kind.isNotNull())
    rows = rows.select("id", events.time.alias("ts_ft"), kind.alias("kind"), F.coalesce(host_key(events.raw("@Computer")), F.upper(events.raw("@Computer"))).alias("host"), F.lower(logon).alias("logon"), *[events.value(f).alias(c) for c, f in DETAILS.items()])
    return with_boot(rows.where("logon is not null"), boots).withColumn("key", F.concat_ws("|", "host", F.col("boot").cast("string"), "logon"))


def logons(events: EventSet, boots: DataFrame | None = None) -> DataFrame:
    """Logon sessions with their end: each start takes the earliest unused end at or after it, in order of start.

    With the starts of a key numbered i and its ends k, and lb the ends before start i, start i takes end
    i + max(lb(j) - j, j <= i): a running maximum instead of a loop.
    """
    rows = logon_rows(events, boot_times(events) if boots is None else boots)
    # ends of one time as a start come after it, so that they can end it
    order = ["ts_ft", F.when(F.col("kind") == "s", 0).otherwise(1), "id"]
    is_end = F.when(F.col("kind") == "e", 1).otherwise(0)
    both = running(rows.where("kind <> 'p'"), ["key"], order, [Running("lb", "sum", is_end, before=True), Running("sb", "sum", 1 - is_end, before=True)])
    both = both.withColumns({"lb": F.coalesce("lb", F.lit(0)), "i": F.coalesce(F.when(F.col("kind") == "s", F.col("sb")).otherwise(F.col("lb")), F.lit(0))})
    starts = running(both.where("kind = 's'"), ["key"], ["ts_ft", "id"], [Running("k", "max", F.col("lb") - F.col("i"))]).withColumn("k", F.col("k") + F.col("i"))
    ends = both.where("kind = 'e'").select("key", F.col("i").alias("k"), F.col("ts_ft").alias("end_ft"), F.col("id").alias("end_id"))
    privileged = rows.where("kind = 'p'").select("key", F.lit(True).alias("privileged")).distinct()
    out = starts.join(ends, ["key", "k"], "left").join(privileged, "key", "left")
    user = F.when(F.col("domain").isNotNull(), F.concat("domain", F.lit("\\"), "name")).otherwise(F.col("name"))
    return out.select(
        "id", "host", F.col("logon").alias("logon_id"), user.alias("user"), "sid", "type", "workstation", F.regexp_replace("ip", "(?i)^::ffff:", "").alias("ip"), "package", "process",
        parameters(F.col("elevated")).alias("elevated"), "linked", F.col("ts_ft").alias("start_ft"), "end_ft", "end_id", "boot", (F.col("end_ft") - F.col("ts_ft")).alias("duration"), F.coalesce("privileged", F.lit(False)).alias("privileged"),
    )


def logon_totals(events: EventSet, sessions: DataFrame, boots: DataFrame | None = None) -> DataFrame:
    """One row: sessions, closed, open, privileged, ends without a start, hosts without a boot."""
    boots = boot_times(events) if boots is None else boots
    n = event_id(events)
    ends = events.df.where(on_channel(events, "Security") & n.isin(4634, 4647) & events.value("TargetLogonId").isNotNull()).agg(F.count("*").alias("ends"))
    sums = sessions.agg(F.count("*").alias("sessions"), F.count("end_ft").alias("closed"), F.count_if("privileged").alias("privileged"))
    unknown = sessions.select("host").distinct().join(boots, "host", "left_anti").agg(F.count("*").alias("hosts_without_boot"))
    row = {**sums.first().asDict(), **ends.first().asDict(), **unknown.first().asDict()}
    row |= {"open": row["sessions"] - row["closed"], "unmatched_ends": row.pop("ends") - row["closed"]}
    return events.df.sparkSession.createDataFrame([row])


def by_type(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("type").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "type")


def rdp_chains(events: EventSet) -> DataFrame:
    """Remote-desktop chains per computer and session: 21 starts one, 23 ends it, all else continues it."""
    n = event_id(events)
    session = F.coalesce(events.value("SessionID"), events.value("Session"), F.lit("?"))
    rows = events.df.where(on_channel(events, RDP_CHANNEL) & n.isin(21, 22, 23, 24, 25, 39, 40))
    step = F.when(n == 40, F.concat(F.lit("40 disconnect (code "), F.coalesce(events.value("Reason"), F.lit("?")), F.lit(")")))
    for k, v in RDP_STEPS.items():
        step = step.when(n == k, v)
    rows = rows.select("id", events.time.alias("ts_ft"), n.alias("n"), events.raw("@Computer").alias("host"), session.alias("session"), events.value("User").alias("u"), events.value("Address").alias("a"), step.alias("step"))
    rows = running(rows, ["host", "session"], ["ts_ft", "id"], [lag("before", F.col("n"))])
    before = F.col("before.v")
    begins = F.when((F.col("n") == 21) | before.isNull() | (before == 23), 1).otherwise(0)
    rows = running(rows, ["host", "session"], ["ts_ft", "id"], [Running("chain", "sum", begins)])
    event = F.struct("ts_ft", "id", "step", "u", "a", "n")
    chains = rows.groupBy("host", "session", "chain").agg(F.array_sort(F.collect_list(event)).alias("e"))
    first = lambda c: F.coalesce(F.get(F.filter(F.transform("e", lambda x: x[c]), lambda v: v.isNotNull()), F.lit(0)), F.lit("?"))
    last = F.element_at("e", -1)
    return chains.select(
        "host", "session", first("u").alias("user"), first("a").alias("address"), F.element_at("e", 1)["ts_ft"].alias("start_ft"), F.when(last["n"] == 23, last["ts_ft"]).alias("end_ft"),
        F.transform("e", lambda x: x["id"]).alias("events"), F.array_join(F.transform("e", lambda x: x["step"]), ARROW).alias("steps"),
    )


def search(sessions: DataFrame, text: str, columns: tuple[str, ...] = ("user", "host", "workstation", "ip", "logon_id", "type")) -> DataFrame:
    """Sessions with the text in one of the columns."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(c), F.lower(F.lit(text))), F.lit(False))
    return sessions.where(hit)


def session_query(session: dict) -> str:
    """The query for all events of a logon session: its host, its id in any logon-id field, its time."""
    from ..functions.timeparse import iso
    from ..plans import printer

    fields = ("TargetLogonId", "SubjectLogonId", "LogonId", "TargetLinkedLogonId")
    logon = " or ".join(f"{f} = {printer.value(session['logon_id'])}" for f in fields)
    end = f' and time <= "{iso(session["end_ft"])}"' if session.get("end_ft") is not None else ""
    return f'host = {printer.value(session["host"] + "*")} and ({logon}) and time >= "{iso(session["start_ft"])}"{end}'
