"""Registry of hosts, users and addresses: roles, names, links."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import domain_key, host_key, is_builtin, split_user, valid_sid
from ..functions.net import ip_key_of
from ..model import EventSet
from ..stages import stored

# Fields that name entities, and the role they give.
USERS = (
    ("TargetUserName", "TargetDomainName", "TargetUserSid", "target"), ("SubjectUserName", "SubjectDomainName", "SubjectUserSid", "subject"), ("TargetOutboundUserName", "TargetOutboundDomainName", None, "target"),
    ("AccountName", "AccountDomain", None, "account"), ("User", None, None, "subject"), ("ParentUser", None, None, "subject"),
)
HOSTS = (("@Computer", "logging"), ("WorkstationName", "source"), ("Workstation", "source"), ("ClientName", "source"), ("SourceHostname", "source"), ("DestinationHostname", "destination"), ("TargetServerName", "destination"))
ADDRESSES = (("IpAddress", "source"), ("ClientAddress", "source"), ("SourceIp", "source"), ("SourceAddress", "source"), ("Address", "source"), ("ClientIP", "source"), ("DestinationIp", "destination"), ("DestAddress", "destination"))
ROLES = ("logging", "source", "target", "subject", "account", "destination", "system")
MOST_LINKED = 12
MOST_RENAMES = 16


@dataclass(frozen=True)
class Registry:
    """entities(entity, kind, key, display, domain, sid, aliases, builtin, events, first_ft, last_ft), mentions(entity, kind, role, id, ts_ft), links(a, b, count, first_ft, last_ft)."""

    entities: DataFrame
    mentions: DataFrame
    links: DataFrame

    def for_queries(self) -> DataFrame:
        """(kind, names, id): what conditions on anyhost, anyuser and anyip look at."""
        names = self.entities.select("entity", F.transform(F.array_distinct(F.concat(F.array("key", "display", F.coalesce("sid", F.lit(""))), "aliases")), F.lower).alias("names"))
        return self.mentions.select("entity", "kind", "id").distinct().join(names, "entity").select("kind", "names", "id")


def _last(events: EventSet, field: str | None) -> Column:
    """Last value of a field, trimmed."""
    if field is None or field not in events.keys:
        return F.lit(None).cast("string")
    key = events.keys[field]
    return F.trim(F.when(F.size(key.text) > 0, F.element_at(key.text, -1)) if key.many else key.text)


def raw_mentions(events: EventSet) -> DataFrame:
    """(id, ts_ft, kind, role, raw, domain, sid): everything that names an entity, one row each; one pass over the events."""
    cell = lambda kind, role, raw, domain=None, sid=None: F.struct(F.lit(kind).alias("kind"), F.lit(role).alias("role"), raw.alias("raw"), (F.lit(None).cast("string") if domain is None else domain).alias("domain"), (F.lit(None).cast("string") if sid is None else sid).alias("sid"))
    cells = [cell("user", role, _last(events, n), _last(events, d), _last(events, s)) for n, d, s, role in USERS if n in events.keys or (s or "") in events.keys]
    cells += [cell("host", role, _last(events, f)) for f, role in HOSTS if f in events.keys]
    cells += [cell("ip", role, _last(events, f)) for f, role in ADDRESSES if f in events.keys]
    if "@UserID" in events.keys:
        cells.append(cell("user", "system", F.lit(None).cast("string"), None, _last(events, "@UserID")))
    if {"Param1", "Param2", "Param3"} <= events.keys.keys() and "@EventID" in events.keys:
        remote = (events.keys["@EventID"].first == "1149") & F.lower(events.raw("@Channel")).contains("remoteconnectionmanager")
        cells += [cell("user", "target", F.when(remote, _last(events, "Param1")), F.when(remote, _last(events, "Param2"))), cell("ip", "source", F.when(remote, _last(events, "Param3")))]
    rows = events.df.select("id", events.time.alias("ts_ft"), F.inline(F.array(*cells)))
    return rows.where("raw is not null or sid is not null")


def renames(events: EventSet) -> DataFrame | None:
    """(old, final) of host keys that rename events gave another name; of several new names the last in time counts.

    A host may be renamed many times: the names that follow one another are joined four times, each time twice as far, up to
    MOST_RENAMES names. A circle of names ends there too.
    """
    if "Data" not in events.keys or "@EventID" not in events.keys:
        return None
    data = events.keys["Data"]
    own = events.df.where((events.keys["@EventID"].first == "6011") & (F.lower(events.raw("@Provider")) == "eventlog"))
    pairs = own.select("id", host_key(F.get(data.text, F.lit(0))).alias("old"), host_key(F.get(data.text, F.lit(1))).alias("new")).where("old <> new")
    table = stored(pairs.groupBy("old").agg(F.max_by("new", "id").alias("final")), "renames")
    if table.isEmpty():
        return None
    hops = 1
    while hops < MOST_RENAMES:
        ahead = table.select(F.col("old").alias("final"), F.col("final").alias("_next"))
        table = stored(table.join(ahead, "final", "left").select("old", F.coalesce("_next", "final").alias("final")), "renames")
        hops *= 2
    return table


def build(events: EventSet) -> Registry:
    """The registry of all events. Mentions are written once, as found and as resolved; everything else reads those narrow tables."""
    raw = stored(raw_mentions(events), "mentions")
    moved = renames(events)
    host = host_key(F.col("raw"))
    machine = (F.col("kind") == "user") & F.col("raw").endswith("$")
    hosts = raw.where((F.col("kind") == "host") | machine).select("id", "ts_ft", F.lit("host").alias("kind"), F.when(machine, F.lit("account")).otherwise(F.col("role")).alias("role"), host.alias("key"), host.alias("name"), F.lit(None).cast("string").alias("domain"), F.lit(None).cast("string").alias("sid")).where("key is not null")
    if moved is not None:
        hosts = hosts.join(moved, hosts["key"] == moved["old"], "left").withColumn("key", F.coalesce("final", "key")).drop("old", "final")
    ips = raw.where("kind = 'ip'").withColumn("key", ip_key_of(F.col("raw"))).where("key is not null").select("id", "ts_ft", "kind", "role", "key", F.col("key").alias("name"), F.lit(None).cast("string").alias("domain"), F.lit(None).cast("string").alias("sid"))
    inner = F.nullif(F.regexp_extract("raw", r"^%\{(S-1-[0-9-]+)\}$", 1), F.lit(""))
    name, domain = split_user(F.when(inner.isNull(), F.col("raw")), F.col("domain"))
    users = raw.where((F.col("kind") == "user") & ~F.coalesce(machine, F.lit(False))).select("id", "ts_ft", "role", name.alias("name"), domain.alias("domain"), F.coalesce(inner, F.when(valid_sid(F.col("sid")), F.col("sid"))).alias("sid")).where("name is not null or sid is not null")
    # a name without SID takes the only SID seen with it; a name without domain the only domain seen with it
    low = F.lower("name")
    sids = users.where("name is not null and sid is not null").groupBy(low.alias("low")).agg(F.min("sid").alias("only"), F.count_distinct("sid").alias("n")).where("n = 1").select("low", "only")
    domains = users.where("name is not null and sid is null and domain is not null").groupBy(low.alias("low")).agg(F.min("domain").alias("only_domain"), F.count_distinct("domain").alias("n")).where("n = 1").select("low", "only_domain")
    users = users.withColumn("low", low).join(sids, "low", "left").join(domains, "low", "left")
    sid = F.coalesce("sid", "only")
    key = F.when(sid.isNotNull(), F.concat(F.lit("sid:"), sid)).otherwise(F.concat(F.lit("name:"), F.coalesce("domain", "only_domain", F.lit("")), F.lit("\\"), F.col("low")))
    users = users.select("id", "ts_ft", F.lit("user").alias("kind"), "role", key.alias("key"), "name", "domain", sid.alias("sid"))
    rows = stored(hosts.unionByName(ips).unionByName(users).withColumn("entity", F.concat("kind", F.lit("|"), "key")), "resolved")
    return Registry(_entities(rows), rows.select("entity", "kind", "role", "id", "ts_ft").distinct(), links(rows))


def _entities(rows: DataFrame) -> DataFrame:
    votes = rows.where("name is not null").groupBy("entity", "name").agg(F.count("*").alias("n"))
    most = F.min_by("name", F.struct(-F.col("n"), F.col("name")))  # the most votes, then the smallest name
    shown = votes.groupBy("entity").agg(most.alias("voted"), F.array_sort(F.collect_set("name")).alias("aliases"))
    base = rows.groupBy("entity", "kind", "key").agg(F.count_distinct("id").alias("events"), F.min("ts_ft").alias("first_ft"), F.max("ts_ft").alias("last_ft"), F.max("domain").alias("domain"), F.max("sid").alias("sid"))
    out = base.join(shown, "entity", "left")
    display = F.coalesce("voted", F.regexp_replace("key", "^(sid|name):", ""))
    return out.select("entity", "kind", "key", display.alias("display"), "domain", "sid", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), is_builtin(F.col("voted"), F.col("domain"), F.col("sid")).alias("builtin"), "events", "first_ft", "last_ft")


def links(rows: DataFrame) -> DataFrame:
    """Pairs of entities in one event, where it names 2 to MOST_LINKED of them: different kinds, or two hosts."""
    each = rows.groupBy("id").agg(F.min("ts_ft").alias("ts_ft"), F.array_sort(F.collect_set(F.struct("entity", "kind"))).alias("e")).where(F.size("e").between(2, MOST_LINKED))
    pairs = each.select("ts_ft", F.explode("e").alias("a"), "e").select("ts_ft", "a", F.explode("e").alias("b")).where((F.col("a.entity") < F.col("b.entity")) & ((F.col("a.kind") != F.col("b.kind")) | (F.col("a.kind") == "host")))
    return pairs.groupBy(F.col("a.entity").alias("a"), F.col("b.entity").alias("b")).agg(F.count("*").alias("count"), F.min("ts_ft").alias("first_ft"), F.max("ts_ft").alias("last_ft"))


def roles(mentions: DataFrame) -> DataFrame:
    """Events by entity and role; mentions name an event once for each."""
    return mentions.groupBy("entity", "role").agg(F.count("*").alias("events"), F.min("ts_ft").alias("first_ft"), F.max("ts_ft").alias("last_ft"))


def listed(registry: Registry, kind: str, text: str = "", hide_builtin: bool = False) -> DataFrame:
    rows = registry.entities.where(F.col("kind") == kind)
    if text:
        rows = rows.where(F.contains(F.lower("display"), F.lower(F.lit(text))) | F.exists("aliases", lambda a: F.contains(F.lower(a), F.lower(F.lit(text)))) | F.contains(F.lower("key"), F.lower(F.lit(text))))
    return (rows.where("not builtin") if hide_builtin else rows).orderBy(F.desc("events"), "display")


def events_of(registry: Registry, entity: str, role: str | None = None) -> DataFrame:
    rows = registry.mentions.where(F.col("entity") == entity)
    return (rows.where(F.col("role") == role) if role else rows).select("id").distinct()


def links_of(registry: Registry, entity: str) -> DataFrame:
    own = registry.links
    return own.where(F.col("a") == entity).select(F.col("b").alias("other"), "count", "first_ft", "last_ft").unionAll(own.where(F.col("b") == entity).select("a", "count", "first_ft", "last_ft")).orderBy(F.desc("count"), "other")


def common_events(registry: Registry, a: str, b: str) -> DataFrame:
    return events_of(registry, a).join(events_of(registry, b), "id", "left_semi")


def lookup(registry: Registry, kind: str, text: str) -> DataFrame:
    """Entities that a user's text names: by key, SID, display, alias, or domain and name."""
    low, spark = text.strip().lower(), registry.entities.sparkSession
    keys = [low]
    one = spark.range(1).select(host_key(F.lit(text)).alias("h"), domain_key(F.lit(text.split("\\")[0])).alias("d"), ip_key_of(F.lit(text)).alias("i")).first()
    if kind == "host" and one["h"]:
        keys.append(one["h"].lower())
    if kind == "ip":
        keys.append(one["i"] or low)
    hit = F.lower("key").isin(*keys) | (F.lower("sid") == low) | (F.lower("display") == low) | F.exists("aliases", lambda a: F.lower(a) == low)
    if kind == "user" and "\\" in text:
        hit = F.coalesce(hit, F.lit(False)) | (F.exists("aliases", lambda a: F.lower(a) == low.split("\\", 1)[1]) & (F.col("domain") == (one["d"] or "")))
    return registry.entities.where((F.col("kind") == kind) & F.coalesce(hit, F.lit(False)))
