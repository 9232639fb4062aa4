"""Process trees: exact edges by process GUID, and the process id heuristic of the Security log."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import host_key
from ..functions.text import number
from ..model import EventSet
from ..stages import stored
from .running import Running, running
from .sessions import boot_times, event_id, on_channel, with_boot

SYSMON = "Microsoft-Windows-Sysmon/Operational"
PATH = " › "
NO_NAME = "(unknown)"


def image_name(image: Column) -> Column:
    return F.coalesce(F.nullif(F.element_at(F.split(image, r"[\\/]"), -1), F.lit("")), F.lit(NO_NAME))


NODES = ("key", "parent", "host", "pid", "image", "command_line", "user", "start_ft", "end_ft", "id", "synthetic", "linked_by_pid", "repeats")


def _nodes(df: DataFrame, **columns: Column) -> DataFrame:
    kinds = {"pid": "bigint", "start_ft": "bigint", "end_ft": "bigint", "id": "bigint", "synthetic": "boolean", "linked_by_pid": "boolean", "repeats": "bigint"}
    return df.select(*[columns.get(c, F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in NODES])


def sysmon_nodes(events: EventSet) -> DataFrame:
    """Nodes by GUID: the first creation counts, repeats are numbered; unknown parents become one synthetic node each."""
    n = event_id(events)
    rows = events.df.where(on_channel(events, SYSMON))
    created = rows.where(n == 1).select(
        "id", events.time.alias("start_ft"), F.upper(events.value("ProcessGuid")).alias("key"), F.upper(events.value("ParentProcessGuid")).alias("parent"), events.raw("@Computer").alias("host"), number(events.value("ProcessId")).alias("pid"),
        events.value("Image").alias("image"), events.value("CommandLine").alias("command_line"), events.value("User").alias("user"), events.value("ParentImage").alias("p_image"), events.value("ParentCommandLine").alias("p_line"), number(events.value("ParentProcessId")).alias("p_pid"),
    ).where("key is not null")
    first = created.groupBy("key").agg(F.min_by(F.struct(*[c for c in created.columns if c != "key"]), "id").alias("x"), (F.count("*") - 1).alias("repeats")).select("key", "x.*", "repeats")
    ended = rows.where(n == 5).select("id", F.upper(events.value("ProcessGuid")).alias("key"), events.time.alias("t")).where("key is not null").groupBy("key").agg(F.max_by("t", "id").alias("end_ft"))
    first = first.join(ended, "key", "left").withColumn("parent", F.when(F.col("parent") != F.col("key"), F.col("parent")))
    lost = first.where("parent is not null").join(first.select(F.col("key").alias("parent")), "parent", "left_anti")
    made = lost.groupBy("parent").agg(F.min_by(F.struct("host", "p_image", "p_line", "p_pid"), "id").alias("x"), F.min("id").alias("id")).select(F.col("parent").alias("key"), "x.*", "id")
    real = _nodes(first, **{c: F.col(c) for c in ("key", "parent", "host", "pid", "image", "command_line", "user", "start_ft", "end_ft", "id", "repeats")}, synthetic=F.lit(False), linked_by_pid=F.lit(False))
    return real.unionByName(_nodes(made, key=F.col("key"), host=F.col("host"), pid=F.col("p_pid"), image=F.col("p_image"), command_line=F.col("p_line"), id=F.col("id"), synthetic=F.lit(True), linked_by_pid=F.lit(False), repeats=F.lit(0)))


def pid_nodes(events: EventSet, boots: DataFrame | None = None) -> DataFrame:
    """Nodes of creations 4688 and exits 4689. A parent is the latest earlier creation with the parent's id on the
    same host and boot that had not ended; otherwise a synthetic node per host, boot, image and id.
    """
    boots = boot_times(events) if boots is None else boots
    n = event_id(events)
    made, gone = n == 4688, n == 4689
    rows = events.df.where(on_channel(events, "Security") & (made | gone)).select(
        "id", events.time.alias("ts_ft"), F.when(made, "c").otherwise("x").alias("kind"), F.coalesce(host_key(events.raw("@Computer")), F.upper(events.raw("@Computer"))).alias("host"),
        F.when(made, number(events.value("NewProcessId"))).otherwise(number(events.value("ProcessId"))).alias("pid"), F.when(made, number(events.value("ProcessId"))).alias("ppid"), F.when(made, events.value("NewProcessName")).alias("image"),
        events.value("ParentProcessName").alias("p_image"), events.value("CommandLine").alias("command_line"), events.value("SubjectUserName").alias("user"),
    )
    rows = with_boot(rows, boots)
    # backwards in time, so that the next exit is the last one seen: a running value, not a search for each row. The first exit
    # at or after a start: later creations of the id do not matter
    ahead = [F.desc("ts_ft"), F.when(F.col("kind") == "c", 1).otherwise(0), F.desc("id")]
    rows = running(rows, ["host", "boot", "pid"], ahead, [Running("exit_ft", "last", F.when(F.col("kind") == "x", F.col("ts_ft")), before=True)])
    rows = rows.withColumn("end_ft", F.when(F.col("kind") == "c", F.col("exit_ft"))).drop("exit_ft")
    created = rows.where("kind = 'c'")
    marks = created.select("host", "boot", F.col("pid").alias("p"), "ts_ft", "id", F.struct(F.col("id").alias("id"), "end_ft").alias("made"), F.lit(None).cast("bigint").alias("child"))
    probes = created.where("ppid is not null").select("host", "boot", F.col("ppid").alias("p"), "ts_ft", "id", F.lit(None).cast("struct<id:bigint,end_ft:bigint>").alias("made"), F.col("id").alias("child"))
    order = ["ts_ft", "id", F.when(F.col("child").isNotNull(), 0).otherwise(1)]
    found = running(marks.unionByName(probes), ["host", "boot", "p"], order, [Running("last", "last", F.col("made"), before=True)]).where("child is not null")
    alive = F.when(F.col("last.end_ft").isNull() | (F.col("last.end_ft") >= F.col("ts_ft")), F.col("last.id"))
    nodes = created.join(found.select(F.col("child").alias("id"), alive.alias("parent_id")), "id", "left")
    synthetic = F.concat_ws("|", F.lit("synthetic"), "host", F.col("boot").cast("string"), F.coalesce(F.lower("p_image"), F.lit("")), F.col("ppid").cast("string"))
    parent = F.when(F.col("parent_id").isNotNull(), F.concat(F.lit("pid|"), F.col("parent_id").cast("string"))).when(F.col("ppid").isNotNull(), synthetic)
    nodes = nodes.withColumn("parent", parent)
    real = _nodes(nodes, key=F.concat(F.lit("pid|"), F.col("id").cast("string")), **{c: F.col(c) for c in ("parent", "host", "pid", "image", "command_line", "user", "end_ft", "id")}, start_ft=F.col("ts_ft"), synthetic=F.lit(False), linked_by_pid=F.col("parent_id").isNotNull(), repeats=F.lit(0))
    lost = nodes.where("parent_id is null and parent is not null").groupBy("parent").agg(F.min_by(F.struct("host", "ppid", "p_image"), "id").alias("x"), F.min("id").alias("id"))
    return real.unionByName(_nodes(lost, key=F.col("parent"), host=F.col("x.host"), pid=F.col("x.ppid"), image=F.col("x.p_image"), id=F.col("id"), synthetic=F.lit(True), linked_by_pid=F.lit(False), repeats=F.lit(0)))


@dataclass(frozen=True)
class Walk:
    """What doubling found: ``tree`` (key, depth, root) of the nodes below a root, and ``jumps[k]`` (key, up), up the node 2^k above."""

    tree: DataFrame
    jumps: tuple[DataFrame, ...]


def steps(nodes: DataFrame) -> DataFrame:
    """(key, parent, name, step): step sorts a node among its siblings, by start, or its earliest child's where it has none, and id."""
    rows = nodes.select("key", "parent", image_name(F.col("image")).alias("name"), "start_ft", "id")
    kids = rows.where("parent is not null and start_ft is not null").groupBy(F.col("parent").alias("key")).agg(F.min("start_ft").alias("kid_ft"))
    rows = rows.join(kids, "key", "left")
    time = F.lpad(F.coalesce("start_ft", "kid_ft", F.lit(0)).cast("string"), 20, "0")
    return rows.select("key", "parent", "name", F.concat(time, F.lit("."), F.lpad(F.col("id").cast("string"), 12, "0")).alias("step"))


#: How the texts of a part of a path and of what is above it join: column and separator.
_TEXTS = {"path": ("name", PATH), "order": ("step", "/")}
#: Open nodes that are walked by doubling at once; each round of more would move all of them.
FEW = 500_000


def _state(rows: DataFrame, texts: bool) -> tuple[DataFrame, list[str]]:
    said = {out: F.col(c).alias(out) for out, (c, _) in _TEXTS.items()} if texts else {}
    return rows.select("key", F.col("parent").alias("up"), F.col("parent").isNotNull().cast("bigint").alias("depth"), *said.values()), list(said)


def _below(said: list[str]) -> list[Column]:
    """Texts of a part of a path below those of the part above it."""
    return [F.concat(f"_{c}", F.lit(_TEXTS[c][1]), c).alias(c) for c in said]


def _doubled(state: DataFrame, said: list[str]) -> Walk:
    state = stored(state, "tree")
    met, open_ = [state.where("up is null")], state.where("up is not null")
    left, jumps = open_.count(), []
    while left:
        jumps.append(open_.select("key", "up"))
        above = reduce(DataFrame.union, [*met, open_])
        above = above.select(F.col("key").alias("up"), F.col("up").alias("_up"), F.col("root").alias("_root"), F.col("depth").alias("_depth"), *[F.col(c).alias(f"_{c}") for c in said])
        state = open_.join(above, "up").select("key", F.col("_up").alias("up"), (F.col("depth") + F.col("_depth")).alias("depth"), *_below(said), F.col("_root").alias("root"))
        state = stored(state, "tree")
        met.append(state.where("up is null"))
        open_ = state.where("up is not null")
        before, left = left, open_.count()
        if left == before:
            break
    return Walk(reduce(DataFrame.union, met).drop("up"), tuple(jumps))


def walk(rows: DataFrame, texts: bool = False) -> Walk:
    """Depth and root of rows (key, parent, name, step) by doubling: a node that knows the node 2^k above takes over what that one knows.

    Rounds are the logarithm of the greatest depth, and a round moves only the nodes that have not met their root. While any
    of them is below a root, some are met in every round; so when a round meets none, all that are left are on cycles or below
    one, and they are not in the tree. Nor is a node whose parent is no node, nor what hangs from it. With texts the tree has
    path and order too, all their characters in memory of tasks and files; they grow with the sum of depths.
    """
    state, said = _state(rows, texts)
    return _doubled(state.withColumn("root", F.when(F.col("up").isNull(), F.col("key"))), said)


def _drawn(node: str, level: int) -> Column:
    return F.xxhash64(node, F.lit(level)).bitwiseAND(F.lit(1)) == 1


def contracted(rows: DataFrame, texts: bool = False) -> DataFrame:
    """What walk's tree says, for all rows: (key, depth, root), with texts path and order; root is null for nodes that are not in the tree.

    While many nodes are below others, half of them are drawn by a hash; one that is not drawn and whose parent is leaves, and its
    children take over its parent. No node leaves together with its parent, so one join does it, of the nodes whose parent is not drawn alone.
    About a quarter leaves at a time: all levels together move as much as a few of the whole table, however deep it is. The
    few that stay are walked by doubling; then the others come back, last ones first, each below the node that was its parent when it left.
    """
    state, said = _state(rows, texts)
    state = stored(state, "tree")
    roots, live, gone, stuck = state.where("up is null"), state.where("up is not null"), [], 0
    told = lambda found: [F.when(F.col(found).isNull(), F.col(c)).otherwise(t).alias(c) for c, t in zip(said, _below(said), strict=True)]
    left, fixed = live.count(), roots.count()
    while left > max(FEW, fixed // 4) and stuck < 3:
        key, up = _drawn("key", len(gone)), _drawn("up", len(gone))
        gone.append(live.where(~key & up))
        above = gone[-1].select(F.col("key").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"), *[F.col(c).alias(f"_{c}") for c in said])
        asking = live.where(~up).join(above, "up", "left")
        asking = asking.select("key", F.coalesce("_up", "up").alias("up"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"), *told("_up"))
        live = stored(live.where(key & up).union(asking), "tree")
        before, left = left, live.count()
        stuck = stuck + 1 if left > 0.95 * before else 0
    tops = roots.select(F.col("key").alias("_top"), *[F.col(c).alias(f"_{c}") for c in said])
    first = live.join(tops, live["up"] == tops["_top"], "left")
    first = first.select("key", F.when(F.col("_top").isNull(), F.col("up")).alias("up"), "depth", *told("_top"), F.col("_top").alias("root"))
    found = _doubled(first, said).tree.select("key", "depth", *said, "root").union(roots.select("key", "depth", *said, F.col("key").alias("root")))
    lost = live.join(found.select("key"), "key", "left_anti")
    lost = lost.select("key", F.lit(0).cast("bigint").alias("depth"), *said, F.lit(None).cast("string").alias("root"))
    parts = [stored(found.union(lost), "tree") if gone else found.union(lost)]
    for k, left_then in reversed(list(enumerate(gone))):
        known = reduce(DataFrame.union, parts).where("root is not null")
        known = known.select(F.col("key").alias("up"), F.col("depth").alias("_depth"), F.col("root").alias("_root"), *[F.col(c).alias(f"_{c}") for c in said])
        back = left_then.join(known, "up", "left").select("key", (F.col("depth") + F.col("_depth")).alias("depth"), *_below(said), F.col("_root").alias("root"))
        parts.append(stored(back, "tree") if k else back)
    return reduce(DataFrame.union, parts)


def ancestors(walked: Walk, wanted: DataFrame) -> DataFrame:
    """(key, at, above) of each wanted key in the tree: itself (above 0) and all nodes above it, as many rows as its depth and one."""
    rows = wanted.select("key").join(walked.tree.select("key"), "key", "left_semi").distinct()
    rows = rows.select("key", F.col("key").alias("at"), F.lit(0).cast("bigint").alias("above"))
    for k, jump in enumerate(walked.jumps):
        up = jump.select(F.col("key").alias("at"), F.col("up").alias("_up"))
        rows = stored(rows.union(rows.join(up, "at").select("key", F.col("_up").alias("at"), F.col("above") + (1 << k))), "ancestors")
    return rows


def depths(nodes: DataFrame) -> DataFrame:
    """(key, depth, root) of all nodes, however deep: nodes that hang from no root are roots of their own."""
    known = contracted(nodes.select("key", "parent"))
    return known.select("key", F.when(F.col("root").isNull(), F.lit(0)).otherwise(F.col("depth")).alias("depth"), F.coalesce("root", "key").alias("root"))


def trees(nodes: DataFrame) -> DataFrame:
    """Add depth, root, path (names from the root) and order (sort key of a tree in order of time) to nodes.

    Nodes on a cycle or below one, and nodes whose parent is no node, hang from no root: each is a root of its own. The result
    is as long as all paths together; ``depths`` says how deep nodes are without them.
    """
    rows = stored(steps(nodes), "steps")
    tree = contracted(rows, texts=True).where("root is not null")
    alone = {"depth": F.lit(0), "root": F.col("key"), "path": F.col("name"), "order": F.col("step")}
    found = rows.select("key", "name", "step").join(tree, "key", "left")
    return found.select("key", *[F.coalesce(tree[c], own).alias(c) for c, own in alone.items()])


def search_paths(nodes: DataFrame, text: str, limit: int | None = 5000) -> DataFrame:
    """Nodes whose image or command line holds the text, with their path from the root; all of them without a limit.

    Paths are made for these nodes alone, from the nodes above them.
    """
    hit = F.contains(F.lower(F.coalesce("image", F.lit(""))), F.lower(F.lit(text))) | F.contains(F.lower(F.coalesce("command_line", F.lit(""))), F.lower(F.lit(text)))
    found = nodes.where(hit).drop("parent")
    rows = stored(steps(nodes), "steps")
    walked = walk(rows)
    line = ancestors(walked, found).join(rows.select(F.col("key").alias("at"), "name", "step"), "at")
    line = line.groupBy("key").agg(F.array_sort(F.collect_list(F.struct((-F.col("above")).alias("at"), "name", "step"))).alias("line"))
    text_of = lambda c, by: F.array_join(F.transform("line", lambda x: x[c]), by)
    line = line.join(walked.tree, "key").select("key", "depth", "root", *[text_of(c, by).alias(out) for out, (c, by) in _TEXTS.items()])
    own = rows.select("key", "name", "step").join(found.select("key"), "key", "left_semi").join(line, "key", "left")
    alone = {"depth": F.lit(0), "root": F.col("key"), "path": F.col("name"), "order": F.col("step")}
    out = own.select("key", *[F.coalesce(line[c], other).alias(c) for c, other in alone.items()]).join(found, "key").orderBy("order")
    return out if limit is None else out.limit(limit)


def totals(walked: DataFrame) -> DataFrame:
    return walked.agg(F.count("*").alias("nodes"), F.count_if(F.col("depth") == 0).alias("roots"), F.max("depth").alias("depth"))


def process_query(node: dict) -> str:
    """The query for all events of a process: by GUID, or by process id within its lifetime."""
    from ..functions.timeparse import iso
    from ..plans import printer

    if not str(node["key"]).startswith(("pid|", "synthetic|")):
        v = printer.value(node["key"])
        return " or ".join(f"{f} = {v}" for f in ("ProcessGuid", "ParentProcessGuid", "SourceProcessGUID", "TargetProcessGUID"))
    pid = f"0x{node['pid']:x}"
    ids = " or ".join(f"{f} in ({pid}, {node['pid']})" for f in ("NewProcessId", "ProcessId"))
    end = f' and time <= "{iso(node["end_ft"])}"' if node.get("end_ft") is not None else ""
    return f'host = {printer.value(node["host"] + "*")} and ({ids}) and time >= "{iso(node["start_ft"])}"{end}'
