"""Facets, histogram, timeline marks, logs, paging and set operations over events."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.timeparse import SECOND, UNIX_EPOCH, zone_name
from ..model import EventSet, flag_names
from ..stages import stored
from .running import lag, running

#: Widths of histogram bins, in seconds, and how many bins are aimed at.
WIDTHS = (1, 5, 15, 30, 60, 300, 900, 1800, 3600, 10_800, 21_600, 43_200, 86_400, 604_800, 2_592_000, 31_536_000)
BINS, TRIM_FROM = 160, 1000
GAP = 3600 * SECOND


def facet(events: EventSet, name: str, within: DataFrame | None = None, limit: int = 200) -> DataFrame:
    """Values of a field with their event counts, most frequent first, then by value."""
    key = events.keys[name]
    df = events.df if within is None else within
    values = df.select(F.explode(F.array_distinct(key.text)).alias("value")) if key.many else df.select(key.text.alias("value")).where("value is not null")
    return values.groupBy("value").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "value").limit(limit)


def distinct_values(events: EventSet, name: str) -> DataFrame:
    key = events.keys[name]
    value = F.explode(key.text) if key.many else key.text
    return events.df.select(value.alias("v")).agg(F.count_distinct("v").alias("n"))


#: Ticks of the steps in which the events at the ends of the trimmed range are found: a day, a second, a tick.
_STEPS = (86_400 * SECOND, SECOND, 1)


def _floored(ft: Column, width: Column | int) -> Column:
    width = F.lit(width) if isinstance(width, int) else width
    return F.call_function("div", ft - F.pmod(ft, width), width)


def _ends(times: DataFrame) -> DataFrame:
    """(lo, hi) of times ``ft``: their first and last, or, from more than TRIM_FROM on, those at n / 1000 from either end.

    Days are counted, then the seconds of the two days where the ends lie, then the ticks of two seconds. What is ordered at
    once is one row for each day, each second of a day, or each tick of a second.
    """
    found = None
    for step in _STEPS:
        rows = times.withColumn("cell", _floored(F.col("ft"), step))
        if found is None:
            counts = rows.groupBy("cell").agg(F.count("*").alias("c"))
            n = F.sum("c").over(Window.partitionBy())
            cut = F.when(n > TRIM_FROM, F.floor(n / 1000)).otherwise(0)
            below = F.sum("c").over(Window.orderBy("cell")) - F.col("c")
            counts = counts.withColumns({"below": below, "ranks": F.array(cut, n - 1 - cut)}).select("*", F.posexplode("ranks").alias("side", "k"))
        else:
            counts = rows.withColumn("up", _floored(F.col("ft"), above)).join(F.broadcast(found), "up").groupBy("side", "k", "cell").agg(F.count("*").alias("c"))
            counts = counts.withColumn("below", F.sum("c").over(Window.partitionBy("side").orderBy("cell")) - F.col("c"))
        found = counts.where((F.col("below") <= F.col("k")) & (F.col("k") < F.col("below") + F.col("c"))).select("side", F.col("cell").alias("up"), (F.col("k") - F.col("below")).alias("k"))  # two rows
        above = step
    return found.agg(F.min("up").alias("lo"), F.max("up").alias("hi"))


def histogram(df: DataFrame, time: str = "ts_ft") -> DataFrame:
    """Bins (start, width, count) with before and after, the events outside the binned range.

    The width is the first of WIDTHS not below the span over BINS, and bins start at its multiples since 1601. From
    more than TRIM_FROM events on, the range runs between the events at n / 1000 from either end. One plan, and no job before
    it runs: the bounds are a subquery of one row.
    """
    times = df.select(F.col(time).alias("ft")).where("ft is not null")
    width = F.lit(WIDTHS[-1] * SECOND)
    for w in reversed(WIDTHS):
        width = F.when(F.lit(w * SECOND * BINS) >= F.col("hi") - F.col("lo"), F.lit(w * SECOND)).otherwise(width)
    bounds = _ends(times).withColumn("width", width).select("width", _floored(F.col("lo"), F.col("width")).alias("first"), _floored(F.col("hi"), F.col("width")).alias("last"))
    one = bounds.select(F.struct("width", "first", "last")).scalar()
    # all that lies outside falls into one bin on either side
    at = F.greatest(F.least(_floored(F.col("ft"), one["width"]), one["last"] + 1), one["first"] - 1)
    counts = times.groupBy(at.alias("bin")).agg(F.count("*").alias("count"))
    every = bounds.select("*", F.explode(F.sequence(F.col("first") - 1, F.col("last") + 1)).alias("bin"))
    rows = every.join(counts, "bin", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    side = lambda bin: F.max(F.when(F.col("bin") == bin, F.col("count"))).over(Window.partitionBy())  # noqa: E731  # a row for each bin
    rows = rows.withColumns({"before": side(F.col("first") - 1), "after": side(F.col("last") + 1)}).where(F.col("bin").between(F.col("first"), F.col("last")))
    return rows.select((F.col("bin") * F.col("width")).alias("start"), "width", "count", "before", "after")


def timeline(df: DataFrame, zone: str = "UTC") -> DataFrame:
    """Events with gap (an hour or more since the event before) and new_day (another day in the zone).

    The event before is a running value over all events, in slices, so that no task sees them all.
    """
    day = lambda ft: F.to_date(F.from_utc_timestamp(F.timestamp_seconds(F.floor((ft - UNIX_EPOCH) / SECOND)), zone_name(zone)))
    ft = F.col("ts_ft")
    rows = running(df, [], ["id"], [lag("_before", ft)])
    before = F.col("_before.v")
    marks = {"gap": ft - before >= GAP, "new_day": day(ft) != day(before)}
    return rows.withColumns({name: F.coalesce(mark, F.lit(False)) for name, mark in marks.items()}).drop("_before")


def page(df: DataFrame, after: int | None = None, size: int = 256) -> DataFrame:
    rows = df if after is None else df.where(F.col("id") > after)
    return rows.orderBy("id").limit(size)


def position(df: DataFrame, id: int) -> DataFrame:
    """How many events come before an id."""
    return df.where(F.col("id") < id).agg(F.count("*").alias("n"))


@dataclass(frozen=True)
class Ranked:
    """Events written in ranges of their id, with ranges(file, first, last, n): a page reads the files it needs, a place is a sum and one file."""

    rows: DataFrame
    ranges: DataFrame

    @staticmethod
    def of(df: DataFrame) -> Ranked:
        rows = stored(df.repartitionByRange("id").sortWithinPartitions("id"), "ranked")
        each = rows.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n"))
        return Ranked(rows, stored(each.coalesce(1), "ranges"))

    def _read(self, files: list[str]) -> DataFrame:
        return self.rows.sparkSession.read.schema(self.rows.schema).parquet(*files) if files else self.rows.limit(0)

    def page(self, after: int | None = None, size: int = 256) -> DataFrame:
        """The next events after an id; each file that has any gives one at least, so that few rows of ranges tell the files."""
        own = self.ranges if after is None else self.ranges.where(F.col("last") > after)
        files, whole = [], 0
        for r in own.orderBy("first").limit(size + 1).collect():
            if whole >= size:
                break
            files.append(r["file"])
            whole += r["n"] if after is None or r["first"] > after else 0
        return page(self._read(files), after, size)

    def position(self, id: int) -> DataFrame:
        """How many events come before an id: those of the ranges before it, and the part of the one range around it."""
        own = self.ranges.agg(F.sum(F.when(F.col("last") < id, F.col("n"))).alias("n"), F.max(F.when((F.col("first") < id) & (F.col("last") >= id), F.col("file"))).alias("file")).first()
        part = position(self._read([own["file"]] if own["file"] else []), id)
        return part.select((F.col("n") + F.lit(own["n"] or 0)).alias("n"))


def flag_counts(events: DataFrame) -> DataFrame:
    return events.select("source", F.explode(flag_names(F.col("flags"))).alias("flag")).groupBy("source", "flag").agg(F.count("*").alias("count"))


def channel_of_file(name: Column) -> Column:
    """Channel from a log's file name: %4 is a slash."""
    return F.replace(F.regexp_replace(F.element_at(F.split(name, r"[\\/]"), -1), r"(?i)\.evtx$", ""), F.lit("%4"), F.lit("/"))


def short_channel(channel: Column) -> Column:
    return F.regexp_replace(channel, "^Microsoft-Windows-", "")


def vendor_group(channel: Column) -> Column:
    """Windows Logs for the five classic logs, else the part before the first slash."""
    classic = channel.isin("Application", "Security", "Setup", "System", "ForwardedEvents")
    return F.when(classic, F.lit("Windows Logs")).otherwise(F.element_at(F.split(short_channel(channel), "/"), 1))


def logs(events: DataFrame, hide_empty: bool = True) -> DataFrame:
    """Event counts per log of the sources."""
    channel = channel_of_file(F.col("source"))
    out = events.groupBy(channel.alias("log")).agg(F.count("*").alias("count"))
    return out.select(vendor_group(F.col("log")).alias("group"), "log", "count").where(F.col("count") > 0 if hide_empty else F.lit(True))


# sets of events by id


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("id"), "id", "left_semi")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("id").union(b.select("id")).distinct()


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("id"), "id", "left_anti")


def complement(universe: DataFrame, a: DataFrame) -> DataFrame:
    return subtract(universe, a)


def clamp(a: DataFrame, first: int, last: int) -> DataFrame:
    return a.where(F.col("id").between(first, last))


def common_count(a: DataFrame, b: DataFrame) -> DataFrame:
    return intersect(a, b).agg(F.count("*").alias("n"))


def bitmap(a: DataFrame) -> DataFrame:
    """Ids as bitmaps of 32,768 bits: bucket and bits."""
    return a.groupBy(F.bitmap_bucket_number("id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits"))
