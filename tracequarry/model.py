"""The event model: events with an id in time order, system keys, and fields that hold any number of text values.

An EventSet is a DataFrame and a catalogue of where each key lives. Keys of ingested logs are native columns and
one map from field name to values; the adapter reads any DataFrame without copying it, so its columns
stay native and filters on them reach the scan.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .functions import text as X
from .functions.timeparse import ticks
from .stages import stored

#: Flag names by bit.
FLAGS = ("beyondHeader", "stale", "headerCrcMismatch", "crcMismatch", "carved", "parseError", "sizeMismatch", "foreignTemplate", "missingTemplate", "timeSkew", "invalidText", "hasCopies", "afterGap")
BIT = {name: 1 << i for i, name in enumerate(FLAGS)}

#: Spellings of system keys in queries.
ALIASES = {
    "host": "@Computer", "computer": "@Computer", "channel": "@Channel", "log": "@Channel", "provider": "@Provider", "provider_name": "@Provider",
    "eventid": "@EventID", "id": "@EventID", "event_id": "@EventID", "level": "@Level", "user": "@UserID", "userid": "@UserID", "sid": "@UserID",
    "file": "@Source", "source": "@Source", "flag": "@Flag", "flags": "@Flag", "task": "@Task", "opcode": "@Opcode", "keywords": "@Keywords",
}

#: Values that level words stand for.
LEVELS = {"critical": ("1",), "error": ("2",), "warning": ("3",), "information": ("4", "0"), "info": ("4", "0"), "verbose": ("5",), "4": ("4", "0")}

#: Columns of the stored events, in order, with their types.
EVENTS = {
    "id": "bigint", "ts_ft": "bigint", "ts": "timestamp", "written_ft": "bigint", "event_date": "date", "source_id": "int", "source": "string", "chunk": "int", "off": "int", "record_id": "bigint", "event_id": "int", "qualifiers": "int",
    "version": "smallint", "level": "smallint", "task": "int", "opcode": "smallint", "keywords": "bigint", "provider": "string", "channel": "string", "computer": "string", "user_sid": "string", "pid": "bigint", "tid": "bigint", "flags": "int",
    "fields": "array<struct<name: string, value: string, type: smallint>>", "f": "map<string, array<string>>",
}


# Order of the flags in exports.
EXPORTED_FLAGS = ("carved", "beyondHeader", "stale", "afterGap", "parseError", "crcMismatch", "headerCrcMismatch", "timeSkew", "foreignTemplate", "missingTemplate", "invalidText", "hasCopies", "sizeMismatch")


def flag_names(flags: Column, order: tuple[str, ...] = FLAGS) -> Column:
    """Names of the bits that are set, in the given order."""
    return F.filter(F.array(*[F.when(flags.bitwiseAND(F.lit(BIT[n])) != 0, F.lit(n)) for n in order]), lambda x: x.isNotNull())


@dataclass(frozen=True)
class Key:
    """A field or system key.

    text: its value, or its array of values if many. native: a column that equals the text and can be pushed to
    the scan. number: a numeric column to compare with, where the text is not read.
    """

    name: str
    text: Column
    many: bool = False
    native: str | None = None
    number: Column | None = None

    @property
    def first(self) -> Column:
        return F.get(self.text, F.lit(0)) if self.many else self.text

    @property
    def present(self) -> Column:
        return self.text.isNotNull() & (F.size(self.text) > 0) if self.many else self.text.isNotNull()

    def any(self, test) -> Column:
        """Whether any value passes; false without a value."""
        found = F.exists(self.text, test) if self.many else test(self.text)
        return F.coalesce(found, F.lit(False))


@dataclass(frozen=True)
class EventSet:
    """Events, their keys, and what queries may refer to besides: entities, annotations, detections."""

    df: DataFrame
    keys: dict[str, Key]
    time: Column = field(default_factory=lambda: F.col("ts_ft"))
    #: entity_events(kind, names array<string>, id), annotations(id, colour, note), det_rule and det_hit.
    entities: DataFrame | None = None
    annotations: DataFrame | None = None
    rules: DataFrame | None = None
    hits: DataFrame | None = None

    @staticmethod
    def from_dataframe(df: DataFrame, id: Column | str | None = None, time: str | Column | None = None, system: dict[str, str | Column] | None = None, fields: list[str] | None = None, json_fields: dict[str, list[str]] | None = None) -> EventSet:
        """Any DataFrame as events.

        id: a column that orders events in time, or None to number them by (time, all columns), slice by
        slice. time: a timestamp column. system: system keys by canonical name. fields: columns to query (arrays hold many values).
        json_fields: column to the keys of its JSON objects. Numbers compare as numbers; their text is Spark's cast.
        """
        kinds = {f.name: f.dataType for f in df.schema}
        fields = [c for c in df.columns] if fields is None else fields
        at = None if time is None else F.col(time) if isinstance(time, str) else time
        ft = F.lit(None).cast("bigint") if at is None else ticks(at, not isinstance(df.select(at.alias("t")).schema[0].dataType, T.TimestampNTZType))
        out = df.withColumn("ts_ft", ft)
        if id is None:
            out = numbered(out, ["ts_ft", *df.columns])
        elif not (isinstance(id, str) and id == "id"):
            out = out.withColumn("id", (F.col(id) if isinstance(id, str) else id).cast("bigint"))
        keys: dict[str, Key] = {}
        for name in fields:
            keys[name] = column_key(name, F.col(f"`{name}`"), kinds[name])
        for column, names in (json_fields or {}).items():
            out = out.withColumn(f"_json_{column}", F.from_json(F.col(column), "map<string,string>"))
            for name in names:
                keys[name] = Key(name, F.col(f"_json_{column}")[name])
        for name, c in (system or {}).items():
            column = F.col(c) if isinstance(c, str) else c
            keys[name] = Key(name, column.cast("string"), native=c if isinstance(c, str) and isinstance(kinds.get(c), T.StringType) else None)
        return EventSet(out, keys)

    @staticmethod
    def from_events(df: DataFrame, fields: list[str], single: frozenset[str] = frozenset(), **more) -> EventSet:
        """Events of the stored schema. fields: names in the map f; single: those with at most one value in any event."""
        keys = {n: Key(n, F.get(F.col("f")[n], F.lit(0)) if n in single else F.col("f")[n], many=n not in single) for n in fields}
        for name, c in (("@EventID", "event_id"), ("@Level", "level"), ("@Task", "task"), ("@Opcode", "opcode")):
            keys[name] = Key(name, F.col(c).cast("string"), native=c, number=F.col(c).cast("bigint"))
        for name, c in (("@Channel", "channel"), ("@Provider", "provider"), ("@Computer", "computer"), ("@UserID", "user_sid"), ("@Source", "source")):
            keys[name] = Key(name, F.col(c))
        keys["@Keywords"] = Key("@Keywords", F.concat(F.lit("0x"), F.lpad(F.lower(F.hex("keywords")), 16, "0")))
        keys["@Flag"] = Key("@Flag", flag_names(F.col("flags")), many=True)
        return EventSet(df, keys, **more)

    def with_df(self, df: DataFrame) -> EventSet:
        return replace(self, df=df)

    def names(self) -> list[str]:
        return sorted(self.keys)

    def value(self, name: str) -> Column:
        """First value of a field, trimmed; null where it is missing, empty or a dash."""
        if name not in self.keys:
            return F.lit(None).cast("string")
        v = F.trim(self.keys[name].first)
        return F.when((v != "") & (v != "-"), v)

    def raw(self, name: str) -> Column:
        return self.keys[name].first if name in self.keys else F.lit(None).cast("string")

    def catalog(self) -> DataFrame:
        """field_catalog: name, n_events, n_values, max_mult, is_system, in one pass over the events."""
        aggs = []
        for i, (_, k) in enumerate(sorted(self.keys.items())):
            n = F.when(k.present, F.size(k.text) if k.many else F.lit(1)).otherwise(0)
            aggs += [F.count_if(n > 0).alias(f"e{i}"), F.sum(n).cast("bigint").alias(f"v{i}"), F.max(n).alias(f"m{i}")]
        one = self.df.agg(*aggs)
        rows = F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"e{i}").alias("n_events"), F.coalesce(f"v{i}", F.lit(0)).alias("n_values"), F.coalesce(f"m{i}", F.lit(0)).alias("max_mult"), F.lit(n.startswith("@")).alias("is_system")) for i, n in enumerate(sorted(self.keys))])
        return one.select(F.inline(rows))

    def long(self) -> DataFrame:
        """event_field: id, key, value, one row per distinct value of a key in an event."""
        pairs = [F.transform(F.array_distinct(k.text) if k.many else F.when(k.text.isNotNull(), F.array(k.text)), lambda v, n=n: F.struct(F.lit(n).alias("key"), v.alias("value"))) for n, k in sorted(self.keys.items())]
        return self.df.select("id", F.inline(F.flatten(F.filter(F.array(*pairs), lambda x: x.isNotNull()))))


def column_key(name: str, c: Column, kind: T.DataType) -> Key:
    if isinstance(kind, T.ArrayType):
        return Key(name, F.transform(c, lambda v: v.cast("string")), many=True)
    if isinstance(kind, T.StringType):
        return Key(name, c, native=name)
    if isinstance(kind, T.NumericType):
        return Key(name, c.cast("string"), native=name, number=c)
    return Key(name, c.cast("string"))


#: Bits of a row's place within its slice, as Spark numbers rows.
PLACE_BITS = 33


def sliced(df: DataFrame, order: list[str]) -> DataFrame:
    """Add _row, which grows along the order of columns: slices of about as many rows each, sorted on their own and written once.

    Slices are cut between rows by all columns of the order, so neither far times nor many rows of one time (or none)
    make a slice large; only rows equal in every column stay together.
    """
    by = [F.col(f"`{c}`") for c in order if not isinstance(df.schema[c].dataType, T.MapType)]
    return stored(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_row", F.monotonically_increasing_id()), "numbered")


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """Add id: 0, 1, ... in the order of columns, nulls first, without moving all rows to one task.

    A row's number is its place within its slice plus the rows of all slices before. What is broadcast has one row
    for each slice, that is for each shuffle partition.
    """
    rows = sliced(df, order)
    part = F.shiftright("_row", PLACE_BITS)
    counts = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    ahead = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_ahead"))
    place = F.col("_row").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return rows.withColumn("_part", part).join(F.broadcast(ahead), "_part").withColumn("id", F.col("_ahead") + place).drop("_part", "_row", "_ahead")


def mask_test(value: str):
    """A test for F-01: whole value, case-insensitive; * and ? make it a mask."""
    if X.has_mask(value):
        return lambda v: X.matches_mask(v, value)
    return lambda v: F.lower(v) == F.lower(F.lit(value))
