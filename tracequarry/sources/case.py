"""A case folder: events and their side tables as Parquet, annotations and detections that may change."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import EVENTS, EventSet
from ..operators.progress import Progress
from . import files, ingest

ANNOTATIONS = "sha256 string, chunk int, off int, colour string, note string, changed double"


@dataclass(frozen=True)
class Case:
    spark: SparkSession
    path: str

    @staticmethod
    def create(spark: SparkSession, inputs: list[str], path: str, options: ingest.Options = ingest.Options(), progress: Progress | None = None) -> Case:
        ingest.build(spark, inputs, path, options, progress)
        return Case.open(spark, path)

    @staticmethod
    def open(spark: SparkSession, path: str) -> Case:
        if not ingest._exists(spark, f"{path}/manifest"):
            raise FileNotFoundError(f"{path} holds no case")
        return Case(spark, path)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    @property
    def manifest(self) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/manifest").first()[0])

    def events(self) -> EventSet:
        """Events with their fields, annotations and detections, as far as they are there."""
        df = self.table("events")
        for name, kind in EVENTS.items():  # an older case may lack a column
            if name not in df.columns:
                df = df.withColumn(name, F.lit(None).cast(kind))
        rows = self.table("field_catalog").select("name", "max_mult").collect()  # one row per field name
        out = EventSet.from_events(df, [r["name"] for r in rows], frozenset(r["name"] for r in rows if r["max_mult"] == 1))
        marks = self.annotations()
        out = replace(out, annotations=self.located(marks))
        if (rules := self._latest("det_rule")) is not None:
            out = replace(out, rules=rules, hits=self._latest("det_hit"))
        if (entities := self._latest("entity_names")) is not None:
            out = replace(out, entities=entities)
        return out

    # versions: each change writes a new folder, so readers never see half of one

    def _versions(self, name: str) -> list[str]:
        fs, p = files.opened(self.spark, f"{self.path}/{name}")
        if not fs.exists(p):
            return []
        done = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(v for v in done if fs.exists(files.opened(self.spark, f"{self.path}/{name}/{v}/_SUCCESS")[1]))

    def _latest(self, name: str) -> DataFrame | None:
        versions = self._versions(name)
        return self.spark.read.parquet(f"{self.path}/{name}/{versions[-1]}") if versions else None

    def replace_table(self, name: str, df: DataFrame) -> None:
        old = self._versions(name)
        df.write.parquet(f"{self.path}/{name}/{time.time_ns():020d}")
        for v in old:
            ingest._remove(self.spark, f"{self.path}/{name}/{v}")

    def annotations(self) -> DataFrame:
        found = self._latest("annotations")
        return self.spark.createDataFrame([], ANNOTATIONS) if found is None else found

    def annotate(self, id: int, colour: str | None, note: str = "") -> None:
        """Replace an event's bookmark, or remove it without a colour and note."""
        sha, chunk, off = self._place(id)
        rows = [r for r in self.annotations().collect() if (r["sha256"], r["chunk"], r["off"]) != (sha, chunk, off)]  # made by hand, one at a time
        if colour or note:
            rows.append((sha, chunk, off, colour or "", note, time.time()))
        self.replace_table("annotations", self.spark.createDataFrame(rows, ANNOTATIONS))

    def _place(self, id: int) -> tuple:
        row = self.table("events").where(F.col("id") == id).join(self.table("sources").select("source_id", F.coalesce("sha256", "path").alias("sha256")), "source_id").select("sha256", "chunk", "off").first()
        if row is None:
            raise KeyError(id)
        return tuple(row)

    def located(self, marks: DataFrame) -> DataFrame:
        """Annotations with the id of their event, by source, chunk and offset."""
        sources = self.table("sources").select("source_id", F.coalesce("sha256", "path").alias("sha256"))
        spots = self.table("events").select("id", "source_id", "chunk", "off")
        return F.broadcast(marks).join(sources, "sha256").join(spots, ["source_id", "chunk", "off"]).select("id", "colour", "note")

    def detect(self, rules, batch: int = 64):
        """Run rules and keep the whole run, in place of the one before."""
        from ..operators import detections

        run = detections.run(self.events(), rules, batch)
        self.replace_table("det_hit", run.hits)
        self.replace_table("det_rule", run.rules)
        return detections.Run(self._latest("det_rule"), self._latest("det_hit"), run.meta)

    def build_entities(self):
        from ..operators import entities

        registry = entities.build(self.events())
        for name, df in (("entities", registry.entities), ("entity_mentions", registry.mentions), ("entity_links", registry.links)):
            self.replace_table(name, df)
        stored = entities.Registry(self._latest("entities"), self._latest("entity_mentions"), self._latest("entity_links"))
        self.replace_table("entity_names", stored.for_queries())
        return stored

    def source_record(self, id: int) -> tuple[str, bytes | None]:
        """An event's record read from its source file again."""
        row = self.table("events").where(F.col("id") == id).join(self.table("sources").select("source_id", "path"), "source_id").select("path", "chunk", "off", "record_id").first()
        if row is None:
            return "no-location", None
        return files.reread(self.spark, row["path"], row["chunk"], row["off"], row["record_id"])

    def info(self) -> list[tuple[str, str]]:
        """What a report says about the case: pairs for a table."""
        m = self.manifest
        out = [("events", str(m["events"])), ("files", str(m["files"])), ("failed files", str(len(m["failed"])))]
        for s in self.table("sources").orderBy("source_id").collect():
            out.append((s["source"], f"{s['records']} records, {s['carved']} carved, {s['copies']} copies, sha256 {s['sha256']}"))
        return out
