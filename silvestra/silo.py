"""A silo: node rows with what can be done with them."""

from __future__ import annotations

import json
import time
from functools import lru_cache

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import export, navigate
from .operators.paths import Options, Query, query
from .plans.compile import attribute
from .schema import COLUMNS, NODES, TreeError
from .sources.builder import Builder, Rules, Source


class Silo:
    """Answers path queries over a node table, which may hold many documents.

    Answers are DataFrames of nodes; nothing runs before they are read, except what ``check`` looks at:
    rows that make a query an error. ``check=False`` spares that look.
    """

    def __init__(self, nodes: DataFrame, guid: str | None = None, options: Options | None = None, path: str | None = None) -> None:
        self.nodes, self.guid, self.path = nodes.select(*COLUMNS), guid, path
        self.options = options or Options()
        self.profile: list[tuple[str, float]] | None = None
        self.index: DataFrame | None = None
        self.valid, self._data = True, {}
        self._parsed = lru_cache(maxsize=512)(lambda xpath: Query(xpath, self.options))

    # where silos come from
    @classmethod
    def from_xml(cls, spark: SparkSession, xml: str, **rules: bool) -> Silo:
        builder = Builder(spark).add_source(Source.of_text(xml, **rules))
        return cls(builder.compiled(), builder.guid())

    @classmethod
    def load(cls, spark: SparkSession, folder: str, options: Options | None = None) -> Silo:
        """A saved silo, whose manifest must be of this version."""
        try:
            manifest = json.loads(spark.read.text(f"{folder}/manifest").first()["value"])
        except (AnalysisException, TypeError, ValueError) as e:  # no folder, an empty or other manifest
            raise TreeError("not_found", f"{folder} holds no silo") from e
        if manifest.get("format") != "silvestra-nodes-1":
            raise TreeError("invalid", f"{folder} is of another format")
        return cls(spark.read.schema(NODES).parquet(f"{folder}/{manifest['nodes']}"), manifest["guid"], options, folder)

    def save(self, folder: str) -> Silo:
        """Writes the nodes sorted by element within files, then a manifest that points to them, and reads them back."""
        spark, name = self.nodes.sparkSession, f"nodes-{self.guid or 'none'}-{time.time_ns()}"
        self.nodes.sortWithinPartitions("path", "silo_id", "node_id").write.parquet(f"{folder}/{name}")
        spark.createDataFrame([(json.dumps({"format": "silvestra-nodes-1", "guid": self.guid, "nodes": name}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")
        return Silo.load(spark, folder, self.options)

    @classmethod
    def ensure(cls, builder: Builder, folder: str, rules: Rules | None = None, ignore_guid: bool = False) -> Silo:
        """The saved silo if its fingerprint is the builder's (or is ignored), else a new one in its place."""
        guid = builder.guid()
        try:
            found = cls.load(builder.spark, folder)
            if ignore_guid or found.guid == guid:
                return found
        except TreeError:
            pass
        return cls(builder.compiled(rules), guid).save(folder)

    def invalidate(self) -> Silo:
        """Marks the silo as outdated, whatever its folder holds."""
        self.valid = False
        return self

    def is_valid(self) -> bool:
        """Whether it wasn't invalidated and the folder still holds what was loaded."""
        if self.path is None or not self.valid:
            return self.valid
        try:
            return Silo.load(self.nodes.sparkSession, self.path).guid == self.guid
        except TreeError:
            return False

    def cached(self) -> Silo:
        self.nodes = self.nodes.persist()
        return self

    # queries
    def query(self, xpath: str, limit: int = 0, start: DataFrame | None = None, check: bool = True, ordered: bool = False) -> DataFrame:
        """Nodes of a union of paths; from the roots, or from any rows of nodes. A node found twice is there twice."""
        return self._timed(xpath, lambda: self._checked(query(self.nodes, xpath, limit, start, self.options, ordered), check))

    def prepare(self, xpath: str, **options: bool | int) -> Query:
        return Query(xpath, self.options, **options) if options else self._parsed(xpath)

    def run(self, prepared: Query | str, *binds: str | int, limit: int | None = None, reverse: bool | None = None, start: DataFrame | None = None, check: bool = True, ordered: bool = False) -> DataFrame:
        """Nodes of a prepared path, each once."""
        prepared = self._parsed(prepared) if isinstance(prepared, str) else prepared
        self._indexed(prepared, binds)
        return self._timed(prepared.xpath, lambda: self._checked(prepared.run(self.nodes, *binds, limit=limit, reverse=reverse, start=start, ordered=ordered), check))

    def first(self, xpath: str, start: DataFrame | None = None, require: bool = False):
        """The first node as a row, or None."""
        row = self.query(xpath, 1, start).first()
        if row is None and require:
            raise TreeError("not_found", f"nothing for {xpath}")
        return row

    def first_text(self, xpath: str, start: DataFrame | None = None) -> str | None:
        row = self.first(xpath, start)
        return row["text"] if row else None

    def first_attr(self, xpath: str, name: str, start: DataFrame | None = None) -> str | None:
        row = self.query(xpath, 1, start).select(attribute(name).alias("v")).first()
        return row["v"] if row else None

    def first_text_as_uint(self, xpath: str, start: DataFrame | None = None) -> int | None:
        row = self.query(xpath, 1, start).select(navigate.text_as_uint().alias("v")).first()
        return int(row["v"]) if row and row["v"] is not None else None

    def first_attr_as_uint(self, xpath: str, name: str, start: DataFrame | None = None) -> int | None:
        row = self.query(xpath, 1, start).select(navigate.attr_as_uint(name).alias("v")).first()
        return int(row["v"]) if row and row["v"] is not None else None

    def first_export(self, xpath: str, start: DataFrame | None = None, **flags: bool) -> str | None:
        row = export.exported(self.nodes, self.query(xpath, 1, start), **flags).first()
        return row["xml"] if row else None

    def query_many(self, xpaths: list[str]) -> DataFrame:
        """All queries in one job; ``query`` tells which a row answers."""
        parts = [self.query(x, check=False).withColumn("query", F.lit(x)) for x in xpaths]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _checked(self, answer, check: bool) -> DataFrame:
        return (answer.check() if check and answer.faults else answer).rows

    def _timed(self, what: str, call):
        """With ``profile`` set, the query is run as a whole, its rows thrown away, and its time noted."""
        began = time.perf_counter()
        out = call()
        if self.profile is not None:
            out.write.format("noop").mode("overwrite").save()
            self.profile.append((what, time.perf_counter() - began))
        return out

    def _indexed(self, prepared: Query, binds: tuple) -> None:
        if not self.options.strict_index:
            return
        wanted = indexed_literals(prepared) + [b for b in prepared.bound(binds) if isinstance(b, str)]
        known = self.index.where(F.col("value").isin(wanted)).count() if self.index is not None and wanted else 0
        if known < len(set(wanted)):
            raise TreeError("invalid_argument", "an indexed literal or bound text isn't in the index")

    def build_index(self, xpath: str, attr: str | None = None) -> Silo:
        """Indexes the texts of the nodes, or with ``attr`` all names and values of their attributes."""
        rows = self.query(xpath, check=False)
        if attr is None:
            values = rows.select(F.col("text").alias("value"))
        else:
            values = rows.select(F.explode("attrs").alias("a")).select(F.explode(F.array("a.name", "a.value")).alias("value"))
        values = values.where("value is not null").distinct()
        self.index = values if self.index is None else self.index.unionByName(values).distinct()
        return self

    # other
    def set_data(self, key: str, rows: DataFrame, value: Column) -> Silo:
        """Gives nodes a value under a name, for the session; a node's later value replaces the earlier one."""
        new = rows.select("silo_id", "node_id", value.alias("value"))
        old = self._data.get(key)
        self._data[key] = new if old is None else new.unionByName(old.join(new, ["silo_id", "node_id"], "left_anti"))
        return self

    def data(self, key: str, rows: DataFrame) -> DataFrame:
        """The rows with what ``set_data`` gave them as ``data``, null where that is nothing."""
        held = self._data.get(key)
        return rows.withColumn("data", F.lit(None).cast("string")) if held is None else rows.join(held.withColumnRenamed("value", "data"), ["silo_id", "node_id"], "left")

    def size(self) -> int:
        return self.nodes.count()

    def is_empty(self) -> bool:
        return self.nodes.isEmpty()

    def export(self, roots: DataFrame | None = None, **flags: bool) -> DataFrame:
        return export.documents(self.nodes, **flags) if roots is None else export.exported(self.nodes, roots, **flags)

    def export_text(self, **flags: bool) -> str:
        row = export.documents(self.nodes, **flags).first()
        return row["xml"] if row else ""

    def write_xml(self, folder: str, **flags: bool) -> None:
        """A text file for each silo's document, by Spark's own writer."""
        export.documents(self.nodes, **flags).select(F.col("xml").alias("value"), "silo_id").write.mode("overwrite").partitionBy("silo_id").option("lineSep", "\n").text(folder)

    def dump(self, n: int = 100) -> str:
        """The first nodes, as a table to look at."""
        rows = self.nodes.orderBy("silo_id", "node_id").limit(n).collect()
        return "\n".join(f"{r['silo_id']}:{r['node_id']:>6} {'  ' * r['depth']}{r['element']} " + " ".join(f'@{a["name"]}={a["value"]}' for a in r["attrs"] or ()) + (f" {r['text']!r}" if r["text"] else "") for r in rows)

    def roots(self) -> DataFrame:
        return navigate.roots(self.nodes)

    def profile_text(self) -> str:
        return "\n".join(f"{s * 1000:.3f} ms  {what}" for what, s in self.profile or ())


def indexed_literals(prepared: Query) -> list[str]:
    from .plans.syntax import Call, Group, Literal

    out, todo = [], [p for s in prepared.path.steps for p in s.predicates]
    while todo:
        e = todo.pop()
        if isinstance(e, Literal) and e.kind == "indexed":
            out.append(e.value)
        todo += [e.body] if isinstance(e, Group) else list(e.args) if isinstance(e, Call) else []
    return out
