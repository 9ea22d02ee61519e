"""From documents to node rows: bulk shredding, and builders that join many sources into one silo."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.text import guid_of
from ..schema import COLUMNS, NODES, TreeError
from ..store import written
from .content import Adapter, as_xml
from .dom import Node, rows_of
from .xml import clean_locales, one_language, parsed, system_locales

VERSION = "1"
#: Documents that one task should parse.
TASK_DOCS = 5000
_ARROW = to_arrow_schema(NODES)


@dataclass
class Fixup:
    """Changes a tree after parsing: called with each node from the top, ``max_depth`` levels down.

    Its id is part of the fingerprint, so it should change with what the function does.
    """

    id: str
    call: Callable[[Node], None]
    max_depth: int | None = None

    @property
    def guid(self) -> str:
        return f"func-id={self.id}" + ("" if self.max_depth is None else f"@{self.max_depth}")


@dataclass
class Rules:
    """How documents are read: literal text, stripped text, tokens for search, languages, what is invalid."""

    literal: bool = False
    strip: bool = False
    tokenize: bool = False
    native_langs: bool = False
    single_lang: bool = False
    single_root: bool = False
    ignore_invalid: bool = False
    locales: tuple[str, ...] = ()

    def languages(self) -> list[str] | None:
        """The wanted languages, those of the system if none are named; None takes all."""
        if not (self.native_langs or self.single_lang):
            return None
        return clean_locales(list(self.locales)) or system_locales()


def _read(name: str | None, raw: bytes, rules: Rules, adapters: tuple[Adapter, ...], fixups: tuple[Fixup, ...]) -> Node:
    root = parsed(as_xml(name, raw, adapters), rules.literal, rules.strip, rules.tokenize, rules.languages())
    for f in fixups:
        root.visit(f.call, f.max_depth)
    if root.ignore:
        raise TreeError("invalid", "the document as a whole can't be ignored")
    if rules.single_root and len([c for c in root.children if not c.ignore]) > 1:
        raise TreeError("invalid", "more than one root")
    return root


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in COLUMNS]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows that documents are made of, over tasks of bounded work: files of short rows may be so small that one task would read all of them.

    The rows are counted, which takes only the footers of files.
    """
    return rows.repartition(max(1, -(-rows.count() // TASK_DOCS)), key)


def shredded(docs: DataFrame, rules: Rules | None = None, adapters: tuple[Adapter, ...] = (), fixups: tuple[Fixup, ...] = ()) -> DataFrame:
    """Node rows of many documents, each a silo of its own: silo_id, content (string or binary), and name if there is one.

    One pass without an exchange, so tasks are those of ``docs`` (see ``spread``). A null document has no rows; an invalid one raises, or with
    ``ignore_invalid`` has none. Other columns are ignored.
    """
    rules = rules or Rules()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []
            for silo, name, content in zip(batch.column("silo_id"), batch.column("name"), batch.column("content"), strict=True):
                raw = content.as_py()
                if raw is None:
                    continue
                try:
                    root = _read(name.as_py(), raw, rules, adapters, fixups)
                    if rules.single_lang:
                        one_language(root)
                    held += rows_of(root.children, silo.as_py())
                except TreeError:
                    if not rules.ignore_invalid:
                        raise
                if len(held) > 20_000:
                    yield batch_of(held)
                    held = []
            yield batch_of(held)

    name = F.col("name").cast("string") if "name" in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col("silo_id").cast("string"), name.alias("name"), F.col("content").cast("binary").alias("content")).where("silo_id is not null").mapInArrow(run, NODES)


@dataclass
class Source:
    """One document of a builder: text, bytes, or files that Spark reads."""

    content: bytes | None = None
    files: str | None = None
    rules: Rules = field(default_factory=Rules)
    prefix: str | None = None
    info: Node | None = None
    adapters: list[Adapter] = field(default_factory=list)
    fixups: list[Fixup] = field(default_factory=list)

    @classmethod
    def of_text(cls, xml: str, **rules: bool) -> Source:
        return cls(xml.encode(), rules=Rules(**rules))

    @classmethod
    def of_bytes(cls, raw: bytes, **rules: bool) -> Source:
        return cls(raw, rules=Rules(**rules))

    @classmethod
    def of_file(cls, path: str, **rules: bool) -> Source:
        return cls(None, path, rules=Rules(**rules))

    def add_adapter(self, kinds: str, convert: Callable, final: bool = False) -> Source:
        """For content types with commas between them."""
        self.adapters.append(Adapter(tuple(kinds.split(",")), convert, final))
        return self

    def add_fixup(self, fixup: Fixup) -> Source:
        self.fixups.append(fixup)
        return self

    def set_info(self, info: Node) -> Source:
        """A subtree that each root of the source gets as its last child."""
        self.info = info
        return self

    def set_prefix(self, prefix: str) -> Source:
        """An element that the source's roots hang under; sources share those of the same name."""
        self.prefix = prefix
        return self


def _copied(node: Node) -> Node:
    new = Node(node.element, node.text, node.attrs)
    new.tail = node.tail
    for c in node.children:
        new.add(_copied(c))
    return new


class Builder:
    """Joins sources into one silo, in the order in which they were added."""

    def __init__(self, spark: SparkSession, silo_id: str = "silo") -> None:
        self.spark, self.silo_id = spark, silo_id
        self.sources: list[Source] = []
        self.nodes: list[Node] = []
        self.fixups: list[Fixup] = []
        self.locales: list[str] = []
        self.parts: list[str] = [VERSION]

    def add_source(self, source: Source) -> Builder:
        self.sources.append(source)
        return self

    def add_node(self, node: Node) -> Builder:
        """A tree made by hand; it comes after all sources, and no fixup or language rule sees it."""
        self.nodes.append(node)
        return self

    def add_fixup(self, fixup: Fixup) -> Builder:
        self.fixups.append(fixup)
        return self

    def add_locale(self, locale: str) -> Builder:
        if not locale.endswith(".UTF-8") and locale not in self.locales:
            self.locales.append(locale)
        return self

    def append_guid(self, guid: str) -> Builder:
        self.parts.append(guid)
        return self

    def contents(self) -> DataFrame:
        """rank, name, stamp, content of all sources; files are listed and read by Spark."""
        schema = "rank int, name string, stamp string, content binary"
        own = [(k, None, hashlib.sha1(s.content).hexdigest(), s.content) for k, s in enumerate(self.sources) if s.files is None]
        out = self.spark.createDataFrame(own, schema)
        for k, s in enumerate(self.sources):
            if s.files is not None:
                found = self.spark.read.format("binaryFile").load(s.files)
                stamp = F.concat_ws(":", "path", F.unix_micros("modificationTime").cast("string"), F.col("length").cast("string"))
                out = out.unionByName(found.select(F.lit(k).alias("rank"), F.col("path").alias("name"), stamp.alias("stamp"), "content"))
        return out

    def guid(self) -> str:
        """The fingerprint of all that decides the result. File contents aren't read for it."""
        stamps = {}
        for r in self.contents().select("rank", "name", "stamp").orderBy("rank", "name").toLocalIterator():
            stamps.setdefault(r["rank"], []).append(r["stamp"])
        parts = list(self.parts)
        for k, s in enumerate(self.sources):
            parts += stamps.get(k, []) + [f.guid for f in s.fixups] + ([f"prefix={s.prefix}"] if s.prefix else []) + ([s.info.export()] if s.info else [])
        return guid_of(*parts, *(f.guid for f in self.fixups), *(f"locale={x}" for x in self.locales), *(n.export() for n in self.nodes))

    def _in_parallel(self, rules: Rules) -> DataFrame:
        """The silo's node rows where no document depends on another: each is parsed on its own, with ids that the sizes of those before it shift."""
        sources, by_hand, silo = self.sources, self.nodes, self.silo_id

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    if row["rank"] == len(sources):
                        roots = by_hand
                    elif row["content"] is None:
                        continue
                    else:
                        source = sources[row["rank"]]
                        own = Rules(**{k: v or getattr(source.rules, k) for k, v in rules.__dict__.items()})
                        try:
                            roots = _read(row["name"], row["content"], own, tuple(source.adapters), tuple(source.fixups)).children
                        except TreeError:
                            if not own.ignore_invalid:
                                raise
                            continue
                        for c in roots:
                            if source.info is not None and not c.ignore:
                                c.add(_copied(source.info))
                    made = batch_of(rows_of(roots, silo))
                    yield pa.RecordBatch.from_arrays([pa.array([row["rank"]] * len(made), pa.int32()), pa.array([row["name"] or ""] * len(made), pa.string()), *made.columns], ["rank", "name", *COLUMNS])

        rows = self.contents().unionByName(self.spark.createDataFrame([(len(sources), None, None, None)], "rank int, name string, stamp string, content binary"))
        schema = T.StructType([T.StructField("rank", T.IntegerType()), T.StructField("name", T.StringType()), *NODES.fields])
        made = written(rows.mapInArrow(run, schema))
        roots = made.where("parent_id is null").groupBy("rank", "name", "element").agg(F.count("*").alias("n"), F.max("last_desc").alias("size"))
        order = W.orderBy("rank", "name")  # one row a document
        docs = roots.groupBy("rank", "name").agg(F.sum("n").alias("roots"), F.max("size").alias("size"))
        docs = docs.select("rank", "name", (F.sum("size").over(order) - F.col("size")).alias("ids"), (F.sum("roots").over(order) - F.col("roots")).alias("sibs"), F.lead(F.lit(1)).over(order).isNotNull().alias("more"), "size")
        names = roots.select(F.col("rank").alias("r"), F.col("name").alias("f"), F.col("element").alias("e"), (F.sum("n").over(W.partitionBy("element").orderBy("rank", "name")) - F.col("n")).alias("named"))
        placed = made.join(docs, ["rank", "name"]).join(names, (F.col("rank") == F.col("r")) & (F.col("name") == F.col("f")) & (F.col("element") == F.col("e")) & F.col("parent_id").isNull(), "left")
        root, ids = F.col("parent_id").isNull(), F.col("ids")
        new = {
            "node_id": F.col("node_id") + ids, "parent_id": F.col("parent_id") + ids, "last_desc": F.col("last_desc") + ids, "anc": F.transform("anc", lambda a: a + F.col("ids")),
            "next_id": F.when(root & F.col("next_id").isNull() & F.col("more"), ids + F.col("size") + 1).otherwise(F.col("next_id") + ids),
            "sib_pos": F.col("sib_pos") + F.when(root, F.col("sibs")).otherwise(0), "name_pos": F.col("name_pos") + F.when(root, F.coalesce("named", F.lit(0))).otherwise(0),
        }
        return placed.select(*[new.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in NODES.fields])

    def compiled(self, rules: Rules | None = None) -> DataFrame:
        """The silo's node rows.

        Files are parsed in parallel, but in one task where fixups or language rules look at all of them
        together, or sources have prefixes, under which they may meet.
        """
        rules = rules or Rules()
        rules = Rules(**{**rules.__dict__, "locales": tuple(rules.locales or self.locales)})
        sources, fixups, nodes, silo = self.sources, self.fixups, self.nodes, self.silo_id
        if any(s.files for s in sources) and not (fixups or rules.single_lang or any(s.prefix for s in sources)):
            return written(self._in_parallel(rules))

        def run(group: pa.Table) -> pa.Table:
            root, prefixed = Node(), {}
            for row in sorted(group.to_pylist(), key=lambda r: (r["rank"], r["name"] or "")):
                if row["content"] is None:
                    continue
                source = sources[row["rank"]]
                own = Rules(**{k: v or getattr(source.rules, k) for k, v in rules.__dict__.items()})
                try:
                    tree = _read(row["name"], row["content"], own, tuple(source.adapters), tuple(source.fixups))
                except TreeError:
                    if not own.ignore_invalid:
                        raise
                    continue
                under = root
                if source.prefix:
                    if source.prefix not in prefixed:
                        prefixed[source.prefix] = root.add(Node(source.prefix))
                    under = prefixed[source.prefix]
                for c in list(tree.children):
                    if source.info is not None and not c.ignore:
                        c.add(_copied(source.info))
                    c.unlink()
                    under.add(c)
            for f in fixups:
                root.visit(f.call, f.max_depth)
            if rules.single_lang:
                one_language(root)
            return pa.Table.from_batches([batch_of(rows_of([*root.children, *nodes], silo))])

        rows = self.contents().unionByName(self.spark.createDataFrame([(len(sources), None, None, None)], "rank int, name string, stamp string, content binary"))
        return rows.groupBy(F.lit(silo).alias("silo")).applyInArrow(run, NODES)
