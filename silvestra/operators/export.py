"""Nodes back to XML, and folds over subtrees. Subtrees are gathered by a range of node ids."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import xml_escaped
from ..schema import COLUMNS

HEADER = '<?xml version="1.0" encoding="UTF-8"?>\n'


def _element(row: dict, kids: dict[int | None, list[dict]], multiline: bool, indent: bool, collapse: bool, level: int) -> str:
    pad, line = "  " * level if indent else "", "\n" if multiline else ""
    below = kids.get(row["node_id"], [])
    head = f"{pad}<{row['element']}" + "".join(f' {a["name"]}="{xml_escaped(a["value"] or "")}"' for a in row["attrs"] or ())
    text, tail = xml_escaped(row["text"] or ""), xml_escaped(row["tail"] or "")
    if not below:
        return f"{head} />{tail}{line}" if collapse and not text else f"{head}>{text}</{row['element']}>{tail}{line}"
    inner = "".join(_element(c, kids, multiline, indent, collapse, level + 1) for c in below)
    return f"{head}>{text}{line}{inner}{pad}</{row['element']}>{tail}{line}"


def _by_parent(rows: list[dict]) -> dict[int | None, list[dict]]:
    kids: dict[int | None, list[dict]] = {}
    for r in sorted(rows, key=lambda r: r["node_id"]):
        kids.setdefault(r["parent_id"], []).append(r)
    return kids


def _streamed(rows: Iterator[dict], multiline: bool, indent: bool, collapse: bool, children_only: bool) -> str:
    """The XML of one root's nodes, which come in the order of the document: only the open elements are held besides what is written."""
    out: list[str] = []
    pieces: list[str] = []
    opened: list[dict] = []
    line, fresh = "\n" if multiline else "", False  # whether the last element has no child so far

    def pad() -> str:
        return "  " * (len(opened) - children_only) if indent else ""

    def close() -> None:
        row = opened.pop()
        if children_only and not opened:
            return
        tail = xml_escaped(row["tail"] or "")
        if not fresh:
            out.append(f"{pad()}</{row['element']}>{tail}{line}")
        elif collapse and not row["text"]:
            out.append(f" />{tail}{line}")
        else:
            out.append(f">{xml_escaped(row['text'] or '')}</{row['element']}>{tail}{line}")

    for row in rows:
        while opened and opened[-1]["node_id"] != row["parent_id"]:
            close()
            fresh = False
        if not opened and row["node_id"] != row["__head"]:
            continue
        if opened and fresh:
            out.append(f">{xml_escaped(opened[-1]['text'] or '')}{line}")
        if opened or not children_only:
            out.append(f"{pad()}<{row['element']}" + "".join(f' {a["name"]}="{xml_escaped(a["value"] or "")}"' for a in row["attrs"] or ()))
            fresh = True
        opened.append(row)
        if len(out) > 10_000:
            pieces.append("".join(out))
            out.clear()
    while opened:
        close()
        fresh = False
    return "".join([*pieces, *out])


def subtrees(nodes: DataFrame, roots: DataFrame, siblings: bool = False) -> DataFrame:
    """All nodes at or below each root, with the root's id as ``root_id``; with its later siblings on demand.

    A node's ancestors are listed in the node, so this is an equi-join, not a range join. Only the
    ancestors at depths that roots have are looked at, and only nodes at least as deep.
    """
    depths = sorted(r["depth"] for r in roots.select("depth").distinct().collect())  # MAX_DEPTH at most
    tops = roots.select("silo_id", F.col("node_id").alias("root_id"), F.col("parent_id").alias("__up")).distinct()
    if siblings:
        heads = nodes.where(F.col("depth").isin(depths)).select("silo_id", F.col("node_id").alias("__head"), F.col("parent_id").alias("__parent"))
        later = heads.alias("h").join(tops.alias("t"), (F.col("h.silo_id") == F.col("t.silo_id")) & F.col("__parent").eqNullSafe(F.col("__up")) & (F.col("__head") >= F.col("root_id")))
        tops = later.select("t.silo_id", "root_id", "__head")
    else:
        tops = tops.withColumn("__head", F.col("root_id")).drop("__up")
    at = lambda d: F.when(F.col("depth") == d, F.col("node_id")).otherwise(F.get("anc", F.lit(d)))
    line = at(depths[0]) if len(depths) == 1 else F.explode(F.array_compact(F.array(*[at(d) for d in depths])) if depths else F.array().cast("array<long>"))
    lines = nodes.where(F.col("depth") >= (depths[0] if depths else 0)).withColumn("__line", line)
    tops = tops.withColumnRenamed("silo_id", "__silo")
    return lines.join(tops, (F.col("silo_id") == F.col("__silo")) & (F.col("__line") == F.col("__head"))).select(*COLUMNS, "root_id", "__head")


def _by_root(rows: DataFrame, made: Callable[[Iterator[dict]], str], name: str) -> DataFrame:
    """silo_id, node_id and what is made of each root's nodes, which come as a sorted stream: many small subtrees share a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in batch.to_pylist())
        out: list[tuple] = []
        for (silo, root), group in groupby(rows, key=lambda r: (r["silo_id"], r["root_id"])):
            out.append((silo, root, made(group)))
            if len(out) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.string()), strict=True)], ["silo_id", "node_id", name])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.string()), strict=True)], ["silo_id", "node_id", name])

    return rows.repartition("silo_id", "root_id").sortWithinPartitions("silo_id", "root_id", "node_id").mapInArrow(run, f"silo_id string, node_id long, {name} string")


def exported(nodes: DataFrame, roots: DataFrame, header: bool = False, multiline: bool = False, indent: bool = False, siblings: bool = False, children_only: bool = False, collapse: bool = False) -> DataFrame:
    """silo_id, node_id, xml of each root. ``children_only`` leaves the root's own tags out."""

    def made(rows: Iterator[dict]) -> str:
        return (HEADER if header else "") + _streamed(rows, multiline, indent, collapse, children_only)

    wanted = subtrees(nodes, roots, siblings and not children_only).select("silo_id", "node_id", "parent_id", "element", "text", "tail", "attrs", "root_id", "__head")
    return _by_root(wanted, made, "xml")


def documents(nodes: DataFrame, header: bool = False, multiline: bool = False, indent: bool = False, collapse: bool = False) -> DataFrame:
    """silo_id, xml: each silo as one document, roots in order."""

    def run(group: pa.Table) -> pa.Table:
        kids = _by_parent(group.to_pylist())
        xml = (HEADER if header else "") + "".join(_element(r, kids, multiline, indent, collapse, 0) for r in kids.get(None, []))
        return pa.table([group["silo_id"].slice(0, 1), pa.array([xml])], ["silo_id", "xml"])

    wanted = nodes.select("silo_id", "node_id", "parent_id", "element", "text", "tail", "attrs")
    return wanted.groupBy("silo_id").applyInArrow(run, "silo_id string, xml string")


def folded(nodes: DataFrame, roots: DataFrame, enter: Callable[[dict, list], bool | None], leave: Callable[[dict, list], bool | None] | None = None) -> DataFrame:
    """silo_id, node_id, result of a fold over each root, its later siblings and all below.

    ``enter`` is called with each node before its children, ``leave`` after them, in document order, and
    both add strings to the list they are given, which are joined. One that returns True ends the fold.
    """

    def made(group: Iterator[dict]) -> str:
        rows = list(group)
        kids, out, heads = _by_parent(rows), [], {r["__head"] for r in rows}

        def visit(row: dict) -> bool:
            seen = {k: row[k] for k in COLUMNS} | {"attrs": {a["name"]: a["value"] for a in row["attrs"] or ()}}
            if enter(seen, out) or any(visit(c) for c in kids.get(row["node_id"], [])):
                return True
            return bool(leave and leave(seen, out))

        any(visit(r) for r in rows if r["node_id"] in heads)
        return "".join(out)

    return _by_root(subtrees(nodes, roots, True), made, "result")


def lines_of(xml: DataFrame) -> Iterator[str]:
    """Documents one at a time, for a file on the driver's side."""
    for row in xml.orderBy("silo_id").toLocalIterator():
        yield row["xml"]
