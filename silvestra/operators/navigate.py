"""Navigation and projection: from rows of nodes to their relatives and their values, in bulk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.compile import attribute, uint
from ..schema import COLUMNS


def _joined(nodes: DataFrame, rows: DataFrame, key: str, of: str) -> DataFrame:
    came = rows.select(F.col("silo_id").alias("__silo"), F.col(key).alias("__key"), F.col("node_id").alias("from_id"))
    return nodes.join(came, (F.col("silo_id") == F.col("__silo")) & (F.col(of) == F.col("__key"))).select(*COLUMNS, "from_id")


def roots(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("parent_id").isNull())


def first_roots(nodes: DataFrame) -> DataFrame:
    """Each silo's first root."""
    return roots(nodes).where("sib_pos = 1")


def parents(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """Each row's parent, with the row's id as ``from_id``, as in all functions here."""
    return _joined(nodes, rows, "parent_id", "node_id")


def following(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """Each row's next sibling."""
    return _joined(nodes, rows, "next_id", "node_id")


def children(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """Each row's children; ``sib_pos`` has their order."""
    return _joined(nodes, rows, "node_id", "parent_id")


def first_children(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    return children(nodes.where("sib_pos = 1"), rows)


def attributes(rows: DataFrame) -> DataFrame:
    """silo_id, node_id, position, name, value of every attribute, in the order of the document."""
    return rows.select("silo_id", "node_id", F.posexplode("attrs").alias("position", "a")).select("silo_id", "node_id", "position", "a.name", "a.value")


def attr(name: str) -> Column:
    return attribute(name)


def attr_as_uint(name: str) -> Column:
    """The attribute as a number, null where it is missing."""
    return uint(attribute(name))


def text_as_uint() -> Column:
    return uint(F.col("text"))


def best_language(rows: DataFrame, locales: list[str]) -> DataFrame:
    """Of nodes of one name and parent those in the best language: the earlier in the list, the better; none is worst."""
    pairs = [x for k, name in enumerate(locales) for x in (F.lit(name), F.lit(len(locales) - k))]
    lang = attribute("xml:lang")
    known = F.element_at(F.create_map(*pairs), lang) if pairs else F.lit(None).cast("int")
    ranked = rows.withColumn("__rank", F.when(lang.isNull(), F.lit(0)).otherwise(known)).where("__rank is not null")
    best = ranked.groupBy(F.col("silo_id").alias("__silo"), F.col("parent_id").alias("__up"), F.col("element").alias("__name")).agg(F.max("__rank").alias("__best"))
    same = (F.col("silo_id") == F.col("__silo")) & F.col("parent_id").eqNullSafe(F.col("__up")) & (F.col("element") == F.col("__name")) & (F.col("__rank") == F.col("__best"))
    return ranked.join(best, same, "left_semi").drop("__rank")
