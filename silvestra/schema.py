"""The node table: one row for each element of each document, in document order."""

from __future__ import annotations

from pyspark.sql import types as T

ATTRS = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.StringType())]))

#: ``node_id`` rises in document order within a silo (1, 2, ... where a document is parsed; gaps are
#: allowed where a tree is built from tables). ``last_desc`` is the greatest node_id of the subtree.
#: ``sib_pos`` ranks a node among its siblings, ``name_pos`` among those of its name. ``path`` joins the
#: element names from the root, ``anc`` has the node_ids of the ancestors, root first: a path query
#: without conditions on the way down is one filtered scan.
NODES = T.StructType(
    [
        T.StructField("silo_id", T.StringType(), False),
        T.StructField("node_id", T.LongType(), False),
        T.StructField("parent_id", T.LongType()),
        T.StructField("next_id", T.LongType()),
        T.StructField("last_desc", T.LongType(), False),
        T.StructField("depth", T.IntegerType(), False),
        T.StructField("sib_pos", T.LongType(), False),
        T.StructField("name_pos", T.LongType(), False),
        T.StructField("element", T.StringType(), False),
        T.StructField("text", T.StringType()),
        T.StructField("tail", T.StringType()),
        T.StructField("attrs", ATTRS),
        T.StructField("tokens", T.ArrayType(T.StringType())),
        T.StructField("is_tokenized", T.BooleanType(), False),
        T.StructField("path", T.StringType(), False),
        T.StructField("anc", T.ArrayType(T.LongType()), False),
    ]
)
COLUMNS = [f.name for f in NODES.fields]


def in_path(name: str) -> str:
    """An element's name as it stands in ``path``, so that a slash in a name (of a tree made by hand) isn't a step."""
    return name.replace("%", "%25").replace("/", "%2F")


class TreeError(Exception):
    """What goes wrong with documents and queries; ``code`` says which kind."""

    def __init__(self, code: str, message: str) -> None:
        super().__init__(message)
        self.code = code
