"""Trees of tables: rows become elements, foreign keys the way up.

Node ids are dense and in document order. Subtree sizes are summed from the lowest level up, one
exchange a level; ids go from the top down as the parent's id plus the sizes of earlier siblings. The
children of the root, which may be all rows of a table, are ranked in buckets by ranges of their first
key, in parallel; below that, each sibling group is ranked where its parent's key lies.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import ATTRS, COLUMNS, NODES, in_path
from ..store import written

#: Rows and bytes of text of a bucket of siblings below the root; rows of a task that joins or ranks the levels below.
BUCKET_ROWS, BUCKET_TEXT, TASK_ROWS = 100_000, 32 << 20, 200_000
#: Keys that are few enough to be sent to all tasks.
FEW = 10_000


@dataclass
class Level:
    """Elements made of rows.

    ``key`` has the columns that children refer to and that siblings are sorted by; rows of a level with
    children must differ in it. ``up`` has the columns that hold the parent's key. ``attrs`` become
    attributes in that order, without null values; ``leaves`` are child elements with text alone, which
    come before the rows of ``below``. Rows whose parent doesn't exist, or that lack a key, are left out.
    """

    element: str
    rows: DataFrame
    key: list[str]
    attrs: dict[str, Column] = field(default_factory=dict)
    text: Column | None = None
    up: list[str] = field(default_factory=list)
    leaves: dict[str, Column] = field(default_factory=dict)
    below: Level | None = None


def _tasks(rows: DataFrame) -> int:
    return max(1, -(-rows.count() // TASK_ROWS))


def _meeting(rows: DataFrame, few: DataFrame, mine: list[str], theirs: list[str], n: int, how: str = "inner") -> DataFrame:
    """Rows joined with those of other keys in tasks of bounded size, whatever the number of shuffle partitions."""
    on = reduce(Column.__and__, [F.col(a) == F.col(b) for a, b in zip(mine, theirs, strict=True)])
    if few.limit(FEW + 1).count() <= FEW:
        return rows.join(F.broadcast(few), on, how)
    return rows.repartition(n, *mine).join(few.repartition(n, *theirs), on, how)


def _prepared(level: Level, sums: DataFrame | None) -> DataFrame:
    """Keys k0.., parent keys p0.., attrs, text, leaf texts, and the size of each row's subtree; ``sums`` has those below by key."""
    pairs = [F.struct(F.lit(n).alias("name"), c.cast("string").alias("value")) for n, c in level.attrs.items()]
    attrs = F.filter(F.array(*pairs), lambda a: a["value"].isNotNull()) if pairs else F.lit(None).cast(ATTRS)
    text = F.lit(None).cast("string") if level.text is None else level.text.cast("string")
    leaves = [c.cast("string").alias(f"l{k}") for k, c in enumerate(level.leaves.values())]
    rows = level.rows.select(*[F.col(c).alias(f"k{k}") for k, c in enumerate(level.key)], *[F.col(c).alias(f"p{k}") for k, c in enumerate(level.up)], attrs.cast(ATTRS).alias("attrs"), text.alias("text"), *leaves)
    for name in [c for c in rows.columns if c[0] == "p" or c[0] == "k"]:
        rows = rows.where(F.col(name).isNotNull())
    own = 1 + len(leaves)
    if sums is None:
        return rows.withColumn("size", F.lit(own).cast("long"))
    mine, theirs = ([f"{x}{k}" for k in range(len(level.key))] for x in "kc")
    rows = _meeting(rows, sums, mine, theirs, _tasks(rows), "left").withColumn("size", own + F.coalesce("below", F.lit(0)))
    return written(rows.drop("below", *[f"c{k}" for k in range(len(level.key))]))  # read again for ids and for the level above


def _order(rows: DataFrame, keys: int) -> list:
    extra = [c for c in ("text",) if c in rows.columns]
    return [*[f"k{k}" for k in range(keys)], F.array_join(F.transform("attrs", lambda a: F.coalesce(a["value"], F.lit(""))), "\x01"), *extra]


def _place(key: Column, bounds: list) -> Column:
    """How many of the ascending bounds are not beyond the key, by chunks of bounds, so that few are looked at."""
    step = max(1, round(len(bounds) ** 0.5))
    chunks = [bounds[k : k + step] for k in range(0, len(bounds), step)]
    passed = lambda some: F.size(F.filter(some, lambda b: b <= key))
    chunk = passed(F.array(*[F.lit(c[0]) for c in chunks]))
    within = F.get(F.array(*[F.array(*map(F.lit, c)) for c in chunks]), chunk - 1)
    return F.when(chunk == 0, F.lit(0)).otherwise((chunk - 1) * step + passed(within))


def ranked(rows: DataFrame, keys: int, first: str | None, n: int | None = None) -> DataFrame:
    """rank (from 1) and before (the sizes of earlier siblings), and whether a row is the last.

    Siblings share ``first``, a column with the parent's id, and are ranked in ``n`` tasks; where it is None all rows are siblings.
    """
    order, numeric = _order(rows, keys), dict(rows.dtypes)["k0"] in ("int", "bigint", "smallint", "double", "float")
    if first is not None:
        by, rows = W.partitionBy(first).orderBy(*order), rows if n is None else rows.repartition(n, first)
        return rows.withColumn("rank", F.row_number().over(by).cast("long")).withColumn("before", F.sum("size").over(by.rowsBetween(W.unboundedPreceding, 0)) - F.col("size")).withColumn("is_last", F.lead(F.lit(1)).over(by).isNull())
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c in rows.columns if c == "text" or c[0] == "l"]
    count, size = rows.agg(F.count("*"), F.coalesce(F.sum(reduce(Column.__add__, texts, F.lit(0))), F.lit(0))).first()
    buckets = max(-(-count // BUCKET_ROWS), -(-size // BUCKET_TEXT))
    bounds = rows.agg(F.percentile_approx("k0", [k / buckets for k in range(1, buckets)], 10 * buckets)).first()[0] if buckets > 1 and numeric else []
    if buckets > 1 and not numeric:  # a sample of the keys, in order; any bounds are right
        bounds = [r["k0"] for r in rows.select("k0").where(F.pmod(F.xxhash64("k0"), F.lit(BUCKET_ROWS // 100 + 1)) == 0).distinct().orderBy("k0").collect()]
        bounds = bounds[:: max(1, len(bounds) // buckets)][1:]
    bounds = sorted(set(bounds))
    spread = rows.withColumn("bucket", _place(F.col("k0"), bounds) if bounds else F.lit(0))
    rows = spread.repartition(len(bounds) + 1, "bucket")
    by = W.partitionBy("bucket").orderBy(*order)
    rows = rows.withColumn("rank", F.row_number().over(by).cast("long")).withColumn("before", F.sum("size").over(by.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
    n0, s0 = [0] * (len(bounds) + 1), [0] * (len(bounds) + 1)  # one row a bucket
    for r in spread.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("size").alias("s")).collect():
        n0[r["bucket"]], s0[r["bucket"]] = r["n"], r["s"]
    earlier = lambda x: F.get(F.array(*[F.lit(v).cast("long") for v in accumulate([0, *x[:-1]])]), F.col("bucket"))
    return rows.withColumn("rank", F.col("rank") + earlier(n0)).withColumn("before", F.col("before") + earlier(s0)).withColumn("is_last", F.col("rank") == F.lit(sum(n0))).drop("bucket")


def _nodes(rows: DataFrame, level: Level, path: str, depth: int, before: int, silo: str) -> DataFrame:
    """The level's node rows, leaves included. ``before``: leaves of the parent, which precede its rows."""
    fixed = dict(silo_id=F.lit(silo), depth=F.lit(depth), element=F.lit(level.element), path=F.lit(path), tail=F.lit(None).cast("string"), tokens=F.lit(None).cast("array<string>"), is_tokenized=F.lit(False))
    made = rows.select(
        *[c.alias(n) for n, c in fixed.items()], "node_id", "parent_id", F.when(~F.col("is_last"), F.col("node_id") + F.col("size")).alias("next_id"), (F.col("node_id") + F.col("size") - 1).alias("last_desc"),
        (F.col("rank") + before).alias("sib_pos"), F.col("rank").alias("name_pos"), F.when(F.trim("text") != "", F.col("text")).alias("text"), "attrs", "anc",
    )
    out = [made.select(*COLUMNS)]
    n = len(level.leaves)
    for k, name in enumerate(level.leaves):
        me = F.col("node_id") + 1 + k
        more = F.lit(True) if k + 1 < n else F.col("size") > 1 + n
        fixed |= dict(depth=F.lit(depth + 1), element=F.lit(name), path=F.lit(f"{path}/{in_path(name)}"))
        leaf = rows.select(
            *[c.alias(x) for x, c in fixed.items()], me.alias("node_id"), F.col("node_id").alias("parent_id"), F.when(more, me + 1).alias("next_id"), me.alias("last_desc"),
            F.lit(k + 1).cast("long").alias("sib_pos"), F.lit(1).cast("long").alias("name_pos"), F.when(F.trim(f"l{k}") != "", F.col(f"l{k}")).alias("text"), F.lit(None).cast(ATTRS).alias("attrs"), F.concat("anc", F.array("node_id")).alias("anc"),
        )
        out.append(leaf.select(*COLUMNS))
    return reduce(DataFrame.unionByName, out)


def tree(root: str, top: Level, silo: str = "silo") -> DataFrame:
    """Node rows of one silo with one root over the rows of ``top`` and what lies below them."""
    path, depth, chain = f"{in_path(root)}/{in_path(top.element)}", 1, [top]
    while chain[-1].below is not None:
        chain.append(chain[-1].below)
    prepared: list[DataFrame] = []
    sums = None
    for k in range(len(chain) - 1, -1, -1):
        prepared.insert(0, _prepared(chain[k], sums))
        if k:
            sums = prepared[0].groupBy(*[F.col(f"p{j}").alias(f"c{j}") for j in range(len(chain[k].up))]).agg(F.sum("size").alias("below"))
    rows = ranked(prepared[0], len(top.key), None)
    rows = rows.withColumn("parent_id", F.lit(1).cast("long")).withColumn("node_id", 2 + F.col("before")).withColumn("anc", F.array(F.lit(1).cast("long")))
    rows = rows if len(chain) == 1 else written(rows)
    size = prepared[0].agg(F.coalesce(F.sum("size"), F.lit(0)).alias("s"))
    head = size.select(
        F.lit(silo).alias("silo_id"), F.lit(1).cast("long").alias("node_id"), F.lit(None).cast("long").alias("parent_id"), F.lit(None).cast("long").alias("next_id"), (F.col("s") + 1).cast("long").alias("last_desc"), F.lit(0).alias("depth"), F.lit(1).cast("long").alias("sib_pos"), F.lit(1).cast("long").alias("name_pos"),
        F.lit(root).alias("element"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("tail"), F.lit(None).cast(ATTRS).alias("attrs"), F.lit(None).cast("array<string>").alias("tokens"), F.lit(False).alias("is_tokenized"), F.lit(in_path(root)).alias("path"), F.array().cast("array<bigint>").alias("anc"),
    )
    out = [head.select(*COLUMNS), _nodes(rows, top, path, depth, 0, silo)]
    for k, (level, lower) in enumerate(zip(chain, chain[1:], strict=False), 1):
        keys, leaves = len(level.key), len(level.leaves)
        ups = rows.select(*[F.col(f"k{j}").alias(f"u{j}") for j in range(keys)], F.col("node_id").alias("parent_id"), F.concat("anc", F.array("node_id")).alias("anc"))
        mine, theirs = ([f"{x}{j}" for j in range(keys)] for x in "pu")
        n = _tasks(prepared[k])
        rows = ranked(_meeting(prepared[k], ups, mine, theirs, n).drop(*theirs), len(lower.key), "parent_id", n)
        rows = rows.withColumn("node_id", F.col("parent_id") + 1 + leaves + F.col("before"))
        rows = rows if lower.below is None else written(rows)
        path, depth = f"{path}/{in_path(lower.element)}", depth + 1
        out.append(_nodes(rows, lower, path, depth, leaves, silo))
    made = reduce(DataFrame.unionByName, out)
    return made.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in NODES.fields])
