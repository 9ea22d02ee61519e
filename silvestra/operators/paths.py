"""Path queries as DataFrames.

Steps down from the roots collapse into one filtered scan by ``path``; only steps with predicates of
their own cost a semi-join with the filtered ancestors. Other steps are equi-joins on node and parent
ids. Nothing is sorted unless an order or a limit is asked for.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.compile import Compiler
from ..plans.syntax import Path, Registry, Step, prepared, union
from ..schema import COLUMNS, TreeError, in_path

_KEY = ["silo_id", "node_id"]


@dataclass
class Options:
    """How queries read and answer.

    ``predicates``: of several on one step the "last" decides, or "all" must hold. ``parity`` evaluates
    order comparisons with a number left of a text the other way around. ``bad_number``: a text without
    a number in a comparison with one is "false", or an "error". ``above_root``: ``..`` from a root is
    an "error", or is "drop"ped. ``strict_index``: indexed literals must be values of the silo.
    """

    predicates: str = "last"
    parity: bool = True
    bad_number: str = "false"
    above_root: str = "error"
    strict_index: bool = False
    precedence: bool = False
    registry: Registry = field(default_factory=Registry)


@dataclass
class Answer:
    """The rows, with ``ord`` as their order, and those that make the query an error."""

    rows: DataFrame
    faults: list[tuple[DataFrame, str]]

    def check(self) -> Answer:
        for rows, message in self.faults:
            if not rows.limit(1).isEmpty():
                raise TreeError("invalid_argument", message)
        return self


class Planner:
    def __init__(self, nodes: DataFrame, options: Options, binds: tuple = (), dedup: bool = False) -> None:
        self.nodes, self.options, self.dedup = nodes, options, dedup
        self.binds, self.faults = binds, []

    def matching(self, step: Step) -> tuple[Column | None, Column | None]:
        """The step's predicates, and where a text held no number."""
        if not step.predicates:
            return None, None
        compiler = Compiler(step.name is not None, self.binds, self.options.registry, self.options.parity)
        made = [compiler.condition(p) for p in step.predicates]
        fault = reduce(Column.__or__, compiler.faults) if compiler.faults and self.options.bad_number == "error" else None
        return (made[-1] if self.options.predicates == "last" else reduce(Column.__and__, made)), fault

    def reached(self, rows: DataFrame, step: Step) -> DataFrame:
        """Rows that the step comes to, filtered by its predicates."""
        condition, fault = self.matching(step)
        if fault is not None:
            self.faults.append((rows.where(fault), "a text that is no number was compared with one"))
        return rows if condition is None else rows.where(condition)

    def from_roots(self, steps: tuple[Step, ...]) -> DataFrame:
        """All steps lead down: a scan of the last step's nodes, and semi-joins with ancestors under conditions."""
        last = len(steps) - 1
        rows = self.reached(self.nodes.where(self.located(steps)), steps[last])
        for level in range(last - 1, -1, -1):
            if steps[level].predicates:
                good = self.reached(self.nodes.where(self.located(steps[: level + 1])), steps[level]).select(F.col("silo_id").alias("__silo"), F.col("node_id").alias("__node"))
                rows = rows.join(good, (F.col("silo_id") == F.col("__silo")) & (F.get("anc", F.lit(level)) == F.col("__node")), "left_semi")
        return rows.withColumn("ord", F.concat("anc", F.array("node_id")))

    def located(self, steps: tuple[Step, ...]) -> Column:
        """Where nodes at the end of these steps are."""
        names = [s.name for s in steps]
        if None not in names:
            return F.col("path") == "/".join(map(in_path, names))
        found = F.col("depth") == len(names) - 1
        if names[-1] is not None:
            found = found & (F.col("element") == names[-1])
        for k, name in enumerate(names[:-1]):
            if name is not None:
                found = found & (F.get(F.split("path", "/"), F.lit(k)) == in_path(name))
        return found

    def down(self, rows: DataFrame, step: Step) -> DataFrame:
        below = self.nodes.where(F.col("parent_id").isNotNull())
        if step.name is not None:
            below = below.where(F.col("element") == step.name)
        came = rows.select(F.col("silo_id").alias("__silo"), F.col("node_id").alias("__node"), F.col("ord").alias("__ord"))
        _, fault = self.matching(step)
        if fault is None:  # the predicates reach the scan
            below = self.reached(below, step)
        joined = below.join(came, (F.col("silo_id") == F.col("__silo")) & (F.col("parent_id") == F.col("__node")))
        joined = joined if fault is None else self.reached(joined, step)
        return joined.select(*COLUMNS, F.concat("__ord", F.array("node_id")).alias("ord"))

    def up(self, rows: DataFrame) -> DataFrame:
        if self.options.above_root == "error":
            self.faults.append((rows.where(F.col("parent_id").isNull()), "a root has no parent"))
        if self.dedup:  # each parent once, whatever the number of children
            came = rows.select(F.col("silo_id").alias("__silo"), F.col("parent_id").alias("__node"))
            kept = self.nodes.join(came, (F.col("silo_id") == F.col("__silo")) & (F.col("node_id") == F.col("__node")), "left_semi")
            return kept.withColumn("ord", F.concat("anc", F.array("node_id")))
        came = rows.select(F.col("silo_id").alias("__silo"), F.col("parent_id").alias("__node"), F.col("ord").alias("__ord"))
        joined = self.nodes.join(came, (F.col("silo_id") == F.col("__silo")) & (F.col("node_id") == F.col("__node")))
        return joined.select(*COLUMNS, F.concat("__ord", F.array("node_id")).alias("ord"))

    def run(self, path: Path, start: DataFrame | None = None) -> DataFrame:
        steps = path.steps
        if start is None:
            head = next((k for k, s in enumerate(steps) if s.axis == "parent"), len(steps))
            if head == 0:
                raise TreeError("invalid_argument", "a root has no parent")
            rows, steps = self.from_roots(steps[:head]), steps[head:]
        else:
            rows = start.select(*COLUMNS)
            rows = (rows.dropDuplicates(_KEY) if self.dedup else rows).withColumn("ord", F.concat("anc", F.array("node_id")))
        for step in steps:
            rows = self.up(rows) if step.axis == "parent" else self.down(rows, step)
        return rows.select(*COLUMNS, "ord")


def _finished(rows: DataFrame, limit: int, reverse: bool, ordered: bool) -> DataFrame:
    order = ["silo_id", "branch", "ord"] if "branch" in rows.columns else ["silo_id", "ord"]
    if limit:
        rows = rows.orderBy(*order).limit(limit)
    if reverse:
        return rows.orderBy(*[F.desc(c) for c in order])
    return rows.orderBy(*order) if ordered else rows


def query(nodes: DataFrame, xpath: str, limit: int = 0, start: DataFrame | None = None, options: Options | None = None, ordered: bool = False) -> Answer:
    """Nodes of a union of paths, as often as they are found; a limit applies to the whole answer."""
    options = options or Options()
    paths = union(xpath, options.registry, options.precedence, start is not None)
    parts, faults, failed = [], [], None
    for k, path in enumerate(paths):
        planner = Planner(nodes, options)
        try:
            parts.append(planner.run(path, start).withColumn("branch", F.lit(k)))
        except TreeError as e:
            if e.code != "invalid_argument" or len(paths) == 1:
                raise
            failed = e
            continue
        if len(paths) == 1:
            faults += planner.faults
        # one failing path of several is skipped: its rows are those found anyway
    if not parts:
        raise failed or TreeError("not_found", "no path")
    rows = reduce(DataFrame.unionByName, parts)
    return Answer(_finished(rows, limit, False, ordered).drop("branch"), faults)


def query_prepared(nodes: DataFrame, path: Path, binds: tuple = (), limit: int = 0, reverse: bool = False, start: DataFrame | None = None, options: Options | None = None, ordered: bool = False) -> Answer:
    """Nodes of one path, each once; ``reverse`` turns what the limit left around."""
    planner = Planner(nodes, options or Options(), binds, dedup=limit != 1)
    rows = planner.run(path, start)
    return Answer(_finished(rows, limit, reverse, ordered), planner.faults)


class Query:
    """A prepared path with options; the same text is parsed once."""

    def __init__(self, xpath: str, options: Options | None = None, optimize: bool = True, reverse: bool = False, limit: int = 0) -> None:
        self.xpath, self.options, self.reverse, self.limit = xpath, options or Options(), reverse, limit
        self.path, self.n_binds = prepared(xpath, self.options.registry, self.options.precedence, optimize)
        self.binds: dict[int, str | int] = {}

    def bind(self, number: int, value: str | int) -> Query:
        if not 0 <= number < self.n_binds:
            raise TreeError("invalid", f"there is no value {number} to bind")
        self.binds[number] = value
        return self

    def bound(self, binds: tuple = ()) -> tuple:
        values = binds or tuple(self.binds[k] for k in sorted(self.binds))
        if len(values) != self.n_binds:
            raise TreeError("invalid", f"{self.n_binds} values must be bound, not {len(values)}")
        return values

    def run(self, nodes: DataFrame, *binds: str | int, limit: int | None = None, reverse: bool | None = None, start: DataFrame | None = None, ordered: bool = False) -> Answer:
        return query_prepared(nodes, self.path, self.bound(binds), self.limit if limit is None else limit, self.reverse if reverse is None else reverse, start, self.options, ordered)

    def __str__(self) -> str:
        return str(self.path)
