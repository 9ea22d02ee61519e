"""Predicates to Catalyst expressions over the node table.

Every comparison is two-valued: it never yields SQL null, so that filters may be reordered freely. A
text compared with a number that it doesn't hold, as ``number()`` of such a text, makes the comparison false and is noted in ``faults``,
which a query can check on the rows that it reaches.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import match_words, search_words, tokens_of
from .syntax import COMPARISONS, FUNCTIONS, Bind, Call, Expression, Literal, Registry, bad, bare

Typed = tuple[str, Column]
_U32 = 0xFFFFFFFF


def attribute(name: Column | str) -> Column:
    """An attribute's value, or null."""
    name = F.lit(name) if isinstance(name, str) else name
    return F.get(F.filter("attrs", lambda a: a["name"] == name), F.lit(0))["value"]


def uint(text: Column) -> Column:
    """A text as an unsigned number: hexadecimal after 0x, 0 for junk, null for null."""
    hexadecimal = F.conv(F.regexp_extract(text, r"^0x([0-9a-fA-F]+)", 1), 16, 10)
    decimal = F.regexp_extract(text, r"^\s*(\d+)", 1)
    top = F.lit(str((1 << 64) - 1)).cast("decimal(20,0)")
    value = F.when(text.startswith("0x"), F.coalesce(hexadecimal.try_cast("decimal(20,0)"), F.lit(0))).otherwise(F.when(decimal == "", F.lit(0)).otherwise(F.coalesce(decimal.try_cast("decimal(20,0)"), top)))
    return F.when(text.isNotNull(), F.least(value, top))


@F.pandas_udf(T.BooleanType())
def _match(text: pd.Series, search: pd.Series) -> pd.Series:
    return pd.Series([bool(match_words(t, s)) if t is not None and s is not None else False for t, s in zip(text, search, strict=True)])


@F.pandas_udf(T.BooleanType())
def _search(text: pd.Series, search: pd.Series) -> pd.Series:
    one = lambda t, s: search_words(t, s) if t.isascii() and s.isascii() else match_words(t, s)
    return pd.Series([bool(one(t, s)) if t is not None and s is not None else False for t, s in zip(text, search, strict=True)])


def _ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


@dataclass
class Compiler:
    """``named`` tells by which rank positions count; ``binds`` are the bound values."""

    named: bool = True
    binds: tuple[str | int, ...] = ()
    registry: Registry = field(default_factory=Registry)
    parity: bool = True
    faults: list[Column] = field(default_factory=list)

    def condition(self, e: Expression) -> Column:
        """A whole predicate, which must be a truth value."""
        kind, column = self.typed(e)
        if kind != "bool":
            raise bad("a predicate must be a truth value")
        return column

    def typed(self, e: Expression) -> Typed:
        e = bare(e)
        if isinstance(e, Literal):
            kind = "text" if e.kind in ("text", "indexed") else e.kind
            return kind, F.lit(e.value).cast({"text": "string", "int": "long", "bool": "boolean"}[kind])
        if isinstance(e, Bind):
            if e.number >= len(self.binds):
                raise bad(f"nothing is bound to value {e.number + 1}")
            value = self.binds[e.number]
            if not isinstance(value, (str, int, type(None))) or isinstance(value, int) and not 0 <= value <= _U32:
                raise bad(f"{value!r} can't be bound")
            return ("int", F.lit(value).cast("long")) if isinstance(value, int) else ("text", F.lit(value).cast("string"))
        arity = self.registry.arities.get(e.name, FUNCTIONS.get(e.name, -1))
        if arity == -1:
            raise bad("a list is only allowed right of =")
        if arity is not None and len(e.args) != arity:
            raise bad(f"{e.name}() takes {arity} arguments, not {len(e.args)}")
        if e.name in self.registry.functions:
            return self.registry.functions[e.name](*map(self.typed, e.args))
        return self.call(e)

    def text(self, e: Expression) -> Column:
        kind, column = self.typed(e)
        if kind != "text":
            raise bad("text was expected")
        return column

    def number(self, e: Expression) -> Column:
        kind, column = self.typed(e)
        if kind == "text":
            raise bad("a number or a truth value was expected")
        return column.cast("long")

    def as_number(self, text: Column) -> Column:
        """A text's number of 32 bits; null, with a fault noted unless the text is null, where there is none."""
        value = F.when(text.rlike("^[0-9]{1,10}$"), text.try_cast("long"))
        value = F.when(value <= _U32, value)
        self.faults.append(text.isNotNull() & value.isNull())
        return value

    def call(self, e: Call) -> Typed:
        name, args = e.name, e.args
        if name == "attr":
            return "text", attribute(bare(args[0]).value if isinstance(bare(args[0]), Literal) else self.text(args[0]))
        if name in ("text", "tail"):
            return "text", F.coalesce(F.col(name), F.lit(""))
        if name == "position":
            return "int", F.col("name_pos" if self.named else "sib_pos")
        if name == "first":
            return "bool", F.col("name_pos" if self.named else "sib_pos") == 1
        if name == "last":
            return "bool", F.col("next_id").isNull()
        if name in ("and", "or"):
            a, b = (F.coalesce(self.number(x) != 0, F.lit(False)) for x in args)
            return "bool", a & b if name == "and" else a | b
        if name == "not":
            kind, a = self.typed(args[0])
            return "bool", a.isNull() if kind == "text" else F.coalesce(a.cast("long") == 0, F.lit(False))
        if name in COMPARISONS:
            return "bool", self.comparison(name, *map(self.typed, args))
        if name == "in":
            needle, items = self.text(args[0]), [bare(a) for a in args[1:]]
            if all(isinstance(a, Literal) and isinstance(a.value, str) for a in items):
                return "bool", F.coalesce(needle.isin([a.value for a in items]), F.lit(False))
            return "bool", needle.isNotNull() & reduce(Column.__or__, [needle.eqNullSafe(self.text(a)) for a in items], F.lit(False))
        if name in ("lower-case", "stem"):
            return "text", F.lower(self.text(args[0]))
        if name == "upper-case":
            return "text", F.upper(self.text(args[0]))
        if name == "string":
            return "text", self.number(args[0]).cast("string")
        if name == "number":
            return "int", self.as_number(self.text(args[0]))
        if name == "string-length":
            return "int", F.coalesce(F.octet_length(self.text(args[0])), F.lit(0)).cast("long")
        if name == "search":
            return "bool", self.search(*args)
        a, b = map(self.text, args)
        return "bool", F.coalesce({"contains": F.contains, "starts-with": F.startswith, "ends-with": F.endswith}[name](a, b), F.lit(False))

    def comparison(self, name: str, left: Typed, right: Typed) -> Column:
        (ka, a), (kb, b) = left, right
        if ka == kb == "text":
            less = lambda x, y: (x.isNull() & y.isNotNull()) | F.coalesce(x < y, F.lit(False))
            return {"eq": lambda: a.eqNullSafe(b), "ne": lambda: ~a.eqNullSafe(b), "lt": lambda: less(a, b), "gt": lambda: less(b, a), "le": lambda: ~less(b, a), "ge": lambda: ~less(a, b)}[name]()
        swapped = self.parity and ka != "text" and kb == "text" and name not in ("eq", "ne")
        a, b = (self.as_number(c) if k == "text" else c.cast("long") for k, c in (left, right))
        if swapped:
            a, b = b, a
        made = {"eq": a == b, "ne": a != b, "lt": a < b, "gt": a > b, "le": a <= b, "ge": a >= b}[name]
        return F.coalesce(made, F.lit(False))

    def search(self, a: Expression, b: Expression) -> Column:
        """Word search: by tokens where the node has them, else by the text."""
        text, search, sought = self.text(a), self.text(b), bare(b)
        fixed = sought.value if isinstance(sought, Literal) else self.binds[sought.number] if isinstance(sought, Bind) else None
        if not isinstance(fixed, str):
            return F.coalesce(_search(text, search), F.lit(False))
        if fixed.isascii():
            slow = F.coalesce(text.rlike(r"(?i)(^|[^A-Za-z0-9])" + re.escape(fixed)), F.lit(False)) if fixed[:1].isalnum() else F.lit(False)
            slow = F.when(_ascii(text), slow).otherwise(F.coalesce(_match(F.when(~_ascii(text), text), search), F.lit(False)))
        else:
            slow = F.coalesce(_match(text, search), F.lit(False))
        if not (isinstance(bare(a), Call) and bare(a).name == "text"):
            return slow
        tokens = tokens_of(fixed)
        fast = F.exists("tokens", lambda t: reduce(Column.__or__, [F.startswith(t, F.lit(s)) for s in tokens])) if tokens else None
        return slow if fast is None else F.when(F.col("is_tokenized"), F.coalesce(fast, F.lit(False))).otherwise(slow)
