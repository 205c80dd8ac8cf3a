"""SOQL -> DataFrame.

Every relationship prefix that some clause uses becomes one left join, shared
by all paths through it; Catalyst turns it into an inner join where a filter
rejects nulls, prunes columns and pushes filters to the scans. IN subqueries
are predicate subqueries, so Spark plans semi and null-aware anti joins.
"""

from __future__ import annotations

import datetime as dt
import itertools
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ast import Among, Call, Compare, Literal, Logic, Not, Order, Path, Query, TypeOf, walk
from .edit import is_aggregate
from .parser import parse

_views = itertools.count()


@dataclass(frozen=True)
class Polymorphic:
    """A reference to one of several objects; ``tag`` is SQL over the row that names it."""

    column: str
    tag: str
    targets: tuple[str, ...]


@dataclass(frozen=True)
class Object:
    name: str
    table: DataFrame
    key: str | None
    parents: dict[str, tuple[str, str]] = field(default_factory=dict)
    children: dict[str, tuple[str, str]] = field(default_factory=dict)
    polymorphic: dict[str, Polymorphic] = field(default_factory=dict)
    labels: dict[str, dict[str, str]] = field(default_factory=dict)
    #: Column with the currency code of a row's amounts.
    currency: str | None = None


class Records:
    """Objects by name, compared without case."""

    def __init__(self, objects: list[Object]):
        self.objects = {o.name.lower(): o for o in objects}

    def __getitem__(self, name: str) -> Object:
        if name.lower() not in self.objects:
            raise LookupError(f"no object {name}")
        return self.objects[name.lower()]


def _get(mapping: dict, name: str):
    return next((v for k, v in mapping.items() if k.lower() == name.lower()), None)


def date_range(name: str, n: int | None, as_of: dt.date, fiscal_start: int = 1, week_start: int = 0) -> tuple[dt.date, dt.date]:
    """[start, end) of a date literal. Weeks begin on ``week_start`` (0: Monday); fiscal years in month ``fiscal_start``."""
    def months(d: dt.date, k: int) -> dt.date:
        m = d.year * 12 + d.month - 1 + k
        return dt.date(m // 12, m % 12 + 1, 1)

    day = dt.timedelta(days=1)
    if name in ("TODAY", "YESTERDAY", "TOMORROW"):
        at = as_of + day * {"TODAY": 0, "YESTERDAY": -1, "TOMORROW": 1}[name]
        return at, at + day
    if name.endswith("90_DAYS"):
        name, n = name.split("_")[0] + "_N_DAYS", 90
    parts = name.split("_")
    fiscal = "FISCAL" in parts
    if name.startswith("N_"):
        unit, which = parts[1], "AGO"
    else:
        unit, which = parts[-1], parts[0]
    unit = unit.rstrip("S") if unit != "DAYS" else "DAY"
    if unit == "DAY":
        if which == "AGO":
            return as_of - n * day, as_of - (n - 1) * day
        return (as_of - n * day, as_of + day) if which == "LAST" else (as_of + day, as_of + (n + 1) * day)
    if unit == "WEEK":
        at, shift = as_of - day * ((as_of.weekday() - week_start) % 7), lambda d, k: d + 7 * k * day
    else:
        size = {"MONTH": 1, "QUARTER": 3, "YEAR": 12}[unit]
        first = fiscal_start if fiscal else 1
        back = (as_of.month - first) % size if unit != "YEAR" else (as_of.month - first) % 12
        at, shift = months(as_of, -back), lambda d, k: months(d, size * k)
    if n is None:
        at = shift(at, {"LAST": -1, "THIS": 0, "NEXT": 1}[which])
        return at, shift(at, 1)
    if which == "AGO":
        return shift(at, -n), shift(at, 1 - n)
    return (shift(at, -n), at) if which == "LAST" else (shift(at, 1), shift(at, n + 1))


_DATE_PARTS = {
    "CALENDAR_YEAR": F.year, "CALENDAR_QUARTER": F.quarter, "CALENDAR_MONTH": F.month, "DAY_IN_MONTH": F.dayofmonth, "DAY_IN_WEEK": F.dayofweek, "DAY_IN_YEAR": F.dayofyear,
    "DAY_ONLY": F.to_date, "HOUR_IN_DAY": F.hour, "WEEK_IN_YEAR": lambda c: F.ceil(F.dayofyear(c) / 7).cast("int"), "WEEK_IN_MONTH": lambda c: F.ceil(F.dayofmonth(c) / 7).cast("int"),
}


class Compiler:
    """``rates``: worth of one unit of each currency code in the reader's own,
    for CONVERTCURRENCY; ``timezone``: the reader's, for CONVERTTIMEZONE, whose
    values are UTC. Without them these two functions are errors."""

    def __init__(self, spark: SparkSession, records: Records, as_of: dt.date | None = None, fiscal_start: int = 1, week_start: int = 0, ignore_case: bool = False, rates: dict[str, float] | None = None, timezone: str | None = None):
        self.rates, self.timezone, self.views = rates, timezone, []
        self.spark, self.records, self.as_of = spark, records, as_of or dt.date.today()
        self.fiscal_start, self.week_start, self.ignore_case = fiscal_start, week_start, ignore_case

    def run(self, query: str | Query) -> DataFrame:
        try:
            return _Plan(self, parse(query) if isinstance(query, str) else query).frame()
        finally:
            # analysed plans hold what the views stand for
            while self.views:
                self.spark.catalog.dropTempView(self.views.pop())


class _Plan:
    def __init__(self, compiler: Compiler, q: Query, keep: str | None = None):
        self.c, self.q, self.keep = compiler, q, keep
        self.object = compiler.records[q.source]
        self.prefixes: dict[tuple, tuple[str, Object]] = {(): ("p0", self.object)}
        self.df = self._renamed(self.object, "p0")

    def _renamed(self, o: Object, alias: str) -> DataFrame:
        return o.table.select(*[F.col(f"`{c}`").alias(f"{alias}__{c}") for c in o.table.columns])

    # --- names

    def column(self, o: Object, alias: str, name: str) -> Column:
        found = next((c for c in o.table.columns if c.lower() == name.lower()), None)
        if found is None and name.lower() == "id" and o.key:
            found = o.key
        if found is None:
            raise LookupError(f"no field {name} on {o.name}")
        return F.col(f"{alias}__{found}")

    def _own(self, parts: tuple[str, ...]) -> tuple[str, ...]:
        heads = {self.q.source.lower(), (self.q.alias or self.q.source).lower()}
        return parts[1:] if len(parts) > 1 and parts[0].lower() in heads and _get(self.object.parents, parts[0]) is None else parts

    def resolve(self, p: Path) -> Column:
        parts = self._own(p.parts)
        *relations, name = parts
        if len(relations) > 5:
            raise LookupError(f"{p} has more than 5 levels")
        at: tuple = ()
        for k, r in enumerate(relations):
            alias, o = self.prefixes[at]
            poly = _get(o.polymorphic, r)
            if poly is not None:
                if k == len(relations) - 1 and name.lower() == "type":
                    return self.tag(alias, o, poly)
                raise LookupError(f"{r} has several targets; use TYPEOF")
            step = (*at, r.lower())
            if step not in self.prefixes:
                link = _get(o.parents, r)
                if link is None:
                    raise LookupError(f"no relationship {r} on {o.name}")
                target = self.c.records[link[1]]
                new = f"p{len(self.prefixes)}"
                self.prefixes[step] = (new, target)
                self.df = self.df.join(self._renamed(target, new), self.column(o, alias, link[0]) == F.col(f"{new}__{target.key}"), "left")
            at = step
        alias, o = self.prefixes[at]
        return self.column(o, alias, name)

    def tag(self, alias: str, o: Object, poly: Polymorphic) -> Column:
        name = f"{alias}__tag_{poly.column}"
        if name not in self.df.columns:
            own = self.df.select("*", *[F.col(f"{alias}__{c}").alias(c) for c in o.table.columns])
            self.df = own.withColumn(name, F.expr(poly.tag)).drop(*o.table.columns)
        return F.col(name)

    # --- expressions

    def value(self, x) -> Column:
        if isinstance(x, Literal):
            return self.literal(x)
        if isinstance(x, Path):
            return self.resolve(x)
        name = x.name.upper()
        if name in _DATE_PARTS:
            return _DATE_PARTS[name](self.value(x.args[0]))
        if name.startswith("FISCAL_"):
            moved = F.add_months(self.value(x.args[0]), -(self.c.fiscal_start - 1))
            return {"FISCAL_YEAR": F.year, "FISCAL_QUARTER": F.quarter, "FISCAL_MONTH": F.month}[name](moved)
        if name == "TOLABEL":
            path = x.args[0]
            _, o = self.prefixes[tuple(p.lower() for p in self._own(path.parts)[:-1])] if len(self._own(path.parts)) == 1 or self.value(path) is not None else (None, None)
            labels = _get(o.labels, path.parts[-1]) or {}
            col = self.value(path)
            return F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in labels.items() for v in kv]), col), col) if labels else col
        if name == "FORMAT":
            return self.value(x.args[0]).cast("string")
        if name == "CONVERTCURRENCY":
            path, inner = self._own(x.args[0].parts), self.value(x.args[0])
            alias, o = self.prefixes[tuple(p.lower() for p in path[:-1])]
            if not self.c.rates or o.currency is None:
                raise LookupError(f"no exchange rates for {x.args[0]}")
            rate = F.element_at(F.create_map(*[F.lit(v) for kv in self.c.rates.items() for v in kv]), self.column(o, alias, o.currency))
            return inner * rate
        if name == "CONVERTTIMEZONE":
            if self.c.timezone is None:
                raise LookupError("no time zone to convert to")
            return F.convert_timezone(F.lit("UTC"), F.lit(self.c.timezone), self.value(x.args[0]).cast("timestamp_ntz"))
        raise LookupError(f"no function {x.name}")

    def aggregate(self, x: Call) -> Column:
        name = x.name.upper()
        if name == "COUNT" and not x.args:
            return F.count(F.lit(1))
        arg = self.value(x.args[0])
        return {"COUNT": F.count, "COUNT_DISTINCT": F.countDistinct, "SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}[name](arg)

    def literal(self, x: Literal) -> Column:
        if x.kind == "date":
            return F.lit(dt.date.fromisoformat(x.value))
        if x.kind == "datetime":
            return F.lit(str(x.value)).cast("timestamp")
        return F.lit(x.value)

    def condition(self, x, of) -> Column:
        """of: how a compared value becomes a column."""
        if isinstance(x, Logic):
            out = self.condition(x.parts[0], of)
            for p in x.parts[1:]:
                out = out & self.condition(p, of) if x.op == "AND" else out | self.condition(p, of)
            return out
        if isinstance(x, Not):
            return ~self.condition(x.of, of)
        left = of(x.left)
        if isinstance(x, Among):
            return self._among(x, left)
        if x.right.kind == "null":
            return left.isNull() if x.op == "=" else left.isNotNull()
        if x.right.kind == "range":
            start, end = (F.lit(d) for d in date_range(x.right.value, x.right.n, self.c.as_of, self.c.fiscal_start, self.c.week_start))
            inside = (left >= start) & (left < end)
            return {"=": inside, "!=": ~inside, "<": left < start, "<=": left < end, ">": left >= end, ">=": left >= start}[x.op]
        if x.op == "LIKE":
            pattern = str(x.right.value)
            return F.lower(left).like(pattern.lower()) if self.c.ignore_case else left.like(pattern)
        right = self.literal(x.right)
        if x.right.kind == "date" and x.op in ("=", "!="):
            day = dt.date.fromisoformat(x.right.value)
            inside = (left >= F.lit(day)) & (left < F.lit(day + dt.timedelta(days=1)))
            return inside if x.op == "=" else ~inside
        if self.c.ignore_case and x.right.kind == "string":
            left, right = F.lower(left), F.lower(right)
        return {"=": left == right, "!=": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[x.op]

    def _among(self, x: Among, left: Column) -> Column:
        if x.op in ("INCLUDES", "EXCLUDES"):
            have = F.split(left, ";")
            hit = F.lit(False)
            for v in x.values:
                hit = hit | (F.size(F.array_except(F.array(*[F.lit(p) for p in str(v.value).split(";")]), have)) == 0)
            return hit if x.op == "INCLUDES" else ~hit
        if x.query:
            inner = _Plan(self.c, x.query).frame()
            view = f"soql_in_{next(_views)}"
            inner.toDF("v").createOrReplaceTempView(view)
            self.c.views.append(view)
            name = self._named(left)
            return F.expr(f"`{name}` {x.op} (SELECT v FROM {view})")
        plain = [v.value for v in x.values if v.kind != "null"]
        hit = left.isin(*plain) if plain else F.lit(False)
        if any(v.kind == "null" for v in x.values):
            hit = F.coalesce(hit, F.lit(False)) | left.isNull()
        return ~hit if x.op == "NOT IN" else hit

    def _named(self, col: Column) -> str:
        name = f"in__{next(_views)}"
        self.df = self.df.withColumn(name, col)
        return name

    # --- the plan

    def frame(self) -> DataFrame:
        q = self.q
        # joins first: every path of every clause, once
        for x in walk((tuple(i for i in q.items if not isinstance(i, (Query, TypeOf))), q.group, tuple(o.by for o in q.order))):
            if isinstance(x, Path) and not self._is_alias(x):
                self.resolve(x)
        if q.where is not None:
            test = self.condition(q.where, self.value)
            self.df = self.df.where(test)
        grouped = bool(q.group) or any(is_aggregate(i) for i in q.items)
        return self._grouped() if grouped else self._plain()

    def _is_alias(self, p: Path) -> bool:
        return len(p.parts) == 1 and any(getattr(i, "alias", None) and i.alias.lower() == p.parts[0].lower() for i in self.q.items)

    def _by_alias(self, x):
        if isinstance(x, Path) and len(x.parts) == 1:
            for i in self.q.items:
                if getattr(i, "alias", None) and i.alias.lower() == x.parts[0].lower():
                    return i
        return x

    @staticmethod
    def name_of(x, k: int = 0) -> str:
        if getattr(x, "alias", None):
            return x.alias
        return "_".join(x.parts) if isinstance(x, Path) else f"expr{k}"

    def _sorted(self, df: DataFrame, keys: list[tuple[Order, Column]]) -> DataFrame:
        if keys:
            df = df.orderBy(*[self._direction(o, c) for o, c in keys])
        if self.q.offset:
            df = df.offset(self.q.offset)
        return df.limit(self.q.limit) if self.q.limit is not None else df

    @staticmethod
    def _direction(o: Order, c: Column) -> Column:
        last = o.nulls == "LAST"
        if o.descending:
            return c.desc_nulls_last() if last else c.desc_nulls_first()
        return c.asc_nulls_last() if last else c.asc_nulls_first()

    def _plain(self) -> DataFrame:
        q, out, k = self.q, [], 0
        for i in q.items:
            if isinstance(i, Query):
                out.append(self._children(i))
            elif isinstance(i, TypeOf):
                out += self._typeof(i)
            else:
                out.append(self.value(i).alias(self.name_of(i, k)))
                k += not isinstance(i, Path)
        keys = [(o, self.value(self._by_alias(o.by))) for o in q.order]
        if self.keep is not None:
            return self._per_parent(out, keys)
        return self._sorted(self.df, keys).select(*out)

    def _grouped(self) -> DataFrame:
        q = self.q
        groups = [self._by_alias(g) for g in q.group]
        cols = [self.value(g).alias(f"g{k}") for k, g in enumerate(groups)]
        calls: dict[str, Call] = {}
        for x in walk((q.items, q.having, tuple(o.by for o in q.order))):
            if is_aggregate(x):
                calls.setdefault(str(x), x)
        named = {text: f"a{k}" for k, text in enumerate(calls)}
        aggs = [self.aggregate(x).alias(named[t]) for t, x in calls.items()]
        for x in walk((q.items, q.having)):
            if isinstance(x, Call) and x.name.upper() == "GROUPING":
                k = next(k for k, g in enumerate(groups) if str(g) == str(x.args[0]))
                if str(x) not in named:
                    named[str(x)] = f"n{k}"
                    aggs.append(F.grouping(f"g{k}").cast("int").alias(f"n{k}"))
        base = self.df.select("*", *cols)
        by = {"ROLLUP": base.rollup, "CUBE": base.cube}.get(q.group_kind, base.groupBy)(*[f"g{k}" for k in range(len(cols))])
        df = by.agg(*aggs) if aggs else by.agg(F.lit(1).alias("one"))

        def of(x) -> Column:
            x = self._by_alias(x)
            if str(x) in named:
                return F.col(named[str(x)])
            for k, g in enumerate(groups):
                if str(g).lower() == str(x).lower() or isinstance(g, Path) and isinstance(x, Path) and self._own(g.parts) == self._own(x.parts):
                    return F.col(f"g{k}")
            if isinstance(x, Call) and len(x.args) == 1 and x.name.upper() in ("TOLABEL", "FORMAT", "CONVERTCURRENCY"):
                inner = of(x.args[0])
                return inner.cast("string") if x.name.upper() == "FORMAT" else inner
            raise LookupError(f"{x} must be grouped or aggregated")

        if q.having is not None:
            df = df.where(self.condition(q.having, of))
        out, k = [], 0
        for i in q.items:
            out.append(of(i).alias(self.name_of(i, k)))
            k += not isinstance(i, Path) and not i.alias
        return self._sorted(df, [(o, of(o.by)) for o in q.order]).select(*out)

    def _children(self, sub: Query) -> Column:
        link = _get(self.object.children, sub.source)
        if link is None:
            raise LookupError(f"no child relationship {sub.source} on {self.object.name}")
        from dataclasses import replace

        rows = _Plan(self.c, replace(sub, source=link[0]), keep=link[1]).frame()
        name = f"c__{next(_views)}"
        self.df = self.df.join(rows.toDF(f"{name}_fk", name), F.col(f"p0__{self.object.key}") == F.col(f"{name}_fk"), "left")
        kind = self.df.schema[name].dataType.simpleString()
        return F.coalesce(F.col(name), F.array().cast(kind)).alias(sub.source)

    def _per_parent(self, out: list[Column], keys: list[tuple[Order, Column]]) -> DataFrame:
        """(foreign key, sorted array of rows) for a child subquery."""
        fk = self.column(self.object, "p0", self.keep)
        order = [self._direction(o, c) for o, c in keys]
        rows = self.df.where(fk.isNotNull()).select(fk.alias("fk"), F.struct(*out).alias("row"), *[c.alias(f"k{i}") for i, (_, c) in enumerate(keys)])
        if order or self.q.limit is not None or self.q.offset:
            w = Window.partitionBy("fk").orderBy(*[self._direction(o, F.col(f"k{i}")) for i, (o, _) in enumerate(keys)], F.col("row"))
            rows = rows.withColumn("n", F.row_number().over(w))
            first = self.q.offset or 0
            rows = rows.where(F.col("n") > first)
            if self.q.limit is not None:
                rows = rows.where(F.col("n") <= first + self.q.limit)
            return rows.groupBy("fk").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "row"))), lambda x: x["row"]).alias("rows"))
        return rows.groupBy("fk").agg(F.sort_array(F.collect_list("row")).alias("rows"))

    def _typeof(self, t: TypeOf) -> list[Column]:
        poly = _get(self.object.polymorphic, t.relation)
        if poly is None:
            raise LookupError(f"{t.relation} is not polymorphic")
        tag, ref = self.tag("p0", self.object, poly), self.column(self.object, "p0", poly.column)
        out: dict[str, Column] = {}
        covered = {k.lower() for k, _ in t.branches}
        branches = [*t.branches, *[(o, t.otherwise) for o in poly.targets if t.otherwise and o.lower() not in covered]]
        for kind, paths in branches:
            target = self.c.records[kind]
            alias = f"t{next(_views)}"
            self.df = self.df.join(self._renamed(target, alias), (tag == target.name) & (ref == F.col(f"{alias}__{target.key}")), "left")
            for p in paths:
                name = f"{t.relation}_{'_'.join(p.parts)}"
                col = self.column(target, alias, p.parts[-1])
                out[name] = F.coalesce(out[name], col) if name in out else col
        return [c.alias(n) for n, c in out.items()]
