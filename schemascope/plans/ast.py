"""The SOQL syntax tree: frozen values, and a printer that gives back equivalent text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields, is_dataclass


@dataclass(frozen=True)
class Path:
    parts: tuple[str, ...]
    alias: str | None = None

    def __str__(self) -> str:
        return ".".join(self.parts)


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple = ()
    alias: str | None = None

    def __str__(self) -> str:
        return f"{self.name}({', '.join(map(str, self.args))})"


@dataclass(frozen=True)
class TypeOf:
    relation: str
    branches: tuple[tuple[str, tuple[Path, ...]], ...]
    otherwise: tuple[Path, ...] = ()

    def __str__(self) -> str:
        whens = " ".join(f"WHEN {t} THEN {', '.join(map(str, p))}" for t, p in self.branches)
        tail = f" ELSE {', '.join(map(str, self.otherwise))}" if self.otherwise else ""
        return f"TYPEOF {self.relation} {whens}{tail} END"


@dataclass(frozen=True)
class Literal:
    """kind: string, number, boolean, null, date, datetime, range (a date literal)."""

    kind: str
    value: object = None
    n: int | None = None

    def __str__(self) -> str:
        if self.kind == "string":
            return "'" + str(self.value).replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\t", "\\t").replace("\r", "\\r") + "'"
        if self.kind == "null":
            return "null"
        if self.kind == "boolean":
            return "TRUE" if self.value else "FALSE"
        if self.kind == "range":
            return f"{self.value}:{self.n}" if self.n is not None else str(self.value)
        return str(self.value)


@dataclass(frozen=True)
class Compare:
    left: Path | Call
    op: str
    right: Literal

    def __str__(self) -> str:
        return f"{self.left} {self.op} {self.right}"


@dataclass(frozen=True)
class Among:
    """[NOT] IN over literals or a subquery, INCLUDES or EXCLUDES over literals."""

    left: Path | Call
    op: str
    values: tuple[Literal, ...] = ()
    query: "Query | None" = None

    def __str__(self) -> str:
        return f"{self.left} {self.op} ({self.query if self.query else ', '.join(map(str, self.values))})"


@dataclass(frozen=True)
class Not:
    of: object

    def __str__(self) -> str:
        return f"NOT ({self.of})"


@dataclass(frozen=True)
class Logic:
    op: str
    parts: tuple

    def __str__(self) -> str:
        return f" {self.op} ".join(f"({p})" if isinstance(p, Logic) else str(p) for p in self.parts)


@dataclass(frozen=True)
class Order:
    by: Path | Call
    descending: bool = False
    nulls: str | None = None

    def __str__(self) -> str:
        return f"{self.by} {'DESC' if self.descending else 'ASC'}" + (f" NULLS {self.nulls}" if self.nulls else "")


@dataclass(frozen=True)
class Query:
    items: tuple
    source: str
    alias: str | None = None
    scope: str | None = None
    where: object = None
    group: tuple = ()
    group_kind: str | None = None
    having: object = None
    order: tuple[Order, ...] = ()
    limit: int | None = None
    offset: int | None = None

    def __str__(self) -> str:
        def item(x) -> str:
            return f"({x})" if isinstance(x, Query) else str(x) + (f" {x.alias}" if getattr(x, "alias", None) else "")

        out = f"SELECT {', '.join(map(item, self.items))} FROM {self.source}" + (f" {self.alias}" if self.alias else "")
        if self.scope:
            out += f" USING SCOPE {self.scope}"
        if self.where is not None:
            out += f" WHERE {self.where}"
        if self.group:
            groups = ", ".join(map(str, self.group))
            out += f" GROUP BY {f'{self.group_kind}({groups})' if self.group_kind else groups}"
        if self.having is not None:
            out += f" HAVING {self.having}"
        if self.order:
            out += f" ORDER BY {', '.join(map(str, self.order))}"
        if self.limit is not None:
            out += f" LIMIT {self.limit}"
        if self.offset is not None:
            out += f" OFFSET {self.offset}"
        return out


def walk(node) -> Iterator:
    """The node and all below it, in order."""
    yield node
    if isinstance(node, tuple):
        for x in node:
            yield from walk(x)
    elif is_dataclass(node):
        for f in fields(node):
            yield from walk(getattr(node, f.name))
