"""Syntax tree of a query; str() of a node is text that parses to the same tree."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Name:
    text: str

    def __str__(self) -> str:
        return self.text


@dataclass(frozen=True)
class Literal:
    value: object

    def __str__(self) -> str:
        match self.value:
            case None:
                return "NULL"
            case bool():
                return str(self.value).upper()
            case str():
                return f"'{self.value}'"
            case float():
                return format(self.value, "f") if "e" in repr(self.value) else repr(self.value)
            case _:
                return str(self.value)


@dataclass(frozen=True)
class Compare:
    op: str
    left: object
    right: object

    def __str__(self) -> str:
        return f"({self.left} {self.op} {self.right})"


@dataclass(frozen=True)
class Both:
    left: object
    right: object

    def __str__(self) -> str:
        return f"({self.left} AND {self.right})"


@dataclass(frozen=True)
class Either:
    left: object
    right: object

    def __str__(self) -> str:
        return f"({self.left} OR {self.right})"


@dataclass(frozen=True)
class Negate:
    part: object

    def __str__(self) -> str:
        return f"(NOT {self.part})"


@dataclass(frozen=True)
class Like:
    part: object
    pattern: str

    def __str__(self) -> str:
        return f"({self.part} LIKE '{self.pattern}')"


@dataclass(frozen=True)
class Among:
    part: object
    values: tuple[Literal, ...]

    def __str__(self) -> str:
        return f"({self.part} IN ({', '.join(map(str, self.values))}))"


@dataclass(frozen=True)
class Between:
    part: object
    low: object
    high: object

    def __str__(self) -> str:
        return f"({self.part} BETWEEN {self.low} AND {self.high})"


@dataclass(frozen=True)
class Aggregate:
    function: str
    column: str

    def __str__(self) -> str:
        return f"{self.function}({self.column})"


@dataclass(frozen=True)
class Item:
    """One entry of the SELECT list: "*", a name or an aggregate."""

    what: object
    alias: str | None = None

    def __str__(self) -> str:
        return f"{self.what} AS {self.alias}" if self.alias else str(self.what)


@dataclass(frozen=True)
class Join:
    kind: str
    table: str
    on: object

    def __str__(self) -> str:
        return f"{self.kind} JOIN {self.table} ON {self.on}"


@dataclass(frozen=True)
class Order:
    name: str
    descending: bool = False

    def __str__(self) -> str:
        return f"{self.name} {'DESC' if self.descending else 'ASC'}"


@dataclass(frozen=True)
class Query:
    items: tuple[Item, ...]
    table: str
    joins: tuple[Join, ...] = ()
    where: object = None
    group: tuple[str, ...] = ()
    having: object = None
    order: tuple[Order, ...] = ()
    limit: int | None = None
    offset: int | None = None

    def __str__(self) -> str:
        parts = [f"SELECT {', '.join(map(str, self.items))} FROM {self.table}", *map(str, self.joins)]
        if self.where is not None:
            parts.append(f"WHERE {self.where}")
        if self.group:
            parts.append(f"GROUP BY {', '.join(self.group)}")
        if self.having is not None:
            parts.append(f"HAVING {self.having}")
        if self.order:
            parts.append(f"ORDER BY {', '.join(map(str, self.order))}")
        if self.limit is not None:
            parts.append(f"LIMIT {self.limit}")
        if self.offset is not None:
            parts.append(f"OFFSET {self.offset}")
        return " ".join(parts)
