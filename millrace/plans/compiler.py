"""From a syntax tree to a DataFrame.

Every column gets an internal name that is unique in the query, so that names
that two tables share can be told apart: a bare name means the leftmost table that
has it, t.c the column of that table. Names count in their case.

Logic. NULL = NULL is true, other comparisons with NULL are false, NOT of what is
not true is true. In a positive place null and false do the same to a filter, so
comparisons stay bare there and reach the scan; only the operand of NOT is made
two-valued. Comparisons of numbers with strings or booleans are false; LIKE drops
every % and looks for the rest anywhere.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import NotFound, PlanError
from millrace.plans import ast


@dataclass(frozen=True)
class Field:
    table: str
    name: str
    internal: str
    kind: T.DataType


class Scope:
    """The columns in reach, leftmost first."""

    def __init__(self, fields: list[Field]):
        self.fields = fields

    def find(self, text: str) -> Field:
        for f in self.fields:
            if f.name == text:
                return f
        table, _, name = text.partition(".")
        for f in self.fields:
            if f.table == table and f.name == name:
                return f
        raise PlanError(f"unknown column {text}; there are {', '.join(f'{f.table}.{f.name}' for f in self.fields)}")


def _family(kind: T.DataType | None) -> str:
    match kind:
        case None | T.NullType():
            return "null"
        case T.BooleanType():
            return "boolean"
        case T.NumericType():
            return "number"
        case T.StringType() | T.CharType() | T.VarcharType():
            return "string"
        case T.DateType() | T.TimestampType() | T.TimestampNTZType():
            return "time"
        case _:
            return kind.typeName()


def _literal_family(value: object) -> str:
    return {type(None): "null", bool: "boolean", int: "number", float: "number", str: "string"}[type(value)]


class Predicates:
    """Compiles conditions over a scope."""

    def __init__(self, scope: Scope):
        self.scope = scope

    def condition(self, node) -> Column:
        """A boolean that may be null where it isn't true."""
        match node:
            case ast.Both(left, right):
                return self.condition(left) & self.condition(right)
            case ast.Either(left, right):
                return self.condition(left) | self.condition(right)
            case ast.Negate(part):
                return ~F.coalesce(self.condition(part), F.lit(False))
            case ast.Compare(op, left, right):
                return self.compare(op, left, right)
            case ast.Like(part, pattern):
                column, family = self.operand(part)
                return column.contains(pattern.replace("%", "")) if family == "string" else F.lit(False)
            case ast.Among(part, values):
                column, family = self.operand(part)
                accepted = {family, "string"} if family == "time" else {family}  # a time may be written as a string
                fitting = [v.value for v in values if v.value is not None and _literal_family(v.value) in accepted]
                if family == "time":
                    fitting = [F.lit(v).cast(self.scope.find(part.text).kind) for v in fitting]
                test = column.isin(fitting) if fitting else F.lit(False)
                return test | column.isNull() if any(v.value is None for v in values) else test
            case ast.Between(part, low, high):
                return self.compare(">=", part, low) & self.compare("<=", part, high)
            case ast.Name(text):
                field = self.scope.find(text)
                if _family(field.kind) != "boolean":
                    raise PlanError(f"{text} is no condition: it isn't boolean")
                return F.col(field.internal)
            case ast.Literal(value):
                return F.lit(value if isinstance(value, bool) else True)
        raise PlanError(f"{node} is no condition")

    def operand(self, node) -> tuple[Column, str]:
        match node:
            case ast.Name(text):
                field = self.scope.find(text)
                return F.col(field.internal), _family(field.kind)
            case ast.Literal(value):
                return F.lit(value), _literal_family(value)
        raise PlanError(f"a comparison of {node} makes no sense")

    def compare(self, op: str, left, right) -> Column:
        (a, fa), (b, fb) = self.operand(left), self.operand(right)
        if "null" in (fa, fb):
            if op != "=":
                return F.lit(False)
            return F.lit(True) if fa == fb == "null" else (a if fb == "null" else b).isNull()
        if {fa, fb} == {"time", "string"} and any(isinstance(x, ast.Literal) for x in (left, right)):
            fb = fa  # a time against a time written as a string
        if fa != fb or (fa == "boolean" and op not in ("=", "!=")):
            # two nulls are equal whatever their types
            columns = isinstance(left, ast.Name) and isinstance(right, ast.Name)
            return a.isNull() & b.isNull() if op == "=" and columns else F.lit(False)
        if op == "=":
            plain = isinstance(left, ast.Literal) or isinstance(right, ast.Literal)
            return a == b if plain else a.eqNullSafe(b)
        return {"!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def _table(tables: Mapping[str, DataFrame], name: str, number: int) -> tuple[DataFrame, list[Field]]:
    if name not in tables:
        raise NotFound(f"unknown table {name}")
    df = tables[name]
    fields = [Field(name, f.name, f"_{number}_{i}", f.dataType) for i, f in enumerate(df.schema.fields)]
    return df.toDF(*[f.internal for f in fields]), fields


def _aggregate(call: ast.Aggregate, scope: Scope) -> Column:
    if call.column == "*":
        if call.function != "COUNT":
            raise PlanError(f"{call} needs a column")
        return F.count(F.lit(1))
    field = scope.find(call.column)
    family, column = _family(field.kind), F.col(field.internal)
    match call.function:
        case "COUNT":
            return F.count(column)
        case "SUM" | "AVG":
            if family != "number":
                raise PlanError(f"{call} needs numbers")
            return F.sum(column) if call.function == "SUM" else F.avg(column)
        case "MIN":
            return F.min(column)
        case _:
            return F.max(column)


def compile_query(query: ast.Query, tables: Mapping[str, DataFrame]) -> DataFrame:
    """The plan of a query over named DataFrames; nothing runs."""
    df, fields = _table(tables, query.table, 0)
    for number, join in enumerate(query.joins, 1):
        right, more = _table(tables, join.table, number)
        fields = fields + more
        on = Predicates(Scope(fields)).condition(join.on)
        df = df.join(right, on, {"INNER": "inner", "LEFT": "left", "RIGHT": "right", "FULL": "full"}[join.kind])
    scope = Scope(fields)
    if query.where is not None:
        df = df.filter(Predicates(scope).condition(query.where))
    calls = [i for i in query.items if isinstance(i.what, ast.Aggregate)]
    if query.group or calls:
        df, output = _grouped(df, query, scope, calls)
        hidden: list[Field] = []
    else:
        if query.having is not None:
            raise PlanError("HAVING needs GROUP BY or an aggregate")
        output, hidden = [], fields
        for item in query.items:
            if item.what == "*":
                output += [Field("", f.name, f.internal, f.kind) for f in fields]
            else:
                field = scope.find(item.what.text)
                name = item.alias or field.name
                output.append(Field("", name, field.internal, field.kind))
    if query.order:
        reach = Scope(output + hidden)
        keys = [F.col(reach.find(o.name).internal) for o in query.order]
        df = df.orderBy(*[k.desc() if o.descending else k.asc() for k, o in zip(keys, query.order, strict=True)])
    if query.offset:
        df = df.offset(query.offset)
    if query.limit is not None:
        df = df.limit(query.limit)
    return df.select(*[F.col(f.internal).alias(f.name) for f in output])


def _grouped(df: DataFrame, query: ast.Query, scope: Scope, calls: list[ast.Item]) -> tuple[DataFrame, list[Field]]:
    """Keys in GROUP BY order, then aggregates in SELECT order."""
    keys = [scope.find(g) for g in query.group]
    names = {}
    for item in query.items:
        if item.what == "*":
            raise PlanError("* can't stand in a grouped query")
        if isinstance(item.what, ast.Name):
            field = scope.find(item.what.text)
            if field not in keys:
                raise PlanError(f"{item.what} is neither grouped nor aggregated")
            if item.alias:
                names[field] = item.alias
    results = [(item.alias or str(item.what), _aggregate(item.what, scope).alias(f"_a_{i}")) for i, item in enumerate(calls)]
    columns = [F.col(k.internal) for k in keys]
    if results:
        df = df.groupBy(*columns).agg(*[c for _, c in results]) if keys else df.agg(*[c for _, c in results])
    else:
        df = df.select(*columns).distinct()
    output = [Field(k.table, names.get(k, k.name), k.internal, k.kind) for k in keys]
    output += [Field("", name, f"_a_{i}", df.schema[f"_a_{i}"].dataType) for i, (name, _) in enumerate(results)]
    if query.having is not None:
        # a key may be called by its own name although it has an alias
        own = [k for k in keys if k in names]
        df = df.filter(Predicates(Scope(output + own)).condition(query.having))
    return df, output
