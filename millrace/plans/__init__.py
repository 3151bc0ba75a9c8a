"""The query dialect: lexer, syntax tree, parser and the compiler to DataFrames."""

from millrace.plans.compiler import compile_query
from millrace.plans.parser import parse

__all__ = ["compile_query", "parse"]
