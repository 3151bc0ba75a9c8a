"""Millrace: relational queries and versioned key-value data on Spark DataFrames."""

#: Of the commit files of versioned tables.
FORMAT_VERSION = 1

from millrace.errors import (  # noqa: E402
    ConflictError,
    CorruptionError,
    InvalidInput,
    InvalidOperation,
    MillraceError,
    NotFound,
    TransactionError,
)

__all__ = [
    "FORMAT_VERSION",
    "ConflictError",
    "CorruptionError",
    "InvalidInput",
    "InvalidOperation",
    "MillraceError",
    "NotFound",
    "TransactionError",
]
