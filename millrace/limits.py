"""Checks of keys, values, names and query texts."""

from __future__ import annotations

from millrace.errors import InvalidInput

MAX_KEY_BYTES = 16 * 1024 * 1024
MAX_VALUE_BYTES = 1024 * 1024 * 1024
MAX_QUERY_BYTES = 1024 * 1024
MAX_INDEX_NAME_BYTES = 256


def check_key(key: bytes) -> bytes:
    if not key:
        raise InvalidInput("a key must not be empty")
    if len(key) > MAX_KEY_BYTES:
        raise InvalidInput(f"a key may have {MAX_KEY_BYTES} bytes at most")
    return key


def check_value(value: bytes) -> bytes:
    if value is None:
        raise InvalidInput("a value must not be None; use delete")
    if len(value) > MAX_VALUE_BYTES:
        raise InvalidInput(f"a value may have {MAX_VALUE_BYTES} bytes at most")
    return value


def check_query(text: str) -> str:
    if not text or not text.strip():
        raise InvalidInput("a query must not be empty")
    if len(text.encode()) > MAX_QUERY_BYTES:
        raise InvalidInput(f"a query may have {MAX_QUERY_BYTES} bytes at most")
    return text


def check_index_name(name: str) -> str:
    if not name or len(name.encode()) > MAX_INDEX_NAME_BYTES:
        raise InvalidInput(f"an index name has 1 to {MAX_INDEX_NAME_BYTES} bytes")
    if any(x in name for x in ("/", "\\", "..", "\0")):
        raise InvalidInput("an index name must not hold path signs")
    return name
