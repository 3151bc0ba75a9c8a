"""Column expressions that bring careless spellings into one form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The signs that Unicode counts as white space, and the control signs next to them.
BLANKS = "".join(map(chr, [*range(0x00, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def stripped(column: Column) -> Column:
    """Without surrounding white space of any kind. No regular expression: this runs on every row of a log."""
    return F.btrim(column, F.lit(BLANKS))


def folded(column: Column) -> Column:
    """In lower case, without surrounding white space."""
    return F.lower(stripped(column))


def plain_path(column: Column) -> Column:
    """The path as a/b/c: either separator counts, empty and current-directory parts are left out; case counts."""
    parts = F.split(F.translate(column, "\\", "/"), "/")
    return F.array_join(F.filter(parts, lambda x: (x != "") & (x != ".")), "/")
