"""Normal forms of catalogue keys, as Column functions (no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def siglum(c: Column) -> Column:
    """White space, '.' and '^' dropped, '_' as '-', upper case, then a trailing '-digits' dropped. Null stays null."""
    bare = F.upper(F.translate(F.regexp_replace(c, r"(?U)[\s.^]", ""), "_", "-"))
    return F.regexp_replace(bare, r"-[0-9]+$", "")


def plate(c: Column) -> Column:
    """Trimmed, lower case, a trailing /rec or /vrs dropped. Null stays null."""
    return F.regexp_replace(F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), r"/(rec|vrs)$", "")


def letters(c: Column) -> Column:
    """The text without any white space."""
    return F.regexp_replace(c, r"(?U)\s+", "")


def aliased(c: Column, aliases: dict[str, str]) -> Column:
    """A siglum in normal form, by its usual name where `aliases` (a small table of normal forms) has one."""
    if not aliases:
        return siglum(c)
    known = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return F.coalesce(F.try_element_at(known, siglum(c)), siglum(c))
