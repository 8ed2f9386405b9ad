"""Modules of file paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROOT_PART = "Mathlib"
#: Roots of packages that stand on their own.
OTHER_ROOTS = ["Init", "Batteries", "Std", "lake"]


def parts(path: Column | str) -> Column:
    """Components of a path, the last without its suffix."""
    bare = F.regexp_replace(F.coalesce(path if isinstance(path, Column) else F.col(path), F.lit("")), r"(?<=[^/])\.[^./]+$", "")
    return F.filter(F.split(bare, "/"), lambda p: (p != "") & (p != "."))


def module_of(path: Column | str) -> Column:
    """Dotted path from the first root component; a path without one stays a path; empty for an empty path."""
    p = parts(path)
    at = F.array_position(p, ROOT_PART)
    return F.when(at > 0, F.array_join(F.slice(p, at.cast("int"), F.size(p)), ".")).otherwise(F.array_join(p, "/"))


def top_module(path: Column | str, other_roots: list[str] = OTHER_ROOTS) -> Column:
    """Component after the root; else the first of ``other_roots``; else ``External``; ``Unknown`` for an empty path."""
    p = parts(path)
    at = F.array_position(p, ROOT_PART).cast("int")
    roots = F.array(*map(F.lit, other_roots)) if other_roots else F.array().cast("array<string>")
    other = F.coalesce(F.get(F.filter(p, lambda x: F.array_contains(roots, x)), F.lit(0)), F.lit("External"))
    return F.when(F.size(p) == 0, "Unknown").when(at > 0, F.coalesce(F.get(p, at), F.lit(ROOT_PART))).otherwise(other)


def second_part(module: Column | str) -> Column:
    """Element 1 of a dotted module; null if there is none."""
    return F.get(F.split(module, r"\."), F.lit(1))


def sql_parts(e: str) -> str:
    return f"list_filter(string_split(regexp_replace(coalesce({e}, ''), '([^/])\\.[^./]+$', '\\1'), '/'), lambda p: p <> '' and p <> '.')"


def sql_module_of(e: str) -> str:
    p = sql_parts(e)
    return f"case when coalesce(list_position({p}, '{ROOT_PART}'), 0) > 0 then array_to_string(({p})[list_position({p}, '{ROOT_PART}'):], '.') else array_to_string({p}, '/') end"


def sql_top_module(e: str, other_roots: list[str] = OTHER_ROOTS) -> str:
    p = sql_parts(e)
    roots = "[" + ", ".join(f"'{r}'" for r in other_roots) + "]::varchar[]"
    return f"case when len({p}) = 0 then 'Unknown' when coalesce(list_position({p}, '{ROOT_PART}'), 0) > 0 then coalesce(({p})[list_position({p}, '{ROOT_PART}') + 1], '{ROOT_PART}') else coalesce(list_filter({p}, lambda x: list_contains({roots}, x))[1], 'External') end"
