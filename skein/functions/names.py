"""Declaration names and tokens, as column expressions and as the equal SQL text.

White space is Unicode's White_Space property, written out so that the JVM, Python and SQL engines agree on it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: every code point with the White_Space property.
WHITE = "\t\n\x0b\x0c\r \x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"
#: Fixed value: the punctuation that separates tokens.
SEPARATORS = ",;[]⟨⟩(){}"
ROOT = "_root_."


def clean_name(c: Column | str) -> Column:
    """Trim white space, drop one leading ``_root_.``; null where nothing is left (an empty value is no name)."""
    t = F.trim(c if isinstance(c, Column) else F.col(c), F.lit(WHITE))
    return F.nullif(F.when(F.startswith(t, F.lit(ROOT)), F.substr(t, F.lit(len(ROOT) + 1))).otherwise(t), F.lit(""))


def clean_names(c: Column | str) -> Column:
    """The names of an array: cleaned, without null and empty elements, repeats kept. A null array stays null."""
    return F.array_compact(F.transform(c, clean_name))


def tokens(c: Column | str) -> Column:
    """Tokens of a tactic: separators count as blanks, runs of white space split. Null and empty text have none."""
    blanks = SEPARATORS + WHITE.replace(" ", "")
    flat = F.translate(F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit("")), blanks, " " * len(blanks))
    return F.array_remove(F.split(flat, " "), "")


def leading_word(c: Column | str, bullet: str = "·") -> Column:
    """First token that isn't the bullet; null where there is none."""
    return F.get(F.array_remove(tokens(c), bullet), F.lit(0))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_name(expr: str) -> str:
    """``clean_name`` in SQL."""
    t = f"trim({expr}, {quoted(WHITE)})"
    return f"nullif(case when starts_with({t}, '{ROOT}') then substr({t}, {len(ROOT) + 1}) else {t} end, '')"


def sql_tokens(expr: str) -> str:
    """``tokens`` in SQL, as a list."""
    blanks = SEPARATORS + WHITE.replace(" ", "")
    return f"list_filter(string_split(translate(coalesce({expr}, ''), {quoted(blanks)}, {quoted(' ' * len(blanks))}), ' '), lambda x: x <> '')"
