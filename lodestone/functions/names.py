"""Clean-up of stored labels: source, language and domain names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What the data calls white space.
WHITE = " \\t\\r\\n\\x{A0}\\x{3000}"


def trim_white(c: Column) -> Column:
    """The string without white space (space, tab, CR, LF, U+00A0, U+3000) at either end."""
    return F.regexp_replace(c, f"^[{WHITE}]++|(?<![{WHITE}])[{WHITE}]++$", "")


def is_blank(c: Column) -> Column:
    """True for null and for strings of white space alone."""
    return c.isNull() | ~c.rlike(f"[^{WHITE}]")


def source_name(c: Column) -> Column:
    """One spelling a source: trimmed, lower case, underscores; ``unknown`` where there is no name."""
    name = F.replace(F.lower(trim_white(c)), F.lit("-"), F.lit("_"))
    return F.when(c.isNull() | (name == ""), F.lit("unknown")).otherwise(name)


def language_name(c: Column) -> Column:
    """Primary language subtag in lower case; ``unknown`` for none and for the code of no language."""
    name = F.substring_index(F.replace(F.lower(trim_white(c)), F.lit("_"), F.lit("-")), "-", 1)
    return F.when(c.isNull() | name.isin("", "und"), F.lit("unknown")).otherwise(name)


def domain_name(c: Column) -> Column:
    """Trimmed lower-case domain; ``unknown`` where there is none."""
    name = F.lower(trim_white(c))
    return F.when(c.isNull() | (name == ""), F.lit("unknown")).otherwise(name)
