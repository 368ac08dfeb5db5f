"""Column functions over text: stripping, words, lines, identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.config import TICKET


def ustrip(c: Column | str) -> Column:
    """Strip all Unicode white space at both ends (``trim`` strips U+0020 alone)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def ustrip_sql(c: str) -> str:
    return f"regexp_replace({c}, r'(?U)^\\s+|\\s+$', '')"


def word_count(c: Column | str) -> Column:
    """White-space separated words; 0 for blank text."""
    s = ustrip(c)
    return F.when(s == "", 0).otherwise(F.size(F.split(s, r"(?U)\s+"))).cast("int")


def content_hash(c: Column | str) -> Column:
    return F.sha2(c if isinstance(c, Column) else F.col(c), 256)


def slugify(c: Column | str) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(s == "", "document").otherwise(s)


def blank_to_null(c: Column | str) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.when(ustrip(col) != "", col)


def first_filled(*cols: Column | str) -> Column:
    """The first column that is neither null nor empty."""
    return F.coalesce(*(F.nullif(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in cols))


def ticket_ids(c: Column | str) -> Column:
    """Distinct ticket ids in upper case, in the order of their first mention."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit("(?iU)" + TICKET), F.lit(0)), F.upper))


def filter_tickets(ids: Column | str, prefixes: list[str]) -> Column:
    """Ids of the given projects, in upper case, with or without ``-COMPLETE`` at the end."""
    pattern = "^(?:" + "|".join(prefixes) + r")-\d+(?:-COMPLETE)?$"
    return F.filter(F.transform(ids, F.upper), lambda t: t.rlike(pattern))


def people_in(c: Column | str, names: list[str]) -> Column:
    """Names of the list that the text mentions as whole words in any case, in the list's order."""
    return F.array_compact(F.array(*(F.when(F.rlike(c, F.lit(rf"(?iU)\b{n}\b")), F.lit(n)) for n in names)))


def filter_people(names: Column | str, allowed: list[str]) -> Column:
    """Capitalised names of the list, distinct, in their own order."""
    return F.array_distinct(F.filter(F.transform(names, F.initcap), lambda n: n.isin(*[a.capitalize() for a in allowed])))


def sentence_count(c: Column | str) -> Column:
    return F.size(F.filter(F.split(ustrip(c), r"(?<=[.!?])\s+"), lambda s: F.trim(s) != ""))
