"""Structured text: blocks, sections and checks of generated markdown and JSON specifications."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.config import TICKET
from docloom.functions.text import sentence_count, ustrip


def split_before(c: Column | str, marker: str) -> Column:
    """Parts that each start at a line with ``marker`` (a regular expression); what stands before the first is left out."""
    parts = F.split(c, rf"(?m)(?=^{marker})")
    return F.filter(F.transform(parts, ustrip), lambda p: p.rlike(f"^{marker}"))


def email_thread_blocks(c: Column | str) -> Column:
    return split_before(c, "## THREAD — ")


def ticket_blocks(c: Column | str) -> Column:
    return split_before(c, r"(?:### Ticket \d+: |## TICKET \d+)")


def ticket_key(block: Column | str) -> Column:
    return F.nullif(F.regexp_extract(block, TICKET, 0), F.lit(""))


def ticket_tier(block: Column | str, default: int = 2) -> Column:
    return F.coalesce(F.regexp_extract(block, r"(?i)\btier\s*:?\s*\**\s*(\d)", 1).try_cast("int"), F.lit(default))


def section_between(c: Column | str, start: str, end: str) -> Column:
    """Text from the marker ``start`` up to ``end``, or to the end of the text; null without a start."""
    col = F.col(c) if isinstance(c, str) else c
    at = F.locate(start, col)
    rest = F.substr(col, at)
    stop = F.locate(end, rest, len(start) + 1)
    return F.when(at > 0, ustrip(F.when(stop > 0, F.substr(rest, F.lit(1), stop - 1)).otherwise(rest)))


def valid_thread(c: Column | str, least_blocks: int = 2, least_body: int = 20) -> Column:
    """Whether the text has enough messages, each under its Date, From, To and Subject lines and with a body."""
    col = F.col(c) if isinstance(c, str) else c
    head = r"(?m)^Date:[^\n]*\nFrom:[^\n]*\nTo:[^\n]*\nSubject:[^\n]*\n"
    bodies = F.transform(F.split(col, head, -1), lambda b: ustrip(F.regexp_replace(b, r"(?m)^---\s*$", "")))
    bodies = F.slice(bodies, F.lit(2), F.greatest(F.size(bodies) - 1, F.lit(0)))
    return (F.size(bodies) >= least_blocks) & F.forall(bodies, lambda b: F.length(b) >= least_body)


def is_narrative(bullet: Column | str) -> Column:
    """A bullet of at least two sentences that names a ticket."""
    return (sentence_count(bullet) >= 2) & F.rlike(bullet, F.lit(TICKET))


def format_hint(c: Column | str) -> Column:
    t = F.lower(c)
    return F.when(F.rlike(t, F.lit(r"\b(?:xlsx|excel|workbook|spreadsheet)\b")), "excel").when(F.rlike(t, F.lit(r"\b(?:docx|word)\b")), "word").when(F.rlike(t, F.lit(r"\b(?:txt|plain text|email)\b")), "txt")


def acceptance_bullets(items: Column | str) -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit("• "), ustrip(x))), "\n")


def ordered_comments(comments: Column | str) -> Column:
    """Comments ``(number, author, date, text)`` by number, those without text left out."""
    return F.array_sort(F.filter(comments, lambda c: ustrip(F.coalesce(c["text"], F.lit(""))) != ""), lambda a, b: a["number"] - b["number"])


def required_comments(tier: Column | str) -> Column:
    return F.when(F.col(tier) == 1, 5).when(F.col(tier) == 2, 3).otherwise(2) if isinstance(tier, str) else F.when(tier == 1, 5).when(tier == 2, 3).otherwise(2)


def spec_is_complete(json: Column | str, schema: str, required: list[str]) -> Column:
    """Whether a JSON specification parses and holds every required field with a value."""
    parsed = F.from_json(json, schema)
    return parsed.isNotNull() & F.forall(F.array(*(parsed[f].cast("string") for f in required)), lambda v: ustrip(F.coalesce(v, F.lit(""))) != "")


def schema_rows(c: Column | str, most: int = 12) -> Column:
    """``struct<name, columns>`` of the blocks ``name:`` with indented or bulleted lines below, the first of each name."""
    blocks = F.regexp_extract_all(c, F.lit(r"(?m)^([a-z_]+):[ \t]*\n((?:[ \t]*[-•][^\n]*(?:\n|\z)|[ \t]+\S[^\n]*(?:\n|\z))+)"), F.lit(0))
    rows = F.transform(blocks, lambda b: F.struct(F.regexp_extract(b, "^([a-z_]+):", 1).alias("name"), F.array_join(F.filter(F.transform(F.split(F.regexp_replace(b, r"^[a-z_]+:[ \t]*\n", ""), "\n"), lambda x: F.regexp_replace(ustrip(x), r"^[-•]\s*", "")), lambda x: x != ""), ", ").alias("columns")))
    names = F.transform(rows, lambda r: r["name"])
    return F.slice(F.filter(rows, lambda r, i: F.array_position(names, r["name"]) == i + 1), 1, most)
