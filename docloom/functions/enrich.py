"""Deterministic metadata of documents and chunks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.config import METADATA_MIN_WORDS, SPRINT_DAYS, SPRINT_FIRST_DAY, SPRINT_QUARTERS, SPRINTS
from docloom.functions.text import first_filled, ustrip, word_count


def doc_type(title: Column | str, ext: Column | str) -> Column:
    """Semantic type by file extension and words of the title, first match first."""
    t, e = F.lower(title), F.lower(ext)
    has = lambda *words: F.lit(False) if not words else F.rlike(t, F.lit("|".join(words)))
    sheet = F.when(has("jira"), "jira").when(has("retro"), "retro").when(has("okr"), "okr").when(has("roadmap"), "roadmap").otherwise("spreadsheet")
    word = F.when(has("planning"), "planning").when(has("meeting", "sync"), "meeting_notes").when(has("spec", "technical"), "technical_spec").when(has("prd"), "prd").otherwise("document")
    return F.when(e == "xlsx", sheet).when(e == "docx", word).when(e == "pdf", "pdf").when(e.isin("txt", "md"), "markdown").when(e == "pptx", "presentation").otherwise("document")


def quarter_of_sprint(sprint: Column | str) -> Column:
    """Q1 to Q4 of sprints 1 to 13, leading zeros allowed; else null."""
    table = F.create_map(*(F.lit(x) for pair in SPRINT_QUARTERS.items() for x in pair))
    col = F.col(sprint) if isinstance(sprint, str) else sprint
    return F.try_element_at(table, ustrip(col).try_cast("int"))


def quarter_of_sheet(sheet: Column | str) -> Column:
    return F.nullif(F.regexp_extract(F.upper(ustrip(sheet)), "^Q[1-4]", 0), F.lit(""))


def quarter(sprint: Column | str, sheet: Column | str) -> Column:
    return F.coalesce(quarter_of_sprint(sprint), quarter_of_sheet(sheet))


def sprint_of_filename(name: Column | str) -> Column:
    return F.nullif(F.regexp_extract(name, r"(?i)sprint[_\s-]*(\d+)", 1), F.lit(""))


def file_date(sprint: Column | str, created: Column | str) -> Column:
    """The creation date, else the first day of the sprint, as ISO text."""
    n = ustrip(F.col(sprint) if isinstance(sprint, str) else sprint).try_cast("int")
    start = F.when(n.between(1, SPRINTS), F.date_format(F.date_add(F.lit(SPRINT_FIRST_DAY).cast("date"), (n - 1) * SPRINT_DAYS), "yyyy-MM-dd"))
    return F.coalesce(first_filled(created), start)


def is_short(content: Column | str) -> Column:
    """Chunks too short for a model: ticket ids alone are taken from them."""
    return word_count(content) < METADATA_MIN_WORDS


def seed_people(sender: Column | str, recipients: Column | str, names: list[str]) -> Column:
    """The sender's first name and the recipients' plus-tags, as far as they are on the list, the sender first."""
    own = F.initcap(F.regexp_extract(ustrip(F.regexp_replace(sender, "<.*$", "")), r"^(\S+)", 1))
    tags = F.transform(recipients, lambda r: F.initcap(F.regexp_extract(r, r"\+([^@]+)@", 1)))
    return F.array_distinct(F.filter(F.concat(F.array(own), tags), lambda n: n.isin(*[x.capitalize() for x in names])))


def first_seen(arrays: Column) -> Column:
    """Distinct values over an array of arrays, in the order of first appearance."""
    return F.array_distinct(F.flatten(arrays))


def base_metadata(*layers: Column | str) -> Column:
    """Maps merged into one, later layers winning over earlier ones; null layers count as empty."""
    none = F.create_map().cast("map<string,string>")
    pairs = F.concat(*(F.map_entries(F.coalesce(F.col(m) if isinstance(m, str) else m, none)) for m in reversed(layers)))
    keys = F.transform(pairs, lambda e: e["key"])
    return F.map_from_entries(F.filter(pairs, lambda e, i: F.array_position(keys, e["key"]) == i + 1))
