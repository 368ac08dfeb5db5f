"""Data quality of stored chunks: rules as data, issues as rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.config import DOC_TYPES, ISSUE_CATEGORIES, QUARTER_FREE, SPRINT_FORBIDDEN, SPRINT_QUARTERS, SPRINT_REQUIRED


@dataclass(frozen=True)
class Rules:
    """What a store's chunks must meet.  Folders, people and the mail domain are the user's own."""

    folders: dict[str, tuple[str, ...]] = field(default_factory=dict, hash=False)
    people: tuple[str, ...] = ()
    features: tuple[str, ...] = ()
    excluded_tickets: tuple[str, ...] = ()
    mail_domain: str = "example.com"
    file_source: str = "google_drive"
    mail_source: str = "gmail"
    sheet_types: tuple[str, ...] = ("jira", "retro", "okr", "roadmap")
    section_types: tuple[str, ...] = ("meeting_notes", "planning", "technical_spec")


def quoted(values: tuple[str, ...] | list[str]) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")" if values else "('')"


def row_rules(r: Rules) -> list[tuple[str, str, str]]:
    """``(category, problem, condition)`` over a chunk's columns; conditions that are null don't hold."""
    blank = lambda c: f"({c} is null or trim({c}) = '')"
    filled = lambda c: f"({c} is not null and trim({c}) <> '')"
    no_type = "coalesce(doc_type, '')"
    mail, other = f"{no_type} = 'email'", f"{no_type} <> 'email'"
    quarter = "case trim(sprint) " + " ".join(f"when '{k}' then '{v}'" for k, v in SPRINT_QUARTERS.items()) + " end"
    sprint = "nullif(trim(sprint), '')"
    valid = "(" + " or ".join(f"{sprint} = '{k}' or {sprint} = '0{k}'" for k in SPRINT_QUARTERS) + ")"
    allowed = " or ".join(f"(folder = '{f}' and {no_type} in {quoted(t)})" for f, t in r.folders.items()) or "false"
    known = f"folder in {quoted(list(r.folders))}"
    return [
        ("document_title", "blank", blank("document_title")),
        ("doc_type", "null", "doc_type is null"),
        ("doc_type", "unknown", f"doc_type not in {quoted(DOC_TYPES)}"),
        ("sprint", "missing", f"doc_type in {quoted(SPRINT_REQUIRED)} and {sprint} is null"),
        ("sprint", "invalid", f"doc_type in {quoted(SPRINT_REQUIRED)} and {sprint} is not null and not {valid}"),
        ("sprint", "forbidden", f"doc_type in {quoted(SPRINT_FORBIDDEN)} and {sprint} is not null"),
        ("quarter", "unmapped sprint", f"{sprint} is not null and {quarter} is null"),
        ("quarter", "not of the sprint", f"{sprint} is not null and {quarter} is not null and (quarter is null or quarter <> {quarter})"),
        ("quarter", "without sprint", f"{sprint} is null and {no_type} not in {quoted(QUARTER_FREE)} and quarter is not null"),
        ("quarter", "invalid", "quarter not in ('Q1', 'Q2', 'Q3', 'Q4')"),
        ("folder", "invalid", f"{mail} and folder is not null and not ({known})"),
        ("folder", "missing", f"{other} and {blank('folder')}"),
        ("folder", "invalid", f"{other} and {filled('folder')} and not ({known})"),
        ("folder", "not of the type", f"{other} and {known} and not ({allowed})"),
        ("source_type", "null", "source_type is null"),
        ("source_type", "invalid", f"source_type not in ('{r.file_source}', '{r.mail_source}')"),
        ("source_type", "mail from files", f"{mail} and source_type = '{r.file_source}'"),
        ("source_type", "file from mail", f"{other} and source_type = '{r.mail_source}'"),
        ("sheet_name", "missing", f"doc_type in {quoted(r.sheet_types)} and {blank('sheet_name')}"),
        ("sheet_name", "forbidden", f"doc_type in {quoted((*r.section_types, 'email'))} and {filled('sheet_name')}"),
        ("section_heading", "missing", f"doc_type in {quoted(r.section_types)} and chunk_index > 0 and {blank('section_heading')}"),
        ("section_heading", "forbidden", f"doc_type in {quoted((*r.sheet_types, 'email'))} and {filled('section_heading')}"),
        ("sender", "missing", f"{mail} and {blank('sender')}"),
        ("sender", "no address", f"{mail} and {filled('sender')} and sender not like '%@%'"),
        ("sender", "other domain", f"{mail} and sender like '%@%' and trim(sender) not like '%{r.mail_domain}'"),
        ("sender", "forbidden", f"{other} and {filled('sender')}"),
        ("subject", "missing", f"{mail} and {blank('subject')}"),
        ("subject", "forbidden", f"{other} and {filled('subject')}"),
        ("author", "missing", f"{mail} and {blank('author')}"),
        ("author", "not the sender", f"{mail} and {filled('author')} and author <> sender"),
        ("file_created_at", "null", "file_created_at is null"),
        ("file_updated_at", "null", "file_updated_at is null"),
        ("chunk_type", "null", "chunk_type is null"),
        ("chunk_type", "invalid", "chunk_type not in ('standard', 'table')"),
    ]


def _items(column: str, extra: str) -> str:
    """Issues of one array column: null, blank items, repeats after the first, and what ``extra`` adds for an item v."""
    issue = lambda problem: f"named_struct('category', '{column}', 'problem', '{problem}')"
    each = (
        f"flatten(transform(transform({column}, v -> trim(coalesce(v, ''))), (v, i) -> case when v = '' then array({issue('blank')}) else concat({extra}, "
        f"if(i > 0 and array_contains(transform(slice({column}, 1, i), w -> trim(coalesce(w, ''))), v), array({issue('duplicate')}), array())) end))"
    )
    return f"case when {column} is null then array({issue('null')}) else {each} end"


def _when(category: str, problem: str, condition: str) -> str:
    return f"if({condition}, array(named_struct('category', '{category}', 'problem', '{problem}')), array())"


def row_issues(chunks: DataFrame, rules: Rules) -> DataFrame:
    """``(category, problem, document_title, chunk_index)`` of every rule that a chunk breaks, in one projection."""
    plain = ", ".join(f"if(coalesce({cond}, false), named_struct('category', '{c}', 'problem', '{p}'), null)" for c, p, cond in row_rules(rules))
    people = f"concat({_when('people', 'full name', 'contains(v, chr(32))')}, {_when('people', 'lower case', 'substr(v, 1, 1) <> upper(substr(v, 1, 1))')}, {_when('people', 'unknown', f'v not in {quoted(rules.people)}')})"
    arrays = [
        _items("people", people),
        _items("features", _when("features", "unknown", f"v not in {quoted(rules.features)}")),
        _items("ticket_ids", _when("ticket_ids", "excluded", f"upper(v) in {quoted(rules.excluded_tickets)}")),
        _items("metrics", "array()"),
    ]
    found = f"concat(filter(array({plain}), s -> s is not null), {', '.join(arrays)})"
    title = F.coalesce(F.nullif(F.trim("document_title"), F.lit("")), F.lit("unknown"))
    return chunks.select(title.alias("document_title"), "chunk_index", F.expr(f"inline({found})")).select("category", "problem", "document_title", "chunk_index")


def sequence_issues(chunks: DataFrame) -> DataFrame:
    """Breaks in the numbering of each document's sheet: null, negative, repeated, not from 0, gaps."""
    title = F.coalesce(F.nullif(F.trim("document_title"), F.lit("")), F.lit("unknown"))
    counted = chunks.select(title.alias("document_title"), "sheet_name", "chunk_index").groupBy("document_title", "sheet_name", "chunk_index").agg(F.count("*").alias("n"))
    before = F.lag("chunk_index").over(Window.partitionBy("document_title", "sheet_name").orderBy(F.col("chunk_index").asc_nulls_first()))
    kinds = [
        ("null", F.col("chunk_index").isNull(), F.col("n")), ("negative", F.col("chunk_index") < 0, F.col("n")),
        ("duplicate", F.col("chunk_index").isNotNull() & (F.col("n") > 1), F.lit(1)), ("not from 0", F.col("before").isNull() & (F.col("chunk_index") != 0), F.lit(1)),
        ("gap", F.col("chunk_index") - F.col("before") > 1, F.lit(1)),
    ]
    found = F.array_compact(F.array(*(F.when(cond, F.struct(F.lit(p).alias("problem"), n.cast("long").alias("times"))) for p, cond, n in kinds)))
    each = counted.withColumn("before", before).select("document_title", "chunk_index", F.inline(found))
    each = each.withColumn("__t", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return each.select(F.lit("chunk_index").alias("category"), "problem", "document_title", "chunk_index")


def issues(chunks: DataFrame, rules: Rules) -> DataFrame:
    return row_issues(chunks, rules).unionByName(sequence_issues(chunks))


def summary(found: DataFrame) -> DataFrame:
    """Issues of each of the fixed categories, those without any included."""
    spark: SparkSession = found.sparkSession
    names = spark.range(1).select(F.explode(F.array(*(F.lit(c) for c in ISSUE_CATEGORIES))).alias("category"))
    return names.join(found.groupBy("category").agg(F.count("*").alias("n")), "category", "left").select("category", F.coalesce("n", F.lit(0)).cast("long").alias("n_issues"))
