"""Sheets as rows ``(doc_id, sheet_name, row_index, cells array<string>)``, row 0 being the header."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.config import GROUP_LEAST, GROUP_MOST, GROUP_PRESENCE, GROUP_REPEAT, LONG_HEADER, SHEET_SINGLE_ROWS
from docloom.functions.text import ustrip, ustrip_sql

SHEET = ("doc_id", "sheet_name")
#: Rows of a sheet that meet in one task at once; what a sheet's blocks have in common is carried over by one row of each.
BLOCK = 4096


def _filled(cells: str = "cells") -> Column:
    return F.expr(f"exists({cells}, c_ -> c_ is not null and {ustrip_sql('c_')} <> '')")


def labelled(headers: str, cells: str) -> Column:
    """``header: value`` of the filled cells; a blank header counts its column, cells beyond the headers are left out."""
    value = f"filter(transform({headers}, (h_, i_) -> if(coalesce({ustrip_sql(f'get({cells}, i_)')}, '') = '', null, concat(if(coalesce(h_, '') = '', concat('Column', i_), h_), ': ', get({cells}, i_)))), v_ -> v_ is not null)"
    return F.array_join(F.expr(value), " | ")


def plain(cells: str = "cells") -> Column:
    return F.array_join(F.expr(f"filter({cells}, c_ -> c_ is not null and {ustrip_sql('c_')} <> '')"), " | ")


def _strategy() -> Column:
    """From the filled rows ``n``, and of the first column its header ``head``, its ``total`` values and ``uniques`` among them."""
    groups = (F.coalesce(ustrip(F.col("head")), F.lit("")) != "") & F.col("uniques").between(GROUP_LEAST, GROUP_MOST) & (F.col("total") > GROUP_REPEAT * F.col("uniques")) & (F.col("total") >= GROUP_PRESENCE * (F.col("n") - 1))
    return F.when(F.col("n") <= SHEET_SINGLE_ROWS, "single_chunk").when(groups, "group_by_column").otherwise("row_based")


def detect_sheets(rows: DataFrame) -> DataFrame:
    """``(doc_id, sheet_name, strategy, group_by_column)`` from the shape of each sheet.

    Counted by the values of the first column, so that no task needs a whole sheet; the first filled row is taken out of the counts.
    """
    values = rows.where(_filled()).groupBy(*SHEET, F.col("cells")[0].alias("value")).agg(F.count("*").alias("k"), F.min("row_index").alias("low"), F.max("row_index").alias("high"))
    known = F.col("value").isNotNull()
    shape = values.groupBy(*SHEET).agg(
        F.sum("k").alias("n"), F.min_by("value", "low").alias("head"), F.min_by(F.col("high") == F.col("low"), "low").alias("alone"),
        F.sum(F.when(known, F.col("k")).otherwise(0)).alias("total"), F.count("value").alias("uniques"),
    )
    headed = F.col("head").isNotNull()
    shape = shape.withColumns({"total": F.col("total") - headed.cast("int"), "uniques": F.col("uniques") - (headed & F.col("alone")).cast("int")})
    return shape.select(*SHEET, _strategy().alias("strategy"), F.when(_strategy() == "group_by_column", F.col("head")).alias("group_by_column"))


def forward_fill(rows: DataFrame) -> DataFrame:
    """Add ``group_value``: the row's first cell, or the last filled one above; the header row has none."""
    first = F.when((F.col("row_index") > 0) & (ustrip(F.col("cells")[0]) != ""), F.col("cells")[0])
    above = Window.partitionBy(*SHEET).orderBy("row_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("group_value", F.last(first, ignorenulls=True).over(above))


def _with_headers(rows: DataFrame) -> DataFrame:
    headers = rows.where("row_index = 0").select(*SHEET, F.transform("cells", lambda c: F.coalesce(c, F.lit(""))).alias("headers"))
    return rows.where("row_index > 0").join(headers, list(SHEET))


def _numbered(chunks: DataFrame, order: str) -> DataFrame:
    number = F.row_number().over(Window.partitionBy(*SHEET).orderBy(order)) - 1
    return chunks.withColumn("chunk_index", number)


def row_chunks(rows: DataFrame) -> DataFrame:
    """One chunk for each filled data row, numbered within its sheet."""
    lines = _with_headers(rows).withColumn("line", labelled("headers", "cells")).where("line <> ''")
    return _numbered(lines, "row_index").select(*SHEET, "chunk_index", "row_index", F.concat(F.lit("["), "sheet_name", F.lit("]\n"), "line").alias("content"))


def group_chunks(rows: DataFrame) -> DataFrame:
    """One chunk for each group value, in the order of first appearance; needs ``group_value``, and leaves rows without one out."""
    lines = _with_headers(rows).where("group_value is not null").withColumn("line", labelled("headers", "cells"))
    grouped = lines.groupBy(*SHEET, "group_value").agg(F.min("row_index").alias("first_row"), F.array_sort(F.collect_list(F.when(F.col("line") != "", F.struct("row_index", "line")))).alias("ls"))
    body = F.array_join(F.transform("ls", lambda x: x["line"]), "\n")
    return _numbered(grouped, "first_row").select(*SHEET, "chunk_index", "group_value", F.concat(F.lit("["), "sheet_name", F.lit("] "), "group_value", F.lit("\n"), body).alias("content"))


def single_chunks(rows: DataFrame, keep_header: bool = False) -> DataFrame:
    """One chunk of each whole sheet's values, its header row left out unless ``keep_header``."""
    least = 0 if keep_header else 1
    line = F.when((F.col("row_index") >= least) & (plain() != ""), F.struct("row_index", plain().alias("line")))
    whole = rows.groupBy(*SHEET).agg(F.array_sort(F.collect_list(line)).alias("ls"), F.max("row_index").alias("last"))
    body = F.array_join(F.transform("ls", lambda x: x["line"]), "\n")
    content = F.concat(F.lit("["), F.col("sheet_name"), F.lit("]"), F.when(body != "", F.concat(F.lit("\n"), body)).otherwise(F.lit("")))
    return whole.where("last > 0").select(*SHEET, F.lit(0).alias("chunk_index"), content.alias("content"))


def _long_cells(cells: str) -> Column:
    return F.expr(f"filter(transform({cells}, c_ -> {ustrip_sql('c_')}), c_ -> length(c_) > {LONG_HEADER})")


def _of_header() -> Column:
    return F.concat(F.lit("["), "sheet_name", F.lit("]\n"), F.array_join("long", "\n")).alias("content")


def header_only_chunks(rows: DataFrame) -> DataFrame:
    """Of sheets that have nothing but a header row: its long cells, if any."""
    only = rows.groupBy(*SHEET).agg(F.max("row_index").alias("last"), F.min_by("cells", "row_index").alias("cells")).where("last = 0")
    return only.withColumn("long", _long_cells("cells")).where(F.size("long") > 0).select(*SHEET, F.lit(0).alias("chunk_index"), _of_header())


def _blocks(rows: DataFrame) -> DataFrame:
    """A row for each block of a sheet's rows: the sheet's ``strategy``, ``headers`` and ``last`` row, and of the blocks before
    it the number of row chunks, ``before``, and the last filled first cell, ``above``."""
    first, data = F.col("cells")[0], F.col("row_index") > 0
    # blank cells only where 0
    place = F.coalesce(F.expr(f"array_position(transform(cells, c_ -> coalesce({ustrip_sql('c_')}, '') <> ''), true)"), F.lit(0))
    heads = data & (ustrip(first) != "")
    parts = rows.withColumn("place", place).groupBy(*SHEET, "block", "place").agg(
        F.count(F.when(data, 1)).alias("k"), F.max("row_index").alias("last"), F.max(F.when(~data, F.transform("cells", lambda c: F.coalesce(c, F.lit(""))))).alias("headers"),
        F.max(F.when(heads, F.col("row_index"))).alias("at"), F.max_by(F.when(heads, first), F.when(heads, F.col("row_index"))).alias("tail"),
    )
    whole = Window.partitionBy(*SHEET)
    parts = parts.withColumns({"last": F.max("last").over(whole), "headers": F.max("headers").over(whole)}).join(detect_sheets(rows).select(*SHEET, "strategy"), list(SHEET), "left").fillna("single_chunk", ["strategy"])
    chunks = F.sum(F.when(F.col("place").between(1, F.size("headers")), F.col("k")).otherwise(0))
    blocks = parts.groupBy(*SHEET, "block", "strategy", "headers", "last").agg(chunks.alias("k"), F.max_by("tail", "at").alias("tail"))
    earlier = Window.partitionBy(*SHEET).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumns({"before": F.coalesce(F.sum("k").over(earlier), F.lit(0)), "above": F.last("tail", ignorenulls=True).over(earlier)}).drop("k", "tail")


def chunk_sheets(rows: DataFrame) -> DataFrame:
    """Chunks ``(doc_id, sheet_name, chunk_index, content, strategy)`` of all sheets by their detected strategies.

    A sheet's rows, whose indexes differ, are dealt in blocks of ``BLOCK``.  Group values are filled downwards and numbers are
    counted within a block, from what :func:`_blocks` carries over; only the text of a group or of a sheet's only chunk is put
    together from all of its blocks.
    """
    rows = rows.withColumn("block", F.expr(f"row_index div {BLOCK}"))
    blocks = _blocks(rows)
    own = Window.partitionBy(*SHEET, "block").orderBy("row_index")
    seen = rows.where("row_index > 0").join(blocks, [*SHEET, "block"])

    lines = seen.where("strategy = 'row_based'").withColumn("line", labelled("headers", "cells")).where("line <> ''")
    by_row = lines.select(*SHEET, (F.col("before") + F.row_number().over(own) - 1).alias("chunk_index"), F.concat(F.lit("["), "sheet_name", F.lit("]\n"), "line").alias("content"), "strategy")

    first, single = F.col("cells")[0], F.col("strategy") == "single_chunk"
    down = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = seen.where("strategy <> 'row_based'").withColumn("group", F.coalesce(F.last(F.when(ustrip(first) != "", first), ignorenulls=True).over(down), "above"))
    filled = filled.withColumns({"line": F.when(single, plain()).otherwise(labelled("headers", "cells")), "key": F.when(single, "").otherwise(F.col("group"))}).where("key is not null")
    joined = lambda order, text: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(text) != "", F.struct(order, text)))), lambda x: x[text]), "\n")
    parts = filled.groupBy(*SHEET, "block", "strategy", "key").agg(F.min("row_index").alias("at"), joined("row_index", "line").alias("text"))
    chunks = parts.groupBy(*SHEET, "strategy", "key").agg(F.min("at").alias("at"), joined("block", "text").alias("body"))
    label = F.when(single, F.when(F.col("body") != "", F.lit("\n")).otherwise(F.lit(""))).otherwise(F.concat(F.lit(" "), "key", F.lit("\n")))
    others = _numbered(chunks, "at").select(*SHEET, "chunk_index", F.concat(F.lit("["), "sheet_name", F.lit("]"), label, "body").alias("content"), "strategy")

    only = blocks.where("last = 0").select(*SHEET, _long_cells("headers").alias("long")).where(F.size("long") > 0)
    headers = only.select(*SHEET, F.lit(0).alias("chunk_index"), _of_header(), F.lit("single_chunk").alias("strategy"))
    return by_row.unionByName(others).unionByName(headers)


def row_hashes(rows: DataFrame) -> DataFrame:
    """SHA-256 of each data row's cells joined by a bar, null cells being empty."""
    cells = F.array_join(F.transform("cells", lambda c: F.coalesce(c, F.lit(""))), "|")
    return rows.where("row_index > 0").select(*SHEET, "row_index", F.sha2(cells, 256).alias("row_hash"))
