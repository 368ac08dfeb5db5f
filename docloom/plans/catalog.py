"""One query for each operator, and DuckDB SQL with the same columns and rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import elements as E
from docloom.functions import enrich, mail, markup, sheets
from docloom.functions import text as T
from docloom.functions.packing import recursive_chunks, sentence_chunks, word_chunks
from docloom.operators import chunk, retrieve, sync, threads, verify
from docloom.operators.detect import detect_docx
from docloom.plans import recipes as R
from docloom.plans.search import search
from docloom.providers import HashedWords, embedding, question_rows
from docloom.sources import pdf

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
_STRIP = "'^\\s+|\\s+$', '', 'g'"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            small = {c: F.col(c).cast("long") for c, kind in df.dtypes if kind in ("int", "smallint", "tinyint")}
            return df.withColumns(small) if small else df

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# Parsing and detection


@query(f"WITH {R.ELEMENTS_SQL} SELECT doc_id, pos, type AS element_type, content, level::BIGINT AS level FROM el")
def parse_text_lines(spark, sf_dir):
    parsed = R.marked(R.table(spark, sf_dir, "documents"))
    parsed = chunk.numbered(parsed, F.expr(E.parse_text("text")), "doc_id", name="e", index="pos")
    return parsed.select("doc_id", (F.col("pos") + 1).alias("pos"), F.col("e.type").alias("element_type"), "e.content", "e.level")


_DETECT = """CASE WHEN h >= 2 THEN 'heading_based' WHEN b >= 3 AND b / n::DOUBLE > 0.15 THEN 'blank_line_based' ELSE 'recursive_fallback' END AS strategy,
  CASE WHEN h >= 2 THEN 'high' WHEN b >= 3 AND b / n::DOUBLE > 0.15 THEN 'medium' ELSE 'low' END AS confidence"""


@query(f"WITH {R.ELEMENTS_SQL}, c AS (SELECT doc_id, count(*) AS n, count(*) FILTER (type = 'heading') AS h, count(*) FILTER (type = 'blank') AS b FROM el GROUP BY doc_id) SELECT doc_id, {_DETECT} FROM c")
def detect_text_strategy(spark, sf_dir):
    return R.marked(R.table(spark, sf_dir, "documents")).where("text <> ''").select("doc_id", F.expr(E.detect_text(E.parse_text("text"))).alias("d")).select("doc_id", "d.*")


def _paragraphs(spark, sf_dir):
    lines = R.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    n = F.col("i") + 1
    style = F.when((F.col("doc_id") % 4 == 0) & (n % 5 == 0), F.concat(F.lit("Heading "), (n % 3 + 1).cast("string"))).otherwise("Normal")
    return lines.select("doc_id", style.alias("style"), F.when((F.col("doc_id") % 4 == 2) & (n % 4 == 0), "").otherwise(F.col("line")).alias("text"), ((F.col("doc_id") % 4 == 1) & (n % 3 == 0)).alias("bold"))


@query("""WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS n, unnest(string_split(text, chr(10))) AS line FROM documents),
p AS (SELECT doc_id, doc_id % 4 = 0 AND n % 5 = 0 AS heading, CASE WHEN doc_id % 4 = 2 AND n % 4 = 0 THEN '' ELSE line END AS text, doc_id % 4 = 1 AND n % 3 = 0 AS bold FROM l),
c AS (SELECT doc_id, count(*) AS n, count(*) FILTER (heading) AS h, count(*) FILTER (bold AND trim(text) <> '' AND length(text) <= 80) AS t, count(*) FILTER (trim(text) = '') AS b FROM p GROUP BY doc_id),
s AS (SELECT doc_id, CASE WHEN h >= 2 THEN 'heading_based' WHEN t >= 2 THEN 'bold_title_based' WHEN b >= 3 AND b / n::DOUBLE > 0.15 THEN 'blank_line_based' ELSE 'recursive_fallback' END AS strategy FROM c)
SELECT doc_id, strategy, CASE strategy WHEN 'heading_based' THEN 'high' WHEN 'recursive_fallback' THEN 'low' ELSE 'medium' END AS confidence FROM s""")
def detect_docx_strategy(spark, sf_dir):
    return detect_docx(_paragraphs(spark, sf_dir))


@query("SELECT DISTINCT o_orderkey AS doc_id, 'Heading ' || (o_orderkey % 12) AS style, least(3, greatest(1, o_orderkey % 12)) AS level FROM orders")
def heading_level_from_style(spark, sf_dir):
    style = F.concat(F.lit("Heading "), (F.col("o_orderkey") % 12).cast("string"))
    level = F.greatest(F.lit(1), F.least(F.lit(3), F.coalesce(F.nullif(F.regexp_extract("style", r"(\d+)", 1), F.lit("")).try_cast("long"), F.lit(1))))
    return R.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), style.alias("style")).distinct().withColumn("level", level)


def _spans(spark, sf_dir):
    return R.table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 500).alias("doc_id"), (F.col("l_suppkey") % 7 + 1).alias("page"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"),
        F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("text"), F.col("l_quantity").alias("size"), F.when(F.col("l_linestatus") == "F", "Sans-Bold").otherwise("Sans").alias("font"), F.lit(0).alias("flags"),
    )


_SPANS_SQL = """sp AS (SELECT l_orderkey % 500 AS doc_id, l_suppkey % 7 + 1 AS page, l_orderkey * 10 + l_linenumber AS pos, 'part ' || l_partkey AS text, l_quantity AS size, l_linestatus = 'F' AS bold FROM lineitem)"""


@query(f"""WITH {_SPANS_SQL}, b AS (SELECT doc_id, coalesce(quantile_cont(size, 0.5) FILTER (page <= 5), 11.0) AS body FROM sp GROUP BY doc_id), pg AS (SELECT doc_id, page, sum(length(text)) AS chars FROM sp GROUP BY 1, 2),
t AS (SELECT doc_id, page, pos, text AS content, size >= 1.3 * body OR (bold AND length(text) < 100 AND abs(size - body) <= 0.1 * body) AS h, size >= 1.5 * body AS top FROM sp JOIN b USING (doc_id) JOIN pg USING (doc_id, page) WHERE chars >= 50
  UNION ALL SELECT doc_id, page, 0, '[Page ' || page || ' — scanned, needs OCR]', false, false FROM pg WHERE chars < 50),
a AS (SELECT doc_id, page, pos, CASE WHEN h THEN 'heading' ELSE 'paragraph' END AS element_type, content, CASE WHEN NOT h THEN 0 WHEN top THEN 1 ELSE 2 END AS level FROM t UNION ALL SELECT doc_id, page, 9223372036854775807, 'blank', '', 0 FROM pg)
SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id ORDER BY page, pos, content, level) AS pos, element_type, content, level::BIGINT AS level FROM a""")
def pdf_span_elements(spark, sf_dir):
    return pdf.elements(_spans(spark, sf_dir))


@query(f"""WITH {_SPANS_SQL}, s AS (SELECT doc_id, sum(length(text)) AS chars, quantile_cont(size, 0.5) AS med, max(size) AS top, count(DISTINCT round(size, 2)) AS sizes FROM sp WHERE page <= 5 GROUP BY doc_id)
SELECT doc_id, CASE WHEN chars >= 100 AND med > 0 AND top >= 1.3 * med AND sizes >= 3 THEN 'heading_based' ELSE 'recursive_fallback' END AS strategy, CASE WHEN chars < 100 THEN 'low' ELSE 'medium' END AS confidence FROM s""")
def detect_pdf_strategy(spark, sf_dir):
    return pdf.detect(_spans(spark, sf_dir))


# Chunking


@query(f"WITH {R.ELEMENTS_SQL}, {R.sections_sql('heading')}")
def chunk_headings(spark, sf_dir):
    df = R.marked(R.table(spark, sf_dir, "documents")).select("doc_id", F.expr(E.heading_chunks(E.parse_text("text"))).alias("cs"))
    return chunk.explode_chunks(df, "cs", "doc_id")


@query(f"WITH {R.typed_sql(3, 'bold_title', 11, 7)}, {R.sections_sql('bold_title')}")
def chunk_bold_titles(spark, sf_dir):
    df = R.typed_elements(R.table(spark, sf_dir, "documents"), 3, "bold_title", 11, 7)
    return chunk.explode_chunks(df.select("doc_id", F.expr(E.heading_chunks("els", "bold_title")).alias("cs")), "cs", "doc_id")


@query(f"""WITH {R.typed_sql(999999, 'heading', 11, 7)},
s AS (SELECT *, sum(CASE WHEN type IN ('blank', 'table') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS sid FROM el),
g AS (SELECT doc_id, sid, 1 AS k, regexp_replace(string_agg(content, chr(10) ORDER BY pos) FILTER (type = 'paragraph' AND content <> ''), {_STRIP}) AS content, NULL AS element_type FROM s GROUP BY doc_id, sid
  UNION ALL SELECT doc_id, sid, 0, '[TABLE]' || chr(10) || content, 'table' FROM s WHERE type = 'table')
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sid, k) - 1 AS chunk_index, content, element_type FROM g WHERE content <> ''""")
def chunk_blank_lines(spark, sf_dir):
    df = R.typed_elements(R.table(spark, sf_dir, "documents"), 999999, "heading", 11, 7)
    return chunk.explode_chunks(df.select("doc_id", F.expr(E.blank_line_chunks("els")).alias("cs")), "cs", "doc_id")


def _pack_sql(pieces: str, sep: str, finer: str | None, tag: str) -> str:
    """The packer as nested ``list_reduce``; ``finer`` is SQL over the piece."""
    a, p = f"acc_{tag}", f"p{tag}"
    flushed = f"CASE WHEN {a}.c = '' THEN {a}.o ELSE list_append({a}.o, {a}.c) END"
    long = "" if finer is None else f"""WHEN length({p}) > 1000 THEN list_transform([{finer.format(p=p)}], lambda q{tag}: {{'o': list_concat({flushed}, q{tag}[1:len(q{tag}) - 1]), 'c': coalesce(q{tag}[len(q{tag})], '')}})[1]"""
    step = f"""CASE WHEN {p} = '' AND {a}.c = '' THEN {a} {long} WHEN {a}.c = '' THEN {{'o': {a}.o, 'c': {p}}} WHEN length({a}.c) + {len(sep)} + length({p}) <= 1000 THEN {{'o': {a}.o, 'c': {a}.c || {_lit(sep)} || {p}}}
  ELSE {{'o': list_append({a}.o, {a}.c), 'c': right({a}.c, 200) || chr(10) || {p}}} END"""
    return f"list_transform([list_reduce({pieces}, lambda {a}, {p}: {step}, {{'o': CAST([] AS VARCHAR[]), 'c': ''}})], lambda z{tag}: CASE WHEN z{tag}.c = '' THEN z{tag}.o ELSE list_append(z{tag}.o, z{tag}.c) END)[1]"


def _lit(sep: str) -> str:
    return {" ": "' '", "\n\n": "chr(10) || chr(10)"}[sep]


_WORDS_SQL = _pack_sql("string_split({p}, ' ')", " ", None, "w")
_SENTENCES = "string_split(regexp_replace({p}, '([.?!]) ', '\\1' || chr(1), 'g'), chr(1))"
_SENT_SQL = _pack_sql(_SENTENCES, " ", "@W@", "s").replace("@W@", _WORDS_SQL.replace("{p}", "ps"))
_PARA_SQL = _pack_sql("string_split({p}, chr(10) || chr(10))", "\n\n", "@S@", "g").replace("@S@", _SENT_SQL.replace("{p}", "pg"))


def _recursive_sql(text: str) -> str:
    return f"""WITH d AS (SELECT doc_id, regexp_replace({text}, {_STRIP}) AS t FROM documents), c AS (SELECT doc_id, CASE WHEN t = '' THEN CAST([] AS VARCHAR[]) WHEN length(t) <= 1000 THEN [t] ELSE {_PARA_SQL.replace("{p}", "t")} END AS cs FROM d)
SELECT doc_id, generate_subscripts(cs, 1) - 1 AS chunk_index, unnest(cs) AS content FROM c"""


@query(_recursive_sql("text"))
def chunk_recursive(spark, sf_dir):
    return chunk.numbered(R.table(spark, sf_dir, "documents"), recursive_chunks("text"), "doc_id", name="content")


@query(_recursive_sql("replace(text, chr(10), chr(10) || chr(10))"))
def chunk_recursive_paragraphs(spark, sf_dir):
    docs = R.table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return chunk.numbered(docs, recursive_chunks("text"), "doc_id", name="content")


@query(f"WITH c AS (SELECT doc_id, {_SENT_SQL.replace('{p}', 'text')} AS cs FROM documents) SELECT doc_id, generate_subscripts(cs, 1) - 1 AS chunk_index, unnest(cs) AS content FROM c")
def pack_sentences(spark, sf_dir):
    return chunk.numbered(R.table(spark, sf_dir, "documents"), sentence_chunks("text"), "doc_id", name="content")


@query(f"WITH c AS (SELECT doc_id, {_WORDS_SQL.replace('{p}', 'text')} AS cs FROM documents) SELECT doc_id, generate_subscripts(cs, 1) - 1 AS chunk_index, unnest(cs) AS content FROM c")
def pack_words(spark, sf_dir):
    return chunk.numbered(R.table(spark, sf_dir, "documents"), word_chunks("text"), "doc_id", name="content")


@query("SELECT conv_id AS doc_id, turn AS chunk_index, turn + 1 AS slide_number, CASE WHEN turn % 4 = 3 THEN '' ELSE text END AS content FROM conversations")
def chunk_slides(spark, sf_dir):
    slides = R.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("slide_number"), F.when(F.col("turn") % 4 != 3, F.col("text")).alias("content"))
    return chunk.slide_chunks(slides)


@query(f"""WITH {R.ELEMENTS_SQL}, c AS (SELECT doc_id, count(*) AS n, count(*) FILTER (type = 'heading') AS h, count(*) FILTER (type = 'blank') AS b FROM el GROUP BY doc_id), k AS (SELECT doc_id, {_DETECT} FROM c)
SELECT strategy, count(*) AS n_documents FROM k GROUP BY strategy""")
def strategy_counts(spark, sf_dir):
    return detect_text_strategy(spark, sf_dir).groupBy("strategy").agg(F.count("*").alias("n_documents"))


_ROUTED = R.ELEMENTS_SQL.replace("END), chr(10)) AS text FROM documents)", "END), chr(10)) AS text FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, text FROM documents WHERE doc_id % 2 = 1)")
_BLANK_LINES = f"""s AS (SELECT *, sum(CASE WHEN type IN ('blank', 'table') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS sid FROM el),
g AS (SELECT doc_id, sid, regexp_replace(string_agg(content, chr(10) ORDER BY pos) FILTER (type <> 'blank' AND content <> ''), {_STRIP}) AS content FROM s GROUP BY doc_id, sid)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sid) - 1 AS chunk_index, content FROM g WHERE content <> ''"""


@query(f"""WITH {_ROUTED}, c AS (SELECT doc_id, count(*) AS n, count(*) FILTER (type = 'heading') AS h, count(*) FILTER (type = 'blank') AS b FROM el GROUP BY doc_id), k AS (SELECT doc_id, {_DETECT} FROM c),
hd AS (WITH {R.sections_sql('heading')}), bl AS (WITH {_BLANK_LINES}), rj AS (SELECT doc_id, string_agg(content, chr(10) || chr(10) ORDER BY pos) AS t FROM el WHERE type <> 'blank' AND content <> '' GROUP BY doc_id),
rc AS (SELECT doc_id, CASE WHEN length(t) <= 1000 THEN [t] ELSE {_PARA_SQL.replace("{p}", "t")} END AS cs FROM rj), ru AS (SELECT doc_id, generate_subscripts(cs, 1) - 1 AS chunk_index, unnest(cs) AS content FROM rc),
al AS (SELECT doc_id, chunk_index, content, strategy FROM hd JOIN k USING (doc_id) WHERE strategy = 'heading_based' UNION ALL SELECT doc_id, chunk_index, content, strategy FROM bl JOIN k USING (doc_id) WHERE strategy = 'blank_line_based'
  UNION ALL SELECT doc_id, chunk_index, content, strategy FROM ru JOIN k USING (doc_id) WHERE strategy = 'recursive_fallback')
SELECT doc_id, chunk_index, content, strategy, len(regexp_split_to_array(trim(content, ' ' || chr(10)), '\\s+')) AS token_count FROM al""")
def chunk_router(spark, sf_dir):
    """Marked texts of even ids and raw ones of odd ids, each chunked by its own strategy."""
    docs = R.table(spark, sf_dir, "documents")
    return chunk.chunk_texts(R.marked(docs.where("doc_id % 2 = 0")).unionByName(docs.where("doc_id % 2 = 1").select("doc_id", "text")))


# Mail


def _clean_sql(c: str) -> str:
    for pattern in ("(?is)<style[^>]*>.*?</style>", "(?is)<script[^>]*>.*?</script>", "<[^>]+>", "&#\\d+;"):
        c = f"regexp_replace({c}, '{pattern}', '', 'g')"
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        c = f"replace({c}, '{entity}', '{char}')"
    return c


@query(f"SELECT page_id, regexp_replace(regexp_replace(regexp_replace({_clean_sql('html')}, '\\n{{3,}}', chr(10) || chr(10), 'g'), ' {{2,}}', ' ', 'g'), {_STRIP}) AS body FROM pages")
def clean_html_body(spark, sf_dir):
    return R.table(spark, sf_dir, "pages").select("page_id", mail.clean_body("html", is_html=True).alias("body"))


@query(f"""WITH m AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS x FROM documents),
r AS (SELECT doc_id, string_agg(x, chr(10) ORDER BY i) AS kept FROM m WHERE i < 9 GROUP BY doc_id) SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(kept, '\\n{{3,}}', chr(10) || chr(10), 'g'), ' {{2,}}', ' ', 'g'), {_STRIP}) AS body FROM r""")
def cut_quoted_reply(spark, sf_dir):
    return R.quoted_replies(R.table(spark, sf_dir, "documents")).select("doc_id", mail.clean_body("text").alias("body"))


@query(f"WITH {R.MESSAGES_SQL} SELECT thread_id, subject, sender, recipients, date, labels, coalesce(body, '') AS body, n_messages FROM thr JOIN lab USING (thread_id)")
def assemble_threads(spark, sf_dir):
    out = threads.assemble(R.messages(R.table(spark, sf_dir, "conversations")))
    return out.withColumns({"recipients": F.array_join("recipients", ","), "labels": F.array_join("labels", ",")})


@query(f"""WITH {R.MESSAGES_SQL}, b AS (SELECT thread_id, 'From: ' || sender || ' | Subject: ' || subject || ' | Date: ' || date || chr(10) || chr(10) AS p, coalesce(body, '') AS body FROM thr),
c AS (SELECT *, CASE WHEN length(p || body) <= 500 THEN [regexp_replace(p || body, {_STRIP})] ELSE list_transform([list_reduce(list_filter(string_split(body, chr(10) || chr(10)), lambda q: q <> ''), lambda a, q:
  CASE WHEN length(a.c) + (CASE WHEN ends_with(a.c, chr(10) || chr(10)) THEN 0 ELSE 2 END) + length(q) > 800 THEN {{'o': CASE WHEN trim(a.c, chr(10) || ' ') <> trim(p, chr(10) || ' ') THEN list_append(a.o, regexp_replace(a.c, {_STRIP})) ELSE a.o END, 'c': p || q}}
  ELSE {{'o': a.o, 'c': a.c || (CASE WHEN ends_with(a.c, chr(10) || chr(10)) THEN '' ELSE chr(10) || chr(10) END) || q}} END, {{'o': CAST([] AS VARCHAR[]), 'c': p}})], lambda z: CASE WHEN trim(z.c, chr(10) || ' ') <> trim(p, chr(10) || ' ') THEN list_append(z.o, regexp_replace(z.c, {_STRIP})) ELSE z.o END)[1] END AS cs FROM b)
SELECT thread_id, generate_subscripts(cs, 1) - 1 AS chunk_index, unnest(cs) AS content FROM c""")
def chunk_email_threads(spark, sf_dir):
    out = threads.assemble(R.messages(R.table(spark, sf_dir, "conversations")))
    return chunk.numbered(out, mail.email_chunks("body", "sender", "subject", "date"), "thread_id", name="content")


@query(f"WITH {R.MESSAGES_SQL} SELECT thread_id, labels FROM lab")
def first_seen_labels(spark, sf_dir):
    out = threads.assemble(R.messages(R.table(spark, sf_dir, "conversations")))
    return out.select("thread_id", F.array_join("labels", ",").alias("labels"))


@query("SELECT conv_id AS thread_id, turn AS pos, 'B ' || role AS sender, 'a' || turn || '@example.com' AS first_recipient, 3::BIGINT AS n_recipients, text AS body, CASE WHEN turn % 2 = 0 THEN '2025-03-0' || (turn % 7 + 1) || 'T10:00:00+02:00' ELSE '1970-01-01T00:00:0' || (turn % 7) || '+00:00' END AS date FROM conversations WHERE trim(text) <> ''")
def parse_mail_messages(spark, sf_dir):
    enc = lambda c: F.translate(F.base64(F.encode(c, "UTF-8")), "+/", "-_")
    h = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("value"))
    date = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("Mon, "), (F.col("turn") % 7 + 1).cast("string"), F.lit(" Mar 2025 10:00:00 +0200"))).otherwise("")
    raw = R.table(spark, sf_dir, "conversations").where(F.trim("text") != "").select(
        F.col("conv_id").alias("thread_id"), F.col("turn").alias("pos"), "text",
        F.array(h("FROM", F.concat(F.lit("B "), F.col("role"))), h("to", F.concat(F.lit(" a"), F.col("turn").cast("string"), F.lit("@example.com , ,c@example.com"))), h("Cc", F.lit("d@example.com")), h("Subject", F.lit("s")), h("Date", date)).alias("headers"),
        F.when(F.col("turn") % 3 != 0, F.array(enc(F.col("text")))).otherwise(F.array().cast("array<string>")).alias("plain"), F.array(enc(F.concat(F.lit("<p>"), F.col("text"), F.lit("</p>")))).alias("html"),
        (F.col("turn") % 7 * 1000).alias("internal_ms"), F.array(F.lit("INBOX")).alias("labels"),
    )
    return threads.parse_messages(raw).select("thread_id", "pos", "sender", F.col("recipients")[0].alias("first_recipient"), F.size("recipients").alias("n_recipients"), "body", "date")


@query(f"WITH {R.MESSAGES_SQL} SELECT thread_id, sender FROM thr WHERE lower(sender) LIKE '%team+user@example.com%'")
def threads_from_sender(spark, sf_dir):
    return threads.from_sender(threads.assemble(R.messages(R.table(spark, sf_dir, "conversations"))), "Team+User@example.com").select("thread_id", "sender")


# Sheets


@query(f"WITH {R.SHEETS_SQL} SELECT doc_id, sheet_name, strategy, CASE WHEN strategy = 'group_by_column' THEN head END AS group_by_column FROM str UNION ALL SELECT 400 + r_regionkey, 'Note', 'single_chunk', NULL FROM region")
def detect_sheet_strategy(spark, sf_dir):
    return sheets.detect_sheets(R.sheets(spark, sf_dir))


@query(f"WITH {R.SHEETS_SQL} SELECT doc_id, sheet_name, row_number() OVER (PARTITION BY doc_id, sheet_name ORDER BY row_index) - 1 AS chunk_index, row_index, '[' || sheet_name || ']' || chr(10) || line AS content FROM lab WHERE line <> ''")
def sheet_row_chunks(spark, sf_dir):
    return sheets.row_chunks(R.sheets(spark, sf_dir))


_BLANKED = "dat AS (SELECT doc_id, sheet_name, row_index, list_concat([CASE WHEN row_index % 3 = 1 THEN cells[1] ELSE '' END], cells[2:]) AS cells, headers FROM dat0 WHERE sheet_name = 'Orders')"
_FILLED = "fil AS (SELECT *, last_value(nullif(trim(cells[1]), '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY row_index) AS g FROM lab)"


def _blanked(spark, sf_dir):
    rows = R.sheets(spark, sf_dir).where("sheet_name = 'Orders'")
    return rows.withColumn("cells", F.when((F.col("row_index") == 0) | (F.col("row_index") % 3 == 1), F.col("cells")).otherwise(F.expr("concat(array(''), slice(cells, 2, size(cells)))")))


def _blanked_sql(select: str) -> str:
    base = R.SHEETS_SQL.replace("dat AS (", "dat0 AS (", 1)
    return f"WITH {base.replace(chr(10) + 'det AS', chr(10) + _BLANKED + ',' + chr(10) + 'det AS', 1)}, {_FILLED} {select}"


@query(_blanked_sql("SELECT doc_id, row_index, g AS group_value FROM fil"))
def forward_fill_groups(spark, sf_dir):
    return sheets.forward_fill(_blanked(spark, sf_dir)).where("row_index > 0").select("doc_id", "row_index", "group_value")


@query(_blanked_sql("""SELECT doc_id, sheet_name, row_number() OVER (PARTITION BY doc_id ORDER BY min(row_index)) - 1 AS chunk_index, g AS group_value, '[Orders] ' || g || chr(10) || string_agg(line, chr(10) ORDER BY row_index) FILTER (line <> '') AS content FROM fil WHERE g IS NOT NULL GROUP BY doc_id, sheet_name, g"""))
def sheet_group_chunks(spark, sf_dir):
    return sheets.group_chunks(sheets.forward_fill(_blanked(spark, sf_dir)))


@query(f"WITH {R.SHEETS_SQL} SELECT doc_id, sheet_name, 0 AS chunk_index, '[' || sheet_name || ']' || chr(10) || string_agg(plain, chr(10) ORDER BY row_index) AS content FROM lab GROUP BY doc_id, sheet_name".replace("0 AS chunk_index", "0::BIGINT AS chunk_index"))
def sheet_single_chunk(spark, sf_dir):
    return sheets.single_chunks(R.sheets(spark, sf_dir))


@query("SELECT 400 + r_regionkey::BIGINT AS doc_id, 'Note' AS sheet_name, 0::BIGINT AS chunk_index, '[Note]' || chr(10) || repeat(r_name, 30) AS content FROM region WHERE length(repeat(r_name, 30)) > 100")
def sheet_header_only(spark, sf_dir):
    return sheets.header_only_chunks(R.sheets(spark, sf_dir))


@query(f"""WITH {R.SHEETS_SQL}, x AS (SELECT lab.*, strategy FROM lab JOIN str USING (doc_id, sheet_name)),
al AS (SELECT doc_id, sheet_name, row_number() OVER (PARTITION BY doc_id, sheet_name ORDER BY row_index) - 1 AS chunk_index, '[' || sheet_name || ']' || chr(10) || line AS content, strategy FROM x WHERE strategy = 'row_based' AND line <> ''
UNION ALL SELECT doc_id, sheet_name, row_number() OVER (PARTITION BY doc_id, sheet_name ORDER BY min(row_index)) - 1, '[' || sheet_name || '] ' || cells[1] || chr(10) || string_agg(line, chr(10) ORDER BY row_index), strategy FROM x WHERE strategy = 'group_by_column' GROUP BY doc_id, sheet_name, cells[1], strategy
UNION ALL SELECT doc_id, sheet_name, 0, '[' || sheet_name || ']' || chr(10) || string_agg(plain, chr(10) ORDER BY row_index), strategy FROM x WHERE strategy = 'single_chunk' GROUP BY doc_id, sheet_name, strategy
UNION ALL SELECT 400 + r_regionkey, 'Note', 0, '[Note]' || chr(10) || repeat(r_name, 30), 'single_chunk' FROM region WHERE length(repeat(r_name, 30)) > 100)
SELECT doc_id, sheet_name, chunk_index, content, strategy FROM al""")
def chunk_sheets(spark, sf_dir):
    return sheets.chunk_sheets(R.sheets(spark, sf_dir))


@query(f"WITH {R.SHEETS_SQL} SELECT doc_id, sheet_name, row_index, sha256(array_to_string(cells, '|')) AS row_hash FROM dat")
def row_hashes(spark, sf_dir):
    return sheets.row_hashes(R.sheets(spark, sf_dir))


_HASHES_SQL = R.SHEETS_SQL + """, o AS (SELECT doc_id, sheet_name, row_index, sha256(array_to_string(cells, '|')) AS row_hash FROM dat WHERE row_index % 10 <> 3),
n AS (SELECT doc_id, sheet_name, row_index, CASE WHEN row_index % 7 = 0 THEN sha256('x' || row_index) ELSE sha256(array_to_string(cells, '|')) END AS row_hash FROM dat WHERE row_index % 11 <> 5)"""


def _versions(spark, sf_dir):
    hashes = sheets.row_hashes(R.sheets(spark, sf_dir))
    changed = F.when(F.col("row_index") % 7 == 0, F.sha2(F.concat(F.lit("x"), F.col("row_index").cast("string")), 256)).otherwise(F.col("row_hash"))
    return hashes.where("row_index % 10 <> 3"), hashes.withColumn("row_hash", changed).where("row_index % 11 <> 5")


@query(f"""WITH {_HASHES_SQL} SELECT * FROM (SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, coalesce(o.sheet_name, n.sheet_name) AS sheet_name, coalesce(o.row_index, n.row_index) AS row_index, CASE WHEN o.row_hash IS NULL THEN 'new' WHEN n.row_hash IS NULL THEN 'removed' WHEN o.row_hash <> n.row_hash THEN 'changed' END AS change
FROM o FULL JOIN n ON o.doc_id = n.doc_id AND o.sheet_name = n.sheet_name AND o.row_index = n.row_index) WHERE change IS NOT NULL""")
def row_delta(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    return sync.row_delta(old, new, ["doc_id", "sheet_name", "row_index"])


@query(f"WITH {_HASHES_SQL} SELECT * FROM n UNION ALL SELECT o.* FROM o ANTI JOIN n USING (doc_id, sheet_name, row_index)")
def upsert_row_hashes(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    return sync.upsert(old, new, ["doc_id", "sheet_name", "row_index"])


@query(f"WITH {R.SHEETS_SQL} SELECT doc_id, sheet_name, row_index FROM lab WHERE line <> '' AND row_index % 7 <> 0")
def delete_chunks_for_rows(spark, sf_dir):
    chunks = sheets.row_chunks(R.sheets(spark, sf_dir))
    gone = sheets.row_hashes(R.sheets(spark, sf_dir)).where("row_index % 7 = 0")
    return sync.without_rows(chunks, gone).select("doc_id", "sheet_name", "row_index")


# Synchronisation


def _incoming(spark, sf_dir):
    docs = R.table(spark, sf_dir, "documents")
    return docs.select(F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("source_id"), T.content_hash("text").alias("content_hash"), F.col("doc_id").alias("seq"))


def _stored(spark, sf_dir, whole=False):
    """A third of the documents as stored, or all of them, some with an older text."""
    docs = R.table(spark, sf_dir, "documents")
    docs = docs if whole else docs.where("doc_id % 3 = 0")
    text = F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit(" old"))).otherwise(F.col("text"))
    return docs.select(F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("source_id"), T.content_hash(text).alias("content_hash"), F.when(F.col("doc_id") % 9 == 0, "gmail").otherwise("google_drive").alias("source_type"),
        F.when(F.col("doc_id") % 6 == 3, F.concat(F.lit("s"), (F.col("doc_id") - 3).cast("string"))).alias("parent_id"), F.array(F.col("lang"), F.lit("INBOX")).alias("labels"), F.col("doc_id"))


_SYNC_SQL = """inc AS (SELECT 's' || doc_id AS source_id, sha256(text) AS content_hash, doc_id AS seq, lang FROM documents),
sto AS (SELECT 's' || doc_id AS source_id, sha256(CASE WHEN doc_id % 2 = 0 THEN text || ' old' ELSE text END) AS content_hash, CASE WHEN doc_id % 9 = 0 THEN 'gmail' ELSE 'google_drive' END AS source_type, CASE WHEN doc_id % 6 = 3 THEN 's' || (doc_id - 3) END AS parent_id, lang, doc_id FROM documents WHERE doc_id % 3 = 0)"""


@query(f"""WITH {_SYNC_SQL}, j AS (SELECT inc.source_id, inc.seq, inc.content_hash, sto.content_hash AS h, inc.content_hash IN (SELECT content_hash FROM sto) AS seen FROM inc LEFT JOIN sto USING (source_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY content_hash, h IS NULL AND NOT seen ORDER BY seq) AS r FROM j)
SELECT source_id, seq, CASE WHEN h = content_hash THEN 'skipped' WHEN h IS NOT NULL THEN 'update' WHEN seen OR r > 1 THEN 'skipped' ELSE 'create' END AS action, CASE WHEN h = content_hash THEN 'unchanged' WHEN h IS NULL AND (seen OR r > 1) THEN 'duplicate_content' END AS reason FROM k""")
def sync_actions(spark, sf_dir):
    return sync.file_actions(_incoming(spark, sf_dir), _stored(spark, sf_dir)).select("source_id", "seq", "action", "reason")


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS content_hash FROM documents GROUP BY text")
def dedup_first_wins(spark, sf_dir):
    docs = R.table(spark, sf_dir, "documents").select("doc_id", T.content_hash("text").alias("content_hash"))
    return docs.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"))


@query(f"""WITH {_SYNC_SQL} SELECT inc.source_id, CASE WHEN sto.content_hash = inc.content_hash AND inc.seq % 5 <> 0 THEN 'skipped' WHEN sto.content_hash = inc.content_hash THEN 'metadata_updated' WHEN sto.content_hash IS NOT NULL THEN 'update' ELSE 'create' END AS action FROM inc LEFT JOIN sto USING (source_id)""")
def email_actions(spark, sf_dir):
    docs = R.table(spark, sf_dir, "documents")
    labels = F.when(F.col("doc_id") % 5 == 0, F.array(F.lit("STARRED"))).otherwise(F.array(F.lit("INBOX"), F.col("lang"), F.lit("INBOX")))
    incoming = docs.select(F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("source_id"), T.content_hash("text").alias("content_hash"), labels.alias("labels"))
    return sync.email_actions(incoming, _stored(spark, sf_dir)).select("source_id", "action")


@query(f"WITH {_SYNC_SQL} SELECT source_id FROM sto WHERE source_type = 'google_drive' AND doc_id % 4 = 0")
def tombstones(spark, sf_dir):
    return sync.tombstones(_stored(spark, sf_dir), _incoming(spark, sf_dir).where("seq % 4 <> 0"), "google_drive").select("source_id")


@query(f"WITH {_SYNC_SQL}, g AS (SELECT source_id FROM sto WHERE doc_id % 4 = 0) SELECT source_id FROM g UNION SELECT source_id FROM sto WHERE parent_id IN (SELECT source_id FROM g)")
def delete_with_attachments(spark, sf_dir):
    stored = _stored(spark, sf_dir)
    return sync.with_attachments(stored.where("doc_id % 4 = 0"), stored)


@query(f"WITH {R.SHEETS_SQL} SELECT doc_id, count(*) AS n_rows FROM dat WHERE doc_id % 4 <> 0 GROUP BY doc_id")
def cascade_delete(spark, sf_dir):
    rows = sheets.row_hashes(R.sheets(spark, sf_dir))
    kept = sync.cascade_delete(rows.where("doc_id % 4 = 0"), "doc_id", row_hashes=rows)["row_hashes"]
    return kept.groupBy("doc_id").agg(F.count("*").alias("n_rows"))


@query(f"WITH {_SYNC_SQL} SELECT source_id, CASE WHEN doc_id % 2 = 0 THEN 'STARRED' ELSE lang || ',INBOX' END AS labels, source_type FROM sto")
def label_only_update(spark, sf_dir):
    stored = _stored(spark, sf_dir, whole=True)
    fresh = stored.where("doc_id % 2 = 0").select("source_id", F.array(F.lit("STARRED")).alias("labels"))
    return sync.merge_labels(stored, fresh).select("source_id", F.array_join("labels", ",").alias("labels"), "source_type")


@query(f"WITH {_SYNC_SQL} SELECT source_id, content_hash FROM sto WHERE content_hash IN (SELECT content_hash FROM inc)")
def exists_by_hash(spark, sf_dir):
    stored = _stored(spark, sf_dir, whole=True).select("source_id", "content_hash")
    return stored.join(_incoming(spark, sf_dir).select("content_hash").distinct(), "content_hash", "left_semi").select("source_id", "content_hash")


@query(f"WITH {_SYNC_SQL} SELECT source_id, content_hash FROM inc UNION ALL SELECT source_id, content_hash FROM sto WHERE source_id NOT IN (SELECT source_id FROM inc)")
def upsert_documents(spark, sf_dir):
    return sync.upsert(_stored(spark, sf_dir).select("source_id", "content_hash"), _incoming(spark, sf_dir).select("source_id", "content_hash"), ["source_id"])


@query("SELECT count(*) FILTER (doc_id % 5 = 0) AS ingested, count(*) FILTER (doc_id % 5 = 1) AS re_ingested, count(*) FILTER (doc_id % 5 = 2) AS skipped, count(*) FILTER (doc_id % 5 >= 3) AS errors, coalesce(sum(n_chars % 10) FILTER (doc_id % 5 < 2), 0)::BIGINT AS chunks FROM documents")
def ingest_summary(spark, sf_dir):
    k = F.col("doc_id") % 5
    log = R.table(spark, sf_dir, "documents").select(F.when(k < 2, "success").when(k == 2, "skipped").when(k == 3, "error").otherwise("?").alias("status"), F.when(k == 0, "create").otherwise("update").alias("action"), (F.col("n_chars") % 10).alias("chunks_stored"))
    return sync.run_summary(log)


# Enrichment

_NAMED = """nm AS (SELECT doc_id, CASE doc_id % 12 WHEN 0 THEN 'Jira board' WHEN 1 THEN 'Team Retro' WHEN 2 THEN 'OKR plan' WHEN 3 THEN 'Roadmap' WHEN 4 THEN 'Planning sprint-' || (doc_id % 15) WHEN 5 THEN 'Weekly Sync' WHEN 6 THEN 'Technical notes' WHEN 7 THEN 'PRD' WHEN 8 THEN 'Sprint_0' || (doc_id % 9) || ' list' ELSE 'Other' END AS title,
  CASE doc_id % 7 WHEN 0 THEN 'xlsx' WHEN 1 THEN 'docx' WHEN 2 THEN 'pdf' WHEN 3 THEN 'md' WHEN 4 THEN 'pptx' WHEN 5 THEN 'docx' ELSE 'odt' END AS ext, text, lang FROM documents)"""


def _named(spark, sf_dir):
    title = "case doc_id % 12 when 0 then 'Jira board' when 1 then 'Team Retro' when 2 then 'OKR plan' when 3 then 'Roadmap' when 4 then concat('Planning sprint-', doc_id % 15) when 5 then 'Weekly Sync' when 6 then 'Technical notes' when 7 then 'PRD' when 8 then concat('Sprint_0', doc_id % 9, ' list') else 'Other' end"
    ext = "case doc_id % 7 when 0 then 'xlsx' when 1 then 'docx' when 2 then 'pdf' when 3 then 'md' when 4 then 'pptx' when 5 then 'docx' else 'odt' end"
    return R.table(spark, sf_dir, "documents").select("doc_id", F.expr(title).alias("title"), F.expr(ext).alias("ext"), "text", "lang")


@query(f"""WITH {_NAMED} SELECT doc_id, CASE WHEN ext = 'xlsx' THEN CASE WHEN title LIKE 'Jira%' THEN 'jira' WHEN title LIKE '%Retro' THEN 'retro' WHEN title LIKE 'OKR%' THEN 'okr' WHEN title = 'Roadmap' THEN 'roadmap' ELSE 'spreadsheet' END
WHEN ext = 'docx' THEN CASE WHEN title LIKE 'Planning%' THEN 'planning' WHEN title LIKE '%Sync' THEN 'meeting_notes' WHEN title LIKE 'Technical%' THEN 'technical_spec' WHEN title = 'PRD' THEN 'prd' ELSE 'document' END
WHEN ext = 'pdf' THEN 'pdf' WHEN ext = 'md' THEN 'markdown' WHEN ext = 'pptx' THEN 'presentation' ELSE 'document' END AS doc_type FROM nm""")
def derive_doc_type(spark, sf_dir):
    return _named(spark, sf_dir).select("doc_id", enrich.doc_type("title", "ext").alias("doc_type"))


@query(f"WITH {_NAMED} SELECT doc_id, nullif(regexp_extract(title, '(?i)sprint[_\\s-]*(\\d+)', 1), '') AS sprint FROM nm")
def sprint_from_filename(spark, sf_dir):
    return _named(spark, sf_dir).select("doc_id", enrich.sprint_of_filename("title").alias("sprint"))


@query("""WITH s AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN (doc_id % 16)::VARCHAR WHEN doc_id % 3 = 1 THEN '0' || (doc_id % 9) END AS sprint, CASE doc_id % 4 WHEN 0 THEN ' q2 plan' WHEN 1 THEN 'Q4' ELSE 'Sheet' END AS sheet FROM documents)
SELECT doc_id, coalesce(CASE WHEN sprint::INTEGER BETWEEN 1 AND 3 THEN 'Q1' WHEN sprint::INTEGER BETWEEN 4 AND 6 THEN 'Q2' WHEN sprint::INTEGER BETWEEN 7 AND 9 THEN 'Q3' WHEN sprint::INTEGER BETWEEN 10 AND 13 THEN 'Q4' END, CASE doc_id % 4 WHEN 0 THEN 'Q2' WHEN 1 THEN 'Q4' END) AS quarter,
CASE WHEN doc_id % 2 = 0 THEN '2024-05-06' WHEN sprint::INTEGER BETWEEN 1 AND 13 THEN strftime(DATE '2025-01-01' + 14 * (sprint::INTEGER - 1), '%Y-%m-%d') END AS file_date FROM s""")
def derive_quarter_and_date(spark, sf_dir):
    d = F.col("doc_id")
    sprint = F.when(d % 3 == 0, (d % 16).cast("string")).when(d % 3 == 1, F.concat(F.lit("0"), (d % 9).cast("string")))
    sheet = F.when(d % 4 == 0, " q2 plan").when(d % 4 == 1, "Q4").otherwise("Sheet")
    docs = R.table(spark, sf_dir, "documents").select("doc_id", sprint.alias("sprint"), sheet.alias("sheet"), F.when(d % 2 == 0, "2024-05-06").otherwise("").alias("created"))
    return docs.select("doc_id", enrich.quarter("sprint", "sheet").alias("quarter"), enrich.file_date("sprint", "created").alias("file_date"))


_TICKETED = "tk AS (SELECT doc_id, 'See TECH-' || doc_id || ', sprint-8 and tech-' || doc_id || '; v2-plan-001 (OPS-7) x_OPS-9 ' || left(text, 50) AS content FROM documents)"


def _ticketed(spark, sf_dir):
    d = F.col("doc_id").cast("string")
    return R.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("See TECH-"), d, F.lit(", sprint-8 and tech-"), d, F.lit("; v2-plan-001 (OPS-7) x_OPS-9 "), "text").alias("content"))


@query(f"WITH {_TICKETED} SELECT doc_id, 'TECH-' || doc_id || ',SPRINT-8,V2-PLAN-001,OPS-7' AS tickets FROM tk")
def extract_tickets(spark, sf_dir):
    return _ticketed(spark, sf_dir).select("doc_id", F.array_join(T.ticket_ids("content"), ",").alias("tickets"))


@query(f"WITH {_TICKETED} SELECT doc_id, 'TECH-' || doc_id || ',OPS-7' AS tickets FROM tk")
def filter_tickets(spark, sf_dir):
    return _ticketed(spark, sf_dir).select("doc_id", F.array_join(T.filter_tickets(T.ticket_ids("content"), ["TECH", "OPS"]), ",").alias("tickets"))


@query("""SELECT doc_id, array_to_string(list_filter(['The', 'De', 'Und'], lambda n: regexp_matches(text, '(?i)(^|[^\\pL\\pN_])' || n || '([^\\pL\\pN_]|$)')), ',') AS people FROM documents""")
def extract_people(spark, sf_dir):
    return R.table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.people_in("text", ["The", "De", "Und"]), ",").alias("people"))


@query("SELECT DISTINCT conv_id AS thread_id, upper(role[1]) || role[2:] || CASE WHEN role <> 'assistant' THEN ',Assistant' ELSE '' END AS people FROM conversations WHERE role <> 'system'")
def seed_people(spark, sf_dir):
    c = R.table(spark, sf_dir, "conversations").where("role <> 'system'")
    sender, recipients = F.concat("role", F.lit(" Last <x@example.com>")), F.array(F.lit("team+assistant@example.com"), F.lit("team+nobody@example.com"))
    return c.select(F.col("conv_id").alias("thread_id"), F.array_join(enrich.seed_people(sender, recipients, ["user", "assistant"]), ",").alias("people")).distinct()


@query("SELECT doc_id, len(regexp_split_to_array(trim(text, ' ' || chr(10)), '\\s+')) AS token_count, len(regexp_split_to_array(trim(text, ' ' || chr(10)), '\\s+')) < 20 AS is_short, sha256(text) AS content_hash FROM documents")
def token_counts_and_gate(spark, sf_dir):
    return R.table(spark, sf_dir, "documents").select("doc_id", T.word_count("text").alias("token_count"), enrich.is_short("text").alias("is_short"), T.content_hash("text").alias("content_hash"))


@query("""WITH c AS (SELECT doc_id, text AS content, CASE WHEN doc_id % 3 = 0 THEN 'table' END AS element_type, CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'f' || doc_id END AS file_name, 't' || doc_id AS title, CASE WHEN doc_id % 5 = 0 THEN 'o' ELSE '' END AS owner, 's' || doc_id AS sender FROM documents)
SELECT doc_id, coalesce(element_type, 'standard') AS chunk_type, len(regexp_split_to_array(trim(content, ' ' || chr(10)), '\\s+')) AS token_count, coalesce(nullif(file_name, ''), title) AS document_title, coalesce(nullif(owner, ''), sender) AS author FROM c""")
def stored_chunk_columns(spark, sf_dir):
    d, s = F.col("doc_id"), F.col("doc_id").cast("string")
    chunks = R.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"), F.when(d % 3 == 0, "table").alias("element_type"), F.when(d % 2 == 0, "").otherwise(F.concat(F.lit("f"), s)).alias("file_name"), F.concat(F.lit("t"), s).alias("title"), F.when(d % 5 == 0, "o").otherwise("").alias("owner"), F.concat(F.lit("s"), s).alias("sender"))
    return chunk.stored_columns(chunks).select("doc_id", "chunk_type", "token_count", "document_title", "author")


@query("SELECT lang, count(*) AS n_documents, sum(length(text)) ::BIGINT AS n_chars, max(length(text)) AS longest, min(length(text)) AS shortest FROM documents GROUP BY lang")
def corpus_statistics(spark, sf_dir):
    n = F.length("text")
    return R.table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n_documents"), F.sum(n).alias("n_chars"), F.max(n).alias("longest"), F.min(n).alias("shortest"))

@query(f"WITH {_SYNC_SQL} SELECT 's' || d.doc_id AS source_id, CASE WHEN s.source_id IS NULL THEN 'not_found' ELSE 'deleted' END AS status, CASE WHEN s.source_id IS NULL THEN 0 ELSE d.n_chars % 4 END AS chunks_deleted FROM documents d LEFT JOIN sto s ON s.source_id = 's' || d.doc_id WHERE d.doc_id % 5 = 0")
def delete_results(spark, sf_dir):
    docs = R.table(spark, sf_dir, "documents").select(F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("source_id"), "doc_id", "n_chars")
    chunks = docs.where("n_chars % 4 > 0").select("source_id", F.expr("explode(sequence(1, cast(n_chars % 4 as int)))").alias("k"))
    return sync.delete_results(docs.where("doc_id % 5 = 0"), _stored(spark, sf_dir), chunks)


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'extra' ELSE lang END AS lang, source, CASE WHEN doc_id % 2 = 0 THEN '1' END AS added FROM documents")
def merge_metadata(spark, sf_dir):
    base = F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"))
    extra = F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("lang"), F.lit("extra"), F.lit("added"), F.lit("1")))
    merged = R.table(spark, sf_dir, "documents").select("doc_id", enrich.base_metadata(base, extra).alias("m"))
    return merged.select("doc_id", *(F.try_element_at("m", F.lit(k)).alias(k) for k in ("lang", "source", "added")))


@query("SELECT DISTINCT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'Ann,Bob' WHEN 1 THEN 'Bob' ELSE '' END AS people FROM customer")
def filter_people(spark, sf_dir):
    k = F.col("c_custkey") % 3
    names = F.when(k == 0, F.array(F.lit("ANN"), F.lit("carl"), F.lit("bob"), F.lit("Ann"))).when(k == 1, F.array(F.lit("bob"))).otherwise(F.array(F.lit("Dora")))
    return R.table(spark, sf_dir, "customer").select("c_custkey", F.array_join(T.filter_people(names, ["Ann", "bob"]), ",").alias("people"))


# Verification

RULES = verify.Rules(folders={"Jira": ("jira",), "Notes": ("meeting_notes", "planning"), "Strategy": ("okr", "roadmap", "technical_spec")}, people=("Ann", "Bob"), features=("search", "diary"), excluded_tickets=("API", "Q1"))
_CHUNKS = {
    "document_title": "case when doc_id % 31 = 0 then ' ' else concat('t', doc_id div 8) end", "chunk_index": "case when doc_id % 29 = 0 then null when doc_id % 23 = 0 then 0 when doc_id % 37 = 0 then -1 else doc_id % 8 end",
    "doc_type": "case doc_id % 10 when 0 then 'jira' when 1 then 'retro' when 2 then 'okr' when 3 then 'email' when 4 then 'planning' when 5 then 'technical_spec' when 6 then 'email' when 7 then 'prd' when 8 then null else 'meeting_notes' end",
    "sprint": "case when doc_id % 3 = 0 then cast(doc_id % 15 as string) when doc_id % 3 = 1 then '06' end", "quarter": "case doc_id % 6 when 0 then 'Q1' when 1 then 'Q2' when 2 then 'Q9' when 3 then 'Q3' end",
    "folder": "case doc_id % 7 when 0 then 'Jira' when 1 then 'Notes' when 2 then 'Strategy' when 3 then '' when 4 then 'Else' end", "source_type": "case doc_id % 5 when 0 then 'gmail' when 1 then 'google_drive' when 2 then 'google_drive' when 3 then 'x' end",
    "sheet_name": "case when doc_id % 16 < 8 then 'S' end", "section_heading": "case when doc_id % 3 = 0 then 'H' else ' ' end", "sender": "case doc_id % 4 when 0 then 'a@example.com' when 1 then 'b@other.org' when 2 then 'nobody' end",
    "subject": "case doc_id % 5 when 0 then 's' when 1 then ' ' end", "author": "case doc_id % 4 when 0 then 'a@example.com' when 1 then 'z' when 2 then '' end", "file_created_at": "case when doc_id % 9 > 0 then '2025' end",
    "file_updated_at": "case when doc_id % 8 > 0 then '2025' end", "chunk_type": "case doc_id % 5 when 0 then 'standard' when 1 then 'table' when 2 then 'odd' end",
}
_ARRAYS = {
    "people": ["null", "[]", "['Ann', 'Bob', 'Ann', 'Ann']", "['ann', 'Carl Sagan', '']"], "features": ["['search', 'none', 'search']", "[]", "null", "['diary', ' ']"],
    "ticket_ids": ["['API', 'T-1', 'T-1']", "null", "['q1', '']", "[]"], "metrics": ["['5', '5']", "[' ']", "null", "[]"],
}


def _case(values: list[str], array: str) -> str:
    return "case doc_id % 4 " + " ".join(f"when {k} then {v if v == 'null' else array.format(v[1:-1])}" for k, v in enumerate(values)) + " end"


def _faulty(spark, sf_dir):
    docs = R.table(spark, sf_dir, "documents")
    return docs.select("doc_id", *(F.expr(v).alias(k) for k, v in _CHUNKS.items()), *(F.expr(_case(v, "cast(array({}) as array<string>)")).alias(k) for k, v in _ARRAYS.items()))


_FAULTY_SQL = "ch AS (SELECT doc_id, " + ", ".join(f"{v.replace(' div ', ' // ').replace('concat(', 'concat(').replace(' as string', ' as varchar')} AS {k}" for k, v in _CHUNKS.items()) + ", " + ", ".join(f"{_case(v, 'CAST([{}] AS VARCHAR[])')} AS {k}" for k, v in _ARRAYS.items()) + " FROM documents)"


def _array_issues(column: str, extra: list[tuple[str, str]]) -> str:
    out = [f"SELECT '{column}' AS category, 'null' AS problem, document_title, chunk_index FROM ch WHERE {column} IS NULL"]
    rows = f"(SELECT document_title, chunk_index, doc_id, trim(unnest({column})) AS v, generate_subscripts({column}, 1) AS i FROM ch)"
    out.append(f"SELECT '{column}', 'blank', document_title, chunk_index FROM {rows} WHERE v = ''")
    out.append(f"SELECT '{column}', 'duplicate', document_title, chunk_index FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, v ORDER BY i) AS r FROM {rows} WHERE v <> '') WHERE r > 1")
    out += [f"SELECT '{column}', '{p}', document_title, chunk_index FROM {rows} WHERE v <> '' AND {cond}" for p, cond in extra]
    return " UNION ALL ".join(out)


_ROW_ISSUES = " UNION ALL ".join(
    [f"SELECT '{c}' AS category, $${p}$$ AS problem, document_title, chunk_index FROM ch WHERE {cond}" for c, p, cond in verify.row_rules(RULES)]
    + [_array_issues("people", [("full name", "v LIKE '% %'"), ("lower case", "v[1] <> upper(v[1])"), ("unknown", "v NOT IN ('Ann', 'Bob')")]), _array_issues("features", [("unknown", "v NOT IN ('search', 'diary')")]), _array_issues("ticket_ids", [("excluded", "upper(v) IN ('API', 'Q1')")]), _array_issues("metrics", [])]
)
_NAMED_TITLE = "coalesce(nullif(trim(document_title), ''), 'unknown')"
_SEQ_SQL = f"""sq AS (SELECT {_NAMED_TITLE} AS t, sheet_name AS s, chunk_index AS i FROM ch), un AS (SELECT t, s, i, count(*) AS n FROM sq WHERE i IS NOT NULL GROUP BY t, s, i), lg AS (SELECT *, lag(i) OVER (PARTITION BY t, s ORDER BY i) AS b FROM un),
seq AS (SELECT 'chunk_index' AS category, 'null' AS problem, t AS document_title, i AS chunk_index FROM sq WHERE i IS NULL UNION ALL SELECT 'chunk_index', 'negative', t, i FROM sq WHERE i < 0 UNION ALL SELECT 'chunk_index', 'duplicate', t, i FROM un WHERE n > 1
UNION ALL SELECT 'chunk_index', 'not from 0', t, i FROM lg WHERE b IS NULL AND i <> 0 UNION ALL SELECT 'chunk_index', 'gap', t, i FROM lg WHERE i - b > 1)"""


@query(f"WITH {_FAULTY_SQL}, iss AS ({_ROW_ISSUES}) SELECT category, problem, {_NAMED_TITLE} AS document_title, chunk_index FROM iss")
def verify_rules(spark, sf_dir):
    return verify.row_issues(_faulty(spark, sf_dir), RULES)


@query(f"WITH {_FAULTY_SQL}, {_SEQ_SQL} SELECT * FROM seq")
def verify_chunk_sequence(spark, sf_dir):
    return verify.sequence_issues(_faulty(spark, sf_dir))


@query(f"WITH {_FAULTY_SQL}, {_SEQ_SQL}, iss AS ({_ROW_ISSUES}), al AS (SELECT category FROM iss UNION ALL SELECT category FROM seq), nm AS (SELECT unnest([{', '.join(repr(c) for c in verify.ISSUE_CATEGORIES)}]) AS category) SELECT nm.category, count(al.category) AS n_issues FROM nm LEFT JOIN al USING (category) GROUP BY nm.category")
def verify_summary(spark, sf_dir):
    return verify.summary(verify.issues(_faulty(spark, sf_dir), RULES))


# Retrieval

_UNIT = "sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))"


def _cos(a: str, b: str) -> str:
    return f"list_dot_product({a}::DOUBLE[], {b}::DOUBLE[]) / (sqrt(list_dot_product({a}::DOUBLE[], {a}::DOUBLE[])) * sqrt(list_dot_product({b}::DOUBLE[], {b}::DOUBLE[])))"


_QUESTION = [((7 * k) % 11 - 5) / 10 for k in range(64)]


@query(f"SELECT vec_id, round({_cos('embedding', str(_QUESTION))}, 6) AS similarity FROM embeddings ORDER BY 2 DESC, 1 LIMIT 10")
def topk_similarity(spark, sf_dir):
    return retrieve.top_k(R.table(spark, sf_dir, "embeddings"), _QUESTION, 10).withColumn("similarity", F.round("similarity", 6))


@query(f"SELECT vec_id, round({_cos('embedding', str(_QUESTION))}, 6) AS similarity FROM embeddings WHERE label = 3 ORDER BY 2 DESC, 1 LIMIT 10")
def filtered_topk(spark, sf_dir):
    return retrieve.top_k(R.table(spark, sf_dir, "embeddings"), _QUESTION, 10, where=F.col("label") == 3).withColumn("similarity", F.round("similarity", 6))


@query(f"WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, round({_cos('e.embedding', 'q.embedding')}, 6) AS similarity FROM embeddings e JOIN (SELECT * FROM embeddings WHERE vec_id < 20) q ON e.vec_id <> q.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM s) SELECT query_id, rank, vec_id, similarity FROM r WHERE rank <= 10")
def topk_per_query(spark, sf_dir):
    vectors = R.table(spark, sf_dir, "embeddings")
    return retrieve.top_k_each(vectors, vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), 10)


@query(f"SELECT vec_id // 4 AS chunk_id, round(max({_cos('embedding', str(_QUESTION))}), 6) AS similarity FROM embeddings GROUP BY 1")
def question_index_max(spark, sf_dir):
    scores = R.table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 4").alias("chunk_id"), retrieve.cosine("embedding", F.array(*(F.lit(x) for x in _QUESTION))).alias("similarity"))
    return retrieve.best_question(scores).withColumn("similarity", F.round("similarity", 6))


@query("""SELECT c_custkey::BIGINT AS document_id, count(l_orderkey) AS n_questions FROM customer LEFT JOIN orders ON o_custkey = c_custkey
LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def count_questions(spark, sf_dir):
    documents = R.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_id"))
    chunks = R.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chunk_id"), F.col("o_custkey").alias("document_id"))
    return retrieve.question_counts(documents, chunks, R.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chunk_id")))


@query("SELECT conv_id, turn FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations WHERE length(text) > 900)")
def sibling_expansion(spark, sf_dir):
    turns = R.table(spark, sf_dir, "conversations")
    return retrieve.siblings(turns, turns.where(F.length("text") > 900), "conv_id").select("conv_id", "turn")


@query("SELECT conv_id, turn FROM conversations WHERE role = 'user' AND conv_id % 10 = 1 AND turn % 2 = 0")
def keyword_prefilter(spark, sf_dir):
    c = R.table(spark, sf_dir, "conversations")
    chunks = c.select("conv_id", "turn", "role", F.concat("role", F.lit("@Example.com")).alias("sender"), F.concat(F.lit("Topic "), (F.col("conv_id") % 10).cast("string")).alias("subject"), F.array(F.concat(F.lit("T-"), (F.col("turn") % 2).cast("string"))).alias("ticket_ids"))
    return retrieve.prefilter(chunks, sender="USER@example", subject="topic 1", ticket="t-0", role="user").select("conv_id", "turn")


@query("""WITH s AS (SELECT conv_id, turn, (turn % 5) / 10.0::DOUBLE AS similarity, list_distinct(regexp_split_to_array(lower(text), '[^0-9a-z_]+')) AS w FROM conversations)
SELECT conv_id, turn, round(similarity * 0.7 + len(list_intersect(['the', 'of', 'und', 'de'], w)) / 4.0::DOUBLE * 0.3, 6) AS score FROM s""")
def rerank_overlap(spark, sf_dir):
    c = R.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", (F.col("turn") % 5 / 10.0).alias("similarity"))
    return retrieve.rerank(c, "the of und de", 0.3, "text").select("conv_id", "turn", F.round("score", 6).alias("score"))


# Structured text


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM part")
def slugify_titles(spark, sf_dir):
    return R.table(spark, sf_dir, "part").select("p_partkey", T.slugify("p_name").alias("slug"))


_BLOCKS_SQL = "SELECT doc_id, 'intro' || chr(10) || '### Ticket 1: TECH-' || doc_id || chr(10) || 'Tier: ' || (doc_id % 3 + 1) || chr(10) || left(text, 80) || chr(10) || '## TICKET 2' || chr(10) || 'OPS-' || (doc_id % 50) || chr(10) || '- end' AS text FROM documents"


def _blocks(spark, sf_dir):
    d = F.col("doc_id").cast("string")
    text = F.concat(F.lit("intro\n### Ticket 1: TECH-"), d, F.lit("\nTier: "), (F.col("doc_id") % 3 + 1).cast("string"), F.lit("\n"), "text", F.lit("\n## TICKET 2\nOPS-"), (F.col("doc_id") % 50).cast("string"), F.lit("\n- end"))
    return R.table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


@query(f"""WITH b AS ({_BLOCKS_SQL}), s AS (SELECT doc_id, string_split(regexp_replace(text, '(?m)^(### Ticket \\d+: |## TICKET \\d+)', chr(1) || '\\1', 'g'), chr(1))[2:] AS p FROM b), u AS (SELECT doc_id, generate_subscripts(p, 1) - 1 AS block, regexp_replace(unnest(p), {_STRIP}) AS content FROM s)
SELECT doc_id, block, content, nullif(regexp_extract(content, '\\b[A-Z][A-Z0-9]*(?:-[A-Z0-9]+)*-\\d+\\b'), '') AS ticket, coalesce(TRY_CAST(regexp_extract(content, '(?i)\\btier\\s*:?\\s*\\**\\s*(\\d)', 1) AS BIGINT), 2) AS tier FROM u""")
def split_ticket_blocks(spark, sf_dir):
    out = _blocks(spark, sf_dir).select("doc_id", F.posexplode(markup.ticket_blocks("text")).alias("block", "content"))
    return out.withColumns({"ticket": markup.ticket_key("content"), "tier": markup.ticket_tier("content")})


@query(f"WITH b AS ({_BLOCKS_SQL}) SELECT doc_id, regexp_replace(substr(text, strpos(text, '### Ticket'), strpos(text, '## TICKET') - strpos(text, '### Ticket')), {_STRIP}) AS section FROM b")
def section_between_markers(spark, sf_dir):
    return _blocks(spark, sf_dir).select("doc_id", markup.section_between("text", "### Ticket", "## TICKET").alias("section"))


@query(f"""WITH {R.MESSAGES_SQL}, x AS (SELECT thread_id, count(*) AS n, min(length(regexp_replace(body, {_STRIP}))) AS least FROM msg GROUP BY thread_id) SELECT thread_id, n >= 2 AND least >= 20 AS valid FROM x""")
def validate_threads(spark, sf_dir):
    m = R.messages(R.table(spark, sf_dir, "conversations"))
    block = F.concat(F.lit("Date: "), "date", F.lit("\nFrom: "), "sender", F.lit("\nTo: all\nSubject: "), "subject", F.lit("\n"), "body", F.lit("\n---\n"))
    texts = m.groupBy("thread_id").agg(F.array_sort(F.collect_list(F.struct("pos", block.alias("b")))).alias("bs")).select("thread_id", F.array_join(F.transform("bs", lambda x: x["b"]), "").alias("text"))
    return texts.select("thread_id", markup.valid_thread("text").alias("valid"))


@query(f"SELECT doc_id, len(list_filter(string_split(regexp_replace(regexp_replace(text, {_STRIP}), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> '')) AS n_sentences FROM documents")
def sentence_counts(spark, sf_dir):
    return R.table(spark, sf_dir, "documents").select("doc_id", T.sentence_count("text").alias("n_sentences"))


@query("SELECT event_id, event_type <> 'purchase' AS complete FROM events")
def validate_specs(spark, sf_dir):
    spec = F.to_json(F.struct(F.col("event_type").alias("title"), F.when(F.col("event_type") == "purchase", " ").otherwise("body").alias("summary")))
    return R.table(spark, sf_dir, "events").select("event_id", markup.spec_is_complete(spec, "title string, summary string", ["title", "summary"]).alias("complete"))


@query("""SELECT o_custkey, string_agg('• ' || o_orderpriority, chr(10) ORDER BY o_orderkey) AS bullets FROM orders GROUP BY o_custkey""")
def ordered_bullets(spark, sf_dir):
    grouped = R.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct(F.col("o_orderkey").cast("int").alias("number"), F.lit("a").alias("author"), F.lit("d").alias("date"), F.col("o_orderpriority").alias("text"))).alias("cs"))
    return grouped.select("o_custkey", markup.acceptance_bullets(F.transform(markup.ordered_comments("cs"), lambda c: c["text"])).alias("bullets"))


# Providers: their answers are no SQL, so that rows alone are compared


@query()
def embed_documents(spark, sf_dir):
    return R.table(spark, sf_dir, "documents").select("doc_id", embedding(HashedWords(), "text").alias("embedding"))


@query()
def search_chunks(spark, sf_dir):
    chunks = chunk.chunk_texts(R.table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "source_id"), key="source_id")
    return search(chunks.withColumn("embedding", embedding(HashedWords(), "content")), "what does the report say", HashedWords())


@query()
def chunk_questions(spark, sf_dir):
    chunks = _ticketed(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), "content", F.lit("Summary").alias("section_heading"), T.ticket_ids("content").alias("ticket_ids"))
    return question_rows(chunks, HashedWords())


# More structured text


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'excel' WHEN 1 THEN 'word' WHEN 2 THEN 'txt' END AS hint FROM part")
def format_hints(spark, sf_dir):
    k = F.col("p_partkey") % 4
    text = F.concat(F.col("p_name"), F.when(k == 0, " as an Excel workbook").when(k == 1, " (.docx)").when(k == 2, " Plain text").otherwise(" excellent wordy"))
    return R.table(spark, sf_dir, "part").select("p_partkey", markup.format_hint(text).alias("hint"))


@query(f"SELECT doc_id, k::BIGINT AS block, '## THREAD — ' || k || chr(10) || regexp_replace(left(text, 40), {_STRIP}) AS content FROM documents, (SELECT unnest([0, 1]) AS k)")
def email_thread_blocks(spark, sf_dir):
    body = F.concat(*(F.concat(F.lit(f"\n## THREAD — {k}\n"), "text", F.lit(" \n")) for k in range(2)))
    docs = R.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("intro"), body).alias("text"))
    return chunk.numbered(docs, markup.email_thread_blocks("text"), "doc_id", index="block", name="content")


@query("SELECT o_orderkey, o_orderkey % 4 >= 2 AND o_orderkey % 2 = 1 AS narrative, CASE o_orderkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 5 ELSE 3 END::BIGINT AS least_comments FROM orders")
def narrative_bullets(spark, sf_dir):
    k = F.col("o_orderkey")
    bullet = F.concat(F.lit("Work went on"), F.when(k % 4 >= 2, ". All is done").otherwise(""), F.when(k % 2 == 1, " in TECH-1.").otherwise("."))
    return R.table(spark, sf_dir, "orders").select("o_orderkey", markup.is_narrative(bullet).alias("narrative"), markup.required_comments(k % 3).alias("least_comments"))


@query("SELECT n_nationkey::BIGINT AS n_nationkey, 'users' AS name, 'id, name' AS columns, 0::BIGINT AS pos FROM nation UNION ALL SELECT n_nationkey::BIGINT, 'logs', lower(n_name), 1 FROM nation")
def schema_blocks(spark, sf_dir):
    text = F.concat(F.lit("Intro\nusers:\n  - id\n  - name\n\ntext: none\nlogs:\n  • "), F.lower("n_name"), F.lit("\nusers:\n  - other\n"))
    rows = chunk.numbered(R.table(spark, sf_dir, "nation"), markup.schema_rows(text), "n_nationkey", index="pos", name="r")
    return rows.select("n_nationkey", "r.name", "r.columns", "pos")
