from __future__ import annotations

import io
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.functions import elements as E
from docloom.functions import enrich, mail, markup, packing, sheets
from docloom.functions import text as T
from docloom.operators import chunk, retrieve, sync, threads
from docloom.plans.ingest import ingest_files, ingest_mail, ingest_texts, mail_chunks
from docloom.providers import HashedWords, classify_sheets, embed_texts, embedding, extract_metadata, parse_classification, parse_json_keys, question_rows, with_row_groups
from docloom.sources import office
from docloom.store import Store
from docloom.streaming.sync import chunk_counts, read_events, sync_stream


def one(spark, expression, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select((F.expr(expression) if isinstance(expression, str) else expression).alias("x")).first()["x"]


# A plain restatement of the packer, piece by piece.


def slow_pack(pieces, separator, finer):
    out, buffer = [], ""
    for piece in pieces:
        if not piece and not buffer:
            continue
        if len(piece) > 1000 and finer:
            out += [buffer] if buffer else []
            parts = finer(piece)
            out, buffer = out + parts[:-1], parts[-1] if parts else ""
        elif not buffer:
            buffer = piece
        elif len(buffer) + len(separator) + len(piece) <= 1000:
            buffer += separator + piece
        else:
            out, buffer = [*out, buffer], buffer[-200:] + "\n" + piece
    return out + [buffer] if buffer else out


def slow_split(text):
    words = lambda t: slow_pack(t.split(" "), " ", None)
    sentences = lambda t: slow_pack(packing._SENTENCE_END.split(t), " ", words)
    text = text.strip()
    return ([text] if text else []) if len(text) <= 1000 else slow_pack(text.split("\n\n"), "\n\n", sentences)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "bb ", "ccc. ", "\n\n", "\n", "? ", "é😀" * 40, "x" * 190, "y" * 1100, "  "]), max_size=120).map("".join))
def test_recursive_split_equals_restatement(text):
    chunks = packing.split_recursively(text)
    assert chunks == slow_split(text)
    assert all(len(c) <= 1201 or " " not in c[201:] for c in chunks)


@pytest.mark.parametrize("text", [None, "", "   ", " " * 1500, "a" * 3000, " x "])
def test_recursive_chunks_edges(spark, text):
    df = spark.createDataFrame([(text,)], "t string").select(packing.recursive_chunks("t").alias("c"))
    assert df.first()["c"] == ([] if text is None else slow_split(text))


def test_strip_takes_all_white_space(spark):
    assert one(spark, T.ustrip("a"), a="   x y\t\n　") == "x y"
    assert one(spark, T.word_count("a"), a="   ") == 0
    assert one(spark, T.word_count("a"), a=" a b\nc ") == 3


def test_parse_text_goldens(spark):
    got = one(spark, E.parse_text("a"), a="# T\r\n\r\n##### deep\nplain \r \n##\n")
    assert [(e["type"], e["content"], e["level"]) for e in got] == [("heading", "T", 1), ("blank", "", 0), ("heading", "## deep", 3), ("paragraph", "plain", 0), ("blank", "", 0), ("heading", "", 2)]
    assert one(spark, E.parse_text("a", clamp_first=False), a="##### deep")[0]["content"] == "deep"
    assert one(spark, E.parse_text("a"), a="") == []


def test_heading_chunks_meeting_notes(spark):
    els = [("paragraph", "Notes", 0), ("heading", "Health", 1), ("paragraph", "fine", 0), ("heading", "Action Items", 1), ("table", "a | b", 0), ("paragraph", "after", 0), ("blank", "", 0), ("heading", "Empty", 2)]
    df = spark.createDataFrame([([dict(zip(("type", "content", "level"), e, strict=True)) for e in els],)], "els array<struct<type string, content string, level int>>")
    got = chunk.explode_chunks(df.select(F.lit(1).alias("doc_id"), F.expr(E.heading_chunks("els")).alias("cs")), "cs", "doc_id").orderBy("chunk_index").collect()
    assert [(r["content"], r["section_heading"], r["element_type"]) for r in got] == [
        ("Notes", "", None), ("Health\nfine", "Health", None), ("Action Items\nafter", "Action Items", None), ("Action Items [TABLE]\na | b", "Action Items", "table"), ("Empty", "Empty", None),
    ]


def test_oversized_sections(spark):
    body = ["p" * 900, "", "q" * 700, "r" * 1600]
    els = [{"type": "heading", "content": "H", "level": 1}] + [{"type": "paragraph" if b else "blank", "content": b, "level": 0} for b in body]
    df = spark.createDataFrame([(els,)], "els array<struct<type string, content string, level int>>")
    got = [c["content"] for c in df.select(F.expr(E.heading_chunks("els")).alias("c")).first()["c"]]
    assert got == ["H\n" + "p" * 900, "H\n" + "q" * 700, "H\n" + "r" * 1600]
    huge = [{"type": "heading", "content": "h" * 1600, "level": 1}]
    assert [c["content"] for c in spark.createDataFrame([(huge,)], df.schema).select(F.expr(E.heading_chunks("els")).alias("c")).first()["c"]] == ["h" * 1600]
    two = one(spark, E.split_section("a"), a="\n\n".join(["s" * 1000, "t\nu" + "v" * 1600, "w"]))
    assert two == ["s" * 1000, "t", "u" + "v" * 1600, "w"]


@pytest.mark.parametrize(
    ("text", "kept"),
    [("a\n> q\nb", "a"), ("a\nOn Mon x wrote: \nb", "a"), ("a\n--- ORIGINAL message ---\nb", "a"), ("a\n_____x", "a"), ("a\nFrom: b\n  Sent: c", "a"), ("a\nFrom: b\nc", "a\nFrom: b\nc"), ("On x wrote:", ""), ("a  b\n\n\n\nc", "a b\n\nc"), ("a\r\nb", "a\nb")],
)
def test_clean_body(spark, text, kept):
    assert one(spark, mail.clean_body("a"), a=text) == kept


def test_clean_html(spark):
    html = "<STYLE a='b'>x\ny</style><p>A&nbsp;&amp;lt;b&#39;</p><script>\n1</script>&copy;"
    assert one(spark, mail.clean_body("a", is_html=True), a=html) == "A <b&copy;"


def test_mail_headers_and_dates(spark):
    assert one(spark, mail.iso_date("a"), a="Tue, 04 Mar 2025 09:30:00 +0530") == "2025-03-04T09:30:00+05:30"
    assert one(spark, mail.iso_date("a"), a="4 Mar 2025 09:30:00 GMT") == "2025-03-04T09:30:00+00:00"
    assert one(spark, mail.iso_date("a"), a="someday") == "someday"
    assert one(spark, mail.iso_date("a", F.lit(1000)), a="") == "1970-01-01T00:00:01+00:00"
    assert one(spark, mail.addresses("a"), a=" a@x , ,b@y") == ["a@x", "b@y"]
    for text in ("", "a", "ab", "abc", "é😀"):
        import base64

        assert one(spark, mail.decode_base64url("a"), a=base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")) == text


def test_email_chunks_sizes(spark):
    body = "\n\n".join(f"{k} " + "w" * 300 for k in range(5))
    got = one(spark, mail.email_chunks("b", "s", "t", "d"), b=body, s="A <a@x>", t="Sub", d="2025")
    assert len(got) == 3 and all(len(c) <= 800 and c.startswith("From: A <a@x> | Subject: Sub | Date: 2025\n\n") for c in got)
    assert one(spark, mail.email_chunks("b", "s", "t", "d"), b="", s="A", t="", d="") == ["From: A | Subject:  | Date:"]


def sheet(spark, name, rows):
    return spark.createDataFrame([("d", name, k, r) for k, r in enumerate(rows)], "doc_id string, sheet_name string, row_index long, cells array<string>")


def test_sheet_strategies(spark):
    comments = [["Ticket", "Text"]] + [[f"T-{k % 3}", str(k)] for k in range(9)]
    tickets = [["Ticket", "Text"]] + [[f"T-{k}", "x"] for k in range(8)]
    got = lambda rows: sheets.detect_sheets(sheet(spark, "S", rows)).first()["strategy"]
    assert [got(comments), got(tickets), got(tickets[:4])] == ["group_by_column", "row_based", "single_chunk"]


def test_forward_fill_keeps_parents(spark):
    rows = sheet(spark, "OKR", [["Objective", "KR"], ["Ship", "a"], ["", "b"], [None, "c"], ["Learn", "d"], ["", "e"]])
    got = sheets.group_chunks(sheets.forward_fill(rows)).orderBy("chunk_index").collect()
    assert [r["content"] for r in got] == ["[OKR] Ship\nObjective: Ship | KR: a\nKR: b\nKR: c", "[OKR] Learn\nObjective: Learn | KR: d\nKR: e"]


def test_metadata(spark):
    assert one(spark, T.ticket_ids("a"), a="see tech-1, TECH-1 and Q2-REVIEW-7; V1") == ["TECH-1", "Q2-REVIEW-7"]
    assert one(spark, enrich.quarter_of_sprint("a"), a="06") == "Q2" and one(spark, enrich.quarter_of_sprint("a"), a="14") is None
    assert one(spark, enrich.file_date("a", "b"), a="2", b="") == "2025-01-15"
    assert one(spark, enrich.sprint_of_filename("a"), a="My SPRINT_07 plan") == "07"
    assert one(spark, T.slugify("a"), a="--") == "document"
    assert one(spark, markup.is_narrative("a"), a="Done. TECH-1 works.") and not one(spark, markup.is_narrative("a"), a="TECH-1 works")
    got = one(spark, markup.schema_rows("a"), a="users:\n  - id\n  - name\nother text\nlogs:\n  id, at\nusers:\n  - x\n")
    assert [(r["name"], r["columns"]) for r in got] == [("users", "id, name"), ("logs", "id, at")]


def test_actions_in_order(spark):
    stored = spark.createDataFrame([("a", "1"), ("b", "2")], "source_id string, content_hash string")
    incoming = spark.createDataFrame([("a", "1", 0), ("b", "9", 1), ("c", "2", 2), ("d", "5", 4), ("e", "5", 3), ("f", "9", 5)], "source_id string, content_hash string, seq long")
    got = {r["source_id"]: (r["action"], r["reason"]) for r in sync.file_actions(incoming, stored).collect()}
    assert got == {"a": ("skipped", "unchanged"), "b": ("update", None), "c": ("skipped", "duplicate_content"), "d": ("skipped", "duplicate_content"), "e": ("create", None), "f": ("create", None)}


def test_store_and_ingest_is_idempotent(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    rows = [("s1", "sprint-3 notes.md", "# A\nx TECH-1\n# B\ny", "F", 1), ("s2", "b.txt", "plain", "F", 2), ("s3", "c.txt", "", "F", 3)]
    schema = "source_id string, title string, text string, folder string, seq long"
    log = {r["source_id"]: (r["action"], r["status"], r["chunks_stored"]) for r in ingest_texts(store, spark.createDataFrame(rows, schema)).collect()}
    assert log == {"s1": ("create", "success", 2), "s2": ("create", "success", 1), "s3": ("create", "error", 0)}
    again = {r["action"] for r in ingest_texts(store, spark.createDataFrame(rows, schema)).collect()}
    assert again == {"skipped"} and store.read("chunks").count() == 3
    rows[1] = ("s2", "b.txt", "changed", "F", 2)
    ingest_texts(store, spark.createDataFrame(rows[1:2], schema), listing_is_complete=True)
    assert [r["content"] for r in store.read("chunks").collect()] == ["changed"] and store.read("documents").count() == 1


def test_store_survives_a_crash_between_pointers(spark, tmp_path, monkeypatch):
    store, one = Store(spark, str(tmp_path / "store")), lambda k: spark.range(k).coalesce(1)
    store.write("t", one(1))
    (tmp_path / "store" / "t" / "next-v-left-by-a-crash").write_text("v-lo")
    first = store.version("t")

    class Dying:
        def __init__(self, files):
            self.files = files

        def __getattr__(self, name):
            return getattr(self.files, name)

        def rename(self, a, b):
            raise OSError("died")

    monkeypatch.setattr(store, "_files", lambda files=store._files(): Dying(files))
    with pytest.raises(OSError):
        store.write("t", one(2))
    monkeypatch.undo()
    assert store.version("t") == first and store.read("t").count() == 1
    for k in (3, 4, 5):
        store.write("t", one(k))
        assert store.read("t").count() == k
    assert len(store._pointers("t")) == 2


def test_ingest_of_files_and_mail(spark, tmp_path):
    p = lambda text, style="": f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'
    folder, store = tmp_path / "in", Store(spark, str(tmp_path / "store"))
    folder.mkdir()
    (folder / "a.docx").write_bytes(archive(**{"word__document.xml": f"<w:document {W}><w:body>{p('One', 'Heading1')}{p('x TECH-1')}{p('Two', 'Heading1')}{p('y')}</w:body></w:document>"}))
    (folder / "b.pptx").write_bytes(archive(**{"ppt__slides__slide1.xml": f'<p {W}><sp>{p("first")}</sp></p>', "ppt__slides__slide2.xml": f'<p {W}><sp>{p("second")}</sp></p>'}))
    (folder / "c.txt").write_text("plain text")
    (folder / "d.bin").write_bytes(b"\x00")
    (folder / "e.docx").write_bytes(b"no archive")
    files = lambda: office.list_files(spark, str(folder))
    log = {r["source_id"][-6:]: (r["action"], r["status"], r["reason"], r["chunks_stored"]) for r in ingest_files(store, files(), provider=HashedWords(8)).collect()}
    assert log == {"a.docx": ("create", "success", None, 2), "b.pptx": ("create", "success", None, 2), "/c.txt": ("create", "success", None, 1), "/d.bin": ("create", "error", "unsupported", 0), "e.docx": ("create", "error", None, 0)}
    chunks = store.read("chunks").collect()
    assert sorted((r["source_id"][-6:], r["chunk_index"]) for r in chunks) == [("/c.txt", 0), ("a.docx", 0), ("a.docx", 1), ("b.pptx", 0), ("b.pptx", 1)] and all(len(r["embedding"]) == 8 for r in chunks)
    assert [r["ticket_ids"] for r in chunks if "TECH" in r["content"]] == [["TECH-1"]]
    (folder / "a.docx").unlink()
    again = {r["action"] for r in ingest_files(store, files(), listing_is_complete=True).collect()}
    assert again == {"skipped"} and not [r for r in store.read("chunks").collect() if "a.docx" in r["source_id"]]
    mail = lambda labels, body: spark.createDataFrame([(7, "S", "A <a+ann@x>", ["t+bob@x"], "2025", labels, body)], "thread_id long, subject string, sender string, recipients array<string>, date string, labels array<string>, body string")
    assert [(r["action"], r["status"], r["chunks_stored"]) for r in ingest_mail(store, mail(["l"], "hi TECH-2"), ["a", "bob"]).collect()] == [("create", "success", 1)]
    assert [(r["action"], r["status"]) for r in ingest_mail(store, mail(["l"], "hi TECH-2")).collect()] == [("skipped", "skipped")]
    assert [(r["action"], r["status"]) for r in ingest_mail(store, mail(["m"], "hi TECH-2")).collect()] == [("metadata_updated", "metadata_updated")]
    assert [(r["people"], r["ticket_ids"]) for r in store.read("chunks").where("source_id = '7'").collect()] == [(["A", "Bob"], ["TECH-2"])]
    assert store.read("documents").where("source_id = '7'").first()["labels"] == ["m"] and store.read("documents").where("ingested_at is null").isEmpty()


def test_stream_merges_each_batch_once(spark, tmp_path):
    from datetime import datetime

    schema = "source_id string, title string, text string, folder string, at timestamp"
    events, store = tmp_path / "events", Store(spark, str(tmp_path / "store"))
    at = lambda m: datetime(2025, 1, 1, 0, m)
    spark.createDataFrame([("s", "a.txt", "one", "F", at(0)), ("s", "a.txt", "two", "F", at(1)), ("s", "a.txt", "two", "F", at(1))], schema).coalesce(1).write.parquet(str(events))
    run = lambda: sync_stream(read_events(spark, str(events)), store, str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination(120)
    assert run()
    assert [r["content"] for r in store.read("chunks").collect()] == ["two"]
    spark.createDataFrame([("s", "a.txt", "three", "F", at(2)), ("t", "b.txt", "four", "F", at(2))], schema).coalesce(1).write.mode("append").parquet(str(events))
    assert run()
    assert sorted(r["content"] for r in store.read("chunks").collect()) == ["four", "three"]
    query = chunk_counts(read_events(spark, str(events))).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    assert query.awaitTermination(120) and sum(r["n"] for r in spark.table("counts").collect()) == 5


def archive(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name.replace("__", "/"), text)
    return out.getvalue()


W = 'xmlns:w="http://x/w"'


def test_office_files(spark, tmp_path):
    p = lambda text, style="", bold="": f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>" if style else ""}<w:r>{"<w:rPr><w:b/></w:rPr>" if bold else ""}<w:t>{text}</w:t></w:r></w:p>'
    table = "<w:tbl><w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in ("a", "a", "b", "a")) + "</w:tr></w:tbl>"
    (tmp_path / "n.docx").write_bytes(archive(**{"word__document.xml": f"<w:document {W}><w:body>{p('Top', 'Heading7')}{p(' x ')}{p('Bold', bold='1')}{p('')}{table}</w:body></w:document>"}))
    (tmp_path / "s.pptx").write_bytes(archive(**{"ppt__slides__slide1.xml": f'<p {W}><sp><nv><ph type="title"/></nv>{p("T")}</sp><sp>{p("body")}</sp></p>', "ppt__slides__slide2.xml": f"<p {W}></p>", "ppt__notesSlides__notesSlide1.xml": f"<n {W}>{p('note')}</n>"}))
    sheet = '<s><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>1.5</v></c></row><row><c r="A2"/></row><row><c r="B3" t="b"><v>1</v></c></row></s>'
    (tmp_path / "w.xlsx").write_bytes(archive(**{"xl__workbook.xml": '<w xmlns:r="q"><sheet name="S" r:id="r1"/></w>', "xl___rels__workbook.xml.rels": '<R><Relationship Id="r1" Target="worksheets/sheet1.xml"/></R>', "xl__worksheets__sheet1.xml": sheet, "xl__sharedStrings.xml": "<s><si><t>He</t><t>ad</t></si></s>"}))
    (tmp_path / "bad.docx").write_bytes(b"no archive")
    files = office.list_files(spark, str(tmp_path), "*.docx", {tmp_path.name: "Jira"})
    assert {r["folder"] for r in files.collect()} == {"Jira"}
    rows = office.read_docx(files).orderBy("doc_id", "pos").collect()
    assert [(r["element_type"], r["content"], r["level"]) for r in rows if r["error"] is None] == [("heading", "Top", 3), ("paragraph", " x ", 0), ("bold_title", "Bold", 0), ("blank", "", 0), ("table", "a | b | a", 0)]
    assert [r["error"][:10] for r in rows if r["error"]] == ["BadZipFile"]
    assert len(office.nested_elements(office.read_docx(files)).first()["els"]) == 5
    assert [r["content"] for r in office.read_pptx(office.list_files(spark, str(tmp_path), "*.pptx")).orderBy("pos").collect()] == ["T\nbody\nnote", ""]
    got = office.read_xlsx(office.list_files(spark, str(tmp_path), "*.xlsx")).orderBy("row_index").collect()
    assert [(r["row_index"], r["cells"]) for r in got] == [(0, ["Head", None, "1.5"]), (1, [None, "True"])]


def test_providers(spark):
    vectors = embed_texts(HashedWords(8), ["", "a b", "a b"])
    assert len(vectors) == 3 and vectors[1] == vectors[2] and abs(sum(x * x for x in vectors[1]) - 1) < 1e-9

    class Failing:
        def embed(self, texts):
            raise OSError("down")

    with pytest.raises(RuntimeError):
        embed_texts(Failing(), ["x"], wait=0)
    assert parse_json_keys('```json\n{"people": ["A"], "ticket_ids": 3}\n```', ("people", "ticket_ids")) == {"people": ["A"], "ticket_ids": []}
    df = spark.createDataFrame([("c", "TECH-1 text", "H", ["TECH-1"])], "chunk_id string, content string, section_heading string, ticket_ids array<string>")
    assert question_rows(df, HashedWords()).count() == 2
    assert df.select(extract_metadata(lambda t: '{"people": ["Ann"]}', "content").alias("m")).first()["m"]["people"] == ["Ann"]
    assert len(df.select(embedding(HashedWords(16), "content").alias("e")).first()["e"]) == 16


def test_sheet_classifier(spark):
    rows = sheet(spark, "OKR", [["Objective", "KR"], ["Ship", "a"], [None, "b"], ["", "c"]])
    answers = {"OKR": '```json\n{"strategy": "group_by_column", "row_groups": {"1": "Ship", "2": "Ship"}}\n```'}
    found = classify_sheets(lambda name, text: answers[name] if text.startswith("Row 0: Objective | KR\nRow 1: Ship | a\nRow 2:  | b") else "?", rows)
    assert found.first()["strategy"] == "group_by_column"
    assert [r["content"] for r in sheets.group_chunks(with_row_groups(rows, found)).collect()] == ["[OKR] Ship\nObjective: Ship | KR: a\nKR: b"]
    assert [parse_classification(a)[0] for a in ("no json", '{"strategy": "group_by_column"}', '{"strategy": "single_chunk"}', "[]")] == ["row_based", "row_based", "single_chunk", "row_based"]
    assert classify_sheets(lambda name, text: 1 / 0, rows).first()["strategy"] == "row_based"


def test_threads_and_retrieval(spark):
    rows = [(1, 0, "A <a+ann@x>", ["team+bob@x"], "S", "2025", "hi TECH-1", ["l"]), (1, 1, "B", [], "S2", "2026", " ", ["m", "l"])]
    df = spark.createDataFrame(rows, "thread_id long, pos long, sender string, recipients array<string>, subject string, date string, body string, labels array<string>")
    thread = threads.assemble(df)
    r = thread.first()
    assert (r["body"], r["labels"], r["subject"]) == ("From: A <a+ann@x>\nDate: 2025\n\nhi TECH-1", ["l", "m"], "S")
    c = mail_chunks(thread, names=["a", "bob"]).first()
    assert c["ticket_ids"] == ["TECH-1"] and c["people"] == ["A", "Bob"]
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None)], "vec_id long, embedding array<float>")
    assert [x["vec_id"] for x in retrieve.top_k(vectors, [1.0, 0.0], 3).collect()] == [1, 2]


def test_entry_without_the_optional_package(monkeypatch):
    import importlib
    import sys

    class Missing:
        def find_spec(self, name, path=None, target=None):
            if name.startswith("docloom.llm") or name == "corpus_pipeline":
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    for name in [n for n in sys.modules if n.startswith("docloom.llm") or n in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(sys, "meta_path", [Missing(), *sys.meta_path])
    entry = importlib.import_module("__spark_entry__")
    assert "chunk_recursive" in entry.queries() and not any(n.startswith("op") and "_" in n and n[2].isdigit() for n in entry.queries())
    monkeypatch.delitem(sys.modules, "__spark_entry__")


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
