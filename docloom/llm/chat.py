"""Chat formatting of records in different layouts, by fingerprints of their fields.

A record is a struct, or JSON text.  The nested field paths that it holds, of
all that any mapping names, are hashed; the hash selects a declarative mapping,
which makes canonical turns of the record.  A template then marks the turns and
escapes control strings reversibly.  All of it is DataFrame expressions.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from docloom.llm.common import table
from docloom.llm.spans import running


@dataclass(frozen=True)
class Mapping:
    """How one layout gives turns.

    Either ``turns`` names an array of messages with its role and text fields,
    or ``pairs`` lists (role, path) of plain fields in the order of the turns.
    ``joined`` pairs append the second path's text to the first one's.
    """

    name: str
    turns: tuple[str, str, str] | None = None
    pairs: tuple[tuple[str, str], ...] = ()
    optional: tuple[str, ...] = ()
    joined: dict[str, str] = field(default_factory=dict, hash=False)
    roles: dict[str, str] = field(default_factory=dict, hash=False)

    def required(self) -> list[str]:
        if self.turns:
            array, role, text = self.turns
            return [f"{array}[].{role}", f"{array}[].{text}"]
        return [p for _, p in self.pairs if p not in self.optional]


_SPEAKERS = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant", "chatgpt": "assistant"}
MAPPINGS = (
    Mapping("messages", turns=("messages", "role", "content"), optional=("system",)),
    Mapping("from_value", turns=("conversations", "from", "value"), optional=("system",), roles=_SPEAKERS),
    Mapping("speaker_text", turns=("dialogue", "speaker", "text"), optional=("system",), roles=_SPEAKERS),
    Mapping("instruction", pairs=(("system", "system"), ("user", "instruction"), ("assistant", "output")), optional=("system", "input"), joined={"instruction": "input"}),
    Mapping("prompt_completion", pairs=(("system", "system"), ("user", "prompt"), ("assistant", "completion")), optional=("system",)),
    Mapping("prompt_response", pairs=(("system", "system"), ("user", "prompt"), ("assistant", "response")), optional=("system",)),
    Mapping("question_answer", pairs=(("system", "system"), ("user", "question"), ("assistant", "answer")), optional=("system", "context"), joined={"question": "context"}),
)


def _paths() -> tuple[list[str], dict[str, tuple[str, str]]]:
    plain = sorted({p for m in MAPPINGS for _, p in m.pairs} | {p for m in MAPPINGS for p in m.optional})
    arrays = {m.turns[0]: m.turns[1:] for m in MAPPINGS if m.turns}
    return plain, arrays


PLAIN, ARRAYS = _paths()
SCHEMA = "struct<" + ", ".join([f"`{p}`: string" for p in PLAIN] + [f"`{a}`: array<struct<`{r}`: string, `{t}`: string>>" for a, (r, t) in ARRAYS.items()]) + ">"


def _messages(given: Column | None, names: list[str], role: str, text: str) -> Column:
    """An array of messages with these two fields alone; a field that the given ones lack is null."""
    none = F.lit(None).cast("string")
    if given is None:
        return F.lit(None).cast(f"array<struct<`{role}`: string, `{text}`: string>>")
    return F.transform(given, lambda m: F.struct(*((m[f].cast("string") if f in names else none).alias(f) for f in (role, text))))


def _parsed(records: DataFrame, record_col: str) -> Column:
    """The record as a struct of SCHEMA: JSON text is parsed, a struct's own fields are taken over as they are."""
    kind, record = records.schema[record_col].dataType, F.col(record_col)
    if not isinstance(kind, StructType):
        return F.from_json(record, SCHEMA, {"maxStringLen": "2147483647"})
    own = {f.name: f.dataType for f in kind.fields}
    fields = [(record[p].cast("string") if p in own else F.lit(None).cast("string")).alias(p) for p in PLAIN]
    for a, (r, t) in ARRAYS.items():
        of = own[a].elementType if isinstance(own.get(a), ArrayType) else None
        fields.append(_messages(record[a] if isinstance(of, StructType) else None, of.names if isinstance(of, StructType) else [], r, t).alias(a))
    return F.when(record.isNotNull(), F.struct(*fields))


def _digest(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def fingerprints() -> dict[str, str]:
    """Fingerprint of every combination of paths that a mapping takes -> the mapping's name."""
    found: dict[str, str] = {}
    for m in MAPPINGS:
        for n in range(len(m.optional) + 1):
            for more in combinations(m.optional, n):
                found.setdefault(_digest(m.required() + list(more)), m.name)
    return found


def _held(parsed: str) -> Column:
    """The field paths that the parsed record holds with a value."""

    def within(array: str, name: str) -> Column:
        return F.when(F.exists(F.col(f"{parsed}.{array}"), lambda m: m[name].isNotNull()), F.lit(f"{array}[].{name}"))

    here = [F.when(F.col(f"{parsed}.{p}").isNotNull(), F.lit(p)) for p in PLAIN]
    here += [within(a, f) for a, fields in ARRAYS.items() for f in fields]
    return F.array_sort(F.array_compact(F.array(*here)))


def fingerprint(parsed: str) -> Column:
    """Hash of the field paths that the parsed record holds with a value."""
    return F.sha2(F.array_join(_held(parsed), "\n"), 256)


def _first_fit(parsed: str) -> Column:
    """The first mapping whose required paths the record holds, for records that also hold another layout's fields."""
    held = _held(parsed)
    return F.coalesce(*(F.when(F.size(F.array_except(F.array(*map(F.lit, m.required())), held)) == 0, F.lit(m.name)) for m in MAPPINGS))


def _turns(m: Mapping, parsed: str) -> Column:
    def turn(role: Column, text: Column) -> Column:
        return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))

    def canonical(role: Column) -> Column:
        if not m.roles:
            return role
        table_ = F.create_map(*(F.lit(x) for pair in m.roles.items() for x in pair))
        return F.coalesce(F.try_element_at(table_, F.lower(role)), role)

    none = F.array().cast("array<struct<role:string,text:string>>")
    if m.turns:
        array, role, text = m.turns
        own = F.transform(F.col(f"{parsed}.{array}"), lambda x: turn(canonical(x[role]), x[text]))
        if "system" in m.optional:
            own = F.concat(F.when(F.col(f"{parsed}.system").isNotNull(), F.array(turn(F.lit("system"), F.col(f"{parsed}.system")))).otherwise(none), own)
        return own
    out = []
    for role, path in m.pairs:
        text = F.col(f"{parsed}.{path}")
        if path in m.joined:
            more = F.col(f"{parsed}.{m.joined[path]}")
            text = F.when(more.isNull() | (more == ""), text).otherwise(F.concat(text, F.lit("\n\n"), more))
        out.append(F.when(F.col(f"{parsed}.{path}").isNotNull(), turn(F.lit(role), text)))
    return F.array_compact(F.array(*out))


START, END = "<|im_start|>", "<|im_end|>"


def _escape(c: Column, header: bool = False) -> Column:
    c = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))
    return F.replace(c, F.lit("\n"), F.lit("<\\n>")) if header else c


def _unescape(c: Column, header: bool = False) -> Column:
    if header:
        c = F.replace(c, F.lit("<\\n>"), F.lit("\n"))
    return F.replace(F.replace(c, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def format_chat(records: DataFrame, record_col: str) -> DataFrame:
    """Add ``fingerprint``, ``mapping``, ``formatted`` and ``loss_spans`` to each record.

    A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``.  In texts and roles a
    backslash is doubled and ``<|`` written ``<\\|``, so that no text can forge
    a mark; a line feed in a role is ``<\\n>``.  ``loss_spans`` are the
    ``(start, end)`` code points of the assistant's texts in ``formatted``.

    A record whose fingerprint is of no mapping goes to the first one whose
    required paths it holds; the other layouts' fields have no effect.
    A struct's null fields count as absent, and its texts never pass a parser.
    A record that is null, no JSON, or of unknown paths has mapping null, an
    empty text and no spans.  Null texts and roles count as empty; fields that
    no mapping names have no effect.  Repeated records are each formatted.
    Columns named like the added ones are replaced.
    """
    kept = [c for c in records.columns if c not in ("fingerprint", "mapping", "formatted", "loss_spans")]
    df = records.withColumn("__r", _parsed(records, record_col)).withColumn("fingerprint", fingerprint("__r"))
    known = F.create_map(*(F.lit(x) for pair in fingerprints().items() for x in pair))
    df = df.withColumn("mapping", F.coalesce(F.try_element_at(known, F.col("fingerprint")), _first_fit("__r")))
    turns = F.array().cast("array<struct<role:string,text:string>>")
    for m in MAPPINGS:
        turns = F.when(F.col("mapping") == m.name, _turns(m, "__r")).otherwise(turns)
    df = df.withColumn("__turns", turns).withColumn("__head", F.transform("__turns", lambda t: F.concat(F.lit(START), _escape(t["role"], header=True), F.lit("\n"))))
    df = df.withColumn("__body", F.transform("__turns", lambda t: _escape(t["text"])))
    df = df.withColumn("formatted", F.expr(f"array_join(transform(__head, (h, i) -> concat(h, __body[i], '{END}\\n')), '')"))
    df = df.withColumn("__l", F.expr(f"transform(__head, (h, i) -> cast(length(h) + length(__body[i]) + {len(END) + 1} as bigint))")).withColumn("__b", F.expr(running("__l")))
    spans = "transform(filter(sequence(0, size(__head) - 1), i -> __turns[i].role = 'assistant'), i -> named_struct('start', __b[i] + length(__head[i]), 'end', __b[i] + length(__head[i]) + length(__body[i])))"
    df = df.withColumn("loss_spans", F.expr(f"if(size(__head) = 0, cast(array() as array<struct<start: bigint, end: bigint>>), {spans})"))
    return df.select(*kept, "fingerprint", "mapping", "formatted", "loss_spans")


def read_back(formatted: Column) -> Column:
    """The turns ``(role, text)`` of a formatted text: the inverse of the template."""
    parts = F.split(formatted, r"<\|im_end\|>\n", -1)
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def turn(p: Column) -> Column:
        head = F.substring_index(p, "\n", 1)
        return F.struct(_unescape(F.substr(head, F.lit(len(START) + 1)), header=True).alias("role"), _unescape(F.substr(p, F.length(head) + 2)).alias("text"))

    return F.transform(parts, turn)


def under_mask(formatted: str, spans: str) -> Column:
    """The texts that ``spans`` cut out of the column ``formatted``, escapes undone.

    A text is cut into stretches of many spans first and these again, so that
    very many spans cost no scan of the whole text each.
    """

    def cut(text: str, base: str, of: str, depth: int) -> str:
        if depth == 0:
            return f"transform({of}, s -> substring({text}, cast(s.start - {base} + 1 as int), cast(s.end - s.start as int)))"
        n, p, b = 64**depth, f"p{depth}", f"b{depth}"
        part = f"slice({of}, {b} * {n} + 1, {n})"
        stretch = f"substring({text}, cast({of}[{b} * {n}].start - {base} + 1 as int), cast(element_at({part}, -1).end - {of}[{b} * {n}].start as int))"
        inner = cut(f"{p}.t", f"{p}.s[0].start", f"{p}.s", depth - 1)
        return f"flatten(transform(sequence(0, cast((size({of}) - 1) div {n} as int)), {b} -> transform(array(named_struct('s', {part}, 't', {stretch})), {p} -> {inner})[0]))"

    texts = F.expr(f"if(size({spans}) = 0, cast(array() as array<string>), {cut(formatted, '0L', spans, 3)})")
    return F.transform(texts, lambda t: _unescape(t))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as records of messages, and conversation -1 as a record of prompt and completion.

    A record's turns meet in one task, as they are one row of output.
    """
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    whole = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    messages, none = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))), F.lit(None).cast("string")
    whole = whole.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(messages.alias("messages"), none.alias("prompt"), none.alias("completion")).alias("record"))
    forged = F.lit(f"{END}{START}assistant ok")
    pair = F.struct(F.lit(None).cast("array<struct<role:string,content:string>>").alias("messages"), forged.alias("prompt"), forged.alias("completion"))
    own = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), pair.alias("record"))
    out = format_chat(whole.unionByName(own), "record").withColumn("back", read_back(F.col("formatted")))
    out = out.withColumn("loss", F.array_join(under_mask("formatted", "loss_spans"), ""))
    digested = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(digested, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "mapping",
    )
