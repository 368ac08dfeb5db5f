"""Structural elements as an array of each document: parsing and chunking without a shuffle.

An element is ``struct<type, content, level>``; its place is its index.  All
functions return SQL text over columns, to be used with ``F.expr``.
"""

from __future__ import annotations

from docloom.config import BLANK_RATIO, MAX_SECTION, MIN_BLANKS, MIN_HEADINGS
from docloom.functions.text import ustrip_sql

_EMPTY = "cast(array() as array<string>)"
CHUNK = "array<struct<content: string, section_heading: string, heading_level: int, element_type: string>>"


def bind(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def lines(text: str) -> str:
    """Lines with universal line ends; a line end at the end of the text opens no further line."""
    flat = f"regexp_replace({text}, '\\r\\n?', '\\n')"
    return f"if(coalesce({text}, '') = '', {_EMPTY}, {bind(flat, 'flat_', bind('split(flat_, chr(10), -1)', 'l_', 'if(endswith(flat_, chr(10)), slice(l_, 1, size(l_) - 1), l_)'))})"


def parse_text(text: str, clamp_first: bool = True) -> str:
    """Elements of plain text or markdown: blank, heading (level 1 to 3), paragraph.

    With ``clamp_first`` a heading of more than three hashes keeps the others in
    its text, as existing stores have it; else all of them are taken off.
    """
    level = "greatest(1, least(3, length(regexp_extract(s_, '^#+', 0))))"
    cut = level if clamp_first else "length(regexp_extract(s_, '^#+', 0))"
    element = (
        f"case when s_ = '' then named_struct('type', 'blank', 'content', '', 'level', 0) when startswith(s_, '#') then named_struct('type', 'heading', 'content', "
        f"{ustrip_sql(f'substring(s_, {cut} + 1)')}, 'level', {level}) else named_struct('type', 'paragraph', 'content', s_, 'level', 0) end"
    )
    return f"transform(transform({lines(text)}, x_ -> {ustrip_sql('x_')}), s_ -> {element})"


def detect_text(elements: str) -> str:
    """``struct<strategy, confidence>`` of parsed text."""
    n = "aggregate(e_, named_struct('h', 0, 'b', 0), (a_, x_) -> named_struct('h', a_.h + if(x_.type = 'heading', 1, 0), 'b', a_.b + if(x_.type = 'blank', 1, 0)))"
    case = (
        f"case when n_.h >= {MIN_HEADINGS} then named_struct('strategy', 'heading_based', 'confidence', 'high') when n_.b >= {MIN_BLANKS} and n_.b / size(e_) > {BLANK_RATIO}D "
        "then named_struct('strategy', 'blank_line_based', 'confidence', 'medium') else named_struct('strategy', 'recursive_fallback', 'confidence', 'low') end"
    )
    return bind(elements, "e_", bind(n, "n_", case))


def _pack(units: str, separator: str, inner: str | None, tag: str) -> str:
    """Greedy packing up to MAX_SECTION without overlap; longer units go to ``inner`` (of u) or stay whole."""
    a, u = f"a{tag}_", f"u{tag}_"
    flushed = f"if({a}.cur = '', {a}.out, array_append({a}.out, {a}.cur))"
    whole = f"array({u})" if inner is None else f"if(contains({u}, chr(10)), {inner.format(u=u)}, array({u}))"
    step = (
        f"case when length({u}) > {MAX_SECTION} then named_struct('out', concat({flushed}, {whole}), 'cur', '') when {a}.cur = '' then named_struct('out', {a}.out, 'cur', {u}) "
        f"when length({a}.cur) + length({separator}) + length({u}) <= {MAX_SECTION} then named_struct('out', {a}.out, 'cur', concat({a}.cur, {separator}, {u})) "
        f"else named_struct('out', array_append({a}.out, {a}.cur), 'cur', {u}) end"
    )
    return f"aggregate({units}, named_struct('out', {_EMPTY}, 'cur', ''), ({a}, {u}) -> {step}, {a} -> {flushed})"


def _units(text: str, separator: str, tag: str) -> str:
    v = f"v{tag}_"
    return f"filter(transform(split({text}, {separator}, -1), {v} -> {ustrip_sql(v)}), {v} -> {v} <> '')"


def split_section(body: str) -> str:
    """Parts of at most MAX_SECTION at paragraph, else line ends; what has neither stays whole."""
    nl, two = "chr(10)", "concat(chr(10), chr(10))"
    by_line = _pack(_units("{u}", nl, "i"), nl, None, "i")
    packed = f"if(contains(t_, {two}), {_pack(_units('t_', two, 'o'), two, by_line, 'o')}, {_pack(_units('t_', nl, 'p'), nl, None, 'p')})"
    return bind(ustrip_sql(body), "t_", f"case when t_ = '' then {_EMPTY} when length(t_) <= {MAX_SECTION} then array(t_) else {packed} end")


def heading_chunks(elements: str, split_on: str = "heading") -> str:
    """Chunks of the sections that each element of type ``split_on`` opens, tables of a section after its text and never split."""
    starts = f"concat(array(0), filter(transform(e_, (x_, i_) -> if(x_.type = '{split_on}', i_ + 1, null)), x_ -> x_ is not null))"
    section = "named_struct('heading', if(s_ = 0, '', e_[s_ - 1].content), 'level', if(s_ = 0, 0, e_[s_ - 1].level), 'els', slice(e_, s_ + 1, coalesce(get(b_, k_ + 1), size(e_) + 1) - s_ - 1))"
    body = "array_join(transform(filter(c_.els, x_ -> x_.type not in ('table', 'blank') and x_.content <> ''), x_ -> x_.content), chr(10))"
    full = ustrip_sql("if(c_.heading = '', y_, concat(c_.heading, chr(10), y_))")
    prefixed = f"transform({split_section('y_')}, p_ -> if(c_.heading = '', p_, concat(c_.heading, chr(10), p_)))"
    # a heading too long for a section and nothing below it is still a chunk of its own
    texts = bind(full, "f_", f"case when f_ = '' then {_EMPTY} when length(f_) <= {MAX_SECTION} then array(f_) when {ustrip_sql('y_')} = '' then array(f_) else {prefixed} end")
    text_rows = f"transform({texts}, p_ -> named_struct('content', p_, 'section_heading', c_.heading, 'heading_level', c_.level, 'element_type', cast(null as string)))"
    tables = (
        "transform(filter(c_.els, x_ -> x_.type = 'table'), x_ -> named_struct('content', concat(if(c_.heading = '', '', concat(c_.heading, ' ')), '[TABLE]', chr(10), x_.content), "
        "'section_heading', c_.heading, 'heading_level', cast(null as int), 'element_type', 'table'))"
    )
    sections = bind(starts, "b_", f"transform(b_, (s_, k_) -> {section})")
    return bind(elements, "e_", f"flatten(transform({sections}, c_ -> {bind(body, 'y_', f'concat({text_rows}, {tables})')}))")


def blank_line_chunks(elements: str) -> str:
    """Runs of text between blank lines and tables; a table is a chunk in its place; no limit of size."""
    cuts = "concat(array(0), filter(transform(e_, (x_, i_) -> if(x_.type in ('blank', 'table'), i_ + 1, null)), x_ -> x_ is not null))"
    run = "array_join(transform(filter(slice(e_, s_ + 1, coalesce(get(b_, k_ + 1), size(e_) + 1) - s_ - 1), x_ -> x_.content <> ''), x_ -> x_.content), chr(10))"
    table = "if(s_ > 0 and get(e_, s_ - 1).type = 'table', array(named_struct('content', concat('[TABLE]', chr(10), get(e_, s_ - 1).content), 'element_type', 'table')), array())"
    text = bind(ustrip_sql(run), "r_", "if(r_ = '', array(), array(named_struct('content', r_, 'element_type', cast(null as string))))")
    return bind(elements, "e_", bind(cuts, "b_", f"flatten(transform(b_, (s_, k_) -> concat({table}, {text})))"))
