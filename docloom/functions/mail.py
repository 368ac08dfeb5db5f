"""Mail: cleaning bodies, addresses, headers, and chunks that repeat their head."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.config import EMAIL_CHUNK, EMAIL_SINGLE
from docloom.functions.elements import bind
from docloom.functions.text import ustrip, ustrip_sql

#: Lines from which on a body is quoted mail; the last alternative looks at the next line too.
QUOTE_START = r"(?m)^(?:On .+ wrote:\s*$|(?i:---\s*Original Message\s*---\s*$)|>|_{5,}|From:[^\n]*\n[^\S\n]*Sent:)"


def strip_tags(c: Column | str) -> Column:
    """HTML without styles, scripts, tags and numeric entities; the four entities that mail bodies use are decoded in a fixed order."""
    c = F.regexp_replace(c, r"(?is)<style[^>]*>.*?</style>", "")
    c = F.regexp_replace(c, r"(?is)<script[^>]*>.*?</script>", "")
    c = F.regexp_replace(F.regexp_replace(c, "<[^>]+>", ""), r"&#\d+;", "")
    for entity, text in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        c = F.replace(c, F.lit(entity), F.lit(text))
    return c


def cut_quoted(c: Column | str) -> Column:
    """The text before the first line that opens quoted mail."""
    col = F.col(c) if isinstance(c, str) else c
    at = F.regexp_instr(col, F.lit(QUOTE_START))
    return F.when(at > 0, F.substr(col, F.lit(1), at - 1)).otherwise(col)


def clean_body(c: Column | str, is_html: bool = False) -> Column:
    c = F.replace(F.col(c) if isinstance(c, str) else c, F.lit("\r\n"), F.lit("\n"))
    c = cut_quoted(strip_tags(c) if is_html else c)
    return ustrip(F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), " {2,}", " "))


def email_chunks(body: str, sender: str, subject: str, date: str) -> Column:
    """Chunks of a cleaned body, each under its From / Subject / Date line: one if short, else paragraphs packed to the limit."""
    prefix = f"concat('From: ', coalesce({sender}, ''), ' | Subject: ', coalesce({subject}, ''), ' | Date: ', coalesce({date}, ''), chr(10), chr(10))"
    two = "concat(chr(10), chr(10))"
    cand = f"if(endswith(a_.cur, {two}), concat(a_.cur, q_), concat(a_.cur, {two}, q_))"
    kept = f"if({ustrip_sql('a_.cur')} <> {ustrip_sql('p_')}, array_append(a_.out, {ustrip_sql('a_.cur')}), a_.out)"
    step = f"transform(array({cand}), c_ -> if(length(c_) > {EMAIL_CHUNK}, named_struct('out', {kept}, 'cur', concat(p_, q_)), named_struct('out', a_.out, 'cur', c_)))[0]"
    start = "named_struct('out', cast(array() as array<string>), 'cur', p_)"
    packed = f"aggregate(filter(split(coalesce({body}, ''), {two}, -1), q_ -> q_ <> ''), {start}, (a_, q_) -> {step}, a_ -> {kept})"
    whole = f"concat(p_, coalesce({body}, ''))"
    many = bind(packed, "m_", f"if(size(m_) = 0, array({ustrip_sql(whole)}), m_)")
    return F.expr(bind(prefix, "p_", f"if(length({whole}) <= {EMAIL_SINGLE}, array({ustrip_sql(whole)}), {many})"))


def header(headers: Column | str, name: str) -> Column:
    """Value of the first header of that name in any case, else empty."""
    return F.coalesce(F.get(F.filter(headers, lambda h: F.lower(h["name"]) == name.lower()), F.lit(0))["value"], F.lit(""))


def addresses(c: Column | str) -> Column:
    return F.filter(F.transform(F.split(c, ","), ustrip), lambda a: a != "")


def decode_base64url(c: Column | str) -> Column:
    """Text of a base64url part, padded or not; line breaks within are allowed."""
    col = F.rtrim(F.translate(c, "-_\r\n", "+/"), F.lit("="))
    return F.decode(F.unbase64(F.concat(col, F.repeat(F.lit("="), F.pmod(-F.length(col), F.lit(4))))), "UTF-8")


def iso_date(date: Column | str, internal_ms: Column | None = None) -> Column:
    """RFC 2822 date as ISO 8601; else the date as it stands; where there is none, the internal milliseconds in UTC."""
    col = F.col(date) if isinstance(date, str) else date
    bare = F.regexp_replace(F.regexp_replace(ustrip(col), r"^[A-Za-z]{3},\s*", ""), r"\s*\([^)]*\)$", "")
    zone = F.regexp_replace(bare, r"\s(?:GMT|UTC|UT)$", " +0000")
    at = F.coalesce(*(F.try_to_timestamp(zone, F.lit(p)) for p in ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z")))
    shift = F.regexp_extract(zone, r"([+-]\d{4})$", 1)
    minutes = (F.substr(shift, F.lit(2), F.lit(2)).try_cast("int") * 60 + F.substr(shift, F.lit(4), F.lit(2)).try_cast("int")) * F.when(F.startswith(shift, F.lit("-")), -1).otherwise(1)
    local = F.timestamp_seconds(F.unix_timestamp(at) + minutes * 60)
    iso = F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), F.substr(shift, F.lit(1), F.lit(3)), F.lit(":"), F.substr(shift, F.lit(4), F.lit(2)))
    fallback = F.lit(None).cast("string") if internal_ms is None else F.concat(F.date_format(F.timestamp_millis(internal_ms), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
    return F.coalesce(F.when(at.isNotNull(), iso), F.nullif(col, F.lit("")), fallback, F.lit(""))
