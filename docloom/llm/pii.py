"""Personal data: base patterns, and candidate spans chosen by boosted trees.

Base patterns always give spans.  Besides, generators with a high recall
propose further spans (separated or disguised writings of the same kinds);
boosted trees score them by their format and by the words around them, and a
threshold for each kind, calibrated on sentences of other templates than those
of the fit, selects.  Trees are fitted on the driver from a bounded set of
invented sentences and applied as SQL, so that the executors run no Python.
"""

from __future__ import annotations

import json
import random

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.boosting import BoostedTrees
from docloom.llm.common import table
from docloom.llm.spans import best_of_overlapping, listed, redacted, with_matches

KINDS = ("email", "ip", "card", "phone")

#: A match of the e-mail pattern starts where a run of local characters does, or where the match before ended;
#: possessive quantifiers change no match here and keep long texts linear.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_DIGITS = "regexp_replace({0}, '[^0-9]', '')"
_LUHN = (
    "aggregate(sequence(1, length({0})), 0, (a, k) -> a + if(k % 2 = 1, cast(substring({0}, -k, 1) as int), "
    "cast(substring({0}, -k, 1) as int) * 2 - if(cast(substring({0}, -k, 1) as int) > 4, 9, 0))) % 10 = 0"
)


def _luhn(digits: str) -> str:
    return f"if(length({digits}) = 0, false, {_LUHN.format(digits)})"


#: What a match must meet; m is the struct of with_matches.
PASSES = {
    "email": "true",
    "ip": rf"m.match rlike r'^{_OCTET}(?:\.{_OCTET}){{3}}$'",
    "card": f"length({_DIGITS.format('m.match')}) between 12 and 19 and {_luhn(_DIGITS.format('m.match'))}",
    "phone": f"length({_DIGITS.format('m.match')}) between 9 and 15",
}

#: Generators: name -> (kind, pattern).  They propose much that is no personal data.
GENERATORS = {
    "g_mail": ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:@|\(at\)|\[at\]|\{at\}|\x20at\x20)\x20?[A-Za-z0-9-]{1,63}+(?:(?:\.|\x20?(?:\(dot\)|\[dot\]|\{dot\}|\x20dot\x20)\x20?)[A-Za-z0-9-]{2,63}+){1,4}"),
    "g_ip": ("ip", r"(?<![0-9.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\x20\.\x20|\x20dot\x20)[0-9]{1,3}){3}(?![0-9])"),
    "g_ip6": ("ip", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    "g_card": ("card", r"(?<![0-9A-Za-z])[0-9]{4}(?:[\x20._/-]{1,3}[0-9]{4}){3}(?![0-9A-Za-z])"),
    "g_phone": ("phone", r"(?<![0-9A-Za-z+.])(?:\(?[0-9]{2,5}\)?[\x20./-]{1,2}){1,4}[0-9]{3,8}(?![0-9A-Za-z])"),
}

_WORDS = {
    "near_phone": r"(?i)\b(?:tel|phone|call|fax|mobile|cell|whatsapp|ring|dial|number|hotline|sms)\b",
    "near_mail": r"(?i)\b(?:e-?mail|mail|mailbox|inbox|write|contact|reach|address)\b",
    "near_card": r"(?i)\b(?:card|visa|credit|debit|cc|payment|charged?|mastercard|amex)\b",
    "near_ip": r"(?i)\b(?:ip|host|server|login|client|ping|from|gateway|node|address)\b",
    "near_other": r"(?i)(?:\b(?:version|order|invoice|isbn|page|pages|figure|table|date|dated|section|ref|part|serial|item|row|score|between|price|total|step|id|tracking|sku|lot|model|chapter|ratio|catalogue|batch|build)\b|[#$€£])",
}
_C = "c.match"
#: Words beside a candidate that are looked at: so many characters before and after it.
_CONTEXT, _AFTER = "right(c.before, 32)", "left(c.after, 24)"
FEATURES = {
    "kind_no": None,
    "length": f"length({_C})",
    "digits": f"length({_DIGITS.format(_C)})",
    "letters": f"length(regexp_replace({_C}, '[^A-Za-z]', ''))",
    "groups": f"size(split({_C}, '[^0-9A-Za-z]+', -1))",
    "luhn": f"cast({_luhn(_DIGITS.format(_C))} as int)",
    "octets": rf"cast({_C} rlike r'^{_OCTET}(?:[^0-9]+{_OCTET}){{3}}$' as int)",
    "brackets": rf"cast({_C} rlike r'[()\[\]{{}}]' as int)",
    "spelled": rf"cast({_C} rlike r'(?i)(?:\(at\)|\[at\]|\{{at\}}|\bat\b)' as int) + cast({_C} rlike r'(?i)(?:\(dot\)|\[dot\]|\{{dot\}}|\bdot\b)' as int)",
    "hexes": rf"cast({_C} rlike r'^(?:[0-9A-Fa-f]{{1,4}}:){{7}}' as int)",
    "date": rf"cast({_C} rlike r'^(?:(?:19|20)[0-9]{{2}}[./-][01]?[0-9][./-][0-3]?[0-9]|[0-3]?[0-9][./-][0-3]?[0-9][./-](?:19|20)[0-9]{{2}})' as int)",
    "first": rf"length(regexp_extract({_C}, r'[0-9]+', 0))",
    "last": rf"length(regexp_extract({_C}, r'([0-9]+)[^0-9]*$', 1))",
    "zero": rf"cast({_C} rlike r'^\(?0' as int)",
} | {k: f"cast({_CONTEXT} rlike r'{v}' as int)" for k, v in _WORDS.items()}
FEATURES |= {f"after_{k}": f"cast({_AFTER} rlike r'{v}' as int)" for k, v in _WORDS.items()}

#: Rows of the fit, and of the calibration, fixed whatever the corpus.
FIT_ROWS, CALIBRATION_ROWS = 3000, 3000
#: Share of right spans that a threshold must reach on the calibration rows.
PRECISION = 0.98
_fitted: dict[int, tuple[BoostedTrees, dict[str, float]]] = {}


def _invented(rows: int, seed: int, other: bool = False) -> list[dict]:
    """Sentences with one thing that a generator proposes, and whether it is personal data; ``other`` takes the calibration's templates."""
    r = random.Random(seed)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 8)))
    filler = lambda: " ".join(word() for _ in range(r.randint(2, 5)))

    def luhn(ok: bool) -> str:
        body = r.choice("3456") + digits(14)
        total = sum(int(x) if k % 2 else (int(x) * 2 - 9 * (int(x) > 4)) for k, x in enumerate(reversed(body)))
        check = (10 - total % 10) % 10
        number = body + str(check if ok else (check + r.randint(1, 9)) % 10)
        return r.choice([".", "_", "/", " - ", "--"]).join(number[k : k + 4] for k in range(0, 16, 4))

    def told(about: str, thing: str, label: int, cues: list[str]) -> tuple[str, int]:
        """The cue stands before the thing, after it, or not at all."""
        cue, k = r.choice(cues), r.random()
        if other:  # the calibration's sentences: other cues, more of them behind, some lacking, some of another kind's
            cue = r.choice(_OTHER_CUES[about, label]) if k < 0.9 else r.choice(sum(_OTHER_CUES.values(), []))
            k = r.random()
            return (f"{cue.capitalize()} {word()}: {thing}" if k < 0.3 else f"{cue} {thing}" if k < 0.6 else f"{thing} ({cue})" if k < 0.85 else f"{filler()} {thing}"), label
        return (f"{cue} {thing}" if k < 0.6 else f"{thing}, {cue}" if k < 0.75 else f"{filler()} {thing}"), label

    def one() -> tuple[str, int]:
        k = r.randrange(16)
        at, dot = r.choice([("(at)", "(dot)"), ("[at]", "[dot]"), ("{at}", "{dot}"), (" at ", " dot "), (" @ ", "."), ("(at)", ".")])
        octets = [str(r.randint(0, 255)) for _ in range(4)]
        if k < 3:
            return told("email", f"{word()}.{word()}{at}{word()}{dot}{r.choice(['com', 'org', 'net', 'de', 'fr'])}", 1, ["mail", "contact", "write to", "reach me:", "e-mail", "my address"])
        if k < 5:
            return f"{filler()} {word()} at {word()}.{word()}", 0
        if k == 5:
            return told("ip", r.choice(["[.]", "(.)", " dot ", " . "]).join(octets), 1, ["host", "server", "ip", "login from"])
        if k == 6:
            return told("ip", ":".join(format(r.randint(0, 65535), "x") for _ in range(8)), 1, ["ip", "host", "client"])
        if k == 7:
            return told("ip", " . ".join(digits(r.randint(1, 3)) for _ in range(4)), 0, ["score", "row", "step", "figure"])
        if k == 8:
            return told("card", luhn(True), 1, ["card", "visa", "credit card", "payment with"])
        if k == 9:
            return told("card", luhn(False), 0, ["order", "serial", "part", "ref"])
        if k in (10, 11):
            number = r.choice([f"({digits(3)}) {digits(3)}-{digits(4)}", f"0{digits(3)} {digits(6)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"0{digits(2)}/{digits(7)}", f"0{digits(1)}.{digits(2)}.{digits(2)}.{digits(2)}.{digits(3)}"])
            return told("phone", number, 1, ["call", "tel", "phone:", "my mobile is", "fax", "dial"])
        if k == 12:
            return told("phone", f"{r.choice(['19', '20'])}{digits(2)}-{r.randint(10, 12)}-{r.randint(10, 28)}-{digits(4)}", 0, ["dated", "date", "section"])
        if k == 13:
            return told("phone", f"{digits(3)}-{digits(r.randint(2, 5))}-{digits(r.randint(3, 6))}", 0, ["order", "invoice", "isbn", "ref", "item", "id", "total", "version"])
        if k == 14:
            return f"{filler()} {digits(r.randint(2, 5))} {digits(r.randint(2, 5))} {digits(r.randint(3, 8))}", 0
        return told("phone", f"{digits(3)}-{digits(r.randint(3, 4))}", 0, ["pages", "between", "price"])

    out = []
    for k in range(rows):
        text, label = one()
        out.append({"k": k, "text": f"{filler()} {text} {filler()}", "label": label})
    return out


#: Cues of the sentences that calibrate the thresholds, by kind and by whether the thing is personal data.
_OTHER_CUES = {
    ("email", 1): ["inbox", "mailbox", "please answer to"], ("ip", 1): ["gateway", "ping", "node", "seen at"], ("ip", 0): ["table", "chapter", "ratio"],
    ("card", 1): ["mastercard", "charged to", "debit"], ("card", 0): ["tracking", "batch", "invoice"], ("phone", 1): ["ring", "hotline", "whatsapp", "number", "sms to"],
    ("phone", 0): ["sku", "lot", "model", "catalogue", "build", "page"],
}


def _candidates(df: DataFrame, text: str) -> DataFrame:
    """Add ``__cand``: what the generators propose, with features."""
    df = with_matches(df, text, {g: p for g, (_, p) in GENERATORS.items()}, gaps=tuple(GENERATORS))
    for g, (kind, _) in GENERATORS.items():
        fields = ", ".join(f"'{f}', cast({KINDS.index(kind) if v is None else v} as double)" for f, v in FEATURES.items())
        df = df.withColumn(g, F.expr(f"transform({g}, c -> named_struct('start', c.start, 'end', c.end, 'kind', '{kind}', {fields}))"))
    return df.withColumn("__cand", F.concat(*GENERATORS)).drop(*GENERATORS)


def fitted(spark: SparkSession, seed: int = 11) -> tuple[BoostedTrees, dict[str, float]]:
    """Trees, and each kind's threshold: the least one whose selection on the calibration rows is right often enough."""
    if seed not in _fitted:
        rows = _invented(FIT_ROWS, seed) + [r | {"k": r["k"] + FIT_ROWS} for r in _invented(CALIBRATION_ROWS, seed + 1, other=True)]
        given = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), "array<struct<k int, text string, label int>>")).alias("r")).select("r.*")
        got = _candidates(given, "text").select("k", "label", F.explode("__cand").alias("c")).select("k", "label", "c.kind", *(F.col(f"c.{f}").alias(f"f_{f}") for f in FEATURES)).orderBy("k", "kind", "f_length").collect()
        x = np.array([[g[f"f_{f}"] for f in FEATURES] for g in got])
        y, k = np.array([g["label"] for g in got], float), np.array([g["k"] for g in got])
        model = BoostedTrees().fit(x[k < FIT_ROWS], y[k < FIT_ROWS])
        p, own, right = model.predict(x[k >= FIT_ROWS]), x[k >= FIT_ROWS, 0], y[k >= FIT_ROWS]
        _fitted[seed] = model, {kind: threshold(p[own == n], right[own == n]) for n, kind in enumerate(KINDS)}
    return _fitted[seed]


def threshold(scores: np.ndarray, right: np.ndarray) -> float:
    """The least score from which PRECISION of the rows are right; above every score where there is none."""
    order = np.argsort(-scores, kind="stable")
    share = np.cumsum(right[order]) / (np.arange(len(order)) + 1)
    last = np.append(scores[order][1:] < scores[order][:-1], True)[: len(order)]  # of equal scores all are taken, or none
    good = np.flatnonzero((share >= PRECISION) & last)
    return float(scores[order][good[-1]]) if len(good) else 1.1


def pii_spans(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``base_spans`` and ``spans``: arrays of ``(start, ord, kind, end)`` in code points, ``spans`` with the selected candidates too.

    Each row is handled alone, so repeated rows, ties and null ids need no
    rule.  A null text counts as empty and has no spans.  Selected candidates
    are taken from the highest score down (ties by start), and one that
    overlaps a base span or a candidate taken before is left out.  Columns named like the added ones are replaced.
    """
    model, limits = fitted(documents.sparkSession)
    df = documents.drop("base_spans", "spans", *KINDS).withColumn("__text", F.coalesce(F.col(text_col), F.lit("")))
    df = with_matches(df, "__text", {f"__base_{k}": p for k, p in BASE.items()})
    df = df.withColumn(
        "base_spans",
        F.array_sort(F.concat(*(F.expr(f"transform(filter(__base_{k}, m -> {PASSES[k]}), m -> named_struct('start', m.start, 'ord', {n}, 'kind', '{k}', 'end', m.end))") for n, k in enumerate(KINDS)))),
    ).drop(*(f"__base_{k}" for k in KINDS))
    df = _candidates(df, "__text")
    score = model.sql([f"c.{f}" for f in FEATURES])
    order = "case c.kind " + " ".join(f"when '{k}' then {n}" for n, k in enumerate(KINDS)) + " end"
    limit = "case c.kind " + " ".join(f"when '{k}' then {limits[k]!r}D" for k in KINDS) + " end"
    df = df.withColumn("__scored", F.expr(f"filter(transform(__cand, c -> named_struct('start', c.start, 'ord', {order}, 'kind', c.kind, 'end', c.end, 'score', {score}, 'limit', {limit})), c -> c.score >= c.limit)"))
    df = df.withColumn("__all", F.expr("array_sort(concat(transform(base_spans, s -> named_struct('start', s.start, 'ord', s.ord, 'kind', s.kind, 'end', s.end, 'score', 2D, 'limit', 0D)), __scored))"))
    chosen = f"array_sort(transform({best_of_overlapping('__all')}, s -> named_struct('start', s.start, 'ord', s.ord, 'kind', s.kind, 'end', s.end)))"
    df = df.withColumn("spans", F.when(F.size("__scored") == 0, F.col("base_spans")).otherwise(F.expr(chosen)))
    return df.drop("__cand", "__scored", "__all")


def redact_pii(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns, each span of the text replaced by its kind in brackets; a null text stays null."""
    df = redacted(pii_spans(documents, text_col), "__text", "spans", "__redacted")
    return df.withColumn(text_col, F.when(F.col(text_col).isNotNull(), F.col("__redacted"))).select(*documents.columns)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = {f"n_{k}": F.expr(f"cast(size(filter(base_spans, s -> s.kind = '{k}')) as bigint)") for k in KINDS}
    return found.select("doc_id", *(v.alias(k) for k, v in count.items()), F.sha2(F.expr(listed("base_spans")), 256).alias("base_sha256"), F.expr(listed("spans")).alias("spans"))
