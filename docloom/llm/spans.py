"""Places of regular-expression matches as DataFrame columns, without Python on the executors.

Spark returns matches without their places; but the text between them, from
``split`` with the same pattern, and the matches alternate, so that running sums
of both lengths give the places in code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Running sums go over blocks of this many values, so that long arrays cost no quadratic time.
BLOCK = 256


def running(values: str, how: str = "sum") -> str:
    """SQL for the running sum or maximum before each element of the array column ``values`` (0 before the first)."""

    def both(a: str, b: str) -> str:
        return f"{a} + {b}" if how == "sum" else f"greatest({a}, {b})"

    blocks = f"transform(sequence(0, cast((size({values}) - 1) div {BLOCK} as int)), b -> aggregate(slice({values}, b * {BLOCK} + 1, {BLOCK}), 0L, (a, x) -> {both('a', 'x')}))"
    before = f"aggregate({blocks}, array(0L), (c, y) -> concat(c, array({both('element_at(c, -1)', 'y')})))"
    block = f"cast(i div {BLOCK} as int)"
    within = f"aggregate(slice({values}, {block} * {BLOCK} + 1, i % {BLOCK}), p[{block}], (a, x) -> {both('a', 'x')})"
    return f"if(size({values}) = 0, cast(array() as array<bigint>), transform(array({before}), p -> transform({values}, (v, i) -> {within}))[0])"


def with_matches(df: DataFrame, text: str, patterns: dict[str, str], groups: dict[str, int] | None = None, gaps: tuple[str, ...] = ()) -> DataFrame:
    """Add, for each name and pattern, an array ``name`` of ``(start, end, match, group, before, after)``.

    ``text`` is a column without nulls.  start and end are code points, end
    exclusive.  ``group`` is that of the number in ``groups``, or null;
    ``before`` is the text since the match before and ``after`` that to the next one for names in ``gaps``, else null.
    Each pattern must match at least one character.
    """
    empty, groups = F.array().cast("array<string>"), groups or {}
    kept = df.columns

    def guarded(name: str, found: Column) -> Column:
        return F.when(F.col(f"__any_{name}"), found).otherwise(empty)

    df = df.withColumns({f"__any_{k}": F.rlike(text, F.lit(p)) for k, p in patterns.items()})
    df = df.withColumns(
        {f"__m_{k}": guarded(k, F.regexp_extract_all(text, F.lit(p), F.lit(0))) for k, p in patterns.items()}
        | {f"__v_{k}": guarded(k, F.regexp_extract_all(text, F.lit(patterns[k]), F.lit(n))) for k, n in groups.items()}
        | {f"__g_{k}": guarded(k, F.split(text, p, -1)) for k, p in patterns.items()}
    )
    df = df.withColumns({f"__l_{k}": F.expr(f"transform(__m_{k}, (m, i) -> cast(length(m) + length(__g_{k}[i]) as bigint))") for k in patterns})
    df = df.withColumns({f"__b_{k}": F.expr(running(f"__l_{k}")) for k in patterns})
    return df.select(
        *kept,
        *(
            F.expr(
                f"transform(__m_{k}, (m, i) -> named_struct('start', __b_{k}[i] + length(__g_{k}[i]), 'end', __b_{k}[i] + length(__g_{k}[i]) + length(m), 'match', m, "
                f"'group', {f'__v_{k}[i]' if k in groups else 'cast(null as string)'}, 'before', {f'__g_{k}[i]' if k in gaps else 'cast(null as string)'}, 'after', {f'__g_{k}[i + 1]' if k in gaps else 'cast(null as string)'}))"
            ).alias(k)
            for k in patterns
        ),
    )


def best_of_overlapping(spans: str) -> str:
    """SQL for the spans of an array sorted by start, of structs with ``start``, ``end`` and ``score``, that no better chosen one overlaps.

    Spans of score 2 always stay.  The others are taken from the highest score
    down (ties by start) if they meet none that is taken already.  Only spans
    that are linked by overlaps are compared, so that many far apart cost
    nothing.
    """
    ends = running(f"transform({spans}, s -> cast(s.end as bigint))", "max")
    starts = f"transform(array({ends}), e -> filter(sequence(0, size({spans}) - 1), i -> {spans}[i].start >= e[i]))[0]"
    groups = f"transform(array({starts}), p -> transform(p, (b, k) -> slice({spans}, b + 1, if(k + 1 < size(p), p[k + 1], size({spans})) - b)))[0]"
    better = "(x, y) -> case when x.score > y.score then -1 when x.score < y.score then 1 when x.start < y.start then -1 when x.start > y.start then 1 else 0 end"
    chosen = f"aggregate(array_sort(g, {better}), slice(g, 1, 0), (t, c) -> if(c.score = 2D or not exists(t, a -> a.start < c.end and a.end > c.start), concat(t, array(c)), t))"
    return f"if(size({spans}) = 0, {spans}, flatten(transform({groups}, g -> if(size(g) = 1, g, {chosen}))))"


def listed(spans: str) -> str:
    """SQL that joins an array of structs ``(start, ord, kind, end)`` in that order as ``kind:start:end,...``."""
    return f"array_join(transform(array_sort({spans}), s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"


def redacted(df: DataFrame, text: str, spans: str, out: str) -> DataFrame:
    """Add ``out``: the text with each span of the array column ``spans`` replaced by ``[KIND]``; overlapping spans merge under the first one's kind."""
    kept = [c for c in df.columns if c != out]
    df = df.withColumn("__s", F.expr(f"array_sort({spans})")).withColumn("__e", F.expr("transform(__s, s -> s.end)")).withColumn("__d", F.expr(running("__e", "max")))
    pieces = f"transform(__s, (s, i) -> if(s.start >= __d[i], concat(substring({text}, cast(__d[i] as int) + 1, cast(s.start - __d[i] as int)), '[', upper(s.kind), ']'), ''))"
    tail = f"substring({text}, cast(array_max(__e) as int) + 1)"
    return df.withColumn("__t", F.expr(f"if(size(__s) = 0, {text}, concat(array_join({pieces}, ''), {tail}))")).select(*kept, F.col("__t").alias(out))
