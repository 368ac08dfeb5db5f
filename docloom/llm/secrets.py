"""Secrets: base patterns, further token shapes, and who owns each candidate across the corpus.

Every candidate is hashed.  For each hash, the distinct repositories and owners
that hold it are counted over all rows: examples and fixtures are copied widely,
a live credential stays with its owner.  Texts are read once; what follows works
on hashes and places alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import materialize, table
from docloom.llm.spans import listed, with_matches

#: Kinds in the order in which equal starts are listed: base ones, then what the method adds.
BASE_KINDS = ("assign", "access", "hex")
ADDED_KINDS = ("service", "signed", "bearer", "pem", "blob")

#: Runs below the least length could be dropped in the pattern where that moves no other match; assign keeps its own filter.
BASE = {
    "assign": r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*+[:=]\x20*+[\"']?([A-Za-z0-9+/_.=-]++)",
    "access": r"AKIA[A-Z0-9]{16,}+",
    "hex": r"(?<![0-9a-f])[0-9a-f]{24,}+",
}
ASSIGN_LENGTH = 6
ADDED = (
    r"(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{30,}+|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}+|xox[abprs]-[A-Za-z0-9-]{10,}+)"
    r"|(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"
    r"|(?<![A-Za-z])(?i:bearer)\x20++[A-Za-z0-9+/_.=-]{20,}+"
    r"|-----BEGIN\x20[A-Z\x20]{0,20}PRIVATE\x20KEY-----"
    r"|(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40,}+={0,2}"
)
_ADDED_KIND = "case when m.match like '-----%' then 'pem' when m.match like 'eyJ%' then 'signed' when lower(m.match) like 'bearer %' then 'bearer' when m.match rlike '^(?:gh[pousr]_|[sr]k_|xox)' then 'service' else 'blob' end"

#: A long run of one case is a hexadecimal digest or an upper-case key at most, which the base patterns have.
_MIXED = "not m.match rlike '^[A-Za-z0-9+/]+=*$' or (m.match rlike '[a-z]' and m.match rlike '[A-Z]' and m.match rlike '[0-9]')"

#: A candidate held by at least so many repositories or owners counts as widely copied.
SHARED_BY = 3
#: A live-looking value has so many different characters, digits and letters, and no word of a placeholder.
DISTINCT_CHARACTERS = 8
_LIVE = f"size(array_distinct(split(v, ''))) >= {DISTINCT_CHARACTERS} and v rlike '[0-9]' and v rlike '[A-Za-z]' and not v rlike '(?i)example|sample|dummy|placeholder|changeme|your_|xxxx'"


def _scan(documents: DataFrame, text_col: str) -> DataFrame:
    """Add ``__cand``: ``(start, ord, kind, end, base, live, hash)`` of every candidate; values stay behind as hashes."""
    df = documents.withColumn("__text", F.coalesce(F.col(text_col), F.lit("")))
    df = with_matches(df, "__text", {f"__{k}": p for k, p in (BASE | {"added": ADDED}).items()}, groups={"__assign": 1})

    def found(column: str, kind: str, order: str, value: str, base: str, where: str = "true") -> str:
        return (
            f"transform(filter({column}, m -> {where}), m -> transform(array({value}), v -> named_struct('start', m.start, 'ord', {order}, 'kind', {kind}, 'end', m.end, "
            f"'base', {base}, 'live', {_LIVE}, 'hash', sha2(v, 256)))[0])"
        )

    kinds = BASE_KINDS + ADDED_KINDS
    order = f"case {_ADDED_KIND} " + " ".join(f"when '{k}' then {kinds.index(k)}" for k in ADDED_KINDS) + " end"
    parts = [found(f"__{k}", f"'{k}'", str(n), "m.group" if k == "assign" else "m.match", "true", f"length(m.group) >= {ASSIGN_LENGTH}" if k == "assign" else "true") for n, k in enumerate(BASE_KINDS)]
    parts.append(found("__added", _ADDED_KIND, order, "m.match", "false", _MIXED))
    return df.withColumn("__cand", F.expr(f"concat({', '.join(parts)})")).drop("__text", "__added", *(f"__{k}" for k in BASE))


def secret_spans(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source", owner_col: str = "source") -> DataFrame:
    """One row for each input row: ``id_col``, ``spans`` and ``base_spans`` with the class of each.

    A span is ``(start, ord, kind, end, base, live, shared, n_repos, n_owners)``
    in code points.  Base spans always stay.  Of the added shapes, those stay
    that look live and that fewer than ``SHARED_BY`` repositories and owners
    hold.  A null text has no spans; a null repository or owner counts as one
    of its own.  Repeated rows are each returned and count their repository
    once; ids may be null or repeated; ties need no rule, as counts decide.
    Other columns are ignored.
    """
    given = documents.select(F.col(id_col), F.col(text_col).alias("__in"), F.coalesce(F.col(repo_col).cast("string"), F.lit("\0")).alias("__repo"), F.coalesce(F.col(owner_col).cast("string"), F.lit("\0")).alias("__owner"))
    rows = _scan(given, "__in").select(F.monotonically_increasing_id().alias("__row"), id_col, "__repo", "__owner", "__cand")
    rows = materialize(rows, "secret-candidates")
    each = rows.where(F.size("__cand") > 0).select("__row", id_col, "__repo", "__owner", F.explode("__cand").alias("c"))
    held = each.select(F.col("c.hash").alias("__hash"), "__repo", "__owner").distinct()
    held = held.groupBy("__hash").agg(F.count_distinct("__repo").alias("n_repos"), F.count_distinct("__owner").alias("n_owners"))
    held = materialize(held, "secret-owners")  # a table of its own, so that Spark can split a hash that very many rows hold
    judged = each.withColumn("__hash", F.col("c.hash")).join(held, "__hash").withColumn("shared", F.expr(f"n_repos >= {SHARED_BY} or n_owners >= {SHARED_BY}"))
    kept = judged.withColumn("__span", F.expr("named_struct('start', c.start, 'ord', c.ord, 'kind', c.kind, 'end', c.end, 'base', c.base, 'live', c.live, 'shared', shared, 'n_repos', n_repos, 'n_owners', n_owners)"))
    kept = kept.withColumn("__keep", F.expr("c.base or (c.live and not shared)"))
    with_any = kept.groupBy("__row", id_col).agg(F.array_sort(F.collect_list(F.when(F.col("__keep"), F.col("__span")))).alias("spans")).select(id_col, "spans")
    empty = F.array().cast(with_any.schema["spans"].dataType)
    without = rows.where(F.size("__cand") == 0).select(id_col, empty.alias("spans"))
    return with_any.unionByName(without).withColumn("base_spans", F.expr("filter(spans, s -> s.base)"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` whole; its sources are both the repositories and their owners."""
    found = secret_spans(table(spark, sf_dir, "documents"))
    count = {f"n_{k}": F.expr(f"cast(size(filter(base_spans, s -> s.kind = '{k}')) as bigint)") for k in BASE_KINDS}
    more = {"n_live": F.expr("cast(size(filter(spans, s -> s.live and not s.shared)) as bigint)"), "n_shared": F.expr("cast(size(filter(spans, s -> s.shared)) as bigint)")}
    return found.select("doc_id", *(v.alias(k) for k, v in count.items()), F.sha2(F.expr(listed("base_spans")), 256).alias("base_sha256"), F.expr(listed("spans")).alias("spans"), *(v.alias(k) for k, v in more.items()))
