"""Near-duplicate documents: circulant MinHash, banding, exact Jaccard verification.

Equal shingle sets collapse to one class first.  Signatures come from two
permutations, one of them circularly shifted for each coordinate.  Bands of
coordinates propose candidates in three rounds: each document against the first
members of the few buckets that it shares most often; then, where a bucket still
spans several components, each member against the one most alike in another; and
last, where it does so yet, all pairs between them.  What is known of a bucket
(size, first member, components) is aggregated before the shuffle and joined to
its members; a large bucket is cut into blocks, and pairs of blocks meet.
Signatures drop clear misses; all other candidates are confirmed on full sets,
those of the last round block by block, and no pair that an earlier round
confirmed or refused is asked again.  So no task holds a bucket, and no step has
a row for each pair of a large group.  Signatures and full sets are kept only
until the step that needs them is written.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from contextlib import ExitStack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.bitmap import Bitmap
from docloom.llm.common import for_lookup, materialize, small_batches, table, temporary
from docloom.llm.components import connected_components
from docloom.llm.vectortext import CirculantMinHash, mix, shingle_sets

#: A pair at similarity 0.75 shares no bucket with probability (1 - 0.75**ROWS)**BANDS = 5e-6.
BANDS, ROWS = 45, 5
WIDTH = 5
#: Links have 100 * intersection >= SIMILARITY * union.
SIMILARITY = 75
#: Share of equal coordinates from which a candidate is confirmed on full sets; 0.75 is five deviations above.
PLAUSIBLE = 0.6
#: Buckets' first members that the first round tries for each document; the later rounds try all others that matter.
NEAREST = 3
_SKETCH = "doc_id long, n int, digest binary, bands array<long>, sketch binary"


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = CirculantMinHash(BANDS * ROWS)
    number = np.arange(BANDS, dtype=np.uint64)
    base = np.uint64(0x9E3779B97F4A7C15)
    for batch in batches:
        n, digests, bands, sketches = [], [], [], []
        for shingles in shingle_sets(batch.column("text"), WIDTH):
            n.append(len(shingles))
            if not len(shingles):
                digests.append(None), bands.append([]), sketches.append(None)
                continue
            values = hasher.signature(shingles)
            key = mix(number)
            for row in values.reshape(BANDS, ROWS).astype(np.uint64).T:
                key = mix(key * base + row)
            digests.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())
            bands.append(key.view(np.int64))
            sketches.append(values.astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int32()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], ["doc_id", "n", "digest", "bands", "sketch"]
        )


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sketches agree often enough."""
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BANDS * ROWS) for c in ("sa", "sb"))
        keep = pa.array((a == b).mean(axis=1) >= PLAUSIBLE)
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])


#: Ids of a block, and documents that meet one block in one task, when pairs are confirmed in the last round.
BLOCK_IDS = 256
#: Members of a bucket's block: two blocks meet in one task.
BUCKET_BLOCK = 384
#: Candidates up to which a document's are confirmed pair by pair in the last round.
FEW = 8
_OPEN = "a long, block int, bs array<long>, comps array<long>"


class _Group:
    """Two blocks of a bucket (sides 0 and 1), or one (side 0 alone) whose members all meet."""

    def __init__(self, key: int, cid: np.ndarray, comp: np.ndarray, n: np.ndarray, side: np.ndarray, bands: np.ndarray, sketch: np.ndarray) -> None:
        self.two_sides = bool(side.any())
        common, counts = np.unique(comp, return_counts=True)
        last = side == 1 if self.two_sides else comp == common[counts.argmax()]  # two of these never have to meet
        order = np.lexsort((cid, last))
        self.ids, self.comp, self.n, self.bands, self.sketch = cid[order], comp[order], n[order].astype(np.int64), bands[order], sketch[order]
        self.asking = len(cid) - int(last.sum())
        self.band = int((self.bands == key).any(axis=0).argmax())  # a repeated id may come with another text's bands

    def plausible(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each member: those it meets that lie in another component and may be alike, and the shares of equal coordinates.

        Two documents that share several buckets meet in the first of them alone.
        """
        for k in range(self.asking):
            at = self.asking if self.two_sides else k + 1
            n = self.n[at:]
            near = np.flatnonzero((self.comp[at:] != self.comp[k]) & (100 * np.minimum(n, self.n[k]) >= SIMILARITY * np.maximum(n, self.n[k]))) + at
            if len(near):
                near = near[(self.bands[near] == self.bands[k]).argmax(axis=1) == self.band]
            if len(near):
                alike = (self.sketch[near] == self.sketch[k]).mean(axis=1)
                keep = alike >= PLAUSIBLE
                if keep.any():
                    yield k, near[keep], alike[keep]


def _by_group(handle: Callable[[Iterator[_Group]], pa.RecordBatch]):
    """Apply ``handle`` to the whole groups among rows sorted by ``key`` and ``gid``."""

    def groups(rows: pa.Table) -> Iterator[_Group]:
        key, gid = rows.column("key").to_numpy(), rows.column("gid").to_numpy()
        columns = [rows.column(c).to_numpy() for c in ("cid", "comp", "n", "side")]
        columns.append(rows.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS))
        columns.append(np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(-1, BANDS * ROWS))
        edges = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (gid[1:] != gid[:-1]), [True]]))
        for s, e in zip(edges[:-1], edges[1:], strict=True):
            yield _Group(int(key[s]), *(c[s:e] for c in columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the group that may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            key, gid = batch.column("key").to_numpy(), batch.column("gid").to_numpy()
            if held and (held[-1].column("key")[0].as_py(), held[-1].column("gid")[0].as_py()) != (int(key[0]), int(gid[0])):
                yield handle(groups(pa.Table.from_batches(held)))
                held = []
            last = int(np.argmax((key == key[-1]) & (gid == gid[-1])))
            if last:
                yield handle(groups(pa.Table.from_batches([*held, batch.slice(0, last)])))
                held = []
            held.append(batch.slice(last))
        if held:
            yield handle(groups(pa.Table.from_batches(held)))

    return run


def _most_alike(groups: Iterator[_Group]) -> pa.RecordBatch:
    """For each member that has any plausible partner: the most alike of them, and how alike."""
    out = []
    for g in groups:
        best, of = np.zeros(len(g.ids)), np.zeros(len(g.ids), np.int64)
        for k, near, alike in g.plausible():
            top = int(np.argmax(alike))
            if alike[top] > best[k]:
                best[k], of[k] = alike[top], g.ids[near[top]]
            if not g.two_sides:
                more = alike > best[near]
                best[near[more]], of[near[more]] = alike[more], g.ids[k]
        out += [(int(g.ids[k]), int(of[k]), float(best[k])) for k in np.flatnonzero(best)]
    return pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], kind) for c, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["x", "y", "alike"])


def _crossing(blocks: int):
    """For each member the plausible partners, a row for each block of theirs."""

    def handle(groups: Iterator[_Group]) -> pa.RecordBatch:
        out = []
        for g in groups:
            for k, near, _ in g.plausible():
                at = g.ids[near] % blocks
                out += [(int(g.ids[k]), int(block), g.ids[near[at == block]], g.comp[near[at == block]]) for block in np.unique(at)]
        kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], kind) for c, kind in enumerate(kinds)], ["a", "block", "bs", "comps"])

    return handle


def _block_pairs(members: DataFrame) -> DataFrame:
    """``(key, gid, side, cid, n, comp, bands, sketch)``: the members of open buckets, once for each pair of blocks that they meet in, sorted by that.

    Two members of a bucket's largest component never need to meet, so that
    only the others meet all blocks.  A bucket of one block is one group.
    """
    sizes = members.groupBy("key", "comp").agg(F.count("*").alias("c"))
    buckets = sizes.groupBy("key").agg(F.max_by("comp", F.struct("c", "comp")).alias("most"), F.max("c").alias("n_most"), F.sum("c").alias("n_all"))
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / F.lit(BUCKET_BLOCK))).cast("int")
    buckets = buckets.select("key", "most", (F.col("n_all") <= BUCKET_BLOCK).alias("small"), blocks(F.col("n_most")).alias("nm"), blocks(F.col("n_all") - F.col("n_most")).alias("no"))
    dealt = members.join(materialize(buckets, "open-buckets"), "key")
    dealt = dealt.withColumn("i", F.pmod(F.xxhash64("cid"), F.when(F.col("comp") == F.col("most"), F.col("nm")).otherwise(F.col("no"))).cast("int"))
    with_most = "transform(sequence(0, {n} - 1), j -> named_struct('gid', 1L + no * no + {at}, 'side', {side}))"
    meets_most = with_most.format(n="nm", at="i * nm + j", side="0")
    met_by_others = with_most.format(n="no", at="j * nm + i", side="1")
    among = "transform(sequence(0, no - 1), j -> named_struct('gid', 1L + least(i, j) * no + greatest(i, j), 'side', if(j < i, 1, 0)))"
    groups = f"case when small then array(named_struct('gid', 0L, 'side', 0)) when comp = most then {met_by_others} else concat({among}, {meets_most}) end"
    return dealt.withColumn("g", F.explode(F.expr(groups))).select("key", F.col("g.gid").alias("gid"), F.col("g.side").alias("side"), "cid", "n", "comp", "bands", "sketch").repartition("key", "gid").sortWithinPartitions("key", "gid")


def _confirm_blocks(sets: pa.Table, asked: pa.Table) -> pa.Table:
    """For each asking document one link to each other component that has any, from the block's full sets."""
    of = {i: np.frombuffer(x.as_py(), np.uint64) for i, x in zip(sets["id"].to_pylist(), sets["shingles"], strict=True)}
    left, right = [], []
    for a, x, bs, comps in zip(asked["a"].to_pylist(), asked["xa"], asked["bs"].to_pylist(), asked["comps"].to_pylist(), strict=True):
        own = np.frombuffer(x.as_py(), np.uint64)
        there = [(b, c, of[b]) for b, c in zip(bs, comps, strict=True) if b in of]
        if not there or not len(own):
            continue
        n = np.array([len(t[2]) for t in there])
        flat = np.concatenate([t[2] for t in there])
        hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
        both = np.add.reduceat(hit, np.concatenate([[0], np.cumsum(n)[:-1]]))
        linked = {there[k][1]: there[k][0] for k in np.flatnonzero(100 * both >= SIMILARITY * (n + len(own) - both))}
        left += [a] * len(linked)
        right += linked.values()
    return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links among candidate pairs, on their full sets."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("xa"), batch.column("xb"), strict=True):
            a, b = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            both = len(a) + len(b) - len(np.union1d(a, b))
            keep.append(100 * both >= SIMILARITY * (len(a) + len(b) - both))
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])


def _sets_of(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """``(id, shingles)`` of the documents whose id may be in ``ids``: the texts are read again, and no set of any other is made."""
    bits = Bitmap.bits_for(ids.count())
    known = Bitmap(ids.select(Bitmap.place("id", bits).alias("place")), bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask = pa.array(known.may_hold(batch.column("place").to_numpy()))
            sets = shingle_sets(batch.column("text").filter(mask), WIDTH)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").filter(mask), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "shingles"])

    given = documents.select(Bitmap.place("doc_id", bits).alias("place"), "doc_id", "text").where("doc_id is not null")
    return given.mapInArrow(run, "id long, shingles binary")


def _alike_only(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` whose sketches agree often enough."""
    return pairs.join(sketches.toDF("a", "sa"), "a").join(sketches.toDF("b", "sb"), "b").select("a", "b", "sa", "sb").mapInArrow(_alike, "a long, b long")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    whole = pairs.join(sets.toDF("a", "xa"), "a").join(sets.toDF("b", "xb"), "b").select("a", "b", "xa", "xb")
    return whole.mapInArrow(_confirm, "a long, b long")


def _links(documents: DataFrame, pairs: DataFrame, tested: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Confirmed links among the candidate pairs ``(a, b)``, a < b, that are not ``tested`` yet, and these pairs."""
    pairs = pairs.distinct()
    if tested is not None:
        pairs = pairs.join(tested, ["a", "b"], "left_anti")
    pairs = materialize(pairs, "candidate-pairs")
    if pairs.isEmpty():
        return pairs, pairs
    with temporary(_sets_of(documents, _ends(pairs)), "shingle-sets") as sets:
        return materialize(_confirmed(pairs, sets).distinct(), "links"), pairs


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()


def _ordered(x: str, y: str) -> tuple[Column, Column]:
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def _likeliest_links(documents: DataFrame, members: DataFrame, tested: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links of each document in an open bucket to the one most alike in another component, and the pairs asked."""
    tried = _block_pairs(members).mapInArrow(_by_group(_most_alike), "x long, y long, alike double")
    pairs = tried.groupBy("x").agg(F.max_by("y", F.struct("alike", -F.col("y"))).alias("y"))
    return _links(documents, pairs.select(*_ordered("x", "y")), tested)


def _links_between(documents: DataFrame, members: DataFrame, tested: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links between the components that meet in a bucket: at least one for each two that any pair of the bucket links.

    A document with few candidates is confirmed pair by pair, but for pairs
    already tested.  One with many lies in a dense group: its set goes once to
    each block of ids that holds a candidate of it, however many those are, and
    a block that very many documents ask for is laid out several times.
    """
    blocks = max(1, -(-members.select("cid").distinct().count() // BLOCK_IDS))
    near = _block_pairs(members).mapInArrow(_by_group(_crossing(blocks)), _OPEN)
    asked = near.groupBy("a", "block").agg(F.array_distinct(F.flatten(F.collect_list(F.arrays_zip("bs", "comps")))).alias("z"))
    asked = asked.select("a", "block", F.col("z.bs").alias("bs"), F.col("z.comps").alias("comps"), F.sum(F.size("z")).over(Window.partitionBy("a")).alias("many"))
    asked = materialize(asked, "open-asked")
    few = asked.where(F.col("many") <= FEW).select("a", F.explode("bs").alias("b"))
    few = materialize(few.select(*_ordered("a", "b")).distinct().join(tested, ["a", "b"], "left_anti"), "candidate-pairs")
    dense = asked.where(F.col("many") > FEW)
    widths = materialize(dense.groupBy("block").agg(F.ceil(F.count("*") / F.lit(BLOCK_IDS)).alias("width")), "block-widths")
    dense = dense.join(widths.toDF("block", "w"), "block").withColumn("part", F.pmod(F.xxhash64("a"), F.col("w"))).select("a", "block", "part", "bs", "comps")
    wanted = dense.groupBy("block", "part").agg(F.array_distinct(F.flatten(F.collect_list("bs"))).alias("bs")).select(F.explode("bs").alias("id"))
    ids = materialize(_ends(few).union(dense.select("a")).union(wanted).distinct(), "open-ids")
    if ids.isEmpty():
        return few, few
    with temporary(_sets_of(documents, ids), "shingle-sets") as sets:
        to = dense.join(sets.toDF("a", "xa"), "a").select("a", "block", "part", "bs", "comps", "xa")
        held = sets.withColumn("block", F.pmod("id", F.lit(blocks)).cast("int")).join(widths, "block").select("id", "shingles", "block", F.explode(F.expr("sequence(0L, width - 1)")).alias("part"))
        many = held.groupBy("block", "part").cogroup(to.groupBy("block", "part")).applyInArrow(_confirm_blocks, "a long, b long")
        return materialize(_confirmed(few, sets).union(many).distinct(), "links"), few


def _bucket_members(classes: DataFrame) -> DataFrame:
    """``(key, cid, n, leader, leader_n)`` of the buckets with two classes at least.

    A first count over the keys alone finds those; a bitmap of them then keeps
    nearly all other members from being shuffled.
    """
    shared = materialize(classes.select(F.explode("bands").alias("key")).groupBy("key").count().where("count > 1").select("key"), "shared-keys")
    known = Bitmap.of_hashes(shared, "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("bands")
            keys, of = lists.flatten().to_numpy(), pc.list_parent_indices(lists)
            mask = pa.array(known.may_hold_hash(keys))
            of = of.filter(mask)
            yield pa.RecordBatch.from_arrays([pa.array(keys).filter(mask), batch.column("cid").take(of), batch.column("n").take(of)], ["key", "cid", "n"])

    likely = materialize(classes.select("cid", "n", "bands").mapInArrow(run, "key long, cid long, n int"), "likely-members")
    buckets = likely.groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct("cid", "n")).alias("leader")).where("size > 1")
    buckets = materialize(buckets.select("key", F.col("leader.cid").alias("leader"), F.col("leader.n").alias("leader_n")), "buckets")
    return likely.join(buckets, "key").select("key", "cid", "n", "leader", "leader_n")


def _open_members(members: DataFrame, found: DataFrame, sketches: DataFrame) -> DataFrame:
    """``(cid, key, n, comp, bands, sketch)`` of the buckets that span several components."""
    named = members.select("key", "cid", "n").join(found, members.cid == found.id, "left").select("key", "cid", "n", F.coalesce("component", "cid").alias("comp"))
    named = materialize(named, "members-by-component")
    split = named.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key")
    return named.join(materialize(split, "split-buckets"), "key").join(sketches, "cid")


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` of each input row.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; the set is that of
    distinct five-word shingles, or the whole sequence where there are fewer
    words.  Null and wordless texts have no set and stay alone.  component_id
    is the smallest id reachable by links; kept is true for the document whose
    id that is.  Rows that repeat an id are all returned, and count as one
    document; a row without id has component null and is kept.  Other columns
    are ignored.  An empty table gives no rows.
    """
    small_batches(documents.sparkSession)
    documents = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    with ExitStack() as until_classes:
        sketches = until_classes.enter_context(temporary(documents.mapInArrow(_sketch, _SKETCH), "sketches"))
        rows = materialize(sketches.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "digest"), "document-sets")
        classes = sketches.where("n > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("cid"), *(F.any_value(c).alias(c) for c in ("n", "bands", "sketch")))
        with temporary(classes, "set-classes") as classes:
            until_classes.close()
            digests = materialize(classes.select("cid", "digest"), "class-digests")
            members = materialize(_bucket_members(classes), "bucket-members")
            own = classes.select("cid", "bands", "sketch").join(members.select("cid").distinct(), "cid", "left_semi")
            own = materialize(own, "member-sketches")
    likely = f"100L * least(n, leader_n) >= {SIMILARITY}L * greatest(n, leader_n)"
    stars = members.where("cid <> leader").where(likely).groupBy(F.col("leader").alias("a"), F.col("cid").alias("b")).agg(F.count("*").alias("shared"))
    rank = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("shared"), "a"))
    nearest = stars.withColumn("rank", rank).where(F.col("rank") <= NEAREST).select("a", "b")
    links, tested = _links(documents, _alike_only(nearest, own.select("cid", "sketch")))
    found = materialize(connected_components(links), "components")
    for step in (_likeliest_links, _links_between):
        with temporary(_open_members(members, found, own), "open-members") as still:
            if still.isEmpty():
                break
            more, pairs = step(documents, still, tested)
        tested = tested.union(pairs)
        if not more.isEmpty():
            links = materialize(links.union(more), "all-links")
            found = materialize(connected_components(links), "components")
    named = digests.join(found, digests.cid == found.id, "left").select("digest", F.coalesce("component", "cid").alias("component"))
    rows = rows.join(named, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def without_near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows and columns of the documents that their component keeps.

    Of rows that repeat a kept id, one stays: the least by text, the others'
    columns of that row going with it; rows without id all stay.
    """
    judged = near_duplicates(documents, id_col, text_col)
    gone = materialize(judged.where("not kept").select(F.col("doc_id").alias("__id")).distinct(), "near-duplicates")
    repeated = judged.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__id"))
    left = documents.join(for_lookup(gone), documents[id_col].cast("long") == gone["__id"], "left_anti")
    repeated = materialize(repeated, "repeated-ids")
    if repeated.isEmpty():
        return left
    same = left[id_col].cast("long") == repeated["__id"]
    order = Window.partitionBy(id_col).orderBy(text_col)
    once = left.join(repeated, same, "left_semi").withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")
    return left.join(repeated, same, "left_anti").unionByName(once)
