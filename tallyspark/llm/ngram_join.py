"""Jaccard self-join of word n-gram sets by vertical partitioning.

The n-grams have one global order (that of a 64-bit hash), which is cut into fragments. A text's
set falls into a part for each fragment; partial overlaps are counted fragment by fragment and
summed for a pair.

Which pairs are counted follows from the same fragments. Two sets that are similar enough
differ in at most H n-grams, hence in at most H fragments. So among the first H + 1 fragments of
a set, in an order of contents that is the same for all sets, at least one must be exactly equal
in both: hashes of those parts meet, and nothing else has to. Any such order loses nothing; a
good one makes rare parts come first. Parts that a count over the corpus shows to be frequent
(a footer of a third of all texts) come last, among the others those of most n-grams come first.
Nothing is capped; no link is lost.

Equal sets are one class from the start and are never paired. Texts whose parts meet form
candidate groups: connected ones, or, where many small meetings chain up to a large group, each
meeting by itself, whichever makes less work. The overlaps inside a group are counted in one
task, or, where a group has many n-grams, in blocks: every pair of blocks is a task of bounded size.
Near copies of one text have nearly all n-grams in common; what most sets of a task have is its
core, and a set is then what it lacks of the core and has beside it. Sets close to the core
link through the closest one without being compared, the others by what little they share. A
task returns the links that join what it has not joined yet, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, NOT_SPACE, U64, extended, materialize, mix, signed, slices, small_side, stream, word_hashes, word_spans
from .graph import components

#: Distinct sets of usual size, and n-grams of such a set, whose product bounds the n-grams of a block.
BLOCK, SET_GRAMS = 4000, 500
#: Rows of one class from which only one row's signatures are used.
MANY_COPIES = 100
#: Fragments in which a task counts partial overlaps.
COUNT_FRAGMENTS = 4
#: Counters of fragments, by the first bits of their hashes, and how many times the mean makes a counter's fragments frequent ones. Any choice is exact.
COUNTER_BITS, FREQUENT = 16, 8
_MULTIPLIERS = stream(64, 4001)


# ------------------------------------------------------------------ sets


def shingle_sets(data: np.ndarray, ends: np.ndarray, n: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text; a text of fewer words, but not none, has its whole sequence as one."""
    data = LOWER[data]
    starts, stops, first = word_spans(data, ends, NOT_SPACE)
    words = word_hashes(data, starts, stops)
    with np.errstate(over="ignore"):
        grams = np.zeros(max(len(words) - n + 1, 0), np.uint64)
        for i in range(n):
            grams += words[i : len(words) - n + 1 + i] * _MULTIPLIERS[i]
        grams = mix(grams)
        found = []
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= n:
                found.append(np.unique(grams[a : b - n + 1]))
            elif b > a:
                found.append(mix(np.array([np.sum(words[a:b] * _MULTIPLIERS[: b - a])], np.uint64) + U64(b - a)))
            else:
                found.append(np.zeros(0, np.uint64))
    return found


def set_key(tokens: np.ndarray) -> bytes:
    """16 bytes that tell sets apart."""
    with np.errstate(over="ignore"):
        a, b = np.sum(mix(tokens + U64(11))), np.sum(mix(tokens ^ U64(0x5BD1E995)) * U64(3))
        return mix(np.array([a + U64(len(tokens)), b], np.uint64)).tobytes()


# ------------------------------------------------------------------ fragments


@lru_cache(8)
def _room(num: int, den: int) -> float:
    """The most n-grams a fragment may hold on average: a fragment of t of them is not empty with (1 - exp(-t)) / t of a set's size, which must stay above H with a margin."""
    t = 8.0
    while (1 - np.exp(-t)) / t < 1.3 * (den - num) / num:
        t -= 0.1
    return t


def level(sizes: np.ndarray, num: int, den: int) -> np.ndarray:
    """Logarithms of the fragment counts for sets of the given sizes. Small sets get more fragments for their size, since chance weighs more there."""
    t = np.where(sizes < 256, _room(num, den) / 2, _room(num, den))
    return np.where(sizes < 16, 6, np.maximum(4, np.ceil(np.log2(np.maximum(sizes, 1) / t)))).astype(np.int64)


@lru_cache(4096)
def levels(size: int, num: int, den: int) -> tuple[int, ...]:
    """The levels of a set of that size: its own and those of any set it may link with."""
    return tuple(np.unique(level(np.arange(-(-size * num // den), size * den // num + 1), num, den)).tolist())


def fragments(tokens: np.ndarray, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, counts of n-grams) of the fragments that are not empty, at each level."""
    with np.errstate(over="ignore"):
        mixed = mix(tokens + U64(77))
        for j in levels(len(tokens), num, den):
            part = tokens >> U64(64 - j)
            heads = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            counts = np.diff(np.append(heads, len(tokens)))
            yield mix(np.add.reduceat(mixed, heads) + _MULTIPLIERS[j] * counts.astype(np.uint64)), counts


def signatures(tokens: np.ndarray, num: int, den: int, frequent: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the first H + 1 fragments at each level: rare ones, then the fullest."""
    size = len(tokens)
    if not size:
        return tokens
    most = size * (den - num) // num + 1
    found = []
    for sums, counts in fragments(tokens, num, den):
        keys = (sums, -counts) if frequent is None else (sums, -counts, frequent[sums >> U64(64 - COUNTER_BITS)])
        found.append(sums[np.lexsort(keys)[:most]])
    return np.concatenate(found)


def frequent_fragments(texts: DataFrame, n: int, num: int, den: int) -> np.ndarray:
    """A flag for each counter: whether its fragments are frequent. texts(text: binary); at most 2**COUNTER_BITS counts reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(1 << COUNTER_BITS, np.int64)
        for _, data, ends in slices(batches):
            sums = [x for s in shingle_sets(data, ends, n) if len(s) for x, _ in fragments(s, num, den)]
            if sums:
                counters += np.bincount((np.concatenate(sums) >> U64(64 - COUNTER_BITS)).astype(np.int64), minlength=1 << COUNTER_BITS)
        at = np.flatnonzero(counters)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counters[at])], names=["slot", "n"])

    counts = np.zeros(1 << COUNTER_BITS, np.int64)
    for r in texts.select("text").mapInArrow(run, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r.slot] = r.n
    return counts > FREQUENT * max(counts.mean(), 1)


# ------------------------------------------------------------------ overlaps inside a group


class Joined:
    """Which members of a group are joined already: equal labels."""

    def __init__(self, n: int):
        self.label, self.links = np.arange(n), []

    def open(self, i: int) -> np.ndarray:
        return self.label != self.label[i]

    def join(self, i: int, others: np.ndarray) -> None:
        """Links i to what its links to the others lead to, with one link for each of these."""
        others = others[self.open(i)[others]]
        while len(others):
            self.links.append((i, int(others[0])))
            self.label[self.label == self.label[others[0]]] = self.label[i]
            others = others[self.open(i)[others]]


def _around_core(ids: np.ndarray, owner: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The n-grams of n members, with those that most of them have (the core) replaced by those of the core that a member lacks: (ids, owner, lacking, core)."""
    core = np.flatnonzero(counts > n / 2)
    if not len(core):
        return ids, owner, np.zeros(n, np.int64), 0
    place = np.full(len(counts), -1)
    place[core] = np.arange(len(core))
    inside = place[ids] >= 0
    has = np.zeros((n, len(core)), bool) if n * len(core) <= 1 << 26 else None
    if has is not None:
        has[owner[inside], place[ids[inside]]] = True
        lack_owner, lack = np.nonzero(~has)
    else:  # the same, member by member
        own, at = place[ids[inside]], np.searchsorted(owner[inside], np.arange(n + 1))
        lacks = [np.setdiff1d(np.arange(len(core)), own[at[i] : at[i + 1]], assume_unique=True) for i in range(n)]
        lack, lack_owner = np.concatenate(lacks), np.repeat(np.arange(n), [len(x) for x in lacks])
    # What is lacked has ids of its own.
    ids = np.concatenate((ids[~inside], len(counts) + lack))
    owner = np.concatenate((owner[~inside], lack_owner))
    return ids, owner, np.bincount(lack_owner, minlength=n), len(core)


def links(sets: list[np.ndarray], sides: np.ndarray, cross: bool, num: int, den: int) -> list[tuple[int, int]]:
    """Pairs (i, j) with den * overlap >= num * union that join all that links join. cross: pairs of one side need not be looked for.

    An overlap is the core's size less what either member lacks of it, plus what both lack or have
    beside it. Members whose lacks are few enough for each other need share nothing: of all
    such pairs both members also link with the closest to the core. For the others, the n-grams
    that are left, rarest first, are cut into fragments; a member's overlaps with all others are
    summed over them, and it is left as soon as none of its partners can still reach what is needed.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(n), sizes)
    _, ids, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    ids, owner, lacking, core = _around_core(ids, owner, counts, n)
    joined = Joined(n)
    # overlap >= num * (sizes) / (num + den), in whole numbers; without anything shared it is core - lacking - lacking.
    far = 2 * (num + den) * lacking + 2 * num * sizes - (num + den) * core
    closest = int(np.argmin(far))
    joined.join(closest, np.flatnonzero(far + far[closest] <= 0))
    _, ids, counts = np.unique(ids, return_inverse=True, return_counts=True)
    rank = np.empty(len(counts), np.int64)
    order = np.argsort(counts, kind="stable")
    rank[order] = np.arange(len(counts))
    ids, counts = rank[ids], counts[order]
    by_gram = np.argsort(ids, kind="stable")
    posting, post_at = owner[by_gram], np.concatenate(([0], np.cumsum(counts)))
    single = int(np.searchsorted(counts, 2))  # what one member has alone overlaps with nothing
    cuts = np.unique(np.linspace(single, len(counts), COUNT_FRAGMENTS + 1).astype(np.int64))
    by_member = np.lexsort((ids, owner))
    own_ids, own_at = ids[by_member], np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n))))
    for i in range(n):
        mine = own_ids[own_at[i] : own_at[i + 1]]
        at = np.searchsorted(mine, cuts)
        need = -(-num * (sizes[i] + sizes) // (num + den))  # least overlap of i with each
        needed = need - core + lacking[i] + lacking  # of what is shared beside the core
        open_to = joined.open(i) & (np.minimum(sizes, sizes[i]) >= need)
        open_to[: i + 1] = False
        if cross:
            open_to &= sides != sides[i]
        shared = np.zeros(n, np.int64)
        for f in range(len(cuts) - 1):
            open_to &= shared + (len(mine) - at[f]) >= needed
            if not open_to.any():
                break
            part = mine[at[f] : at[f + 1]]
            if len(part):
                lengths = counts[part]
                total = int(lengths.sum())
                places = np.repeat(post_at[part] - (np.cumsum(lengths) - lengths), lengths) + np.arange(total)
                shared += np.bincount(posting[places], minlength=n)
        joined.join(i, np.flatnonzero(open_to & (shared >= needed)))
    return joined.links


# ------------------------------------------------------------------ the join


def ngram_classes(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, text: str = "text", doc_id: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs.

    Words are what stands between ASCII white space, A-Z lower-cased; a text's set are its
    distinct n-grams of words. Rows link when den * overlap >= num * union; component_id is the
    smallest doc_id that links lead to, the row's own included. Rows without words (null, empty
    or blank texts) have an empty set and link with nothing. Repeated rows and equal texts are
    one class. A null doc_id is smaller than none: it is taken only where all ids of a component
    are null. Columns other than doc_id and text are ignored; an empty table gives an empty
    result. Sets are compared as 64-bit hashes of n-grams.
    """
    found = _classes(docs, n, num, den, text, doc_id, block)
    per_root = found.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return found.join(per_root, "root").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _classes(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, text: str = "text", doc_id: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """doc_id, tkey (of the text), n_shingles, root (a key) of every row of docs."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    sketches = _sketches(rows, n, num, den)
    members = sketches.select("doc_id", "tkey", "n_shingles", "key", "node")
    groups = candidate_groups(sketches, block)
    found = _links(rows, members, groups, n, num, den, block)
    classes = components(found)
    # Classes without links are their own component.
    per_class = members.select("key").distinct().join(classes.withColumnRenamed("node", "key"), "key", "left").select("key", F.coalesce("root", "key").alias("root"))
    return materialize(members.join(materialize(per_class, "classes"), "key").select("doc_id", "tkey", "n_shingles", "root"), "members")


def _sketches(rows: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """rows(doc_id, text) → doc_id, tkey (of the text), n_shingles, key and node (of the set), and its signatures: sigs, and frequent, those among frequent fragments; written."""
    keyed = rows.withColumn("tkey", F.xxhash64("text"))
    schema = extended(keyed.select("doc_id", "tkey"), "n_shingles bigint, key binary, node bigint, sigs array<bigint>, frequent array<bigint>")
    frequent = rows.sparkSession.sparkContext.broadcast(frequent_fragments(rows, n, num, den))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, ends in slices(batches):
            sets = shingle_sets(data, ends, n)
            keys = [set_key(s) for s in sets]
            nodes = np.frombuffer(b"".join(k[:8] for k in keys), np.int64)
            sigs = [signatures(s, num, den, frequent.value) for s in sets]
            flags = [frequent.value[s >> U64(64 - COUNTER_BITS)] for s in sigs]
            lists = [_lists([s[f == hot] for s, f in zip(sigs, flags, strict=True)]) for hot in (False, True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(nodes), *lists], names=schema.names)

    return materialize(keyed.select("doc_id", "text", "tkey").mapInArrow(sketch, schema), "sketches")


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    bounds = np.concatenate(([0], np.cumsum([len(s) for s in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(signed(np.concatenate(parts))))


def candidate_groups(sketches: DataFrame, block: int = BLOCK) -> DataFrame:
    """(node, grp): nodes whose links lie inside their groups. A node may be in several."""
    # Rows of one class have equal signatures. A few of them do no harm where signatures meet; classes with many rows send those of one row only.
    with_words = sketches.where("n_shingles > 0").select("node", "sigs", "frequent")
    many = materialize(sketches.where("n_shingles > 0").groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > MANY_COPIES).select("node"), "many")
    many = small_side(many)
    once = with_words.join(many, "node", "left_semi").dropDuplicates(["node"])
    parts = with_words.join(many, "node", "left_anti").unionByName(once)
    # Hashes that one node has alone are most; the rest bring their nodes together. No hash but a frequent one has a large share of all rows: it meets in one shuffle.
    own = Window.partitionBy("sig")
    rare = parts.select("node", F.explode("sigs").alias("sig")).select("node", "sig", F.min("node").over(own).alias("least"), F.max("node").over(own).alias("most"))
    rare = rare.where("least <> most").select("sig", "node", "least")
    # Frequent ones are counted before they are shuffled, and their nodes found by a join whose hot keys Spark splits.
    hot = parts.select("node", F.explode("frequent").alias("sig"))
    shared = hot.groupBy("sig").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least <> most").select("sig", "least")
    hot = hot.join(small_side(materialize(shared, "shared")), "sig").select("sig", "node", "least")
    met = materialize(rare.unionByName(hot).distinct(), "met")
    groups = components(met.where("node <> least").select(F.col("node").alias("u"), F.col("least").alias("v")))
    return _split_groups(materialize(groups.select("node", F.col("root").alias("grp")), "groups"), met, 2 * block)


def _split_groups(groups: DataFrame, met: DataFrame, most: int) -> DataFrame:
    """(node, grp) with each connected group of more than `most` nodes dealt into its meetings, met(node, sig), where comparing inside these is less work."""
    large = groups.groupBy("grp").agg(F.count("*").alias("size")).where(F.col("size") > most)
    large = materialize(large, "large")
    if large.isEmpty():
        return groups
    inside = materialize(met.join(groups.join(small_side(large), "grp"), "node").select("grp", "size", "sig", "node"), "inside")
    # Meetings of the same nodes are one.
    meetings = inside.groupBy("grp", "size", "sig").agg(F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("nodes"))
    meetings = meetings.groupBy("grp", "size", "n", "nodes").agg(F.min("sig").alias("sig"))
    split = meetings.groupBy("grp", "size").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("work")).where(F.col("work") < F.col("size").cast("double") * F.col("size"))
    split = small_side(materialize(split.select("grp"), "split"))
    chosen = small_side(materialize(meetings.join(split, "grp").select("grp", "sig"), "meetings"))
    own = inside.join(chosen, ["grp", "sig"]).select("node", F.xxhash64("grp", "sig").alias("grp"))
    return materialize(groups.join(split, "grp", "left_anti").select("node", "grp").unionByName(own), "groups")


def _links(rows: DataFrame, members: DataFrame, groups: DataFrame, n: int, num: int, den: int, block: int) -> DataFrame:
    """(u, v): keys of linked classes that join all that links join."""
    one = members.where("n_shingles > 0").join(groups, "node").groupBy("grp", "key").agg(F.min(F.struct("tkey", "doc_id", "n_shingles")).alias("f"))
    one = materialize(one.select("grp", "key", F.col("f.tkey").alias("tkey"), F.col("f.doc_id").alias("fid"), F.col("f.n_shingles").alias("grams")), "members")
    sizes = one.groupBy("grp").agg(F.count("*").alias("size"), F.sum("grams").alias("grams")).where("size > 1")
    most = block * SET_GRAMS
    placed = one.drop("grams").join(sizes, "grp").withColumn("blocks", F.when(F.col("grams") <= 2 * most, 1).otherwise(F.least("size", F.ceil(F.col("grams") / most))).cast("int"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    placed = small_side(materialize(placed.withColumnRenamed("tkey", "k2"), "placed"))
    texts = rows.withColumn("tkey", F.xxhash64("text")).join(placed, F.col("tkey") == F.col("k2")).where(F.col("doc_id").eqNullSafe(F.col("fid")))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = texts.select("grp", "block", "text", other.alias("other")).select("grp", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "text")
    dealt = dealt.repartition("grp", "a", "b").sortWithinPartitions("grp", "a", "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sets, sides = None, [], []

        def done() -> list[tuple[bytes, bytes]]:
            if len(sets) < 2:
                return []
            keys = [set_key(s) for s in sets]
            seen: dict[bytes, int] = {}
            for i, k in enumerate(keys):
                seen.setdefault(k, i)
            pick = list(seen.values())
            own, at = [sets[i] for i in pick], np.array([sides[i] for i in pick])
            return [(keys[pick[i]], keys[pick[j]]) for i, j in links(own, at, now[1] != now[2], num, den)]

        def out(pairs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.binary())], names=["u", "v"])

        for batch, data, ends in slices(batches):
            heads = list(zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True))
            pairs = []
            for (g, a, b, side), s in zip(heads, shingle_sets(data, ends, n), strict=True):
                if (g, a, b) != now:
                    pairs += done()
                    now, sets, sides = (g, a, b), [], []
                sets.append(s)
                sides.append(side)
            if pairs:
                yield out(pairs)
        if pairs := done():
            yield out(pairs)

    return materialize(dealt.select("grp", "a", "b", "block", "text").mapInArrow(compare, "u binary, v binary"), "links")


def keep_one_of_each(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs, all columns, with one of each component: one row with the smallest doc_id (null last), then text key. Rows without words stay."""
    rows = _classes(docs, n, num, den).where("n_shingles > 0").select("doc_id", "tkey", "root")
    # Losing (doc_id, text) pairs, and winning ones that stand in several rows; the other rows are not touched.
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tkey")
    best = rows.groupBy("root").agg(F.min(place).alias("best"))
    pairs = rows.groupBy("root", "doc_id", "tkey").agg(F.count("*").alias("n")).join(best, "root")
    wins = F.col("best.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("best.tkey") == F.col("tkey"))
    marked = materialize(pairs.select(F.col("doc_id").alias("_id"), F.col("tkey").alias("_tkey"), wins.alias("_wins"), "n").where("NOT _wins OR n > 1").drop("n"), "marked")
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    on = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_tkey"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    lone = docs.join(small_side(marked), on, "left_anti").select(*columns)
    repeated = docs.join(small_side(marked.where("_wins")), on).withColumn("_n", F.row_number().over(Window.partitionBy("_id", "_tkey").orderBy("_tkey"))).where("_n = 1")
    return lone.unionByName(repeated.select(*columns))
