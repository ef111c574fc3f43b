"""Exact Jaccard join of documents on word shingles, with an R-tree over count vectors.

1. A document is its set of shingle hashes. Documents of equal sets are one class, led by its smallest id.
2. Two sets of likeness t share ``m`` of their first ``n - ceil(t n) + m`` elements in any order common to all, m
   being that of the set with the smaller m; here m is 1 and one more for every ``STEP`` elements. In the order of
   the hashes this leaves the classes that share enough leading elements with others.
3. Among these, elements are counted and ordered again, the rarest first: an element of one class only cannot be
   shared, and classes with too few shared leading elements drop out. Those left meet in groups, one for each
   shared leading element (now m is 1); elements with the same members are one group.
4. Each class goes with its set to its first ``HOMES`` groups. In a group, the elements' hashes are dealt into
   ``CELLS`` cells and a set's cell counts are a point. Points are packed into leaves with the largest count per
   cell; a sum of cell-wise minima bounds the overlap from above, first for leaves, then for points, and what is
   left is verified on the sets. Only links leave the group. Classes of one component need no second proof.
5. The groups that still hold different components are searched in the same way, those of a family of components in
   one go if the family is of moderate size: classes outside the largest component meet every part of the group or
   family, the others only their own part.
6. Components come from all links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import discard, gram_hashes, mix, ragged_take, split_words, stored, text_slices, word_hashes
from .components import components

WORDS = 5
#: Likeness in per cent.
PERCENT = 75
#: Elements of a set for each leading element that partners must share besides one.
STEP = 16
#: Bits of the map of classes whose sets are wanted for each class, and at most; a full map costs time, never a link.
MAP_BITS_EACH, MAP_BITS = 32, 1 << 28
#: Cells of a count vector, and points in a leaf.
CELLS, LEAF = 128, 16
#: Groups each class is clustered in first, and classes in one part of a group.
HOMES, PART = 3, 2000
#: Classes of components that meet in groups; families of more are searched group by group.
FAMILY = 8000
#: Sets looked at in one call, and pairs verified side by side.
SETS_AT_ONCE, PAIRS_AT_ONCE = 500, 64


def shingle_sets(texts: pa.Array, words_each: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct elements of each text in ascending order, one text after another, and offsets by text.

    An element is the upper 63 bits of a shingle's hash. A text of fewer words has one shingle of all its words; one
    without words has none.
    """
    words, codes, offsets = split_words(texts, lower=True)
    hashes, size = word_hashes(words)[codes], np.diff(offsets)
    doc = np.repeat(np.arange(len(size)), size)
    grams = gram_hashes(hashes, words_each)
    at = np.flatnonzero(doc[: len(grams)] == doc[len(doc) - len(grams) :]) if len(grams) else np.empty(0, np.int64)
    value, owner = [grams[at]], [doc[at]]
    short = np.flatnonzero((size > 0) & (size < words_each))
    for n in range(1, words_each):
        some = short[size[short] == n]
        if len(some):
            rows = hashes[offsets[some][:, None] + np.arange(n)]
            acc = np.full(len(some), np.uint64(n))
            for k in range(n):
                acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
            value.append(acc)
            owner.append(some)
    value, owner = np.concatenate(value) >> np.uint64(1), np.concatenate(owner)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[new], np.concatenate([[0], np.cumsum(np.bincount(owner[new], minlength=len(size)))])


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.view(np.int64)))


def _signature(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set, equal for equal sets."""
    total = lambda v: np.diff(np.concatenate([[np.uint64(0)], np.cumsum(v)])[offsets]).view(np.int64)
    return total(mix(values)), total(mix(values ^ np.uint64(0xC2B2AE3D27D4EB4F)))


class CountTree:
    """R-tree of two levels over cell counts: leaves of points of like size with the corners of their boxes."""

    def __init__(self, sizes: np.ndarray, counts: np.ndarray):
        # packed by size, then by the heaviest cells, so that boxes stay small
        self.order = np.lexsort((counts[:, 0], counts[:, 1], sizes)) if len(sizes) else np.empty(0, np.int64)
        self.sizes, self.counts = sizes[self.order], counts[self.order]
        at = np.arange(0, len(sizes), LEAF)
        self.corner = np.maximum.reduceat(self.counts, at, axis=0) if len(at) else self.counts
        self.low, self.high = self.sizes[at], self.sizes[np.minimum(at + LEAF, len(sizes)) - 1] if len(at) else self.sizes

    def near(self, size: int, count: np.ndarray) -> np.ndarray:
        """Points that the bounds allow to reach the likeness."""
        first = np.searchsorted(self.high * 100, size * PERCENT)
        last = np.searchsorted(self.low * PERCENT, size * 100, side="right")
        if first >= last:
            return np.empty(0, np.int64)
        bound = np.minimum(self.corner[first:last], count).sum(axis=1, dtype=np.int64)
        leaves = first + np.flatnonzero(bound * (100 + PERCENT) >= PERCENT * (size + self.low[first:last]))
        points = (leaves[:, None] * LEAF + np.arange(LEAF)).reshape(-1)
        points = points[points < len(self.sizes)]
        bound = np.minimum(self.counts[points], count).sum(axis=1, dtype=np.int64)
        sizes = self.sizes[points]
        fits = (bound * (100 + PERCENT) >= PERCENT * (size + sizes)) & (np.minimum(size, sizes) * 100 >= np.maximum(size, sizes) * PERCENT)
        return self.order[points[fits]]


def cell_counts(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    cell = (values & np.uint64(CELLS - 1)).astype(np.int64)
    return np.bincount(owner * CELLS + cell, minlength=(len(offsets) - 1) * CELLS).reshape(-1, CELLS).astype(np.uint32)


def overlaps(own: np.ndarray, values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """How many of the ascending elements ``own`` each of the sets has."""
    other = ragged_take(values, starts, lengths)
    place = np.minimum(np.searchsorted(own, other), len(own) - 1)
    return np.add.reduceat((own[place] == other).astype(np.int64), np.cumsum(lengths) - lengths)


def cluster(ids: np.ndarray, values: np.ndarray, offsets: np.ndarray, label: np.ndarray, asking: np.ndarray) -> list[tuple[int, int]]:
    """Links inside a group that join different labels; each of ``asking`` is held against all others."""
    sizes = np.diff(offsets)
    counts = cell_counts(values, offsets)
    tree, label, links = CountTree(sizes, counts), label.copy(), []
    for i in asking[np.argsort(sizes[asking], kind="stable")]:
        own = values[offsets[i] : offsets[i + 1]]
        near = tree.near(int(sizes[i]), counts[i])
        while len(near := near[label[near] != label[i]]):
            some, near = near[:PAIRS_AT_ONCE], near[PAIRS_AT_ONCE:]
            both = overlaps(own, values, offsets[some], sizes[some])
            for j in some[100 * both >= PERCENT * (sizes[i] + sizes[some] - both)]:
                if label[j] != label[i]:
                    links.append((ids[i], ids[j]))
                    label[label == label[j]] = label[i]
    return links


def _groups(*keys: np.ndarray) -> Iterator[np.ndarray]:
    """Rows of each group of equal keys."""
    order = np.lexsort(keys)
    if len(order):
        change = np.logical_or.reduce([np.diff(k[order]) != 0 for k in keys])
        yield from np.split(order, np.flatnonzero(change) + 1)


def _linked(table: pa.Table) -> pa.Table:
    """Links of each (key, part) of a table with rep, elements, component and guest (held against all of its part)."""
    lists = table["elements"].combine_chunks()
    values, offsets = lists.flatten().to_numpy().view(np.uint64), lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
    ids, key, part, component = (table[c].to_numpy() for c in ("rep", "key", "part", "component"))
    guest, found = table["guest"].to_numpy(), []
    for rows in _groups(key, part):
        label = np.unique(component[rows], return_inverse=True)[1]
        if label.max() and guest[rows].any():
            length = offsets[rows + 1] - offsets[rows]
            own = ragged_take(values, offsets[rows], length)
            found += cluster(ids[rows], own, np.concatenate([[0], np.cumsum(length)]), label, np.flatnonzero(guest[rows]))
    found = np.array(found, np.int64).reshape(-1, 2)
    return pa.table({"a": found[:, 0], "b": found[:, 1]})


def _search(places: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) of the groups in ``places``: key, part, rep, s1, component, guest."""
    places = stored(places, "places")
    calls = max(1, places.count() // SETS_AT_ONCE)
    placed = places.join(sets, ["rep", "s1"]).withColumn("call", F.pmod(F.xxhash64("key", "part"), F.lit(calls)).cast("int"))
    links = stored(placed.groupBy("call").applyInArrow(_linked, "a long, b long"), "links")
    discard(places)
    return links


def _leading(n: str, shared: int = 0) -> Column:
    """Leading elements of a set of ``n`` of which partners share one (or, with STEP, some more)."""
    return F.col(n) - F.ceil(F.col(n) * PERCENT / 100) + 1 + (F.floor(F.col(n) / shared) if shared else 0)


def _least() -> Column:
    """Leading elements that a partner of a set of ``n`` shares at least, as it can be so much smaller."""
    return F.floor(F.ceil(F.col("n") * PERCENT / 100) / STEP) + 1


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", needed: list[DataFrame] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest id reachable by links).

    Null, empty and blank texts have no shingles and link with nothing. Rows of one id count as one document.
    Rows of a null id are not linked and have a null component. Ids must be integers. The stored tables that the
    result reads are added to ``needed``, so that a caller can discard them after use.
    """
    docs = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    spark = docs.sparkSession

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                value, offsets = shingle_sets(part["text"])
                n, ids = np.diff(offsets), part["id"].combine_chunks()
                s1, s2 = _signature(value, offsets)
                # copies within the slice lead once, by their smallest id
                order = np.lexsort((ids.fill_null(0).to_numpy(), s1))
                order = order[(n[order] > 0) & ids.is_valid().to_numpy(zero_copy_only=False)[order]]
                order = np.sort(order[np.append(True, s1[order][1:] != s1[order][:-1])] if len(order) else order)
                length = np.zeros(len(n), np.int64)
                length[order] = n[order] - -(-n[order] * PERCENT // 100) + 1 + n[order] // STEP
                lead = _lists(ragged_take(value, offsets[:-1], length), np.concatenate([[0], np.cumsum(length)]))
                yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(s1), pa.array(s2), lead], ["id", "n", "s1", "s2", "lead"])

    all_rows = stored(docs.mapInArrow(described, "id long, n long, s1 long, s2 long, lead array<long>"), "sets")
    classes = stored(all_rows.where("n > 0 and id is not null").groupBy("n", "s1", "s2").agg(F.min("id").alias("rep")), "classes")

    # classes that share enough leading elements in the order of the hashes
    lead = all_rows.select(F.explode("lead").alias("key"), F.col("id").alias("rep"), "s1")
    keys = lead.groupBy("key").agg(F.min("s1").alias("lo"), F.max("s1").alias("hi")).where("lo < hi").select("key")
    owns = lead.select("key", "rep").join(keys, "key").groupBy("rep").agg(F.count("*").alias("own"))
    left = stored(owns.join(classes.groupBy("rep").agg(F.min("n").alias("n")), "rep").where(F.col("own") >= _least()).select("rep"), "left")
    slim = stored(all_rows.drop("lead"), "rows")
    discard(all_rows)
    all_rows, wanted = slim, spark.sparkContext.broadcast(_map_of(left))
    size = 32 * len(wanted.value)

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(2).fill_null(0).to_numpy()
            batch = batch.filter(pa.array((wanted.value[at // 32] >> (at % 32).astype(np.uint32)) & 1 == 1))
            for part in text_slices(batch):
                value, offsets = shingle_sets(part["text"])
                some = np.diff(offsets) > 0
                s1 = _signature(value, offsets)[0]
                rows = pa.RecordBatch.from_arrays([part["id"].combine_chunks(), pa.array(s1), _lists(value, offsets)], ["rep", "s1", "elements"])
                yield rows.filter(pa.array(some))

    mapped = docs.where("id is not null").withColumn("slot", F.pmod(F.xxhash64("id"), F.lit(size)))
    sets = mapped.select("id", "text", "slot").mapInArrow(full, "rep long, s1 long, elements array<long>").dropDuplicates(["rep", "s1"])
    sets = stored(sets.join(left, "rep", "left_semi"), "elements")

    # the order by counts: what only one set has leads, and is not shared
    each = sets.select("rep", "s1", F.size("elements").cast("long").alias("n"), F.explode("elements").alias("key"))
    often = each.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    ranked = each.join(often, "key").groupBy("rep", "s1", "n").agg(F.sort_array(F.collect_list(F.struct("c", "key"))).alias("e"))
    alone = F.col("n") - F.size("e")
    ranked = ranked.where(_leading("n", STEP) - alone >= _least()).withColumn("e", F.slice("e", 1, F.greatest(F.lit(0), _leading("n") - alone).cast("int")))
    members = stored(ranked.select("rep", "s1", F.explode("e.key").alias("key")), "members")

    # one group for each set of members
    whom = F.struct("rep", "s1")
    groups = members.groupBy("key").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("rep", "s1")).alias("x"), F.bit_xor(F.xxhash64("s1", "rep", F.lit(1))).alias("y"), F.min(whom).alias("first"))
    groups = groups.where("size > 1").groupBy("size", "x", "y").agg(F.min("key").alias("key"), F.first("first").alias("first"))
    places = stored(members.join(groups.select("key", "size", "first"), "key"), "groups")
    rarest = F.row_number().over(Window.partitionBy("rep", "s1").orderBy("size", "key"))
    homes = stored(places.withColumn("r", rarest).where(F.col("r") <= HOMES).drop("r"), "homes")
    parts = F.ceil(F.col("size") / PART).cast("int")
    own = F.array(F.pmod(F.xxhash64("rep", "s1"), parts).cast("int"))
    anew = F.xxhash64("rep", "s1").alias("component")  # every set is a component of its own
    part = F.explode(F.when(whom == F.col("first"), F.sequence(F.lit(0), parts - 1)).otherwise(own)).alias("part")
    links = _search(homes.select("key", part, "rep", "s1", anew, F.lit(True).alias("guest")), sets)
    found = components(links)

    # groups with different components in which not all have met
    of = found.select(F.col("node").alias("rep"), "component")
    rest = places.join(of, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    sure = homes.groupBy("key").agg(F.count("*").alias("met"), F.first("size").alias("size")).where((F.col("met") == F.col("size")) & (F.col("size") <= PART))
    mixed = rest.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").join(sure.select("key"), "key", "left_anti")
    rest = open_rows = stored(rest.join(mixed.select("key", "lo"), "key"), "rest")
    # components that meet in a group make a family; in families of moderate size each class is placed once
    families = components(rest.select(F.col("component").alias("a"), F.col("lo").alias("b")))
    rest = rest.join(families.select(F.col("node").alias("component"), F.col("component").alias("family")), "component")
    classes_ = rest.select("family", "component", "rep", "s1").distinct()
    size = classes_.groupBy("family").agg(F.count("*").alias("all"))
    rest, classes_ = (x.join(size.where(cond).select("family"), "family") for x, cond in ((rest, F.col("all") > FAMILY), (classes_, F.col("all") <= FAMILY)))
    columns = ["kind", "key", "rep", "s1", "component"]
    spots = rest.withColumn("kind", F.lit(1)).select(*columns).unionByName(classes_.select(F.lit(0).alias("kind"), F.col("family").alias("key"), "rep", "s1", "component"))
    each = spots.groupBy("kind", "key", "component").agg(F.count("*").alias("c")).groupBy("kind", "key").agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.sum("c").alias("size"))
    spots = spots.join(each, ["kind", "key"]).withColumn("guest", F.col("component") != F.col("main"))
    part = F.explode(F.when(F.col("guest"), F.sequence(F.lit(0), parts - 1)).otherwise(own)).alias("part")
    more = _search(spots.select("key", "kind", part, "rep", "s1", "component", "guest").withColumn("part", F.col("part") * 2 + F.col("kind")).drop("kind"), sets)
    discard(members, places, homes, sets, left, families, open_rows)

    # the new links join components: their graph has a node per component
    at = lambda end: found.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))
    more_ = more.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    joined = components(more_)
    whole = found.select(F.col("node").alias("rep"), "component").join(joined.select(F.col("node").alias("component"), F.col("component").alias("whole")), "component", "left").select("rep", F.coalesce("whole", "component").alias("component"))
    single = joined.select(F.col("node").alias("rep"), "component").join(found.select(F.col("node").alias("rep")), "rep", "left_anti")
    whole = stored(whole.unionByName(single), "found")
    discard(links, more, found, joined)
    if needed is not None:
        needed += [all_rows, classes, whole]
    ids = all_rows.join(classes, ["n", "s1", "s2"], "left").join(whole, "rep", "left")
    linked = (F.col("n") > 0) & F.col("id").isNotNull()
    return ids.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(linked, F.coalesce("component", "rep")).otherwise(F.col("id")).alias("component_id"))


def _map_of(left: DataFrame) -> np.ndarray:
    """Bit map of the hashed ids in ``left``; its size follows their number up to ``MAP_BITS``."""
    size = 1 << 10
    while size < min(MAP_BITS, MAP_BITS_EACH * left.count()):
        size *= 2
    bits = left.select(F.pmod(F.xxhash64("rep"), F.lit(size)).alias("slot")).distinct()
    bits = bits.groupBy(F.expr("cast(slot div 32 as int)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot % 32 as int)))").alias("bits"))
    found = np.zeros(size // 32, np.uint32)
    for r in bits.toLocalIterator():  # at most MAP_BITS / 32 rows
        found[r.word] = r.bits
    return found
