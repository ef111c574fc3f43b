"""Prefix trie of conversations by partition refinement.

A node is a class of conversations that share their first turns. All conversations start in one class, the root.
Each round looks at one more turn: every active class is split by it, and the classes that come out are the nodes of
the next depth. A class that holds one distinct sequence is retired: the rest of its turns are a unary chain and are
emitted as they are, without further rounds. Classes whose sequences have at most ``LOCAL_ROWS`` turns left in all are
refined to their ends inside one task, in the same way; only larger ones need another round over the cluster. At last
what is summed over subtrees is folded back, depth by depth, from the deepest round to the root.

Equal conversations are one sequence with a weight from the start, so a conversation that is copied a million times
retires like any other. The ids of the copies are hashed as they stream by in order and are never held together.
Turns are compared by 128 bits of SHA-256; texts are read once and not exchanged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import discard, stored

#: Turns that the sequences of a class may have left in all to be refined inside one task.
LOCAL_ROWS = 20_000
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
NOTHING = hashlib.sha256(b"").hexdigest()


def turn_keys(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, key (of role and text; null is empty) and the text's UTF-8 bytes. Rows without an id are no turn of any conversation."""
    role, text = (F.coalesce(rows[c], F.lit("")) for c in (role_col, text_col))
    key = F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)
    return rows.select(rows[id_col].cast("long").alias("conv_id"), rows[turn_col].alias("turn"), key.alias("key"), F.octet_length(text).cast("long").alias("bytes")).where("conv_id is not null")


def head_length(conv_id: Column) -> Column:
    """Turns that a conversation takes from the first of its five."""
    return (F.crc32(conv_id.cast("string")) % 9).cast("int")


def rebuilt(turns: DataFrame) -> DataFrame:
    """conv_id, depth, key, bytes: turns of the rebuilt conversations from depth 1 on, and a row of depth 0 for each.

    Conversation c takes the first h turns of conversation c - c % 5 (fewer if it has fewer) and then its own behind
    its first h; turns of one number go by key. The up to nine conversations of one head are exchanged together.
    """
    head = F.col("conv_id") - F.col("conv_id") % 5
    df = turns.withColumn("head", head).repartition("head")
    df = df.withColumn("at", F.row_number().over(Window.partitionBy("head", "conv_id").orderBy(F.col("turn").asc_nulls_first(), "key")))
    # each conversation learns of its head's length, and the head of the conversations that take its turns
    first, family = F.col("conv_id") == F.col("head"), Window.partitionBy("head")
    df = df.withColumn("head_size", F.coalesce(F.max(F.when(first, F.col("at"))).over(family), F.lit(0))).withColumn("members", F.collect_set("conv_id").over(family))
    own = F.when(F.col("at") > head_length(F.col("conv_id")), F.array(F.struct("conv_id", (F.col("at") - head_length(F.col("conv_id")) + F.least(head_length(F.col("conv_id")), "head_size")).cast("long").alias("depth"))))
    taking = F.when(first, F.filter("members", lambda c: F.col("at") <= head_length(c)))
    taken = F.transform(taking, lambda c: F.struct(c.alias("conv_id"), F.col("at").cast("long").alias("depth")))
    start = F.when(F.col("at") == 1, F.array(F.struct("conv_id", F.lit(0).cast("long").alias("depth"))))
    none = F.array().cast("array<struct<conv_id:bigint,depth:bigint>>")
    places = F.concat(*[F.coalesce(x, none) for x in (own, taken, start)])
    df = df.select(F.explode(places).alias("p"), "key", "bytes")
    turn = F.col("p.depth") > 0
    return df.select("p.conv_id", "p.depth", F.when(turn, F.col("key")).alias("key"), F.when(turn, F.col("bytes")).otherwise(0).alias("bytes"))


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(s1, s2, size, conv_id) in order -> one row a sequence: first id, size, number of ids, digest of all ids."""
    open_key, first, count, digest = None, 0, 0, None

    def closed(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        return pa.record_batch([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3])], ["conv_id", "size", "weight", "ends_sha256"])

    for batch in batches:
        if not batch.num_rows:
            continue
        s1, s2, size, ids = (batch[c].to_numpy(zero_copy_only=False) for c in ("s1", "s2", "size", "conv_id"))
        new = np.flatnonzero((s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1]) | (size[1:] != size[:-1])) + 1
        out = []
        for a, b in zip([0, *new.tolist()], [*new.tolist(), len(ids)], strict=True):
            key = (int(s1[a]), int(s2[a]), int(size[a]))
            if key != open_key:
                if digest is not None:
                    out.append((first, open_key[2], count, digest.hexdigest()))
                open_key, first, count, digest = key, int(ids[a]), 0, hashlib.sha256()
            digest.update(((b"," if count else b"") + ",".join(map(str, ids[a:b].tolist())).encode()))
            count += b - a
        if out:
            yield closed(out)
    if digest is not None:
        yield closed([(first, open_key[2], count, digest.hexdigest())])


def sequences(rows: DataFrame) -> DataFrame:
    """Distinct sequences of rebuilt turns: conv_id (the smallest that has it), size, weight (conversations), ends_sha256."""
    seeds = [F.xxhash64(F.lit(seed), "depth", "key") for seed in (1, 2)]
    of_turn = [F.when(F.col("depth") > 0, s) for s in seeds]
    whole = rows.groupBy("conv_id").agg(*[F.coalesce(F.bit_xor(s), F.lit(0)).alias(f"s{i}") for i, s in enumerate(of_turn, 1)], F.max("depth").alias("size"))
    order = whole.repartition("s1", "s2", "size").sortWithinPartitions("s1", "s2", "size", "conv_id")
    return order.select("s1", "s2", "size", "conv_id").mapInArrow(_ends, "conv_id long, size long, weight long, ends_sha256 string")


def _refined(table: pa.Table) -> pa.Table:
    """All nodes below the top of a class, and what is summed over its subtree.

    ``table``: rows (class, top_depth, conv_id, weight, size, ends_sha256, depth, key, bytes), one per turn beyond the top,
    and one of null depth for a sequence that ends there.
    """
    table = table.sort_by([("conv_id", "ascending"), ("depth", "ascending")])
    ids, start = np.unique(table["conv_id"].to_numpy(), return_index=True)
    top, label = table["top_depth"][0].as_py(), table["class"][0].as_py()
    weight, size = table["weight"].to_numpy()[start], table["size"].to_numpy()[start]
    if (np.diff([*start, len(table)]) != np.maximum(1, size - top)).any():
        raise ValueError("turns of a sequence are missing or repeated")
    ends = table["ends_sha256"].take(pa.array(start)).to_pylist()
    codes, nbytes = table["key"].combine_chunks().dictionary_encode(), table["bytes"].to_numpy(zero_copy_only=False)
    if isinstance(codes, pa.ChunkedArray):
        codes = codes.combine_chunks()
    codes = codes.indices.to_numpy(zero_copy_only=False)
    out: list[list] = []  # node: first, depth, parent, n_convs, children, leaves, saved, ends; children come behind their parents
    parent_of: list[int] = []

    def node(members: np.ndarray, at: int, parent: int, last_bytes: int) -> int:
        n = int(weight[members].sum())
        done = [ends[m] for m in members if size[m] == at]
        out.append([int(ids[members[0]]), at, out[parent][0] if parent >= 0 else None, n, 0, 0, (n - 1) * last_bytes, done[0] if done else NOTHING])
        parent_of.append(parent)
        return len(out) - 1

    active = [(np.arange(len(ids)), top, node(np.arange(len(ids)), top, -1, 0))]
    while active:
        members, at, own = active.pop()
        if len(members) == 1:  # retired: the rest is a unary chain
            m = members[0]
            for d in range(at + 1, int(size[m]) + 1):
                own = node(members, d, own, int(nbytes[start[m] + d - top - 1]))
            continue
        members = members[size[members] > at]
        if not len(members):
            continue
        places = start[members] + at - top
        found = codes[places]
        order = np.argsort(found, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(found[order])) + 1):
            group = np.sort(group)
            active.append((members[group], at + 1, node(members[group], at + 1, own, int(nbytes[places[group[0]]]))))
    for i in range(len(out) - 1, -1, -1):  # fold back
        x = out[i]
        x[5] = max(1, x[5])
        if parent_of[i] >= 0:
            p = out[parent_of[i]]
            p[4] += 1
            p[5] += x[5]
            p[6] += x[6]
    columns = list(zip(*out, strict=True))
    kinds = [pa.int64()] * 7 + [pa.string()]
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    made = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
    return pa.table([pa.array([label] * len(out), pa.binary()), pa.array([i == 0 for i in range(len(out))]), *made], ["class", "top", *names])


def _chains(rows: DataFrame, lone: DataFrame) -> DataFrame:
    """Nodes of retired classes below their tops: every turn of the one sequence that is left."""
    df = rows.join(lone, "conv_id").where("depth > top_depth")
    below = Window.partitionBy("conv_id").orderBy(F.col("depth").desc())
    last = F.col("depth") == F.col("size")
    return df.select(
        "conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), F.col("weight").alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        F.sum((F.col("weight") - 1) * F.col("bytes")).over(below).alias("saved_tokens"), F.when(last, F.col("ends_sha256")).otherwise(NOTHING).alias("ends_sha256"),
    )


def trie(conversations: DataFrame, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """Nodes of the prefix trie of rebuilt conversations: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns go by ``turn`` (null first); turns of one number in one conversation, repeated rows among them, by their
    content's hash. Null roles and texts are empty. Rows without conv_id belong to no conversation and are left out.
    Other columns are not carried on, so their names cannot clash. An empty table gives no node, not even a root.
    """
    rows = stored(rebuilt(turn_keys(conversations)), "trie-turns")
    known = stored(sequences(rows), "trie-sequences")
    root = F.unhex(F.sha2(F.lit("root"), 256)).substr(1, 16)
    active = known.select(root.alias("class"), "conv_id", "weight", "size", "ends_sha256")
    at, levels, spent = 0, [], [known]
    nodes = active.groupBy("class").agg(F.lit(None).cast("binary").alias("parent"), F.min("conv_id").alias("conv_id"), F.sum("weight").alias("n_convs"), F.lit(0).cast("long").alias("bytes"), F.max(F.when(F.col("size") == 0, F.col("ends_sha256"))).alias("ends_sha256"), F.lit(False).alias("small"), F.lit(False).alias("lone"))
    levels.append(stored(nodes, "trie-nodes"))
    settled: list[DataFrame] = []
    while True:
        at += 1
        # one more turn: the class of a sequence is the class before and that turn
        turn = rows.where(F.col("depth") == at).select("conv_id", "key", "bytes")
        step = active.where(F.col("size") >= at).join(turn, "conv_id")
        step = step.withColumn("parent", F.col("class")).withColumn("class", F.substring(F.unhex(F.sha2(F.concat("class", "key"), 256)), 1, 16)).drop("key")
        step = stored(step, "trie-classes")
        spent.append(step)
        left = F.sum(F.col("size") - at)
        nodes = step.groupBy("class").agg(
            F.first("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.sum("weight").alias("n_convs"), F.first("bytes").alias("bytes"),
            F.max(F.when(F.col("size") == at, F.col("ends_sha256"))).alias("ends_sha256"), (left <= local_rows).alias("small"), (F.count("*") == 1).alias("lone"),
        )
        nodes = stored(nodes, "trie-nodes")
        levels.append(nodes)
        state = step.drop("parent", "bytes").join(nodes.select("class", "small", "lone"), "class").withColumn("top_depth", F.lit(at).cast("long"))
        settled.append(state.where("small or lone"))
        active = state.where("not small and not lone").select("class", "conv_id", "weight", "size", "ends_sha256")
        if nodes.where("not small and not lone").isEmpty():
            break
    done = settled[0]
    for more in settled[1:]:
        done = done.unionByName(more)
    done = stored(done, "trie-settled")
    chains = _chains(rows, done.where("lone").select("conv_id", "weight", "size", "ends_sha256", "top_depth"))
    several = done.where("not lone").select("class", "top_depth", "conv_id", "weight", "size", "ends_sha256")
    turns = rows.where("depth > 0").withColumnRenamed("conv_id", "c").withColumnRenamed("depth", "d")
    turns = several.join(turns, (F.col("c") == F.col("conv_id")) & (F.col("d") > F.col("top_depth")), "left").drop("c").withColumnRenamed("d", "depth")
    schema = "class binary, top boolean, " + NODE
    refined = stored(turns.groupBy("class").applyInArrow(_refined, schema), "trie-refined")
    # fold back: a settled class brings its sums, the others have those of their children
    sums = refined.where("top").select("class", "n_children", "n_leaves", "saved_tokens")
    whole = done.where("lone").select("class", (F.col("size") > F.col("top_depth")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), "conv_id")
    saved = chains.groupBy("conv_id").agg(F.max("saved_tokens").alias("saved_tokens"))
    sums = sums.unionByName(whole.join(saved, "conv_id", "left").select("class", "n_children", "n_leaves", F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens")))
    sums = stored(sums, "trie-sums")
    out, below = [], None
    for nodes in reversed(levels):
        settled_sums = nodes.join(sums, "class", "left")
        if below is not None:
            inner = below.groupBy("parent").agg(F.count("*").alias("c"), F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s")).withColumnRenamed("parent", "p")
            settled_sums = settled_sums.join(inner, F.col("p") == F.col("class"), "left")
            pick = [F.coalesce("n_children", "c", F.lit(0)).alias("n_children"), F.coalesce("n_leaves", "l", F.lit(1)).alias("n_leaves"), F.coalesce("saved_tokens", "s", F.lit(0)).alias("below")]
        else:
            pick = [F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).alias("below")]
        folded = settled_sums.select("class", "parent", "conv_id", "n_convs", "bytes", F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"), *pick)
        below = stored(folded.withColumn("saved_tokens", F.col("below") + (F.col("n_convs") - 1) * F.col("bytes")).drop("below", "bytes"), "trie-folded")
        out.append(below)
    out.reverse()
    columns = NODE.replace(" long", "").replace(" string", "").split(", ")
    found = refined.where("not top").select(*columns).unionByName(chains.select(*columns))
    for depth, nodes in enumerate(out):
        above = out[depth - 1].select(F.col("class").alias("p"), F.col("conv_id").alias("parent_conv_id")) if depth else None
        named = nodes.join(above, F.col("p") == F.col("parent")) if depth else nodes.withColumn("parent_conv_id", F.lit(None).cast("long"))
        found = found.unionByName(named.withColumn("depth", F.lit(depth).cast("long")).select(*columns))
    discard(*spent, *levels, sums)
    return found
