"""Language-model scores by prediction by partial matching over bytes.

The model is a trie of byte contexts: how often each byte followed each context of up to ``ORDER`` bytes in
the training texts. A text is its lower-case words, each closed by a space, and one end; contexts reach
across words, and before the text there is padding. A byte is looked for in the longest context first; if it
never followed there, an escape is paid and the next shorter context is tried, with all followers of the
longer one excluded. A shorter context counts a byte once for each longer context in which it followed, as only
bytes that are new to the longer one come down to it. How likely an escape is, in a context of so many
occurrences and distinct followers that reaches so far into the word, is estimated from the training texts
themselves: each occurrence is left out in turn, and it counts whether its byte then needs the escape. States
seldom met lean towards as many escapes as distinct followers.

Work is split so that nothing whole passes through one place: blocks of documents send their own (context, byte)
pairs, packed and compressed, to parts of the trie, dealt by the three nearest context bytes (all levels from three
bytes on depend only on pairs that share them; the levels below have at most 2**24 pairs and are sent to all tasks).
A part merges the blocks' pairs, group of blocks by group of blocks, and scores go back to the blocks packed in the
same order. Words are counted beside for the add-one base score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import give_back, mix, split_words, stored, text_slices

#: Bytes of context; a pair of context and byte is packed in ORDER + 1 bytes of a long, the nearest context byte first.
ORDER = 6
#: Bytes of context that pairs of one part of the trie share.
NEAR = 3
#: Before and after a text; UTF-8 has neither byte.
PAD, END = 0xFF, 0xFE
#: The end of a text as a word; no word holds this byte.
END_WORD = "\n"
#: Text in one block of documents (fewer blocks repeat fewer pairs), and bytes looked at together in a block.
DOC_BLOCK_BYTES, AT_ONCE = 16_000_000, 1 << 20
#: Pairs gathered before they are merged into the block's.
GATHERED = 1 << 20
#: Text for one part of the trie, parts at least, and blocks whose pairs are merged in one call.
PART_BYTES, LEAST_PARTS, MERGED = 4_000_000, 64, 128
#: Grades (half powers of two) of occurrences and of followers for escape estimates, and the weight of the plain estimate.
GRADES, PRIOR = 32, 2.0
#: A-Z to a-z, white space to one space.
_PLAIN = bytes(range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\v\f\r", b"abcdefghijklmnopqrstuvwxyz     "))


def is_held_out(doc_id: object, modulus: int, rest: int) -> bool:
    """crc32 of the id as text, modulo; a null id is never held out."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % modulus == rest


def plain_bytes(texts: pa.Array | pa.ChunkedArray) -> bytes:
    """Padding, words each followed by a space, and the end, for each text (null: no words)."""
    before, after = bytes([PAD]) * ORDER, bytes([0x20, END])
    data = b"".join(before + (t or b"").translate(_PLAIN) + after for t in texts.cast(pa.large_binary()).to_pylist())
    data = np.frombuffer(data, np.uint8)
    space = data == 0x20
    keep = ~space
    keep[1:] |= ~(space[:-1] | (data[:-1] == PAD))
    return data[keep].tobytes()


def block_words(plain: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of a block, the end last; code and text of each word, then of each end."""
    texts = plain.translate(None, bytes([PAD])).split(bytes([END]))[:-1]
    size = np.cumsum([len(t) for t in texts], dtype=np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(size // AT_ONCE)) + 1), len(texts)]  # split about AT_ONCE bytes at a time
    coded, counts = [], []
    for start, end in zip(cuts[:-1], cuts[1:], strict=True):
        words, codes, offsets = split_words(pa.array(texts[start:end], pa.large_binary()).cast(pa.large_string()))
        coded.append(pa.DictionaryArray.from_arrays(pa.array(codes.astype(np.int32)), words.cast(pa.string())))
        counts.append(np.diff(offsets))
    coded = pa.chunked_array(coded).unify_dictionaries()
    words, codes = coded.chunk(0).dictionary, np.concatenate([c.indices.to_numpy() for c in coded.chunks])
    doc = np.arange(len(texts), dtype=np.int32)
    said = pa.concat_arrays([words, pa.array([END_WORD])])
    return said, np.concatenate([codes, np.full(len(texts), len(words), codes.dtype)]), np.concatenate([np.repeat(doc, np.concatenate(counts)), doc])


def byte_pairs(plain: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Packed (context, byte) pair of each byte that is not padding, and the text it belongs to, in pieces."""
    data, first = np.frombuffer(plain, np.uint8), 0
    for start in range(0, len(data), AT_ONCE):
        piece = data[start : start + AT_ONCE]
        packed = np.zeros(len(piece), np.int64)
        for back in [*range(1, ORDER + 1), 0]:
            shifted = data[max(0, start - back) : start + len(piece) - back]  # shorter only where the first padding is
            packed <<= 8
            packed[len(piece) - len(shifted) :] |= shifted
        keep = piece != PAD
        end = piece[keep] == END
        yield packed[keep], first + np.cumsum(end) - end
        first += int(end.sum())


def _by_key(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in ascending order and the sum of ``n`` for each."""
    order = np.argsort(key, kind="stable")
    return _runs(key[order], n[order])


def _runs(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same of keys in order."""
    if not len(key):
        return key, n.astype(float)
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[first], np.add.reduceat(n.astype(float), first)


def _get(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Values of sorted keys; 0 where a key is absent."""
    if not len(keys):
        return np.zeros(len(wanted))
    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[place] == wanted, values[place], 0.0)


def _cut(pairs: np.ndarray, level: int, to: int) -> np.ndarray:
    """Pairs of ``level`` context bytes with only the nearest ``to`` of them."""
    return pairs if level == to else (pairs >> (8 * (level - to + 1)) << 8) | (pairs & 0xFF)


def _level(key: np.ndarray, n: np.ndarray) -> tuple:
    """Pairs, counts, contexts, their occurrences and distinct followers."""
    key, n = key[n > 0], n[n > 0]
    return key, n, *_runs(key >> 8, n), _runs(key >> 8, np.ones(len(key)))[1]


def upper_levels(pairs: np.ndarray, counts: np.ndarray) -> list[tuple]:
    """Levels from ``NEAR`` context bytes on; ``pairs`` (ascending) must hold all that share their nearest bytes with one of them."""
    levels = [_level(pairs, counts)]
    for j in range(ORDER - 1, NEAR - 1, -1):
        key = _cut(levels[0][0], j + 1, j)
        levels.insert(0, _level(*_by_key(key, np.ones(len(key)))))
    return levels


def lower_levels(keys: np.ndarray, counts: np.ndarray) -> list[tuple]:
    """The levels below; ``keys`` are all pairs of ``NEAR`` - 1 context bytes (ascending)."""
    levels = [_level(keys, counts)]
    for j in range(NEAR - 2, -1, -1):
        key = _cut(levels[0][0], j + 1, j)
        levels.insert(0, _level(*_by_key(key, np.ones(len(key)))))
    return levels


def _state(levels: list[tuple], j: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Counts of the wanted pairs at level ``j``, occurrences and followers of their contexts, and how far these reach into the word.

    ``wanted`` has level ``j + 1`` (or ``ORDER``): what followed the longer context is excluded from the two.
    """
    key, n, context, total, followers = levels[j]
    own = _cut(wanted, min(ORDER, j + 1), j)
    here, t, d = _get(key, n, own), _get(context, total, own >> 8), _get(context, followers, own >> 8)
    if j < ORDER:
        longer_key, _, longer, _, longer_followers = levels[j + 1]
        cut_context, cut_total = _runs(longer_key >> 8, _get(key, n, _cut(longer_key, j + 1, j)))
        t = t - _get(cut_context, cut_total, wanted >> 8)
        d = d - _get(longer, longer_followers, wanted >> 8)
    reach = np.full(len(own), j)
    for k in range(j, 0, -1):
        reach = np.where((own >> (8 * (j - k + 1))) & 0xFF == 0x20, k - 1, reach)
    return here, t, d, reach


def _grade(x: np.ndarray) -> np.ndarray:
    return np.minimum(2 * np.log2(np.maximum(x, 1)), GRADES - 1).astype(np.int64)


def no_escapes() -> np.ndarray:
    """Finds and escapes by level, reach, and grades of occurrences and followers."""
    return np.zeros((ORDER + 1, ORDER + 1, GRADES, GRADES, 2))


def escape_counts(levels: list[tuple], which: range) -> np.ndarray:
    """Finds and escapes of the levels ``which``, each occurrence left out in turn.

    Only occurrences that come down to a level count there: those whose longer pair occurred once.
    """
    table = no_escapes()
    for j in which:
        if j == ORDER:
            wanted, weight = levels[j][:2]
            here, t, d, reach = _state(levels, j, wanted)
        else:
            wanted = levels[j + 1][0][levels[j + 1][1] == 1]
            weight = np.ones(len(wanted))
            here, t, d, reach = _state(levels, j, wanted)
            t, d = t + here, d + 1  # left out, the byte did not follow the longer context
        single = here == 1
        t, d = t - 1, d - single
        met = t > 0
        np.add.at(table[j], (reach[met], _grade(t[met]), _grade(d[met]), single[met].astype(np.int64)), weight[met])
    return table


def pair_scores(pairs: np.ndarray, levels: list[tuple], escapes: np.ndarray) -> np.ndarray:
    """log10 probability of each pair's byte after its context."""
    score, open_ = np.zeros(len(pairs)), np.ones(len(pairs), bool)
    for j in range(ORDER, -1, -1):
        here, t, d, reach = _state(levels, j, _cut(pairs, ORDER, min(ORDER, j + 1)))
        finds, misses = np.moveaxis(escapes[j][reach, _grade(t), _grade(d)], -1, 0)
        use = open_ & (t > 0)
        found = use & (here > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = (misses + PRIOR * d / (t + d)) / (finds + misses + PRIOR)
            score = np.where(found, score + np.log10((1 - escape) * here / t), score)
            score = np.where(use & ~found, score + np.log10(escape), score)
        open_ &= ~found
    rest = 256 - len(levels[0][0])  # bytes never seen at all share what is left evenly
    return np.where(open_, score - np.log10(max(1, rest)), score)


def _squeeze(a: np.ndarray, kind: str) -> bytes:
    return zstandard.compress(np.ascontiguousarray(a, kind).tobytes(), 3)


def _grow(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), kind)


def pack_pairs(pairs: np.ndarray) -> bytes:
    """Ascending pairs as differences, byte by byte."""
    step = np.diff(pairs, prepend=0).astype("<u8")
    return zstandard.compress(step.view(np.uint8).reshape(-1, 8).T.tobytes(), 3)


def unpack_pairs(data: bytes) -> np.ndarray:
    rows = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(rows.T).view("<u8").reshape(-1)).astype(np.int64)


def merged(packed: list[bytes], times: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of several packed arrays that occurred in training, with their counts."""
    pairs, n = _by_key(np.concatenate([unpack_pairs(x) for x in packed]), np.concatenate([_grow(x, "<u8") for x in times]))
    return pairs[n > 0], n[n > 0]


def _distinct(pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs, and the place of each pair among them."""
    order = np.argsort(pair)
    pair = pair[order]
    new = np.append(True, pair[1:] != pair[:-1]) if len(pair) else np.empty(0, bool)
    inverse = np.empty(len(pair), np.int32)
    inverse[order] = np.cumsum(new, dtype=np.int32) - 1
    return pair[new], inverse


def _ascending(pair: np.ndarray) -> np.ndarray:
    """Distinct pairs in ascending order."""
    pair = np.sort(pair)
    return pair[np.append(True, pair[1:] != pair[:-1])] if len(pair) else pair


def _counted(pair: np.ndarray, learned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs in ascending order, and how often each was ``learned``; the mark is sorted along below the pair's seven bytes."""
    both = np.sort((pair << 1) | learned)
    pair = both >> 1
    first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else np.empty(0, np.int64)
    return pair[first], np.add.reduceat(both & 1, first) if len(first) else np.empty(0, np.int64)


class BlockPairs:
    """Distinct pairs of a block in the order of the parts, with their training counts if the held-out texts are given."""

    def __init__(self, plain: bytes, parts: int, held: np.ndarray | None = None):
        self.pairs, self.n = np.empty(0, np.int64), np.empty(0, np.int32)
        waiting = []
        for pair, doc in byte_pairs(plain):
            waiting.append((_ascending(pair), None) if held is None else _counted(pair, ~held[doc]))
            if sum(len(p) for p, _ in waiting) >= GATHERED:
                self._add(waiting)
                waiting = []
        if waiting:
            self._add(waiting)
        near = self.pairs >> (8 * (ORDER - NEAR + 1))
        first = np.flatnonzero(np.append(True, near[1:] != near[:-1])) if len(near) else np.empty(0, np.int64)
        part = (mix(near[first].astype(np.uint64) + np.uint64(1)) % np.uint64(parts)).astype(np.int32)
        part = np.repeat(part, np.diff(np.append(first, len(near))))
        del near
        self.order = np.argsort(part, kind="stable")  # pairs ascend inside a part
        self.n = self.n[self.order] if held is not None else None
        part = part[self.order]
        self.first = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.empty(0, np.int64)
        self.parts = part[self.first].astype(np.int64)

    def _add(self, gathered: list[tuple]) -> None:
        """Merge distinct ascending pairs into those held; only the new ones move the others."""
        if gathered[0][1] is None:
            self.pairs = _ascending(np.concatenate([self.pairs, *[p for p, _ in gathered]]))
            return
        pairs, n = _by_key(*map(np.concatenate, zip(*gathered, strict=True)))
        n, place = n.astype(np.int32), np.searchsorted(self.pairs, pairs)
        known = place < len(self.pairs)
        known[known] = self.pairs[place[known]] == pairs[known]
        self.n[place[known]] += n[known]
        new = ~known
        self.pairs = np.insert(self.pairs, place[new], pairs[new])
        self.n = np.insert(self.n, place[new], n[new])

    def totals(self, plain: bytes, score: np.ndarray, texts: int) -> np.ndarray:
        """Sum over each text of ``score``, which is in the order of the parts."""
        each, total = np.empty(len(score)), np.zeros(texts)
        each[self.order] = score
        for pair, doc in byte_pairs(plain):
            if len(pair):
                runs = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
                pair, inverse = _distinct(pair)
                total[doc[runs]] += np.add.reduceat(each[np.searchsorted(self.pairs, pair)][inverse], runs)
        return total


def lm_scores(docs: DataFrame, modulus: int = 7, held_out: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every text; one row per row of ``docs``.

    Learns from rows whose crc32(id as text) modulo ``modulus`` is not ``held_out``. Tokens are the words
    ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case and one end. Columns: doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score (add-one unigram, log10), score (log10 probability by the trie). Null texts
    count as empty: the end alone. Rows without an id are learned from. Without any training row every
    byte has the even probability. Repeated rows count as often as they occur.
    """
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    block_schema = f"block long, ids array<{kind}>, held array<boolean>, plain binary"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, waiting, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for part in text_slices(batch):
                waiting.append(part)
                size += part["text"].nbytes
                if size >= DOC_BLOCK_BYTES:
                    yield packed(block, pa.concat_tables(waiting))
                    block, waiting, size = block + 1, [], 0
        if waiting:
            yield packed(block, pa.concat_tables(waiting))

    def packed(block: int, table: pa.Table) -> pa.RecordBatch:
        ids = table["id"].to_pylist()
        held = [is_held_out(i, modulus, held_out) for i in ids]
        arrays = [pa.array([block]), pa.array([ids], pa.list_(table["id"].type)), pa.array([held]), pa.array([zstandard.compress(plain_bytes(table["text"]), 3)])]
        give_back()
        return pa.RecordBatch.from_arrays(arrays, ["block", "ids", "held", "plain"])

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                said, codes, doc = block_words(zstandard.decompress(row["plain"]))
                n = np.bincount(codes, weights=~np.array(row["held"], bool)[doc], minlength=len(said)).astype(np.int64)
                del codes, doc
                give_back()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), row["block"])), pa.array(np.arange(len(n))), said, pa.array(n)], ["block", "pos", "word", "n"])

    picked = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    blocks = stored(picked.mapInArrow(count, block_schema), "lm-blocks")
    asked = blocks.select("block", "held", "plain").mapInArrow(words_of, "block long, pos long, word string, n long")
    sums = asked.groupBy("word").agg(F.sum("n").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count_if(F.col("n") > 0).alias("known"))
    tokens, known_words = stored(sums, "lm-words").first()

    size = picked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(LEAST_PARTS, min(1 << 20, size // PART_BYTES))
    rounds = F.floor(F.pmod(F.xxhash64("block"), F.lit(max(1, -(-blocks.count() // MERGED))))).cast("int")

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = BlockPairs(zstandard.decompress(row["plain"]), parts, np.array(row["held"], bool))
                ends = np.append(own.first[1:], len(own.pairs))
                pairs = [pack_pairs(own.pairs[own.order[a:b]]) for a, b in zip(own.first, ends, strict=True)]
                times = [_squeeze(own.n[a:b], "<u8") for a, b in zip(own.first, ends, strict=True)]
                arrays = [pa.array(np.full(len(pairs), row["block"])), pa.array(own.parts), pa.array(pairs, pa.binary()), pa.array(times, pa.binary())]
                del own, pairs, times
                give_back()
                yield pa.RecordBatch.from_arrays(arrays, ["block", "part", "pairs", "times"])

    messages = blocks.select("block", "held", "plain").mapInArrow(sent, "block long, part long, pairs binary, times binary")
    messages = stored(messages.withColumn("round", rounds), "lm-pairs")

    def merge(table: pa.Table) -> pa.Table:
        pairs, n = merged(table["pairs"].to_pylist(), table["times"].to_pylist())
        return pa.table({"part": table["part"][:1], "pairs": pa.array([pack_pairs(pairs)], pa.binary()), "times": pa.array([_squeeze(n, "<u8")], pa.binary())})

    def lowest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                key = upper_levels(unpack_pairs(row["pairs"]), _grow(row["times"], "<u8"))[0][0]
                key, n = _by_key(_cut(key, NEAR, NEAR - 1), np.ones(len(key)))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["key", "n"])

    packed_pairs = "part long, pairs binary, times binary"
    trie = messages.select("part", "round", "pairs", "times").groupBy("part", "round").applyInArrow(merge, packed_pairs).groupBy("part").applyInArrow(merge, packed_pairs)
    trie = stored(trie, "lm-trie")
    low = trie.mapInArrow(lowest, "key long, n double").groupBy("key").agg(F.sum("n").alias("n")).orderBy("key").collect()  # at most 2**24 rows
    low = lower_levels(np.array([r.key for r in low], np.int64), np.array([r.n for r in low]))
    shared = docs.sparkSession.sparkContext.broadcast(low)

    def escaped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = no_escapes().reshape(-1)
        for batch in batches:
            for row in batch.to_pylist():
                levels = shared.value + upper_levels(unpack_pairs(row["pairs"]), _grow(row["times"], "<u8"))
                total += escape_counts(levels, range(ORDER, NEAR - 2, -1)).reshape(-1)
        state = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(state), pa.array(total[state])], ["state", "n"])

    escapes = escape_counts(low, range(NEAR - 2, 0, -1))
    for r in trie.mapInArrow(escaped, "state long, n double").groupBy("state").agg(F.sum("n").alias("n")).collect():  # at most one row a state
        escapes.reshape(-1)[r.state] += r.n
    estimates = docs.sparkSession.sparkContext.broadcast(escapes)

    def scored(table: pa.Table, part: pa.Table) -> pa.Table:
        seen = [unpack_pairs(x) for x in table["pairs"].to_pylist()]
        known = [(unpack_pairs(x), _grow(y, "<u8")) for x, y in zip(part["pairs"].to_pylist(), part["times"].to_pylist(), strict=True)]
        every = np.unique(np.concatenate([np.empty(0, np.int64), *seen]))
        score = pair_scores(every, shared.value + upper_levels(*(known[0] if known else (np.empty(0, np.int64), np.empty(0)))), estimates.value).astype("<f4")
        return pa.table({"to_block": table["block"], "at": table["part"], "scores": pa.array([score[np.searchsorted(every, x)].tobytes() for x in seen], pa.binary())})

    each_round = messages.select(F.col("part").alias("to_part"), F.col("round").alias("to_round")).distinct()
    each_round = each_round.join(trie, F.col("to_part") == F.col("part")).select("to_part", "to_round", "pairs", "times")
    by_pair = messages.select("block", "part", "round", "pairs").groupBy("part", "round").cogroup(each_round.groupBy("to_part", "to_round")).applyInArrow(scored, "to_block long, at long, scores binary")
    by_pair = by_pair.select("to_block", "at", F.lit(None).cast("long").alias("n"), "scores")
    whole = F.sum("n").over(Window.partitionBy("word"))  # at most one row a block
    by_word = asked.select(F.col("block").alias("to_block"), F.col("pos").alias("at"), whole.alias("n"), F.lit(None).cast("binary").alias("scores"))
    back = by_pair.unionByName(by_word)

    def text_scores(table: pa.Table, known: pa.Table) -> pa.Table:
        out = {"doc_id": [], "held_out": [], "n_tokens": [], "n_known": [], "base_score": [], "score": []}
        is_word = known["n"].is_valid().to_numpy()
        at, times_of = known["at"].to_numpy(), known["n"].fill_null(0).to_numpy()
        n = np.zeros(int(is_word.sum()))
        n[at[is_word]] = times_of[is_word]
        by_part = known.filter(pa.array(~is_word)).sort_by("at")["scores"].to_pylist()
        score = np.frombuffer(b"".join(by_part), "<f4").astype(float)
        base = np.log10((n + 1) / (tokens + known_words + 1))
        for row in table.to_pylist():
            plain, texts = zstandard.decompress(row["plain"]), len(row["ids"])
            _, codes, doc = block_words(plain)
            total = lambda each: np.bincount(doc, weights=each, minlength=texts)  # noqa: B023, E731
            sums = total(np.ones(len(codes))).astype(np.int64), total((n > 0)[codes]).astype(np.int64), total(base[codes])
            del codes, doc
            give_back()
            whole = BlockPairs(plain, parts).totals(plain, score, texts)
            give_back()
            for name, values in zip(out, (row["ids"], row["held"], *sums, whole), strict=True):
                out[name].extend(values)
        types = {"doc_id": table["ids"].type.value_type, "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64()}
        return pa.table({c: pa.array(v, types.get(c, pa.float64())) for c, v in out.items()})

    done = blocks.groupBy("block").cogroup(back.groupBy("to_block")).applyInArrow(text_scores, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return done.withColumn("train_tokens", F.lit(int(tokens)).cast("long"))
