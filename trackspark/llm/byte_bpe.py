"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Pre-token boundaries are found without regular expressions. Each code point gets a class (with one
look ahead: is it white space before a non-space, an apostrophe before a contraction's letters), each
class is a function from the automaton's states to its states, and functions compose associatively: the
text is cut into strips, all strips compose their functions side by side from every state, the strips'
functions are scanned, and a second sweep from the known states marks the first code point of each
match. The slices are byte ranges of the text's own buffer; distinct slices go through cached pair
merging, and the offsets of tokens and texts are kept for decoding.

The automaton is that of the pattern of the public rank files::

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ._common import ragged_take, text_slices
from .token_counts import PairTable, merge_all

# classes of code points
LETTER, NUMBER, OTHER, SPACE, WHITE = range(5)
# symbols of the automaton: the classes after look-ahead
S_LETTER, S_NUMBER, S_OTHER, S_SHORT, S_LONG, S_JOIN, S_LONE, S_RUN = range(8)
# states: nothing open, inside a run of letters, numbers, others, after a space that joins what follows,
# inside a run of white space, one or two letters of a contraction still to come
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, JOINED, IN_WHITE, ONE_MORE, TWO_MORE = range(8)
STATES = SYMBOLS = 8
#: Code points composed in one strip.
STRIP = 512


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state, and whether the code point begins a match, by (begins its text, symbol, state)."""
    opened = {S_LETTER: IN_LETTERS, S_NUMBER: IN_NUMBERS, S_OTHER: IN_OTHERS, S_SHORT: ONE_MORE, S_LONG: TWO_MORE, S_JOIN: JOINED, S_LONE: FRESH, S_RUN: IN_WHITE}
    goes_on = {IN_LETTERS: {S_LETTER}, IN_NUMBERS: {S_NUMBER}, IN_OTHERS: {S_OTHER, S_SHORT, S_LONG}, JOINED: {S_LETTER, S_NUMBER, S_OTHER, S_SHORT, S_LONG}, IN_WHITE: {S_RUN}}
    to, begins = np.zeros((2, SYMBOLS, STATES), np.uint8), np.ones((2, SYMBOLS, STATES), bool)
    for symbol in range(SYMBOLS):
        for state in range(STATES):
            target, begin = opened[symbol], True
            if state in (ONE_MORE, TWO_MORE):
                target, begin = (FRESH if state == ONE_MORE else ONE_MORE), False
            elif symbol in goes_on.get(state, ()):
                target, begin = (IN_OTHERS if symbol in (S_SHORT, S_LONG) else opened[symbol]), False
            to[0, symbol, state], begins[0, symbol, state] = target, begin
            to[1, symbol, state] = opened[symbol]
    return to.reshape(-1), begins.reshape(-1)


NEXT, BEGINS = _automaton()


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """Class of every code point."""
    import regex

    out = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, range(0xD800))) + "".join(map(chr, range(0xE000, 0x110000)))
    for name, code in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", WHITE)):
        for m in regex.finditer(name, every):
            a, b = m.span()
            out[[i if i < 0xD800 else i + 0x800 for i in range(a, b)]] = code
    out[0x20] = SPACE
    return out


def boundaries(points: np.ndarray, begins_text: np.ndarray) -> np.ndarray:
    """Whether each code point begins a pre-token; ``begins_text``: whether it begins a text."""
    n = len(points)
    if not n:
        return np.zeros(0, bool)
    kind = class_table()[points]
    ends_text = np.append(begins_text[1:], True)
    white = kind >= SPACE
    before_word = np.append(~white[1:], False) & ~ends_text
    symbol = kind.copy()
    symbol[white] = S_RUN
    symbol[white & before_word] = S_LONE
    symbol[(kind == SPACE) & before_word] = S_JOIN
    quote = np.flatnonzero(points == 0x27)
    if len(quote):
        padded = np.append(points, [0, 0])
        first, second = padded[quote + 1], padded[quote + 2]
        has_one = ~ends_text[quote]
        has_two = has_one & ~np.append(ends_text, [True, True])[quote + 1]
        letter = lambda a, c: a == ord(c)
        short = has_one & (letter(first, "s") | letter(first, "t") | letter(first, "m") | letter(first, "d"))
        long = has_two & ((letter(second, "e") & (letter(first, "r") | letter(first, "v"))) | (letter(first, "l") & letter(second, "l")))
        symbol[quote[short]], symbol[quote[long]] = S_SHORT, S_LONG
    step = (symbol + SYMBOLS * begins_text.astype(np.uint8)).astype(np.uint8)
    strips = -(-n // STRIP)
    grid = np.full(strips * STRIP, S_OTHER, np.uint8)
    grid[:n] = step
    grid = np.ascontiguousarray(grid.reshape(strips, STRIP).T).astype(np.int16) * STATES
    # every strip's function: where each state leads
    function = np.tile(np.arange(STATES, dtype=np.int16), (strips, 1))
    for row in grid:
        function = NEXT[row[:, None] + function].astype(np.int16)
    # prefix scan of the functions by doubling: composition is associative
    scanned, width = function, 1
    while width < strips:
        after = scanned.copy()
        after[width:] = np.take_along_axis(scanned[width:], scanned[:-width].astype(np.int64), axis=1)
        scanned, width = after, width * 2
    state = np.concatenate([[FRESH], scanned[:-1, FRESH]]).astype(np.int16)
    out = np.empty((STRIP, strips), bool)
    for j, row in enumerate(grid):
        at = row + state
        out[j] = BEGINS[at]
        state = NEXT[at].astype(np.int16)
    return out.T.reshape(-1)[:n]


class RankFile:
    """Ranks of byte strings; merging is by rank of the joined bytes."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        size = max(self.rank.values()) + 1
        self.token = [b""] * size
        for raw, i in self.rank.items():
            self.token[i] = raw
        self.single = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        left, right, joined = [], [], []
        for raw, i in sorted(self.rank.items(), key=lambda x: x[1]):
            for cut in range(1, len(raw)):
                a, b = self.rank.get(raw[:cut]), self.rank.get(raw[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    joined.append(i)
        # pairs that join to the same bytes have the same rank: their order among themselves is free
        self.pairs = PairTable(np.array(left), np.array(right), np.array(joined))
        self.decimal = pa.array([f"{i} " for i in range(size)], pa.large_string())
        self.bytes = pa.array(self.token, pa.large_binary())


@lru_cache(maxsize=2)
def ranks(path: str) -> RankFile:
    return RankFile(path)


class SliceCache:
    """Ids of distinct pre-tokens, kept from batch to batch up to a number of pre-tokens."""

    def __init__(self, path: str, limit: int = 600_000):
        self.file, self.limit = ranks(path), limit
        self.clear()

    def clear(self) -> None:
        self.slot: dict[bytes, int] = {}
        self.ids, self.start, self.n = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def slots(self, pieces: list[bytes]) -> np.ndarray:
        if len(self.slot) > self.limit:
            self.clear()
        new = [p for p in pieces if p not in self.slot]
        if new:
            size = np.fromiter(map(len, new), np.int64, len(new))
            symbols = self.file.single[np.frombuffer(b"".join(new), np.uint8)]
            ids, n = merge_all(symbols, size, self.file.pairs)
            self.slot.update(zip(new, range(len(self.n), len(self.n) + len(new)), strict=True))
            self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(n) - n])
            self.ids, self.n = np.concatenate([self.ids, ids]), np.concatenate([self.n, n])
        return np.fromiter(map(self.slot.__getitem__, pieces), np.int64, len(pieces))


def encode_texts(texts: pa.Array, cache: SliceCache) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all texts one after another, offsets by text, and the first byte of each token in its text's buffer."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    heads = np.flatnonzero((data & 0xC0) != 0x80)  # first byte of each code point
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    begins_text = np.zeros(len(points), bool)
    filled = at[:-1][np.diff(at) > 0]
    begins_text[np.searchsorted(heads, filled)] = True
    cut = heads[boundaries(points, begins_text)]
    edges = np.append(cut, len(data)).astype(np.int64)
    pieces = pa.Array.from_buffers(pa.large_binary(), len(cut), [None, pa.py_buffer(edges), pa.py_buffer(data.tobytes())]).dictionary_encode()
    slot = cache.slots(pieces.dictionary.to_pylist())
    slot = slot[pieces.indices.to_numpy()] if len(cut) else np.empty(0, np.int64)
    n = cache.n[slot]
    each = np.concatenate([[0], np.cumsum(n)])
    ids = ragged_take(cache.ids, cache.start[slot], n)
    size = np.fromiter(map(len, cache.file.token), np.int64, len(cache.file.token))[ids]
    return ids, each[np.searchsorted(cut, at)], np.cumsum(size) - size


def taken(items: pa.Array, ids: np.ndarray, offsets: np.ndarray) -> list[memoryview]:
    """Items by id, joined without a separator, for each text. With ``RankFile.bytes`` this decodes."""
    found = items.take(pa.array(ids)).cast(pa.large_binary())
    ends = np.frombuffer(found.buffers()[1], np.int64)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
    data = memoryview(found.buffers()[2] or b"")
    edges = ends[offsets]
    return [data[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


def byte_bpe(docs: DataFrame, rank_path: str, keep_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each text and decode its ids again; one row per row of ``docs``.

    Columns: doc_id, n_tokens, ids_sha256 (of the decimal ids joined by one space), decoded_sha256, and
    with ``keep_ids`` ids and token_starts (first byte of each token in the text). Null texts count as
    empty: no ids. Repeated rows, null ids and further columns are harmless.
    """
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, token_starts array<long>" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = SliceCache(rank_path)
        for batch in batches:
            for part in text_slices(batch):
                ids, offsets, starts = encode_texts(part["text"], cache)
                said = [hashlib.sha256(b[:-1]).hexdigest() for b in taken(cache.file.decimal, ids, offsets)]
                back = [hashlib.sha256(b).hexdigest() for b in taken(cache.file.bytes, ids, offsets)]
                columns = [part["id"].combine_chunks(), pa.array(np.diff(offsets)), pa.array(said), pa.array(back)]
                if keep_ids:
                    lists = offsets.astype(np.int32)
                    base = np.repeat(starts[np.minimum(offsets[:-1], max(0, len(starts) - 1))], np.diff(offsets)) if len(ids) else starts
                    columns += [pa.ListArray.from_arrays(lists, pa.array(ids, pa.int32())), pa.ListArray.from_arrays(lists, pa.array(starts - base))]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, schema)
