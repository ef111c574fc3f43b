"""Token counts by rank-synchronous array merging.

Distinct white-space-free pieces of text are normalised and cut into pre-tokens; a batch of
pre-tokens is one ragged array of symbol ids. In every round each pre-token's lowest-rank pair is
merged at all its places at once, for all pre-tokens together, until none has a known pair. The
symbols that survive are the tokens.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ._common import ragged_take, split_words, text_slices

NO_RANK = np.int32(2**31 - 1)
#: Finds a code point from the first unassigned one on; below, all tables agree.
BEYOND_GREEK = re.compile("[\u0378-\U0010ffff]").search
#: Pre-tokens merged at once, in symbols.
CHUNK_SYMBOLS = 2_000_000
#: Distinct pieces kept between batches in one Python worker.
CACHE_WORDS = 600_000


class PairTable:
    """Open-addressing table in arrays: (left, right) -> rank and merged symbol."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(left)) * 4))))
        size = 1 << self.bits
        self.key, self.rank = np.full(size, -1, np.int64), np.full(size, NO_RANK, np.int32)
        self.merged = np.asarray(merged, np.int32)
        key = (left.astype(np.int64) << 32) | right
        todo, slot = np.arange(len(key)), self._slot(key)
        while len(todo):  # parallel insertion: the first claimant of a free slot wins, the rest probe on
            free = self.key[slot] == -1
            first = np.unique(slot[free], return_index=True)[1]
            won = np.flatnonzero(free)[first]
            self.key[slot[won]], self.rank[slot[won]] = key[todo[won]], todo[won]
            rest = np.ones(len(todo), bool)
            rest[won] = False
            todo, slot = todo[rest], (slot[rest] + 1) & (size - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.int64) << 32) | right
        slot = self._slot(key)
        found = self.key[slot]
        out = np.where(found == key, self.rank[slot], NO_RANK)
        todo = np.flatnonzero((found != key) & (found != -1))
        while len(todo):
            slot_t = slot[todo] = (slot[todo] + 1) & (len(self.key) - 1)
            found = self.key[slot_t]
            hit = found == key[todo]
            out[todo[hit]] = self.rank[slot_t[hit]]
            todo = todo[~hit & (found != -1)]
        return out


def merge_all(symbols: np.ndarray, lengths: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Merge each sequence's lowest-rank pair, all sequences at once, to the end: symbols and lengths."""
    symbols, lengths = symbols.astype(np.int32), lengths.astype(np.int64)
    done_symbols, done_seq = [], []
    seq = np.repeat(np.arange(len(lengths)), lengths)
    rank = np.full(len(symbols), NO_RANK, np.int32)
    fresh = np.flatnonzero(seq[:-1] == seq[1:]) if len(seq) else np.empty(0, np.int64)
    rank[fresh] = table.lookup(symbols[fresh], symbols[fresh + 1])
    while len(symbols):
        first = np.flatnonzero(np.concatenate([[True], seq[1:] != seq[:-1]]))
        counts = np.diff(np.append(first, len(seq)))
        low = np.repeat(np.minimum.reduceat(rank, first), counts)
        live = low != NO_RANK
        if not live.all():  # sequences without a known pair are finished
            done_symbols.append(symbols[~live])
            done_seq.append(seq[~live])
            symbols, seq, rank, low = symbols[live], seq[live], rank[live], low[live]
            if not len(symbols):
                break
        at = rank == low
        # a pair of equal symbols can overlap itself: of a run of places take every second one
        if (at[1:] & at[:-1]).any():
            pos = np.arange(len(at))
            start = np.maximum.accumulate(np.where(at & ~np.concatenate([[False], at[:-1]]), pos, 0))
            at &= ((pos - start) & 1) == 0
        where = np.flatnonzero(at)
        symbols[where] = table.merged[low[where]]
        keep = np.ones(len(symbols), bool)
        keep[where + 1] = False
        place = (np.cumsum(keep) - 1)[where]
        symbols, seq, rank = symbols[keep], seq[keep], rank[keep]
        near = np.zeros(len(symbols), bool)
        near[place] = True
        near[:-1] |= near[1:]
        again = np.flatnonzero(near)
        rank[again] = NO_RANK
        again = again[again + 1 < len(seq)]
        again = again[seq[again] == seq[again + 1]]
        rank[again] = table.lookup(symbols[again], symbols[again + 1])
    if not done_seq:
        return symbols, np.zeros(len(lengths), np.int64)
    seq, symbols = np.concatenate(done_seq), np.concatenate(done_symbols)
    order = np.argsort(seq, kind="stable")
    return symbols[order], np.bincount(seq, minlength=len(lengths))


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself if visible, else from U+0100 on."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    shown, extra = {b: chr(b) for b in visible}, 0
    for b in range(256):
        if b not in shown:
            shown[b] = chr(256 + extra)
            extra += 1
    return [shown[b] for b in range(256)]


@lru_cache(maxsize=1)
def young_letters():
    """Pattern for what Python's Unicode tables leave unassigned, private use and surrogates aside."""
    import regex

    points = np.array([i for i in range(0x80, 0xE0000) if unicodedata.category(chr(i)) == "Cn"])
    runs = np.split(points, np.flatnonzero(np.diff(points) != 1) + 1)
    return regex.compile("[" + "".join(f"\\U{r[0]:08x}-\\U{r[-1]:08x}" for r in runs) + "]")


class WordVocabulary:
    """A tokenizer file of the kind BPE with word ends, byte level, lower case, white space dropped."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, end = spec["model"], spec["model"]["end_of_word_suffix"]
        vocab = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.table = PairTable(np.array([vocab[a] for a, _ in pairs]), np.array([vocab[b] for _, b in pairs]), np.array([vocab[a + b] for a, b in pairs]))
        shown = byte_symbols()
        self.inner = np.array([vocab[c] for c in shown], np.int32)
        self.last = np.array([vocab[c + end] for c in shown], np.int32)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.path, self.shown = path, {c: b for b, c in enumerate(shown)}

    def pre_tokens(self, piece: str) -> list[str]:
        """Pre-tokens of a piece of text that holds no special string."""
        if not piece.isascii():
            if BEYOND_GREEK(piece) and young_letters().search(piece):
                return self.library_pre_tokens(piece)
            piece = unicodedata.normalize("NFC", piece)
            piece = "".join(c.lower() for c in piece) if "Σ" in piece else piece.lower()
        elif piece.isalpha():
            return [piece.lower()]
        else:
            piece = piece.lower()
        return self.pattern.findall(piece)

    def library_pre_tokens(self, piece: str) -> list[str]:
        """The same from the library, for code points on whose class Unicode versions differ."""
        from tokenizers import Tokenizer

        if not hasattr(self, "library"):
            self.library = Tokenizer.from_file(self.path)
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(piece))
        return [bytes(self.shown[c] for c in part).decode("utf-8", "surrogateescape") for part, _ in found]

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and the number of each word's ids."""
        flat, owner, fixed = [], [], []  # fixed: place of a special token among the pre-tokens
        for i, word in enumerate(words):
            parts = self.split_special.split(word) if self.split_special and "<|" in word else [word]
            for part in parts:
                if part in self.special:
                    fixed.append((len(flat), self.special[part]))
                    flat.append("\0")
                    owner.append(i)
                elif part:
                    found = self.pre_tokens(part)
                    flat += found
                    owner += [i] * len(found)
        coded = [p.encode("utf-8", "surrogateescape") for p in flat]
        size = np.fromiter(map(len, coded), np.int64, len(coded))
        data = np.frombuffer(b"".join(coded), np.uint8)
        ends = np.cumsum(size)
        symbols = self.inner[data]
        symbols[ends - 1] = self.last[data[ends - 1]]
        out, n = [], np.zeros(len(size), np.int64)
        at = 0
        while at < len(size):  # bounded chunks
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + CHUNK_SYMBOLS, side="right")))
            got, count = merge_all(symbols[base : ends[to - 1]], size[at:to], self.table)
            out.append(got)
            n[at:to] = count
            at = to
        ids = np.concatenate(out) if out else np.empty(0, np.int32)
        starts = np.cumsum(n) - n
        for place, token in fixed:
            ids[starts[place]] = token
        return ids, np.bincount(np.asarray(owner, np.int64), weights=n, minlength=len(words)).astype(np.int64)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> WordVocabulary:
    return WordVocabulary(path)


class WordCache:
    """Ids of distinct pieces between white space, kept from batch to batch up to a number of pieces."""

    def __init__(self, path: str, limit: int = CACHE_WORDS):
        self.vocab, self.limit = vocabulary(path), limit
        self.clear()

    def clear(self) -> None:
        self.slot: dict[str, int] = {}
        self.ids, self.start, self.n = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def slots(self, words: list[str]) -> np.ndarray:
        if len(self.slot) > self.limit:
            self.clear()
        new = [w for w in words if w not in self.slot]
        if new:
            ids, n = self.vocab.encode(new)
            base = len(self.n)
            self.slot.update(zip(new, range(base, base + len(new)), strict=True))
            self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(n) - n])
            self.ids, self.n = np.concatenate([self.ids, ids]), np.concatenate([self.n, n])
        return np.fromiter(map(self.slot.__getitem__, words), np.int64, len(words))

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Number of tokens of each text."""
        words, codes, offsets = split_words(texts)
        slot = self.slots(words.to_pylist())
        each = np.concatenate([[0], np.cumsum(self.n[slot[codes]])]) if len(codes) else np.zeros(1, np.int64)
        return each[offsets[1:]] - each[offsets[:-1]]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and offsets by text."""
        words, codes, offsets = split_words(texts)
        slot = self.slots(words.to_pylist())
        slot = slot[codes] if len(codes) else np.empty(0, np.int64)
        n = self.n[slot]
        each = np.concatenate([[0], np.cumsum(n)])
        return ragged_take(self.ids, self.start[slot], n), each[offsets]


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, UTF-8 bytes, tokens, and whether the tokens exceed ``limit``.

    Null and empty texts have no bytes and no tokens. Repeated rows, null ids and further columns are
    harmless: each row is counted for itself. Special strings inside a text count as their one token.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordCache(tokenizer_path)
        for batch in batches:
            for part in text_slices(batch):
                n = cache.counts(part["text"])
                size = pc.fill_null(pc.binary_length(part["text"]), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part["id"].combine_chunks(), size.combine_chunks(), pa.array(n, pa.int64()), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    picked = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return picked.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
