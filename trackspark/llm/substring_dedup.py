"""Removal of word passages that repeat across documents, by level-wise doubling.

Windows of one length that occur in one document only cannot be part of a longer repeated window, so
only windows that repeat are extended to twice the length, from ``FIRST`` words up to the full window. A
level below asks for the smallest short window inside every full window that is still a candidate (equal
full windows have equal smallest short ones, and a short one stands for many full windows); the last level
asks for the full windows themselves, each made of two overlapping shorter ones. Where no candidate
survives, nothing is asked any more.

A level is one exchange: a block of documents (8 MB of text) asks about each distinct window once,
with the smallest and largest id that it has for it, so that a window in a third of all documents is a
row per block and not per document. What repeats goes back to the blocks. The texts are exchanged once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import BLOCK_BYTES, block_of, give_back, gram_hashes, mix, split_words, word_hashes

#: Words of the first level's windows.
FIRST = 4
#: Stands for a null id: larger than every other.
NO_ID = np.iinfo(np.int64).max


def levels_of(length: int) -> list[int]:
    """Window lengths below ``length``, each twice the one before."""
    levels = [min(FIRST, max(1, length - 1))]
    while levels[-1] * 2 < length:
        levels.append(levels[-1] * 2)
    return levels


class _Windows:
    """Words of a block's documents in ascending order of id, and the hashes of their windows."""

    def __init__(self, table: pa.Table, length: int):
        table = table.append_column("rank", pc.fill_null(table["id"].cast(pa.int64()), NO_ID)).sort_by("rank")
        self.table, self.id, self.length = table, table["rank"].to_numpy(), length
        self.words, self.codes, self.offsets = split_words(table["text"])
        n = len(self.codes) - length + 1
        self.doc = np.repeat(np.arange(len(table)), np.diff(self.offsets))
        self.at = np.flatnonzero(self.doc[:n] == self.doc[length - 1 :]) if n > 0 else np.empty(0, np.int64)
        self.hashes = word_hashes(self.words)[self.codes] if n > 0 else np.empty(0, np.uint64)

    def smallest(self, short: int) -> np.ndarray:
        """Hash of the smallest window of ``short`` words inside each full window."""
        if not len(self.at):
            return np.empty(0, np.uint64)
        low, width, span = gram_hashes(self.hashes, short), 1, self.length - short + 1  # by doubling
        while width * 2 <= span:
            low, width = np.minimum(low[:-width], low[width:]), width * 2
        if width < span:
            low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
        return low[self.at]

    def full(self, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """80 bits of hash, in two parts, of the full windows at the places ``at[where]``."""
        if not len(self.at):
            return np.empty(0, np.uint64), np.empty(0, np.uint64)
        short = (self.length + 1) // 2
        half = gram_hashes(self.hashes, short)
        a, b = half[self.at[where]], half[self.at[where] + self.length - short]
        return mix(a * np.uint64(0x9E3779B97F4A7C15) + b), mix(b * np.uint64(0xC2B2AE3D27D4EB4F) + a) >> np.uint64(48)

    def asked(self, where: np.ndarray, *keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Each distinct key with the smallest id that has it here, and whether a larger one has."""
        order = np.lexsort(keys[::-1])  # stable: ids ascend inside a key
        keys, ids = [k[order] for k in keys], self.id[self.doc[self.at[where]]][order]
        new = np.ones(len(ids), bool)
        if len(ids):
            new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(ids)) - 1 if len(first) else first
        turn = np.argsort(ids[first], kind="stable")  # rows of one id together: the exchange compresses its runs
        first, last = first[turn], last[turn]
        return [k[first].view(np.int64) for k in keys], ids[first], ids[first] < ids[last]


def remove_repeats(docs: DataFrame, length: int = 13, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), untouched_as_is: bool = False, block_bytes: int = 2 * BLOCK_BYTES) -> DataFrame:
    """Remove each word covered by a window of ``length`` words that also starts in a row of smaller id.

    One row per row of ``docs``: doc_id, n_words, n_removed, kept_text (kept words joined by one space, or
    with ``untouched_as_is`` the text itself if it loses no word) and the columns ``keep``. Windows are judged on the input. Null texts have no words. Rows of one id do not
    remove each other's words; a null id is larger than every other, and null ids are equal. Texts shorter
    than a window keep all words.
    """
    block, _ = block_of(docs, text_col, block_bytes)
    picked = docs.select(block.alias("block"), docs[id_col].alias("id"), docs[text_col].alias("text"), *[docs[c].alias(f"keep_{c}") for c in keep])
    kinds = {f.name: f.dataType.simpleString() for f in picked.schema}
    levels = levels_of(length)

    def answered(w: _Windows, where: np.ndarray, keys: tuple[np.ndarray, ...]) -> pa.Table:
        keys, low, more = w.asked(where, *keys)
        return pa.table({"block": pa.repeat(w.table["block"][0], len(low)).cast(pa.int32()), **{f"k{i}": k for i, k in enumerate(keys, 1)}, "low": low, "more": more})

    def first(table: pa.Table) -> pa.Table:
        give_back()
        w = _Windows(table, length)
        return answered(w, np.arange(len(w.at)), (w.smallest(levels[0]),))

    def longer(short: int, twice: int | None):
        """Ask for windows of ``twice`` words (None: full windows) where those of ``short`` words repeat."""

        def ask(table: pa.Table, known: pa.Table) -> pa.Table:
            if not (len(table) and len(known)):
                keys = ("k1",) if twice else ("k1", "k2")
                return pa.table({"block": pa.array([], pa.int32()), **{c: pa.array([], pa.int64()) for c in (*keys, "low")}, "more": pa.array([], pa.bool_())})
            give_back()
            w = _Windows(table, length)
            where = np.flatnonzero(np.isin(w.smallest(short).view(np.int64), known["k1"].to_numpy()))
            return answered(w, where, (w.smallest(twice)[where],) if twice else w.full(where))

        return ask

    def cut(table: pa.Table, known: pa.Table) -> pa.Table:
        give_back()
        w = _Windows(table, length)
        gone = np.zeros(len(w.codes) + 1, np.int64)
        if len(known) and len(w.at):
            order = np.argsort(known["k1"].to_numpy())
            k1, k2, first = (known[c].to_numpy()[order] for c in ("k1", "k2", "first"))
            h1, h2 = (h.view(np.int64) for h in w.full(np.arange(len(w.at))))
            place = np.minimum(np.searchsorted(k1, h1), len(k1) - 1)
            hit = np.flatnonzero((k1[place] == h1) & (k2[place] == h2))
            hit = hit[first[place[hit]] < w.id[w.doc[w.at[hit]]]]
            np.add.at(gone, w.at[hit], 1)
            np.add.at(gone, w.at[hit] + length, -1)
        kept = np.cumsum(gone[:-1]) == 0
        ends = np.concatenate([[0], np.cumsum(kept)])[w.offsets]
        words = w.words.cast(pa.string()).take(pa.array(w.codes[kept]))
        text = pc.binary_join(pa.ListArray.from_arrays(ends.astype(np.int32), words), " ")
        n = np.diff(w.offsets)
        if untouched_as_is:
            text = pc.if_else(pa.array(n == np.diff(ends)), w.table["text"].combine_chunks().cast(pa.string()), text)
        return pa.table({"doc_id": w.table["id"], "n_words": n, "n_removed": n - np.diff(ends), "kept_text": text, **{c: w.table[f"keep_{c}"] for c in keep}})

    by_block, one_key = picked.groupBy("block"), "block int, k1 long, low long, more boolean"
    by_key = Window.partitionBy("k1")  # at most one row a block
    asked = by_block.applyInArrow(first, one_key)
    for short, twice in zip(levels, [*levels[1:], None], strict=True):
        spread = (F.min("low").over(by_key) < F.max("low").over(by_key)) | F.max("more").over(by_key)
        repeated = asked.withColumn("spread", spread).where("spread").select("block", "k1")
        columns = one_key if twice else "block int, k1 long, k2 long, low long, more boolean"
        asked = by_block.cogroup(repeated.groupBy("block")).applyInArrow(longer(short, twice), columns)
    asked = asked.withColumn("first", F.min("low").over(Window.partitionBy("k1", "k2")))
    known = asked.where("first < low or more").select("block", "k1", "k2", "first")
    schema = f"doc_id {kinds['id']}, n_words long, n_removed long, kept_text string" + "".join(f", `{c}` {kinds[f'keep_{c}']}" for c in keep)
    return by_block.cogroup(known.groupBy("block")).applyInArrow(cut, schema)
