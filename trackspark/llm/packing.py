"""Vector bin packing of tokenised examples into training sequences.

An example demands three resources of a sequence: tokens, one segment, and loss-bearing tokens (those
predicted from a token of the same segment: all but a segment's first). Sequences are filled one at a
time by the dot-product rule: of the examples that fit, take the one whose demand has the largest dot
product with what is left of the sequence, both in units of the limits. When nothing fits, an example
is cut so that its first part ends the sequence. A pool of examples is packed inside one task; what a
pool leaves over opens the next pool of the task, so only a task's last sequence can stay short.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ._common import give_back, text_slices
from .token_counts import WordCache

#: Sequences of one task; a task has its own range of ids.
IDS_PER_TASK = 1 << 40
#: Text tokenised at once; a pool is tokenised piece by piece, as the words of a piece take many times its size.
ENCODED_BYTES = 1 << 20
#: Distinct words kept from piece to piece, about 200 bytes each.
KEPT_WORDS = 300_000


@dataclass(frozen=True)
class Limits:
    """Limits of one sequence."""

    tokens: int = 2048
    segments: int = 512
    loss_tokens: int = 2048


@dataclass
class Pieces:
    """Placed pieces: example, first token in it, length, sequence and place there."""

    example: np.ndarray
    start: np.ndarray
    length: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray


def pack(lengths: np.ndarray, limits: Limits, first_sequence: int = 0, keep_open: bool = False) -> tuple[Pieces, np.ndarray, int]:
    """Pack examples of so many tokens: pieces, examples left for the next pool (their first unplaced token, or -1), next sequence.

    With ``keep_open`` examples that could not fill a whole sequence are left over instead of placed.
    """
    out: list[tuple[int, int, int, int, int]] = []
    left_at = np.full(len(lengths), -1, np.int64)
    sequence, start = first_sequence, np.zeros(len(lengths), np.int64)
    for i in np.flatnonzero(lengths >= limits.tokens):  # whole sequences of one example
        while lengths[i] - start[i] >= limits.tokens and limits.loss_tokens >= limits.tokens - 1:
            out.append((i, start[i], limits.tokens, sequence, 0))
            start[i] += limits.tokens
            sequence += 1
    live = np.flatnonzero(lengths > start)
    rest = lengths[live] - start[live]
    order = np.argsort(rest, kind="stable")
    # examples of equal length are alike: the candidates are the distinct lengths, at most as many as the limit
    by_length = {int(n): list(part) for n, part in zip(*_groups(live[order], rest[order]), strict=True)}
    sizes = np.array(sorted(by_length), np.int64)
    count = np.array([len(by_length[int(n)]) for n in sizes], np.int64)
    scale = np.array([1 / limits.tokens, 1 / limits.segments, 1 / limits.loss_tokens])
    total, members = int(rest.sum()), int(count.sum())
    while members:
        free = np.array([limits.tokens, limits.segments, limits.loss_tokens], np.int64)
        if keep_open and total < limits.tokens and members < limits.segments:
            break
        while free[0] and free[1] and members:
            fits = (count > 0) & (sizes <= free[0]) & (sizes - 1 <= free[2])
            if fits.any():
                weight = free * scale * scale
                score = np.where(fits, sizes * weight[0] + weight[1] + (sizes - 1) * weight[2], -1.0)
                k = int(np.argmax(score))
                n = cut = int(sizes[k])
            else:  # cut the longest example
                k = int(np.flatnonzero(count > 0)[-1])
                n, cut = int(sizes[k]), int(min(free[0], free[2] + 1, sizes[k]))
            i = by_length[n].pop()
            count[k] -= 1
            out.append((i, start[i], cut, sequence, limits.tokens - int(free[0])))
            start[i] += cut
            free -= np.array([cut, 1, cut - 1])
            total -= cut
            if cut < n:
                k = int(np.searchsorted(sizes, n - cut))
                if k == len(sizes) or sizes[k] != n - cut:
                    sizes, count = np.insert(sizes, k, n - cut), np.insert(count, k, 0)
                by_length.setdefault(n - cut, []).append(i)
                count[k] += 1
            else:
                members -= 1
            if free[2] < 0:
                break
        sequence += 1
    for group in by_length.values():
        for i in group:
            left_at[i] = start[i]
    table = np.array(out, np.int64).reshape(-1, 5).T
    return Pieces(*table), left_at, sequence


def _groups(index: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    if not len(length):
        return length, []
    at = np.flatnonzero(np.diff(length)) + 1
    return length[np.concatenate([[0], at])], np.split(index, at)


def pack_documents(docs: DataFrame, tokenizer_path: str, limits: Limits = Limits(), end_id: int = 1, pool_bytes: int = 8_000_000, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Tokenise each text, append ``end_id`` and pack all texts; one row per piece.

    Columns: doc_id, start, length, ids_crc32 (of the ids as little-endian unsigned 32-bit), doc_tokens,
    sequence_id, offset, loss_tokens, and ids (the piece itself; not ``with_ids``: none). Null and empty texts are packed
    as the end id alone. Repeated rows and null ids are packed like any other row; further columns are ignored.
    """
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long" + ", ids array<int>" * with_ids
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordCache(tokenizer_path, KEPT_WORDS)
        sequence = TaskContext.get().partitionId() * IDS_PER_TASK
        held = None  # ids, offsets, doc ids, sizes and places that the pools before have left
        for batch in batches:
            for part in text_slices(batch, limit=pool_bytes):
                ids, size = encoded(cache, part)
                pool = (ids, np.cumsum(size) - size, size, np.zeros(len(part), np.int64), part["id"].combine_chunks())
                del ids
                rows, held, sequence = place(pool, held, sequence, True)
                del pool
                give_back()
                yield rows
        if held is not None and len(held[1]):
            yield place(None, held, sequence, False)[0]
        held = cache = None
        give_back()

    def encoded(cache, part):
        """Ids of all texts one after another, each with its end, and the number of each text's ids."""
        found, sizes = [], []
        for piece in text_slices(part, limit=ENCODED_BYTES):
            ids, offsets = cache.encode(piece["text"])
            found.append(np.insert(ids, offsets[1:], end_id))
            sizes.append(np.diff(offsets) + 1)
        return np.concatenate(found), np.concatenate(sizes)

    def place(pool, held, sequence, keep_open):
        if held is not None and pool is not None:
            pool = (np.concatenate([held[0], pool[0]]), np.concatenate([held[1], pool[1] + len(held[0])]), np.concatenate([held[2], pool[2]]), np.concatenate([held[3], pool[3]]), pa.concat_arrays([held[4], pool[4]]))
        ids, begin, size, done, doc = pool or held
        pieces, left, sequence = pack(size - done, limits, sequence, keep_open)
        first = done[pieces.example] + pieces.start
        at = begin[pieces.example] + first
        raw = ids.astype("<i4", copy=False).view("<u4")
        crc = np.fromiter((zlib.crc32(raw[a : a + n]) for a, n in zip(at, pieces.length, strict=True)), np.int64, len(at))
        columns = [doc.take(pa.array(pieces.example)), *map(pa.array, (first, pieces.length, crc, size[pieces.example], pieces.sequence, pieces.offset, pieces.length - 1))]
        if with_ids:
            flat = np.concatenate([ids[a : a + n] for a, n in zip(at, pieces.length, strict=True)]) if len(at) else ids[:0]
            columns.append(pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(pieces.length)]).astype(np.int32), flat.astype(np.int32)))
        rows = pa.RecordBatch.from_arrays(columns, names)
        keep = np.flatnonzero(left >= 0)
        flat = np.concatenate([ids[begin[i] : begin[i] + size[i]] for i in keep]) if len(keep) else ids[:0]
        held = (flat, np.cumsum(size[keep]) - size[keep], size[keep], done[keep] + left[keep], doc.take(pa.array(keep)))
        return rows, held, sequence

    picked = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return picked.mapInArrow(run, schema)
