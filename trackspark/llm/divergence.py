"""Audit of how sources of one language differ in their terms, on integer dictionaries.

Texts are cut into terms and each block's terms become integers (its distinct terms in order of their bytes); counts
by group and term are integer counts of those. Terms in enough documents of a language are kept. The kept terms of a
language are sorted and cut into chunks of ``CHUNK_TERMS``; inside a chunk a term's id is its place in the sorted
array, found by searchsorted, so ids go by UTF-8 order, counts of a block of sources are one dense matrix filled by
bincount, and ties in value are settled by the id. What chunks give is summed, or for the leading terms merged.

No dictionary is sent to all tasks: chunks, blocks of sources and pairs of such blocks are keys of an exchange. All
numbers are integers and exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import BLOCK_BYTES, discard, split_words, stored, text_slices

#: Documents of a language that a kept term is in at least.
MIN_DOCS = 10
#: Terms in a chunk and sources in a block: the sides of a task's matrix.
CHUNK_TERMS, BLOCK_SOURCES = 2048, 256
#: Leading terms by group.
TOP = 10
#: Probabilities are counted in units of 1 / SCALE.
SCALE = 1_000_000_000
#: What a byte becomes: letters stay, A-Z in lower case, and so does all of a code point above 127; anything else is a blank.
LETTERS = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


def _only_terms(texts: pa.Array) -> pa.Array:
    """Texts with every character that is no part of a term turned into a blank."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets, data = texts.buffers()
    if data is None:
        return texts
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    plain = LETTERS[np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]]
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(ends - ends[0]), pa.py_buffer(plain)])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) -> (lang, source, term, n, docs) by block of text, and a row of empty term for each group."""
    for batch in batches:
        for part in text_slices(batch, limit=2 * BLOCK_BYTES):
            groups = pa.StructArray.from_arrays([part["lang"].combine_chunks(), part["source"].combine_chunks()], ["lang", "source"])
            seen: dict[tuple[str, str], int] = {}
            group = np.fromiter((seen.setdefault((g["lang"], g["source"]), len(seen)) for g in groups.to_pylist()), np.int64, len(groups))
            terms, codes, offsets = split_words(_only_terms(part["text"]))
            order = pc.array_sort_indices(terms).to_numpy()
            terms, place = terms.take(pa.array(order)), np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            width = max(1, len(terms))
            doc = np.repeat(np.arange(len(part)), np.diff(offsets))
            in_doc, times = np.unique(doc * width + place[codes], return_counts=True)
            key, back = np.unique(group[in_doc // width] * width + in_doc % width, return_inverse=True)
            n, docs = np.bincount(back, times, len(key)).astype(np.int64), np.bincount(back, minlength=len(key))
            langs, sources = (pa.array([g[i] for g in seen], pa.string()) for i in (0, 1))
            of = pa.array(np.concatenate([np.arange(len(seen)), key // width]))
            term = pa.chunked_array([pa.array([""] * len(seen), pa.string()), terms.cast(pa.string()).take(pa.array(key % width))]).combine_chunks()
            count = lambda x: pa.array(np.concatenate([np.zeros(len(seen), np.int64), x]))  # noqa: E731, B023
            yield pa.record_batch([langs.take(of), sources.take(of), term, count(n), count(docs)], ["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents); the empty term stands for the group itself. Nulls are ''."""
    named = docs.select(*[F.coalesce(docs[c].cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    counted = named.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _chunked(chunk_terms: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Number the chunks of a partition whose rows (part, lang, term, total) are in order."""
        lang, chunk, left = None, -1, 0
        for batch in batches:
            found = []
            for x in batch["lang"].to_pylist():
                if x != lang or not left:
                    lang, chunk, left = x, chunk + 1, chunk_terms
                left -= 1
                found.append(chunk)
            chunks = pc.add(pc.multiply(batch["part"].cast(pa.int64()), 1 << 32), pa.array(found, pa.int64()))
            yield pa.record_batch([batch["lang"], batch["term"], batch["total"], chunks], ["lang", "term", "total", "chunk"])

    return cut


def shares(count: np.ndarray, total: np.ndarray | int, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms)), exact: three digits at a time stay inside 64 bits."""
    whole = np.asarray(total, np.int64) + 2 * terms
    left, out = count + 2, np.zeros(np.broadcast(count, whole).shape, np.int64)
    for _ in range(3):
        left = left * 1000
        out = out * 1000 + left // whole
        left = left % whole
    return out + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _compared(top: int):
    def compare(key: tuple, counts: pa.Table, groups: pa.Table) -> pa.Table:
        """Sums over this chunk by pair of sources, and each source's leading terms of it.

        ``groups``: the sources of blocks a and b (side 0 and 1) with their sums; ``counts``: their counts of this chunk's terms.
        """
        made: dict[str, list] = {"source": [], "part": [], "item": [], "value": []}
        a, b = key[2].as_py(), key[3].as_py()
        n_terms, width = groups["n_terms"][0].as_py(), groups["width"][0].as_py()
        # sources and terms as integers in order of their bytes
        names = np.sort(np.array([x.encode() for x in groups["source"].to_pylist()], object))
        ids_of = lambda known, column: np.searchsorted(known, np.array([x.encode() for x in column.dictionary.to_pylist()], object))[column.indices.to_numpy()]
        encoded = lambda column: pa.concat_arrays(column.chunks).dictionary_encode()
        at = ids_of(names, encoded(groups["source"]))
        total, side = np.empty(len(names), np.int64), np.empty(len(names), np.int64)
        total[at], side[at] = groups["n"].to_numpy(), groups["side"].to_numpy()
        terms = np.empty(0, object)
        dense, all_of = np.zeros((len(names), 0), np.int64), np.zeros(0, np.int64)
        if len(counts):
            term = encoded(counts["term"])
            terms = np.sort(np.array([x.encode() for x in term.dictionary.to_pylist()], object))
            column, row = ids_of(terms, term), ids_of(names, encoded(counts["source"]))
            dense = _summed(row * len(terms) + column, counts["n"].to_numpy(), len(names) * len(terms)).reshape(len(names), len(terms))
            all_of = np.zeros(len(terms), np.int64)
            all_of[column] = counts["total"].to_numpy()
        # p is what a term without an occurrence has, where the chunk's terms are missing here
        p = shares(dense, total[:, None], n_terms) if n_terms else dense
        base = shares(np.zeros(len(names), np.int64), total, n_terms) if n_terms else np.zeros(len(names), np.int64)
        rest = width - len(terms)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == (0 if a == b else 1))
        for i in left:
            others = right[right > i] if a == b else right
            if len(others):
                value = apart(p[i], p[others]).sum(axis=1) if len(terms) else np.zeros(len(others), np.int64)
                if rest:
                    value = value + rest * apart(base[i], base[others])
                made["source"] += [names[i]] * len(others)
                made["part"] += ["pair"] * len(others)
                made["item"] += names[others].tolist()
                made["value"] += value.tolist()
        if a == b and len(terms):
            q = shares(all_of, groups["lang_n"][0].as_py(), n_terms)
            for i in left:
                more = np.flatnonzero((dense[i] > 0) & (p[i] > q))
                value = apart(p[i][more], q[more])
                best = np.argsort(-value, kind="stable")[:top]  # ids ascend, and so do the terms of a tie
                made["source"] += [names[i]] * len(best)
                made["part"] += ["term"] * len(best)
                made["item"] += terms[more[best]].tolist()
                made["value"] += value[best].tolist()
        text = lambda c: pa.array([x.decode() if isinstance(x, bytes) else x for x in made[c]], pa.string())
        return pa.table({"lang": pa.array([key[0].as_py()] * len(made["value"]), pa.string()), "source": text("source"), "part": text("part"), "item": text("item"), "value": pa.array(made["value"], pa.int64())})

    return compare


def _summed(ids: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """Exact bincount of 64-bit weights: halves of 32 bits each stay inside a double's 53."""
    low, high = np.bincount(ids, n & 0xFFFFFFFF, size), np.bincount(ids, n >> 32, size)
    return low.astype(np.int64) + (high.astype(np.int64) << 32)


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, chunk_terms: int = CHUNK_TERMS, block_sources: int = BLOCK_SOURCES, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank: how far each source is from each other one of its language, and its leading terms.

    A document is a row: repeated rows count again, and rows of one id are documents of their own. Null langs, sources
    and texts are ''. A group without terms is compared like any other. Ties in value go by the item's UTF-8 bytes.
    Other columns are not read. An empty table gives no row; a lang with one source has no pairs.
    """
    counts = stored(term_counts(docs, lang_col, source_col, text_col), "terms")
    by_term = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total")).where(F.col("docs") >= min_docs).select("lang", "term", "total")
    ordered = by_term.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term").select(F.spark_partition_id().alias("part"), "lang", "term", "total")
    kept = stored(ordered.mapInArrow(_chunked(chunk_terms), "lang string, term string, total long, chunk long"), "kept-terms")
    found = stored(counts.where("term <> ''").join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "total", "chunk"), "kept-counts")
    # groups with the sums of their language, in blocks by hash of the source
    langs = kept.groupBy("lang").agg(F.count("*").alias("n_terms"), F.sum("total").alias("lang_n"))
    sums = found.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = counts.where("term = ''").select("lang", "source")
    blocks = groups.groupBy("lang").agg(F.ceil(F.count("*") / block_sources).cast("int").alias("blocks"))
    of_lang = stored(blocks.join(langs, "lang", "left").select("lang", "blocks", F.coalesce("n_terms", F.lit(0)).alias("n_terms"), F.coalesce("lang_n", F.lit(0)).alias("lang_n")), "langs")
    block = F.pmod(F.xxhash64("source"), "blocks").cast("int").alias("block")
    groups = groups.join(sums, ["lang", "source"], "left").join(of_lang, "lang").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), "n_terms", "lang_n", "blocks", block)
    groups = stored(groups, "groups")

    # a task takes a chunk of terms and a pair of blocks; a lang without terms has one empty chunk
    chunks = kept.groupBy("lang", "chunk").agg(F.count("*").alias("width")).unionByName(of_lang.where("n_terms = 0").select("lang", F.lit(-1).cast("long").alias("chunk"), F.lit(0).cast("long").alias("width")))
    pairs = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.struct(F.least("block", other).alias("a"), F.greatest("block", other).alias("b"))))
    spread = lambda df: df.withColumn("p", pairs).withColumn("a", F.col("p.a")).withColumn("b", F.col("p.b"))
    members = spread(groups.join(chunks, "lang")).withColumn("side", F.when(F.col("block") == F.col("a"), 0).otherwise(1).cast("long"))
    members = members.select("lang", "chunk", "a", "b", "side", "source", "n", "n_terms", "lang_n", "width")
    entries = spread(found.join(of_lang.select("lang", "blocks"), "lang").withColumn("block", block)).select("lang", "chunk", "a", "b", "source", "term", "n", "total")
    keys = ["lang", "chunk", "a", "b"]
    schema = "lang string, source string, part string, item string, value long"
    compared = stored(entries.groupBy(*keys).cogroup(members.groupBy(*keys)).applyInArrow(_compared(top), schema), "compared")

    one_way = compared.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    both_ways = one_way.select("lang", both.alias("x"), "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    rank = F.row_number().over(order).alias("rank")
    columns = ["lang", "source", "part", "item", "value", "rank"]
    leading = compared.where("part = 'term'").select("lang", "source", "part", "item", "value", rank).where(F.col("rank") <= top)
    discard(counts, kept, found, of_lang, groups)  # only what was compared is still read
    return both_ways.select("*", rank).select(*columns).unionByName(leading.select(*columns))
