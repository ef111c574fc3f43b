"""Operators in the shapes that large tables give them: many blocks, ranges and parts, one key with most rows, a text of a megabyte."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from test_operators import SCHEMA, low, words

from trackspark.llm import jaccard, queries, winnow
from trackspark.llm.byte_bpe import byte_bpe
from trackspark.llm.divergence import divergence
from trackspark.llm.packing import pack_documents
from trackspark.llm.quality import quality
from trackspark.llm.substring_dedup import remove_repeats
from trackspark.llm.token_counts import count_tokens

SF = "/root/testdata/sf0.001"


def test_repeats_across_blocks(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    whole = Counter(map(tuple, remove_repeats(docs).collect()))
    assert Counter(map(tuple, remove_repeats(docs, block_bytes=20_000).collect())) == whole
    licence = " ".join(f"clause{i}" for i in range(30))  # in every text, so in every block
    rows = [(i, f"own{i} words{i} {licence} end{i}", "en", "hot", 0, 0, "x", i) for i in range(300)]
    found = {r.doc_id: r for r in remove_repeats(spark.createDataFrame(rows, SCHEMA), block_bytes=4_000).collect()}
    assert found[0].n_removed == 0 and all(found[i].kept_text == f"own{i} words{i} end{i}" and found[i].n_removed == 30 for i in range(1, 300))


def test_winnowing_across_ranges(spark, monkeypatch):
    monkeypatch.setattr(winnow, "RANGE_ROWS", 16)
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    found = sorted(winnow.winnow(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect(), key=lambda r: r.doc_id)
    for n, r in enumerate(found):
        text, after = rows[n].text or "", rows[(n + 1) % len(rows)].text or ""
        half = len(text) // 2
        assert r.edited_sha256 == hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()


def test_links_in_tiny_parts(spark, monkeypatch):
    for name, value in (("HOMES", 1), ("PART", 3), ("FAMILY", 6), ("SETS_AT_ONCE", 5), ("MAP_BITS", 1024)):
        monkeypatch.setattr(jaccard, name, value)
    base = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(base[: 40 - i % 5] + [f"t{i % 7}"]).upper() if i % 3 else " ".join(base)) for i in range(60)] + [(100 + i, f"alone {i} " * 9) for i in range(30)]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in rows for w in [words(low(t))]}
    least = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    assert found == {i: (len(s), least[i]) for i, s in sets.items()} and len(links) > 500


def test_a_text_of_a_megabyte(spark):
    long = "ein langer Text, der sich nie ganz wiederholt: " + " ".join(f"wort{i * 7919 % 100003} é{i}" for i in range(70_000))
    assert len(long.encode()) > 1_000_000
    docs = spark.createDataFrame([(1, long, "de", "s", 0, 0, "x", 1), (2, "short text", "de", "s", 0, 0, "x", 2), (3, long, "de", "t", 0, 0, "x", 3)], SCHEMA)
    counts = {r.doc_id: r for r in count_tokens(docs, queries.WORD_BPE).collect()}
    assert counts[1].n_tokens == counts[3].n_tokens > 100_000 and counts[1].over_limit
    pieces = defaultdict(int)
    for r in pack_documents(docs, queries.WORD_BPE).collect():
        pieces[r.doc_id] += r.length
    assert pieces[1] == counts[1].n_tokens + 1
    coded = {r.doc_id: r for r in byte_bpe(docs, queries.BYTE_BPE, keep_ids=False).collect()}
    assert coded[1].decoded_sha256 == hashlib.sha256(long.encode()).hexdigest()
    kept = {r.doc_id: r for r in remove_repeats(docs).collect()}
    assert kept[1].n_removed == 0 and kept[3].n_removed == kept[3].n_words
    rated = {r.doc_id: r for r in quality(docs).collect()}
    assert rated[1].n_words == len(re.findall(r"\S+", long)) and rated[1].n_repeat_words == 0
    assert divergence(docs, min_docs=1).where("part = 'pair'").count() == 2


@pytest.mark.parametrize("parts", [1, 7])
def test_most_rows_of_one_id_and_one_source(spark, parts):
    rows = [(5 if i % 3 else i, f"word{i % 4} " * 6, "en", "hot" if i % 3 else f"s{i}", 0, 0, "x", i) for i in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    assert quality(docs).count() == remove_repeats(docs).count() == winnow.winnow(docs).count() == 300
