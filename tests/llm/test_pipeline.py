"""Stages of the pipeline on awkward rows."""

import re

import corpus_pipeline

from trackspark.llm import queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = " ".join(f"word{i}" for i in range(60))
OTHER = " ".join(f"other{i}" for i in range(60))
THIRD = " ".join(f"third{i}" for i in range(60))


def test_jaccard_stage_keeps_different_texts_of_one_id(spark):
    rows = [
        (1, WORDS, "en", "b", 1), (1, WORDS, "en", "a", 1), (1, OTHER, "en", "c", 2),  # one id, two texts, one of them twice
        (2, WORDS, "en", "a", 1), (2, THIRD, "en", "a", 1),  # a copy of the first, and a text of its own
        (6, THIRD, "en", "a", 1), (6, OTHER, "en", "a", 1),  # copies of both
        (3, None, "en", "a", 0), (3, None, "en", "a", 0), (4, "", "en", "a", 0), (5, " ", "en", "a", 1),
        (None, WORDS, "en", "a", 1), (None, WORDS, "en", "a", 1),
    ]
    want = [(1, WORDS, "en", "a", 1), (1, OTHER, "en", "c", 2), (2, THIRD, "en", "a", 1), (3, None, "en", "a", 0), (4, "", "en", "a", 0), (5, " ", "en", "a", 1), *rows[-2:]]
    for parts in (1, 4):
        found = corpus_pipeline.ngram_jaccard_join(spark, spark.createDataFrame(rows, SCHEMA).repartition(parts), "")
        assert found.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)


def test_jaccard_stage_without_repeated_ids(spark):
    rows = [(1, WORDS, "en", "a", 1), (2, WORDS, "en", "a", 1), (3, OTHER, "en", "a", 1), (4, None, "en", "a", 0), (None, OTHER, "en", "a", 1)]
    found = corpus_pipeline.ngram_jaccard_join(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), "")
    assert sorted(map(tuple, found.collect()), key=repr) == sorted([rows[0], *rows[2:]], key=repr)


def test_stages_in_turn_against_the_operators(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, {r.doc_id for r in queries.op8_quality(spark, sf).where("kept").collect()}
    by_name = dict(corpus_pipeline.STAGES)
    first = corpus_pipeline.stored(by_name["quality_rules"](spark, docs, sf), "test")
    assert {r.doc_id for r in first.collect()} == kept and first.columns == columns
    named = first.withColumn("row", corpus_pipeline.F.struct(*columns)).select("row.*")
    second = corpus_pipeline.stored(by_name["language_id"](spark, named, sf), "test")
    assert second.columns == columns and second.exceptAll(first).isEmpty() and second.count() > 0.95 * first.count()
    third = corpus_pipeline.stored(by_name["ngram_jaccard_join"](spark, second, sf), "test")
    sets = {r.doc_id: shingles(r.text) for r in second.collect()}
    group = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and 4 * len(sets[i] & sets[j]) >= 3 * len(sets[i] | sets[j]) and sets[i]:
                a, b = sorted((group[i], group[j]))
                group = {k: a if g == b else g for k, g in group.items()}
    assert {r.doc_id for r in third.collect()} == set(group.values()) and third.columns == columns
    fourth = corpus_pipeline.stored(by_name["substring_dedup"](spark, third, sf), "test")
    assert fourth.columns == columns and fourth.count() == third.count()
    seen, want = {}, {}
    texts = {r.doc_id: r.text for r in third.collect()}
    for i in sorted(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", texts[i] or "")
        windows = [tuple(w[k : k + 13]) for k in range(len(w) - 12)]
        gone = {k + n for k, g in enumerate(windows) if seen.get(g, i) < i for n in range(13)}
        for g in windows:
            seen.setdefault(g, i)
        want[i] = " ".join(x for k, x in enumerate(w) if k not in gone) if gone else texts[i]
    assert {r.doc_id: r.text for r in fourth.collect()} == want
    pieces = by_name["packing"](spark, fourth, sf).collect()
    assert {r.doc_id for r in pieces} == set(want)
    for i in want:
        own = [r for r in pieces if r.doc_id == i]
        assert sum(r.length for r in own) == own[0].doc_tokens


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
