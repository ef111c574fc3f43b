"""The source audit against brute force, with chunks and blocks small enough that groups span several."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from trackspark.llm.divergence import divergence, shares

SCHEMA = "doc_id long, text string, lang string, source string, term string, n long, part string"


def brute(rows, least=2, top=3):
    docs = [((r[2] or ""), (r[3] or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))) for r in rows]
    seen, count = Counter(), defaultdict(Counter)
    for lang, source, w in docs:
        seen.update((lang, x) for x in set(w))
        count[lang, source].update(w)
    out = Counter()
    for lang in {d[0] for d in docs}:
        kept = sorted((x for (of, x), n in seen.items() if of == lang and n >= least), key=str.encode)
        sources = sorted((s for of, s in count if of == lang), key=str.encode)

        def p_of(c):
            total = sum(c[x] for x in kept)
            return {x: 1 + 10**9 * (c[x] + 2) // (total + 2 * len(kept)) for x in kept}

        p = {s: p_of(count[lang, s]) for s in sources}
        q = p_of(sum((count[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(sum(f(p[s][x], p[o][x]) for x in kept), o) for o in sources if o != s]
            terms = [(f(p[s][x], q[x]), x) for x in kept if count[lang, s][x] and p[s][x] > q[x]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda v: (-v[0], v[1].encode()))[:most], 1):
                    out[lang, s, part, item, value, rank] += 1
    return out


def some_rows():
    dice = random.Random(5)
    vocabulary = ["a", "B", "bb", "élan", "Été", "中文", "x-ray", "don't", "😀", "z", "ÀB", "ab9cd"]
    rows = []
    for i in range(150):
        text = " ".join(dice.choice(vocabulary) for _ in range(dice.randrange(30)))
        rows.append((i, text, dice.choice(["en", "en", "en", "fr", None, ""]), dice.choice(["s1", "s2", "é", "😀", None]), "x", 1, "p"))
    rows += [(200, None, "de", "only", "x", 1, None), (201, "once upon", "es", "a", None, 1, "p"), (202, None, "es", "b", "x", 1, "p"), (None, "a " * 20000 + "b" * 50000, "en", "s1", "x", 1, "p")]
    return rows + rows[:5]


@pytest.mark.parametrize(("chunk", "block"), [(2048, 256), (3, 2), (1, 1)])
def test_divergence_by_brute_force(spark, chunk, block):
    rows = some_rows()
    found = divergence(spark.createDataFrame(rows, SCHEMA).repartition(3), min_docs=2, top=3, chunk_terms=chunk, block_sources=block)
    assert dict(found.dtypes) == {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"}
    assert Counter(map(tuple, found.collect())) == brute(rows)


def test_divergence_with_one_source_holding_most_rows_and_an_empty_table(spark):
    rows = [(i, f"word{i % 7} common", "en", "hot" if i % 9 else f"s{i}", "x", 1, "p") for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert Counter(map(tuple, divergence(df, min_docs=2, top=3).collect())) == brute(rows)
    assert divergence(df.limit(0)).count() == 0


def test_shares_are_exact_beyond_doubles():
    dice = random.Random(1)
    for _ in range(300):
        total, terms = dice.randrange(1, 2**52), dice.randrange(1, 10**7)
        count = dice.randrange(0, total)
        assert int(shares(np.array([count]), total, terms)[0]) == 1 + 10**9 * (count + 2) // (total + 2 * terms)
