"""Pairs of a block against a plain count."""

from collections import Counter

import numpy as np
import pyarrow as pa

from trackspark.llm import ppm


def test_pairs_of_a_block_by_hand(monkeypatch):
    texts = ["a b A", None, "", "b" * 40, "naïve 日本", "a b a"]
    monkeypatch.setattr(ppm, "AT_ONCE", 16)  # pieces that cut words, texts and paddings
    monkeypatch.setattr(ppm, "GATHERED", 8)
    plain = ppm.plain_bytes(pa.array(texts))
    held = np.array([False, True, False, True, False, True])
    seen, learned, sums, doc = Counter(), Counter(), np.zeros(len(texts)), 0
    for i, byte in enumerate(plain):
        if byte != ppm.PAD:
            pair = int.from_bytes(bytes([*plain[i - ppm.ORDER : i][::-1], byte]), "big")
            seen[pair] += 1
            learned[pair] += not held[doc]
            sums[doc] += pair % 1013
            doc += byte == ppm.END
    bare, counted = ppm.BlockPairs(plain, 3), ppm.BlockPairs(plain, 3, held)
    assert bare.pairs.tolist() == counted.pairs.tolist() == sorted(seen)
    assert bare.n is None  # nothing is counted where nothing is asked for
    assert counted.n.tolist() == [learned[p] for p in counted.pairs[counted.order].tolist()]
    assert bare.totals(plain, (bare.pairs[bare.order] % 1013).astype(float), len(texts)).tolist() == sums.tolist()
    assert ppm._counted(np.array([5, 3, 5]), np.array([True, False, True]))[1].tolist() == [0, 2]
