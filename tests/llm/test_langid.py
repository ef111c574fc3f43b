"""The language network: gradients, pieces, and what its sample holds."""

import numpy as np

from trackspark.llm.langid import PIECE, Network, Training, padded, pieces_of, training_rows


def small():
    network = Network(["a", "b", "c"], Training(hidden=3, embedding=2))
    network.embed, network.out, network.bias = (x.astype(float) for x in (network.embed, network.out, network.bias))
    for d in network.directions:
        d.w, d.u, d.b = (x.astype(float) for x in (d.w, d.u, d.b))
    return network


def test_gradients_by_differences():
    network, (data, mask) = small(), padded([b"hello", b"xy", b"abcabcab"])
    mask, target = mask.astype(float), np.array([0, 2, 1])
    _, grads = network.gradient(data, mask, target)
    dice = np.random.default_rng(1)
    for p, g in zip(network.parameters(), grads, strict=True):
        for _ in range(12):
            at = tuple(dice.integers(n) for n in p.shape) if p is not network.embed else (int(data[tuple(dice.integers(n) for n in data.shape)]), int(dice.integers(2)))
            was, losses = p[at], []
            for step in (1e-3, -1e-3):
                p[at] = was + step
                losses.append(network.gradient(data, mask, target)[0])
            p[at] = was
            assert abs((losses[0] - losses[1]) / 2e-3 - g[at]) < 2e-4  # states are single precision


def test_words_do_not_depend_on_their_neighbours_in_a_batch():
    network, word = small(), b"straight"
    logp, _ = network.forward(*padded([word, b"and longer ones"]))
    alone, _ = network.forward(*padded([word]))
    assert np.allclose(alone[:, 0], logp[: len(word), 0], atol=1e-6) and np.allclose(np.exp(logp).sum(axis=2), 1)
    other, _ = network.forward(*padded([word[:-1] + b"x"]))
    assert not np.allclose(other[0, 0], alone[0, 0])  # the first position sees the last byte


def test_pieces_are_cut_between_code_points():
    for word in ("a" * 100, "é" * 50, "中" * 40, "😀" * 20, "aé中😀" * 9, "", "x" * PIECE):
        pieces = pieces_of(word.encode())
        assert "".join(p.decode() for p in pieces) == word and all(len(p) <= PIECE for p in pieces)


def test_sample_counts_whole_texts(spark):
    rows = [(i, "early " * 3000 + f"late{i % 3}", "en" if i % 4 else "fr") for i in range(40)] + [(50, None, "en"), (51, "nobody", None), (None, "named", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {(w, k): n for w, k, n in training_rows(docs, Training())}
    assert {w for w, _ in found} == {"early", "late0", "late1", "late2", "named"} and found["early", "en"] == 3000 * sum(n for (w, k), n in found.items() if k == "en" and w.startswith("late"))
    assert len({w for w, k, _ in training_rows(docs, Training(words_per_language=2)) if k == "en"}) == 2
    few = training_rows(docs, Training(rows_per_language=2))
    assert {(k, n) for w, k, n in few if w == "early"} <= {("en", 6000), ("fr", 6000), ("en", 3000), ("fr", 3000)}
