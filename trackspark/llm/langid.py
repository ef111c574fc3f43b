"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

The network reads the bytes of a word in both directions (pieces of at most ``PIECE`` bytes, the states
start anew in each) and labels every byte position; it is trained by backpropagation through time. A
document's probabilities pool the log probabilities of all its positions. As a word's positions depend
on the word alone, a task labels each distinct word once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import discard, give_back, split_words, stored, text_slices

#: Bytes of a word read at once.
PIECE = 24
#: Pooled evidence counts as that of so many positions at most, so that scores of long texts stay below 1.
POOLED = 64.0
UNKNOWN = "und"
CACHE_WORDS = 500_000


@dataclass(frozen=True)
class Training:
    """The bounded sample and the training run: rows per language, whose whole texts count, distinct words kept of these, steps."""

    rows_per_language: int = 300
    words_per_language: int = 50_000
    hidden: int = 16
    embedding: int = 8
    steps: int = 500
    batch: int = 256
    rate: float = 0.02
    seed: int = 7


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Direction:
    """One gated recurrent layer: z and r gates and candidate, with its gradient."""

    def __init__(self, rng: np.random.Generator, size_in: int, hidden: int):
        scale = 1 / np.sqrt(hidden)
        self.w = rng.uniform(-scale, scale, (size_in, 3 * hidden)).astype(np.float32)
        self.u = rng.uniform(-scale, scale, (hidden, 3 * hidden)).astype(np.float32)
        self.b = np.zeros(3 * hidden, np.float32)
        self.hidden = hidden

    def forward(self, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, list]:
        """x: (time, batch, 3 * hidden) input parts; mask: (time, batch). States by time, and what the gradient needs."""
        h, n = np.zeros((x.shape[1], self.hidden), np.float32), self.hidden
        states, trace = np.empty((*x.shape[:2], n), np.float32), []
        for t in range(len(x)):
            gates = _sigmoid(x[t, :, : 2 * n] + h @ self.u[:, : 2 * n])
            z, r = gates[:, :n], gates[:, n:]
            c = 2 * _sigmoid(2 * (x[t, :, 2 * n :] + (r * h) @ self.u[:, 2 * n :])) - 1
            new = h + (z * (c - h)) * mask[t, :, None]
            trace.append((h, z, r, c))
            states[t] = h = new
        return states, trace

    def backward(self, d_states: np.ndarray, mask: np.ndarray, trace: list) -> tuple[np.ndarray, np.ndarray]:
        """Gradient of the input parts and of u."""
        n = self.hidden
        d_x, d_u = np.empty((*d_states.shape[:2], 3 * n), np.float32), np.zeros_like(self.u)
        d_h = np.zeros(d_states.shape[1:], np.float32)
        for t in range(len(d_states) - 1, -1, -1):
            h, z, r, c = trace[t]
            d_h = d_h + d_states[t]
            step = d_h * mask[t, :, None]
            d_c = step * z * (1 - c * c)
            d_z = step * (c - h) * z * (1 - z)
            back = d_c @ self.u[:, 2 * n :].T
            d_r = back * h * r * (1 - r)
            d_gates = np.concatenate([d_z, d_r], axis=1)
            d_u[:, : 2 * n] += h.T @ d_gates
            d_u[:, 2 * n :] += (r * h).T @ d_c
            d_x[t] = np.concatenate([d_gates, d_c], axis=1)
            d_h = d_h - step * z + back * r + d_gates @ self.u[:, : 2 * n].T
        return d_x, d_u


class Network:
    """Bytes -> log probabilities of the labels at every position."""

    def __init__(self, labels: list[str], training: Training):
        rng = np.random.default_rng(training.seed)
        self.labels = labels
        self.embed = rng.normal(0, 0.3, (256, training.embedding)).astype(np.float32)
        self.directions = [Direction(rng, training.embedding, training.hidden) for _ in range(2)]
        self.out = rng.normal(0, 0.1, (2 * training.hidden, len(labels))).astype(np.float32)
        self.bias = np.zeros(len(labels), np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, self.out, self.bias, *(p for d in self.directions for p in (d.w, d.u, d.b))]

    def forward(self, data: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, tuple]:
        """data: (time, batch) bytes, each piece from time 0 on; the reverse direction reads the masked tail first."""
        sides = []
        for k, d in enumerate(self.directions):
            table = self.embed @ d.w + d.b
            bytes_, m = (data, mask) if k == 0 else (data[::-1], mask[::-1])
            states, trace = d.forward(table[bytes_], m)
            sides.append((states if k == 0 else states[::-1], trace))
        both = np.concatenate([sides[0][0], sides[1][0]], axis=2)
        logits = both @ self.out + self.bias
        logits -= logits.max(axis=2, keepdims=True)
        return logits - np.log(np.exp(logits).sum(axis=2, keepdims=True)), (both, sides)

    def gradient(self, data: np.ndarray, mask: np.ndarray, target: np.ndarray) -> tuple[float, list[np.ndarray]]:
        logp, (both, sides) = self.forward(data, mask)
        n = float(mask.sum())
        d = np.exp(logp)
        d[:, np.arange(len(target)), target] -= 1
        d *= mask[:, :, None] / n
        d_out, d_bias = np.tensordot(both, d, axes=([0, 1], [0, 1])), d.sum(axis=(0, 1))
        d_both = d @ self.out.T
        size, d_embed, grads = self.directions[0].hidden, np.zeros_like(self.embed), []
        for k, layer in enumerate(self.directions):
            part = d_both[:, :, k * size : (k + 1) * size]
            bytes_, m = (data, mask) if k == 0 else (data[::-1], mask[::-1])
            d_x, d_u = layer.backward(part if k == 0 else part[::-1], m, sides[k][1])
            d_table = np.zeros((256, 3 * size), np.float32)
            np.add.at(d_table, bytes_.reshape(-1), d_x.reshape(-1, 3 * size))
            d_embed += d_table @ layer.w.T
            grads += [self.embed.T @ d_table, d_u, d_table.sum(axis=0)]
        loss = -float((logp[:, np.arange(len(target)), target] * mask).sum() / n)
        return loss, [d_embed, d_out, d_bias, *grads]

    def label_words(self, words: list[bytes]) -> np.ndarray:
        """Sum of the positions' log probabilities of each word."""
        pieces, owner = [], []
        for i, w in enumerate(words):
            for piece in pieces_of(w):
                pieces.append(piece)
                owner.append(i)
        total = np.zeros((len(words), len(self.labels)))
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(size, kind="stable")
        for at in range(0, len(order), 4096):  # pieces of like length together
            part = order[at : at + 4096]
            data, mask = padded([pieces[i] for i in part])
            logp, _ = self.forward(data, mask)
            np.add.at(total, np.asarray(owner)[part], (logp * mask[:, :, None]).sum(axis=0))
        return total


def padded(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Pieces as (time, batch) bytes and their mask."""
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
    long = int(size.max(initial=1))
    data = np.frombuffer(b"".join(p.ljust(long, b"\0") for p in pieces), np.uint8).reshape(-1, long).T
    return data, (np.arange(long)[:, None] < size).astype(np.float32)


def pieces_of(word: bytes) -> list[bytes]:
    """A word in pieces of at most ``PIECE`` bytes, cut between code points."""
    out, at = [], 0
    while len(word) - at > PIECE:
        end = at + PIECE
        while word[end] & 0xC0 == 0x80:
            end -= 1
        out.append(word[at:end])
        at = end
    return [*out, word[at:]]


def train(rows: list[tuple[str, str] | tuple[str, str, int]], training: Training = Training()) -> Network | None:
    """Train on (text, label) or (text, label, times) rows, labels in equal parts, words as often as they occur; None without a word to learn from."""
    words: dict[str, list[bytes]] = {}
    times: dict[str, list[int]] = {}
    for text, label, *n in rows:
        own = [p for w in text.lower().split() for p in pieces_of(w.encode())]
        words.setdefault(label, []).extend(own)
        times.setdefault(label, []).extend([n[0] if n else 1] * len(own))
    words = {k: v for k, v in sorted(words.items()) if v}
    if not words:
        return None
    ends = {k: np.cumsum(times[k]) for k in words}
    network, rng = Network(list(words), training), np.random.default_rng(training.seed)
    params = network.parameters()
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, training.steps + 1):
        target = rng.integers(0, len(network.labels), training.batch)
        drawn = [(words[(name := network.labels[k])], int(np.searchsorted(ends[name], rng.integers(ends[name][-1]), side="right"))) for k in target]
        data, mask = padded([own[at] for own, at in drawn])
        _, grads = network.gradient(data, mask, target)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = training.rate * (1 - step / (training.steps + 1))
        for p, g, m, v in zip(params, grads, first, second, strict=True):
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return network


def held_out(doc_id: Column, modulus: int = 3, rest: int = 1) -> Column:
    """crc32 of the id as text, modulo; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == rest, F.lit(False))


def training_rows(docs: DataFrame, training: Training, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> list[tuple[str, str, int]]:
    """(word, label, occurrences) of the bounded sample: for each label the whole texts of the rows of smallest hash among those not held out.

    Rows are ranked in parts first, so that a label that most rows have is no one task. Words are counted by Spark; of a
    label's distinct words those of smallest hash come here, up to the bound. Rows equal in id and text count each.
    """
    df = docs.where(~held_out(docs[id_col]) & docs[label_col].isNotNull() & docs[text_col].isNotNull())
    df = df.select(df[label_col].cast("string").alias("label"), df[text_col].alias("text"), F.xxhash64(df[id_col], df[text_col]).alias("h"))

    def least(df: DataFrame, most: int) -> DataFrame:
        for part in (["label", F.pmod("h", F.lit(64))], ["label"]):
            df = df.withColumn("n", F.row_number().over(Window.partitionBy(*part).orderBy("h"))).where(F.col("n") <= most).drop("n")
        return df

    # stored, the limits' size is known: they are broadcast while labels are few, and the texts stay where they are
    limits = stored(least(df.select("label", "h"), training.rows_per_language).groupBy("label").agg(F.max("h").alias("most")), "limits")
    sample = df.join(limits, "label").where("h <= most")
    words = sample.select("label", F.explode(F.split(F.lower("text"), r"[\x20\x09-\x0D]+")).alias("word")).where("word <> ''")
    counts = words.groupBy("label", "word").agg(F.count("*").alias("times")).withColumn("h", F.xxhash64("word"))
    found = sorted((r.word, r.label, r.times) for r in least(counts, training.words_per_language).collect())
    discard(limits)
    return found


class Labelled:
    """Evidence of distinct words, kept from batch to batch up to a number of words."""

    def __init__(self, network: Network):
        import regex

        self.network, self.letter = network, regex.compile(r"\p{L}")
        self.clear()

    def clear(self) -> None:
        self.slot: dict[str, int] = {}
        self.total, self.size, self.lettered = np.empty((0, len(self.network.labels))), np.empty(0), np.empty(0, bool)

    def slots(self, words: list[str]) -> np.ndarray:
        if len(self.slot) > CACHE_WORDS:
            self.clear()
        new = [w for w in words if w not in self.slot]
        if new:
            coded = [w.encode() for w in new]
            self.slot.update(zip(new, range(len(self.size), len(self.size) + len(new)), strict=True))
            self.total = np.concatenate([self.total, self.network.label_words(coded)])
            self.size = np.concatenate([self.size, np.fromiter(map(len, coded), float, len(coded))])
            self.lettered = np.concatenate([self.lettered, np.fromiter((bool(self.letter.search(w)) for w in new), bool, len(new))])
        return np.fromiter(map(self.slot.__getitem__, words), np.int64, len(words))

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        words, codes, offsets = split_words(pc.utf8_lower(texts))
        slot = self.slots(words.to_pylist())
        slot = slot[codes] if len(codes) else np.empty(0, np.int64)
        n, doc = len(offsets) - 1, np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        total = lambda each: np.bincount(doc, weights=each, minlength=n)
        evidence = np.stack([total(self.total[slot, k]) for k in range(self.total.shape[1])], axis=1)
        size, lettered = total(self.size[slot]), total(self.lettered[slot].astype(float)) > 0
        logits = evidence / np.maximum(size, 1)[:, None] * np.minimum(size, POOLED)[:, None]
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        labels = [self.network.labels[k] if ok else UNKNOWN for k, ok in zip(best, lettered, strict=True)]
        return labels, np.where(lettered, p[np.arange(n), best], 0.0)


def identify(docs: DataFrame, network: Network | None, text_col: str = "text") -> DataFrame:
    """``docs`` in a struct ``row`` with lang_pred and score (0 to 1), predicted from the text alone.

    ``und`` with score 0 if the text is null or has no letter, or nothing could be learned. The whole text
    is read. Repeated rows get equal predictions; columns of ``docs`` stay inside ``row``.
    """
    packed = docs.select(F.struct("*").alias("row"), docs[text_col].alias("text"))
    schema = T.StructType([packed.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labelled = Labelled(network) if network else None
        for batch in batches:
            for part in text_slices(batch):
                labels, score = labelled.predict(part["text"]) if labelled else ([UNKNOWN] * len(part), np.zeros(len(part)))
                yield pa.RecordBatch.from_arrays([part["row"].combine_chunks(), pa.array(labels, pa.string()), pa.array(score)], ["row", "lang_pred", "score"])
        labelled = None
        give_back()

    return packed.mapInArrow(run, schema)
