"""The prefix trie against brute force, refined in tasks and over the cluster."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from trackspark.llm.trie import trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, class int"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
            own[c].append((turn is not None, turn or 0, key, role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    made = {}
    for c in own:
        h, head = zlib.crc32(str(c).encode()) % 9, c - (c % 5 if c >= 0 else -(-c % 5))
        made[c] = tuple(own.get(head, [])[:h] + own[c][h:])
    nodes, children = defaultdict(list), defaultdict(list)
    for c, seq in made.items():
        for d in range(len(seq) + 1):
            nodes[seq[:d]].append(c)
    for k in nodes:
        if k:
            children[k[:-1]].append(k)
    out, leaves, saved = Counter(), {}, {}
    for k in sorted(nodes, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in children[k]) or 1
        saved[k] = sum(saved[x] for x in children[k]) + (len(nodes[k]) - 1) * (len(k[-1][1].encode()) if k else 0)
        ends = ",".join(map(str, sorted(c for c in nodes[k] if len(made[c]) == len(k))))
        parent = min(nodes[k[:-1]]) if k else None
        out[min(nodes[k]), len(k), parent, len(nodes[k]), len(children[k]), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()] += 1
    return out


def some_rows():
    dice = random.Random(3)
    rows = []
    for c in [*range(60), -3, -5, -12, 1000001, 2**63 - 1]:
        for turn in range(dice.randrange(1, 12)):
            rows.append((c, dice.choice([turn, turn, turn, None, 1]), dice.choice(["user", "assistant", None]), dice.choice(["a", "b", None, "ü long text"]), "x", 1))
    rows += [(None, 0, "user", "no conversation", "x", 1)]
    rows += [(c, turn, "user", "same", "x", 1) for c in range(2000, 2200) for turn in range(5)]  # copies
    return rows + [(3000, turn, "user", "t" * 1000, "x", 1) for turn in range(400)] + [(3001, turn, "user", "t" * 1000, "x", 1) for turn in range(401)]


@pytest.mark.parametrize("local", [20_000, 300, 3])
def test_trie_by_brute_force(spark, local):
    rows = some_rows() if local > 3 else [r for r in some_rows() if r[0] is None or r[0] < 3000]
    found = trie(spark.createDataFrame(rows, SCHEMA).repartition(3), local_rows=local)
    assert Counter(map(tuple, found.collect())) == brute(rows)


def test_trie_of_turnless_conversations_and_of_nothing(spark):
    c = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)  # takes all from a head that is absent
    assert [tuple(r) for r in trie(spark.createDataFrame([(c, 0, "user", "a", "x", 1)], SCHEMA)).collect()] == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
    assert trie(spark.createDataFrame([], SCHEMA)).count() == 0
