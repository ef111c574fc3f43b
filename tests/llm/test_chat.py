"""Chat formatting: turns come back whatever their texts hold."""

import hashlib
import random
from collections import defaultdict

import pytest

from trackspark.llm.chat import Template, digests, formatted, loss_spans

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, turns int"
PIECES = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "[TEXT]", "[/TEXT]", "\\", "\\\\", " ", "\n", "a", "é😀", "<s", "INST]", "<", "$1"]


def some_rows():
    dice = random.Random(2)
    rows = []
    for c in range(80):
        for turn in range(dice.randrange(1, 6)):
            text = "".join(dice.choice(PIECES) for _ in range(dice.randrange(6)))
            rows.append((c, turn, dice.choice(["user", "assistant", "system", "tool", "", None, "[ROLE]", "x\\[/ROLE]"]), dice.choice([text, text, None]), "f", 1))
    rows += [(None, 0, "user", "no id", None, None), (None, None, "assistant", "first", None, None), (90, 1, "user", "same", "f", 1), (90, 1, "user", "same", "f", 1), (91, 0, "assistant", "\\" * 30000 + "[INST]" * 3000, "f", 1)]
    return rows


def chats(rows):
    found = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        found[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(t)] for c, t in found.items()}


def test_turns_come_back(spark):
    rows = some_rows()
    out = formatted(spark.createDataFrame(rows, SCHEMA).repartition(3))
    want, got = chats(rows), {r.conv_id: r for r in out.collect()}
    assert got.keys() == want.keys()
    for c, turns in want.items():
        assert [(t.role, t.text) for t in got[c].turns] == turns
        assert all(t.loss == (t.role == "assistant") for t in got[c].turns)
    digest = {r.conv_id: r for r in digests(out).collect()}
    spans = defaultdict(list)
    for r in loss_spans(out).collect():
        spans[r.conv_id].append((r.start, r.length))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, turns in want.items():
        loss, d, text = "".join(t for r, t in turns if r == "assistant"), digest[c], got[c].formatted
        assert (d.n_turns, d.turns_sha256) == (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)))
        assert (d.loss_chars, d.loss_sha256, d.formatted_chars) == (len(loss), sha(loss), len(text))
        # what lies under the mask is the assistant's text, escaped
        masked = [text[a : a + n] for a, n in sorted(spans[c])]
        for m in PIECES[:10]:
            masked = [x.replace("\\" + m, m) for x in masked]
        assert masked == [t for r, t in turns if r == "assistant"]


def test_only_conflicting_conversations_are_escaped(spark):
    rows = [(1, 0, "user", "plain \\ text", None, None), (2, 0, "user", "has [/INST] inside", None, None), (3, 0, "user", "escaped \\<s>", None, None)]
    got = {r.conv_id: r.formatted for r in formatted(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: "[INST] plain \\ text [/INST]", 2: "[INST] has \\[/INST] inside [/INST]", 3: "[INST] escaped \\\\<s> [/INST]"}


def test_empty_table_and_templates(spark):
    assert digests(formatted(spark.createDataFrame([], SCHEMA))).count() == 0
    own = Template(marks={"q": ("{Q}", "{/Q}"), "a": ("{A}", "{/A}")}, learned=("a",))
    row = formatted(spark.createDataFrame([(1, 0, "q", "{/Q}{A}", None, None), (1, 1, "a", "yes", None, None), (1, 2, "user", "[INST]", None, None)], SCHEMA), own).first()
    assert row.formatted == "{Q} \\{/Q}\\{A} {/Q}{A} yes {/A}[ROLE] user [/ROLE][TEXT] [INST] [/TEXT]"
    assert [(t.role, t.text, t.loss) for t in row.turns] == [("q", "{/Q}{A}", False), ("a", "yes", True), ("user", "[INST]", False)]
    for marks in ({"q": ("<a>", "<a>")}, {"q": ("a b", "c")}, {"q": ("xy", "yz")}, {"q": ("\\x", "y")}):
        with pytest.raises(ValueError):
            Template(marks=marks)
