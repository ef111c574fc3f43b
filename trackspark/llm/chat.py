"""Chat formatting with a grammar round trip, in DataFrame functions only.

A conversation is rendered by a template whose marks are control strings. The rendered text is parsed again by a
deterministic grammar and the turns it gives are compared with the source. Turns that do not come back as they were
are escaped (a backslash before each control string) and the text is rendered and parsed anew, until both are
identical. The parser takes a control string for a mark only if no backslash stands before it, and takes one
backslash off where one does, so one escape gives back whatever a text holds; should it not, the job fails.

Grammar, with control strings as tokens::

    conversation = { turn }
    turn         = open content close            roles with marks of their own
                 | ROLE name /ROLE TEXT content /TEXT   any other role

Contents have one blank on either side that is no part of them; nothing stands between the marks of two turns.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks around the content of a turn by role; other roles are named in the text. Marks hold no blank."""

    marks: dict[str, tuple[str, str]] = field(default_factory=lambda: {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")})
    name: tuple[str, str] = ("[ROLE]", "[/ROLE]")
    text: tuple[str, str] = ("[TEXT]", "[/TEXT]")
    #: Roles whose text bears the loss.
    learned: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        found = self.strings
        cut = any(a[k:] == b[: len(a) - k] for a in found for b in found for k in range(1, len(a)))
        if len(set(found)) < len(found) or cut or any(b in a for a in found for b in found if a != b) or any(c.isspace() or c == "\\" for m in found for c in m):
            raise ValueError("marks must differ, not overlap, and hold neither blanks nor backslashes")

    @property
    def strings(self) -> list[str]:
        return [m for pair in (*self.marks.values(), self.name, self.text) for m in pair]

    @property
    def control(self) -> str:
        """Pattern of all control strings."""
        return "|".join("".join(c if c.isalnum() else f"\\{c}" for c in m) for m in self.strings)


def escaped(text: Column, template: Template) -> Column:
    return F.regexp_replace(text, f"(?=(?:{template.control}))", r"\\")


def unescaped(text: Column, template: Template) -> Column:
    return F.regexp_replace(text, rf"\\(?=(?:{template.control}))", "")


def _wrapped(marks: tuple[str, str], content: Column) -> Column:
    return F.concat(F.lit(f"{marks[0]} "), content, F.lit(f" {marks[1]}"))


def rendered(turns: Column, template: Template) -> Column:
    """Text of an array of (role, text)."""

    def one(t: Column) -> Column:
        out = F.concat(_wrapped(template.name, t["role"]), _wrapped(template.text, t["text"]))
        for role, marks in template.marks.items():
            out = F.when(t["role"] == role, _wrapped(marks, t["text"])).otherwise(out)
        return out

    return F.array_join(F.transform(turns, one), "")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` computed once however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), 0)


def parsed(text: Column, template: Template) -> Column:
    """Array of (role, text, width, loss) that a rendered text holds by the grammar; null if it is no text of the grammar.

    ``width`` is the number of characters that the content takes in the rendered text.
    """
    mark = rf"(?<!\\)(?:{template.control})"
    pairs = [*template.marks.values(), template.name, template.text]
    closes = F.create_map(*[F.lit(m) for pair in pairs for m in pair])
    opens_name, opens_text = (lambda p: p["open"] == template.name[0]), (lambda p: p["open"] == template.text[0])
    inside = lambda p: p["inside"].substr(F.lit(2), F.length(p["inside"]) - 2)

    def parts(t: Column) -> Column:
        """What stands at each pair of marks."""
        span = F.sequence(F.lit(0), (F.size(t["marks"]) / 2).cast("int") - 1)
        at = lambda of, i: F.get(t[of], i)
        one = lambda i: F.struct(at("marks", 2 * i).alias("open"), at("marks", 2 * i + 1).alias("close"), at("pieces", 2 * i).alias("before"), at("pieces", 2 * i + 1).alias("inside"))
        return F.transform(F.when(F.size(t["marks"]) >= 2, span).otherwise(F.array().cast("array<int>")), one)

    def well(p: Column) -> Column:
        blanks = (F.length(p["inside"]) >= 2) & p["inside"].startswith(" ") & p["inside"].endswith(" ")
        return F.coalesce((p["before"] == "") & (closes[p["open"]] == p["close"]) & blanks, F.lit(False))

    def turns(t: Column, found: Column) -> Column:
        # the name of a role stands before its text, and nowhere else
        named = F.transform(found, lambda p, i: opens_text(p) == F.coalesce(opens_name(F.get(found, i - 1)), F.lit(False)))
        whole = (F.size(t["marks"]) % 2 == 0) & (F.element_at(t["pieces"], -1) == "") & F.forall(found, well) & F.forall(named, lambda x: x)
        whole &= ~F.coalesce(opens_name(F.get(found, F.size(found) - 1)), F.lit(False))

        def turn(p: Column, i: Column) -> Column:
            role = F.when(opens_text(p), unescaped(inside(F.get(found, i - 1)), template))
            for name, (open_mark, _) in template.marks.items():
                role = role.when(p["open"] == open_mark, F.lit(name))
            width = (F.length(p["inside"]) - 2).cast("long")
            return F.struct(role.alias("role"), unescaped(inside(p), template).alias("text"), width.alias("width"), role.isin(*template.learned).alias("loss"))

        return F.when(whole, F.filter(F.transform(found, turn), lambda x: x["role"].isNotNull()))

    tokens = F.struct(F.regexp_extract_all(text, F.lit(f"({mark})"), 1).alias("marks"), F.split(text, mark, -1).alias("pieces"))
    return _let(tokens, lambda t: _let(parts(t), lambda found: turns(t, found)))


def formatted(rows: DataFrame, template: Template = Template(), id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted (the rendered text) and turns, an array of (role, text, width, loss) read back from it.

    Turns go by ``turn`` (null first), ties by role and text; null roles and texts are empty. Repeated rows are turns of
    their own. Rows of a null id are one conversation. Other columns are not carried on, so their names cannot clash.
    A conversation is one value, as its text is. An empty table gives an empty result.
    """
    plain = lambda c: F.coalesce(rows[c], F.lit(""))
    picked = rows.select(rows[id_col].alias("conv_id"), F.struct(rows[turn_col].alias("turn"), plain(role_col).alias("role"), plain(text_col).alias("text")).alias("row"))
    df = picked.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    pair = lambda role, text: F.struct(role.alias("role"), text.alias("text"))
    same = lambda x: F.transform(x["turns"], lambda t: pair(t["role"], t["text"])) == x["source"]
    failed = F.raise_error(F.concat(F.lit("no escape gives back conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))))

    def read_back(source: Column, contents: Column) -> Column:
        """(source, formatted, turns), where the contents are rendered and the text parsed."""
        return _let(rendered(contents, template), lambda text: F.struct(source.alias("source"), text.alias("formatted"), parsed(text, template).alias("turns")))

    source = F.transform("rows", lambda r: pair(r["role"], r["text"]))
    safe = lambda x: F.transform(x["source"], lambda t: pair(escaped(t["role"], template), escaped(t["text"], template)))
    again = lambda x: F.when(same(x), x).otherwise(read_back(x["source"], safe(x)))
    checked = lambda x: F.when(same(x), x).otherwise(failed)
    done = _let(_let(_let(source, lambda s: read_back(s, s)), again), checked)
    return df.select("conv_id", done.alias("x")).select("conv_id", "x.formatted", "x.turns")


def digests(chats: DataFrame) -> DataFrame:
    """What came back, by conversation: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    df = chats.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return df.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def loss_spans(chats: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, start and length (code points of ``formatted``) of each content that bears the loss, one row each."""
    fixed = len("".join((*template.name, template.text[0]))) + 3
    df = chats.select("conv_id", F.posexplode("turns").alias("at", "t"))
    before, behind = F.length(escaped(F.col("t.role"), template)) + fixed, F.lit(len(template.text[1]) + 1)
    for role, (a, b) in template.marks.items():
        before, behind = F.when(F.col("t.role") == role, len(a) + 1).otherwise(before), F.when(F.col("t.role") == role, len(b) + 1).otherwise(behind)
    df = df.withColumn("before", before).withColumn("size", before + F.col("t.width") + behind)
    so_far = Window.partitionBy("conv_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("start", F.coalesce(F.sum("size").over(so_far), F.lit(0)) + F.col("before"))
    return df.where("t.loss").select("conv_id", F.col("start").cast("long"), F.col("t.width").alias("length"))
