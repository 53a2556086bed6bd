r"""Chat formatting with typed parts, in built-in expressions only.

A message is a row with parts: text, image, audio or document. A visitor turns each part into
text: a text part is escaped, any other becomes a placeholder of its kind and an entry in the
list of attachments, in the same order, with its reference and the tokens it expands to. A
conversation becomes

    <|turn|>role<|says|>body<|end|>

for each turn, and the loss mask lists where the bodies of the trained roles are. Escaping puts
a backslash behind every < and [ and doubles every backslash, so no control string of this or
another template (all begin with < or [) is left in a text, and any text can be read back.

One exchange by conversation serves both the running offsets and the gathering of turns. A
conversation is one training example, so it is one row.

Defined results: a null text or role is empty, null parts are none; parts of an unknown kind
become the placeholder of ``part``, of no tokens; equal turn numbers go by role and text; a null
turn comes first; rows without a conversation make one together; repeated rows repeat turns; an
empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
PARTS = f"array<{PART}>"


def escaped(text: Column) -> Column:
    out = text
    for plain, safe in (("\\", "\\\\"), ("<", "<\\"), ("[", "[\\")):
        out = F.replace(out, F.lit(plain), F.lit(safe))
    return out


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\|\\(\\)", "$1$2")


def text_parts(text: Column) -> Column:
    """A text as a list of one part."""
    none = {"ref": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    rest = [F.lit(None).cast(kind).alias(name) for name, kind in none.items()]
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), *rest))


class PartVisitor:
    """Text and token count of each kind of part; subclass to change a kind or add one."""

    kinds = ("text", "image", "audio", "document")
    patch, pages_tokens, seconds_tokens = 14, 512, 25

    def text(self, part: Column) -> tuple[Column, Column]:
        return escaped(F.coalesce(part["text"], F.lit(""))), F.lit(0)

    def image(self, part: Column) -> tuple[Column, Column]:
        return F.lit("<|image|>"), F.ceil(part["width"] / self.patch) * F.ceil(part["height"] / self.patch)

    def audio(self, part: Column) -> tuple[Column, Column]:
        return F.lit("<|audio|>"), F.ceil(part["seconds"] * self.seconds_tokens)

    def document(self, part: Column) -> tuple[Column, Column]:
        return F.lit("<|document|>"), part["pages"] * self.pages_tokens

    def _visit(self, part: Column, which: int, other: Column) -> Column:
        out = other
        for kind in reversed(self.kinds):
            out = F.when(part["kind"] == kind, getattr(self, kind)(part)[which]).otherwise(out)
        return out

    def flat(self, parts: Column) -> Column:
        """The parts as one escaped text with placeholders."""
        return F.array_join(F.transform(parts, lambda p: self._visit(p, 0, F.lit("<|part|>"))), "")

    def attachments(self, parts: Column) -> Column:
        """Kind, reference and tokens of each placeholder, in order."""
        others = F.filter(parts, lambda p: ~p["kind"].eqNullSafe(F.lit("text")))
        return F.transform(others, lambda p: F.struct(
            p["kind"].alias("kind"), p["ref"].alias("ref"),
            F.coalesce(self._visit(p, 1, F.lit(0)), F.lit(0)).cast("long").alias("tokens"),
        ))


def formatted(
    messages: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts",
    trained: tuple[str, ...] = ("assistant",), visitor: PartVisitor | None = None,
) -> DataFrame:
    """Per conversation: key, ``formatted``, ``loss`` (spans of code points), ``attachments`` (with their turn), ``n_turns``."""
    visitor = visitor or PartVisitor()
    listed = F.coalesce(F.col(f"`{parts}`"), F.expr(f"cast(array() as {PARTS})"))
    rows = messages.select(
        F.col(f"`{key}`").alias("key"), F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"),
        visitor.flat(listed).alias("body"), visitor.attachments(listed).alias("files"),
    )
    head = F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(SAYS))
    rows = rows.select("key", "turn", "role", "body", "files", F.concat(head, "body", F.lit(END + "\n")).alias("said"), F.char_length(head).alias("head"))
    order = Window.partitionBy("key").orderBy(F.col("turn").asc_nulls_first(), "role", "body")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumns({
        "place": F.row_number().over(order), "start": F.sum(F.char_length("said")).over(running) - F.char_length("said") + F.col("head"),
    })
    one = F.struct(
        "place", "said", "files",
        F.when(F.col("role").isin(*trained), F.struct(F.col("start").alias("start"), (F.col("start") + F.char_length("body")).alias("end"))).alias("loss"),
    )
    gathered = placed.groupBy("key").agg(F.array_sort(F.collect_list(one)).alias("turns"), F.count("*").alias("n_turns"))
    files = F.flatten(F.transform("turns", lambda t: F.transform(t["files"], lambda f: F.struct(
        t["place"].alias("turn"), f["kind"].alias("kind"), f["ref"].alias("ref"), f["tokens"].alias("tokens"),
    ))))
    return gathered.select(
        F.col("key").alias(key), F.array_join(F.transform("turns", lambda t: t["said"]), "").alias("formatted"),
        F.filter(F.transform("turns", lambda t: t["loss"]), lambda s: s.isNotNull()).alias("loss"), files.alias("attachments"), "n_turns",
    )


def read_back(text: Column) -> Column:
    """Role and body of each turn of a formatted text, unescaped; placeholders stay."""
    marks = r"<\|says\|>|<\|end\|>"
    turns = F.slice(F.split(text, r"<\|turn\|>"), 2, F.greatest(F.size(F.split(text, r"<\|turn\|>")) - 1, F.lit(0)))
    return F.transform(turns, lambda t: F.struct(unescaped(F.split(t, marks)[0]).alias("role"), unescaped(F.split(t, marks)[1]).alias("text")))


def under_mask(text: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(loss, lambda s: unescaped(F.substring(text, s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")))), "")
