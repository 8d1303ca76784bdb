"""Chat formatting checked by a grammar round trip.

Grammar:  conversation = turn*     turn = OPEN body CLOSE

    role        OPEN            CLOSE
    user        [INST]          [/INST]
    system      <<SYS>>         <</SYS>>
    assistant   <s>             </s>
    any other   [ROLE=name]     [/ROLE]

A body holds no control string. Each turn is first rendered with its text as it is and reparsed; if the parser
doesn't recover exactly the role and the text from exactly two control strings, the text is escaped and the
turn rendered again. The parser always unescapes, so a text that merely looks escaped is a conflict as well.
Escaped: backslash, both square brackets and `<` become a backslash and one of e, b, d, l; no control string
can stand in the result, and the way back is unique.

As the parser stops at the first CLOSE after an OPEN, turns that are recovered one by one are recovered from
their concatenation.

Defined cases: a null text or role is empty; a very long text is escaped and parsed whole; turns go by (turn, rendered text), null turns first, so repeated
rows and ties have one order; a null conv_id is a conversation of its own; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPENS = r"\[INST\]|<<SYS>>|<s>|\[ROLE=[^\]]*\]"
CLOSES = r"\[/INST\]|<</SYS>>|</s>|\[/ROLE\]"
CONTROL = f"{OPENS}|{CLOSES}"
TURN = f"(?s)({OPENS})(.*?)(?:{CLOSES})"
ESCAPES = (("\\", "\\e"), ("[", "\\b"), ("]", "\\d"), ("<", "\\l"))


def escape(text: Column) -> Column:
    for plain, escaped in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def unescape(text: Column) -> Column:
    for plain, escaped in reversed(ESCAPES):
        text = F.replace(text, F.lit(escaped), F.lit(plain))
    return text


def _marks(role: Column) -> tuple[Column, Column]:
    def pick(user: str, system: str, assistant: str, other: Column) -> Column:
        return F.when(role == "user", user).when(role == "system", system).when(role == "assistant", assistant).otherwise(other)

    return (
        pick("[INST]", "<<SYS>>", "<s>", F.concat(F.lit("[ROLE="), escape(role), F.lit("]"))),
        pick("[/INST]", "<</SYS>>", "</s>", F.lit("[/ROLE]")),
    )


def role_of(mark: Column) -> Column:
    """The role that an OPEN stands for."""
    name = F.regexp_extract(mark, r"(?s)^\[ROLE=(.*)\]$", 1)
    return F.when(mark == "[INST]", "user").when(mark == "<<SYS>>", "system").when(mark == "<s>", "assistant").otherwise(unescape(name))


def _recovered(role: Column, text: Column, rendered: Column) -> Column:
    return (
        (F.regexp_count(rendered, F.lit(CONTROL)) == 2)
        & (role_of(F.regexp_extract(rendered, TURN, 1)) == role)
        & (unescape(F.regexp_extract(rendered, TURN, 2)) == text)
    )


def render_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per turn: conv_id, turn, open, body, close, loss (is it under the mask), escaped."""
    t = turns.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    opened, closed = _marks(F.col("role"))
    t = t.withColumn("open", opened).withColumn("close", closed)
    t = t.withColumn("escaped", ~_recovered(F.col("role"), F.col("text"), F.concat("open", "text", "close")))
    t = t.withColumn("body", F.when(F.col("escaped"), escape(F.col("text"))).otherwise(F.col("text")))
    whole = F.concat("open", "body", "close")
    wrong = F.concat(F.lit("a turn isn't recovered from: "), F.substring(whole, 1, 200))
    t = t.withColumn(
        "body",
        F.when(F.col("escaped") & ~_recovered(F.col("role"), F.col("text"), whole), F.raise_error(wrong)).otherwise(F.col("body")),
    )
    return t.select("conv_id", "turn", "open", "body", "close", (F.col("role") == "assistant").alias("loss"), "escaped")


def format_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per conversation: conv_id and segments (text, loss). The formatted text is the segments' texts one after
    the other; those with loss are the bodies of assistant turns. A conversation is one value of the output, so
    its turns meet in one row; conversations are spread over the tasks."""
    t = render_turns(turns, conv, turn, role, text)
    turn_struct = F.struct(F.col("turn"), F.concat("open", "body", "close").alias("whole"), "open", "body", "close", "loss")
    grouped = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn_struct)).alias("t"))

    def segments(x: Column) -> Column:
        none = F.lit(False)
        return F.array(
            F.struct(x["open"].alias("text"), none.alias("loss")),
            F.struct(x["body"].alias("text"), x["loss"].alias("loss")),
            F.struct(x["close"].alias("text"), none.alias("loss")),
        )

    return grouped.select("conv_id", F.flatten(F.transform("t", segments)).alias("segments"))


def formatted(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def parse(text: Column) -> tuple[Column, Column]:
    """Roles and texts of the turns of a formatted conversation, as two arrays."""
    marks = F.regexp_extract_all(text, F.lit(TURN), 1)
    bodies = F.regexp_extract_all(text, F.lit(TURN), 2)
    return F.transform(marks, role_of), F.transform(bodies, unescape)


def masked_texts(segments: Column) -> Column:
    """The texts under the loss mask, unescaped, in order."""
    return F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"]))
