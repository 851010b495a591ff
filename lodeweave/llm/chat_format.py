"""Chat formatting with Spark expressions only.

A conversation is sorted by turn; adjacent turns of one role are merged into
one block, whose turns stay apart by a separator. The template is

    [BOS] then per block: [ROLE]role[TEXT]text([SEP]text)*[END]

where the five marks are control strings; texts and roles are escaped so that no
control string (nor one of other templates that begins with `<` or `[`) can
occur in them, and unescaped when read back. The loss mask
is a list of half-open code-point spans over the formatted text: the escaped
text of each assistant turn, marks excluded.

Defined results: null text is empty text; a null role is the role `unknown`;
rows with the same turn number keep a fixed order (role, then text); a null
turn number comes first; rows without a conversation id form one conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The control strings of the template.
ROLE_MARK = "<|role|>"
TEXT_MARK = "<|text|>"
SEP_MARK = "<|next|>"
END_MARK = "<|end|>"
BEGIN_MARK = "<|begin|>"
# What stands for the characters that control strings begin with, and for the mark itself (last to be undone).
ESCAPES = [("<", "\\l"), ("[", "\\b"), ("\\", "\\s")]
TRAINED_ROLE = "assistant"


def escape(text: Column) -> Column:
    """Without `<` and `[`, so no control string is left; each backslash is followed by one of three letters."""
    for char, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(char), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for char, code in ESCAPES:
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def format_chats(
    rows: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    trained_role: str = TRAINED_ROLE,
) -> DataFrame:
    """(conv, formatted string, loss_spans array<struct<start, stop>>), one row a conversation."""
    role = F.coalesce(F.col(role_col).cast("string"), F.lit("unknown"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    turn = F.struct(F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    chats = rows.select(F.col(conv_col).alias("conv"), turn.alias("t")).groupBy("conv").agg(
        F.sort_array(F.collect_list("t")).alias("turns")
    )
    escaped = F.transform("turns", lambda t: F.struct(t.role.alias("role"), escape(t.text).alias("text")))
    chats = chats.select("conv", escaped.alias("turns"))
    # A turn opens a block unless the one before has its role; what precedes each text is then known by itself.
    pieces = F.transform(
        "turns",
        lambda t, i: F.struct(
            F.when(
                (i > 0) & (F.get("turns", i - 1).role == t.role), F.lit(SEP_MARK)
            ).otherwise(
                F.concat(F.when(i > 0, F.lit(END_MARK)).otherwise(F.lit(BEGIN_MARK)), F.lit(ROLE_MARK), escape(t.role), F.lit(TEXT_MARK))
            ).alias("lead"),
            t.text.alias("text"),
            (t.role == trained_role).alias("trained"),
        ),
    )
    chats = chats.select("conv", pieces.alias("pieces"))
    spans = F.aggregate(
        "pieces",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,stop:bigint>>").alias("spans")),
        lambda acc, p: _advance(acc, p),
        lambda acc: acc.spans,
    )
    body = F.concat(F.array_join(F.transform("pieces", lambda p: F.concat(p.lead, p.text)), ""), F.lit(END_MARK))
    return chats.select("conv", body.alias("formatted"), spans.alias("loss_spans"))


def _advance(acc: Column, piece: Column) -> Column:
    start = acc.at + F.char_length(piece.lead)
    stop = (start + F.char_length(piece.text)).cast("long")
    span = F.array(F.struct(start.cast("long").alias("start"), stop.alias("stop")))
    return F.struct(stop.alias("at"), F.when(piece.trained, F.concat(acc.spans, span)).otherwise(acc.spans).alias("spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv, turns array<struct<role, text>>, loss_text, formatted_chars), from the output of format_chats() alone."""
    body = F.regexp_replace("formatted", r"^<\|begin\|>|<\|end\|>$", "")
    blocks = F.split(body, r"<\|end\|>")
    turns = F.flatten(
        F.transform(
            blocks,
            lambda block: F.transform(
                F.split(F.element_at(F.split(block, r"<\|text\|>", 2), 2), r"<\|next\|>"),
                lambda text: F.struct(
                    unescape(F.substring_index(F.element_at(F.split(block, r"<\|text\|>", 2), 1), ROLE_MARK, -1)).alias("role"),
                    unescape(text).alias("text"),
                ),
            ),
        )
    )
    loss = F.array_join(
        F.transform(
            "loss_spans", lambda s: unescape(F.col("formatted").substr((s.start + 1).cast("int"), (s.stop - s.start).cast("int")))
        ),
        "",
    )
    return formatted.select(
        "conv", turns.alias("turns"), loss.alias("loss_text"), F.char_length("formatted").cast("long").alias("formatted_chars")
    )
