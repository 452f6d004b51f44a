"""Chat formatting: conversations as marked-up text with a loss mask, in Spark expressions.

``format_chat`` sorts the collected turns of a conversation, merges neighbours of the same
role and concatenates them to

    <|im_start|>role NEWLINE text (<|im_sep|> text)* <|im_end|> NEWLINE

``<|im_sep|>`` stands between the texts of merged turns, so that the turns can be read back.
Control strings inside roles and texts are escaped: a backslash goes behind the ``<`` of
every ``<|``, ``<\\|`` and so on, which keeps other texts as they are and can be undone.

Defined cases: a null role or text is empty; a newline in a role becomes ``<\\n|``; turns of
one number are ordered by role and text, null numbers come first; repeated rows are repeated
turns; rows without a conversation id form one conversation; an empty table gives no rows;
other columns are ignored.  A conversation is one output string, so it is held by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let, running_total

START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"


def escape_control(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape_control(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def _escape_role(role: Column) -> Column:
    # the second step cannot meet what the first one left: that never has "<\n|"
    return F.replace(escape_control(F.regexp_replace(role, r"<(\\*)n\|", r"<\\$1n|")), F.lit("\n"), F.lit("<n|"))


def _unescape_role(role: Column) -> Column:
    plain = unescape_control(F.replace(role, F.lit("<n|"), F.lit("\n")))
    return F.regexp_replace(plain, r"<\\(\\*)n\|", "<$1n|")


def _merge(turns: Column) -> Column:
    """Neighbours of one role as one struct with the array of their texts.

    Runs are cut where the role changes, so a turn is copied once, however many there are.
    """

    def build(all_turns: Column) -> Column:
        changes = F.transform(
            all_turns, lambda t, i: F.when((i == 0) | (F.get(all_turns, i - 1)["role"] != t["role"]), i)
        )

        def run(start: Column, end: Column) -> Column:
            texts = F.transform(F.slice(all_turns, start + 1, end - start), lambda t: t["text"])
            return F.struct(F.get(all_turns, start)["role"].alias("role"), texts.alias("texts"))

        return let(
            F.filter(changes, lambda i: i.isNotNull()),
            lambda at: F.transform(
                at, lambda start, k: run(start, F.coalesce(F.get(at, k + 1), F.size(all_turns)))
            ),
        )

    return let(turns, build)


def _piece(text: Column, learn: Column) -> Column:
    return F.struct(text.alias("text"), learn.alias("learn"))


def format_chat(
    rows: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    learn: tuple[str, ...] = ("assistant",),
) -> DataFrame:
    """``conversation``, ``formatted`` and ``loss``: spans of code points to learn from.

    ``loss`` is an array of structs ``start`` (from zero) and ``length``, one for each text
    of a role in ``learn``.
    """
    no = F.lit(False)
    one = F.struct(
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    grouped = rows.select(F.col(conversation).alias("_id"), one.alias("_turn")).groupBy("_id")
    turns = grouped.agg(F.sort_array(F.collect_list("_turn")).alias("_turns"))

    def pieces(merged: Column) -> Column:
        first = F.concat(F.lit(START), _escape_role(merged["role"]), F.lit("\n"))
        body = F.transform(
            merged["texts"],
            lambda t, i: F.array(
                _piece(F.when(i == 0, first).otherwise(F.lit(SEPARATOR)), no),
                _piece(escape_control(t), merged["role"].isin(*learn)),
            ),
        )
        return F.concat(F.flatten(body), F.array(_piece(F.lit(END), no)))

    out = turns.select("_id", F.flatten(F.transform(_merge(F.col("_turns")), pieces)).alias("_pieces"))

    def spans(all_pieces: Column) -> Column:
        lengths = F.transform(all_pieces, lambda p: F.length(p["text"]))
        return let(
            running_total(lengths),
            lambda starts: F.transform(
                F.filter(
                    F.transform(
                        all_pieces,
                        lambda p, i: F.struct(
                            p["learn"].alias("learn"),
                            F.get(starts, i).alias("start"),
                            F.length(p["text"]).alias("length"),
                        ),
                    ),
                    lambda s: s["learn"],
                ),
                lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length")),
            ),
        )

    return out.select(
        F.col("_id").alias(conversation),
        F.array_join(F.col("_pieces.text"), "").alias("formatted"),
        let(F.col("_pieces"), spans).alias("loss"),
    )


def read_chat(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of structs ``role`` and ``text``."""
    marked = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda t: t != "")

    def turns(block: Column) -> Column:
        body = F.substring(block, len(START) + 1, F.length(block))
        role = F.substring_index(body, "\n", 1)
        texts = F.split(F.substring(body, F.length(role) + 2, F.length(body)), r"<\|im_sep\|>")
        return F.transform(
            texts,
            lambda t: F.struct(_unescape_role(role).alias("role"), unescape_control(t).alias("text")),
        )

    return F.flatten(F.transform(marked, turns))


def learned_text(formatted: Column, loss: Column) -> Column:
    """What the loss mask covers, unescaped, nothing in between."""
    parts = F.transform(
        loss, lambda s: unescape_control(F.substring(formatted, s["start"] + 1, s["length"]))
    )
    return F.array_join(parts, "")
