"""Chat formatting with DataFrame expressions only.

A conversation becomes one string. Adjacent turns of one role share a block::

    <|im_start|>role\ntext<|im_next|>text<|im_end|>\n

Control strings inside roles and texts get one backslash after their first character
(``<|im_end|>`` becomes ``<\\|im_end|>``, ``<\\|im_end|>`` becomes ``<\\\\|im_end|>``), which
``unescape`` takes out again; line breaks in a role are percent-coded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, NEXT, END = "<|im_start|>", "<|im_next|>", "<|im_end|>\n"
LEARNED = "assistant"
#: Our own marks, and marks of other templates that tokenizers give a meaning.
CONTROL = r"([<\[])(\\*)(\|im_start\|>|\|im_next\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\])"
ESCAPED = CONTROL.replace(r"(\\*)", r"\\(\\*)")
#: Turns whose numbers share a multiple of this are put together before the conversation is.
CHUNK = 64


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def _segment(text: Column, loss: Column) -> Column:
    return F.struct(text.alias("text"), loss.alias("loss"))


def _mark(before: Column, role: Column) -> Column:
    """What stands between a turn of role ``before`` (null: none) and one of ``role``."""
    opening = F.concat(F.lit(START), role, F.lit("\n"))
    return _segment(
        F.when(before.isNull(), opening).when(before == role, NEXT).otherwise(F.concat(F.lit(END), opening)),
        F.lit(False),
    )


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per ``conv_id``: ``formatted``, ``blocks`` and ``segments``.

    ``segments`` (text, loss) put together are ``formatted``; ``loss`` marks the assistant texts, which
    is the loss mask. ``blocks`` counts runs of one role. Turns go by ``turn`` (null first), then role,
    then text, so ties and repeated rows have one order and each row stays a turn. Null roles and texts
    are empty; rows with a null ``conv_id`` form one conversation; other columns are ignored; an empty
    table gives an empty result. A long conversation is put together from chunks of neighbouring turn
    numbers, so that the second grouping gets few rows for it.
    """
    rows = turns.select(
        "conv_id", F.floor(F.col("turn") / CHUNK).alias("chunk"),
        F.struct("turn", F.coalesce("role", F.lit("")).alias("plain"), F.coalesce("text", F.lit("")).alias("said"))
        .alias("row"),
    )
    ordered = F.transform(
        F.sort_array(F.collect_list("row")),
        lambda r: F.struct(_escape_role(r["plain"]).alias("role"), escape(r["said"]).alias("text"),
                           (r["plain"] == LEARNED).alias("loss")),
    )
    chunks = rows.groupBy("conv_id", "chunk").agg(ordered.alias("turns")).withColumn(
        "inner", F.flatten(F.transform("turns", lambda t, i: F.array(
            _mark(F.when(i > 0, F.get("turns", i - 1)["role"]), t["role"]), _segment(t["text"], t["loss"])))),
    ).select("conv_id", F.struct(
        "chunk",
        F.get("turns", F.lit(0))["role"].alias("first"),
        F.element_at("turns", -1)["role"].alias("last"),
        F.slice("inner", F.lit(2), F.size("inner")).alias("inner"),
        F.aggregate(
            "turns", F.struct(F.lit(None).cast("string").alias("role"), F.lit(0).alias("n")),
            lambda run, t: F.struct(t["role"].alias("role"), (run["n"] + F.when(
                run["role"].eqNullSafe(t["role"]), 0).otherwise(1)).alias("n")),
        )["n"].alias("blocks"),
    ).alias("part"))
    parts = chunks.groupBy("conv_id").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    before = lambda i: F.when(i > 0, F.get("parts", i - 1)["last"])
    segments = F.concat(
        F.flatten(F.transform("parts", lambda p, i: F.concat(F.array(_mark(before(i), p["first"])), p["inner"]))),
        F.array(_segment(F.lit(END), F.lit(False))),
    )
    joined = F.transform("parts", lambda p, i: p["blocks"] - F.when(before(i).eqNullSafe(p["first"]), 1).otherwise(0))
    return parts.select("conv_id", segments.alias("segments"),
                        F.aggregate(joined, F.lit(0), lambda n, x: n + x).alias("blocks")).withColumn(
        "formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, in order."""
    blocks = F.slice(F.split(formatted, r"<\|im_end\|>\n"), F.lit(1),
                     F.size(F.split(formatted, r"<\|im_end\|>\n")) - 1)

    def turns(block: Column) -> Column:
        role = _unescape_role(F.substring_index(F.substr(block, F.lit(len(START) + 1)), "\n", 1))
        body = F.regexp_replace(block, r"\A[^\n]*\n", "")
        return F.transform(F.split(body, r"<\|im_next\|>"),
                           lambda text: F.struct(role.alias("role"), unescape(text).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
