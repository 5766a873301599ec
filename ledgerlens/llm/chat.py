"""Chat formatting as relational work, with DataFrame functions only.

A conversation becomes one string of marked blocks:

    <|start|>role<|text|>text<|next|>text<|end|><|start|>role<|text|>...<|end|>

Adjacent turns of one role share a block; ``<|next|>`` keeps them apart so that the turns can be read back.
Every mark begins with ``<|``. In roles and texts, backslashes are doubled and ``<|`` is written ``<\\|``, so that
no text can hold a mark and the original comes back exactly.

Turns are gathered in runs of at most ``RUN`` turn numbers, formatted there, and the runs' strings are then joined
per conversation: a long conversation is formatted in many groups, and only its finished strings meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, TEXT, NEXT, END = "<|start|>", "<|text|>", "<|next|>", "<|end|>"
RUN = 256
BLOCKS = "array<struct<role:string,texts:array<string>>>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def _blocks(turns: Column) -> Column:
    """Sorted turn structs with adjacent turns of a role merged: (role, texts)."""
    def add(blocks: Column, turn: Column) -> Column:
        last = F.element_at(blocks, -1)
        grown = F.struct(last["role"].alias("role"), F.concat(last["texts"], F.array(turn["text"])).alias("texts"))
        fresh = F.struct(turn["role"].alias("role"), F.array(turn["text"]).alias("texts"))
        return F.when((F.size(blocks) > 0) & (F.try_element_at(blocks, F.lit(-1))["role"] == turn["role"]),
                      F.concat(F.slice(blocks, 1, F.size(blocks) - 1), F.array(grown))).otherwise(F.concat(blocks, F.array(fresh)))

    return F.aggregate(turns, F.array().cast(BLOCKS), add)


def _segments(blocks: Column, trained: Column) -> Column:
    """(s, loss) in order: marks and texts of a run's blocks, without the head of its first block."""
    def block(b: Column, i: Column) -> Column:
        head = F.when(i == 0, F.lit("")).otherwise(F.concat(F.lit(END + START), b["role"], F.lit(TEXT)))
        texts = F.transform(b["texts"], lambda t, k: F.array(
            F.struct(F.when(k == 0, head).otherwise(F.lit(NEXT)).alias("s"), F.lit(False).alias("loss")),
            F.struct(t.alias("s"), F.array_contains(trained, b["role"]).alias("loss"))))
        return F.flatten(texts)

    return F.flatten(F.transform(blocks, block))


def _spans(segments: Column) -> Column:
    """(start, length) in code points, from 0, of the segments under the loss mask."""
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def add(acc: Column, x: Column) -> Column:
        end = acc["at"] + F.length(x["s"])
        span = F.struct(acc["at"].alias("start"), F.length(x["s"]).alias("length"))
        return F.struct(end.alias("at"), F.when(x["loss"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(segments, state, add, lambda acc: acc["spans"])


def format_conversations(turns: DataFrame, trained_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row for each conversation: ``conv_id`` and ``pieces``, array of (text, loss).

    The texts of the pieces, one after another, are the formatted conversation; ``loss`` are the spans (start and
    length in code points) of a piece that are trained on: the texts of ``trained_roles``, without any mark.
    ``turns`` has conv_id, turn, role, text. Turns are taken by number; null numbers come last, and ties by role, then
    text; repeated rows are repeated turns. Null roles and texts count as empty. Turns with a null conv_id form
    one conversation with a null id. Other columns are not read; an empty table gives no rows.
    """
    clean = turns.select("conv_id", F.col("turn").isNull().alias("none"), "turn", escape(F.coalesce("role", F.lit(""))).alias("role"),
                         escape(F.coalesce("text", F.lit(""))).alias("text"))
    runs = (clean.groupBy("conv_id", "none", F.floor(F.col("turn") / RUN).alias("run"))
            .agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("all")))
    # turns without a number, or with one number, are one run however many they are: it is cut by place
    places = F.sequence(F.lit(0).cast("long"), F.floor((F.size("all") - 1) / RUN))
    runs = (runs.select("conv_id", "none", "run", F.posexplode(F.transform(places, lambda i: F.slice("all", (i * RUN + 1).cast("int"), F.lit(RUN)))).alias("part", "turns"))
            .withColumn("blocks", _blocks(F.col("turns"))))
    trained = F.array(*[escape(F.lit(r)) for r in trained_roles])
    runs = runs.select("conv_id", "none", "run", "part", F.element_at("blocks", 1)["role"].alias("first"), F.element_at("blocks", -1)["role"].alias("last"),
                       _segments(F.col("blocks"), trained).alias("segments"))
    runs = runs.select("conv_id", F.struct("none", "run", "part", "first", "last", F.concat_ws("", F.col("segments.s")).alias("body"),
                                           _spans(F.col("segments")).alias("spans")).alias("piece"))
    gathered = runs.groupBy("conv_id").agg(F.sort_array(F.collect_list("piece")).alias("runs"))

    def piece(r: Column, i: Column) -> Column:
        before = F.try_element_at("runs", F.when(i > 0, i).otherwise(F.size("runs") + 1))  # null for the first
        head = F.when(before["last"] == r["first"], F.lit(NEXT)).otherwise(
            F.concat(F.when(i > 0, F.lit(END)).otherwise(F.lit("")), F.lit(START), r["first"], F.lit(TEXT)))
        tail = F.when(i == F.size("runs") - 1, F.lit(END)).otherwise(F.lit(""))
        moved = F.transform(r["spans"], lambda s: F.struct((s["start"] + F.length(head)).alias("start"), s["length"].alias("length")))
        return F.struct(F.concat(head, r["body"], tail).alias("text"), moved.alias("loss"))

    return gathered.select("conv_id", F.transform("runs", piece).alias("pieces"))


def formatted_text(pieces: str = "pieces") -> Column:
    return F.concat_ws("", F.col(pieces)["text"])


def read_turns(formatted: Column) -> Column:
    """array of (role, text) that a formatted conversation holds, turn by turn."""
    def block(b: Column) -> Column:
        sides = F.split(b, F.lit(r"<\|text\|>"))
        role = unescape(F.substring(sides[0], len(START) + 1, 2**31 - 1))
        return F.transform(F.split(sides[1], F.lit(r"<\|next\|>")), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    blocks = F.split(formatted, F.lit(r"<\|end\|>"))
    return F.flatten(F.transform(F.slice(blocks, 1, F.size(blocks) - 1), block))


def read_loss(pieces: Column) -> Column:
    """The unescaped text under the loss mask, span after span."""
    return F.concat_ws("", F.flatten(F.transform(pieces, lambda p: F.transform(
        p["loss"], lambda s: unescape(F.substring(p["text"], s["start"] + 1, s["length"]))))))
