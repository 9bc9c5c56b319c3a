"""Perspective rotation of multi-party dialogues, in DataFrame functions only.

For every participant the dialogue is written with that speaker as the assistant and all others
as named users, and only the assistant's words carry a loss. The library has no dialogue records,
so the operator is general: conversation rows conv_id, turn, role, text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import written

END = "<|end|>\n"


def _head(speaker: Column, perspective: Column, narrators: tuple[str, ...]) -> Column:
    return (F.when(speaker == perspective, F.lit("<|assistant|>\n"))
            .when(speaker.isin(*narrators), F.concat(F.lit("<|"), speaker, F.lit("|>\n")))
            .otherwise(F.concat(F.lit("<|user|>"), speaker, F.lit("\n"))))


def perspectives(turns: DataFrame, narrators: tuple[str, ...] = ("system",)) -> DataFrame:
    """One row per turn and participant: conv_id, perspective, turn, speaker, head, text, loss.

    Participants are the roles of a conversation but for narrators, who speak to all and are never
    the assistant. loss is true where the speaker is the perspective. Rows without conv_id are
    left out; a null role is the speaker 'unknown', a null text is empty, a null turn counts as -1.
    Turns and participants meet on conv_id, both from exchanges, so adaptive execution can split a
    conversation that holds a large share of all turns.
    """
    clean = turns.filter(F.col("conv_id").isNotNull()).select(
        "conv_id", F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"),
        F.coalesce("role", F.lit("unknown")).alias("speaker"),
        F.coalesce("text", F.lit("")).alias("text"))
    people = written(clean.filter(~F.col("speaker").isin(*narrators))
                     .select("conv_id", F.col("speaker").alias("perspective")).distinct(), "people")
    return clean.join(people, "conv_id").select(
        "conv_id", "perspective", "turn", "speaker",
        _head(F.col("speaker"), F.col("perspective"), narrators).alias("head"), "text",
        (F.col("speaker") == F.col("perspective")).alias("loss"))


def rotated_dialogues(turns: DataFrame, narrators: tuple[str, ...] = ("system",),
                      turns_per_piece: int = 64) -> DataFrame:
    """Rendered dialogues: conv_id, perspective, piece, n_turns, text and loss_spans.

    A piece holds turns_per_piece turn numbers, so a dialogue of any length is never gathered in
    one place; a dialogue of fewer turns is one piece. Turns follow each other by turn, then
    speaker, then text; repeated rows stay. loss_spans: array<struct<start, end>> of code points of
    the assistant's words with the end mark, half-open, in the order of the text.
    """
    parts = perspectives(turns, narrators).withColumn(
        "piece", F.floor(F.col("turn") / turns_per_piece).cast("long"))
    said = parts.groupBy("conv_id", "perspective", "piece").agg(F.array_sort(F.collect_list(
        F.struct("turn", "speaker", "text", "head", "loss"))).alias("said"))
    said = said.withColumn("sizes", F.transform("said", lambda x: F.char_length(x["head"])
                                                + F.char_length(x["text"]) + len(END)))
    ends = F.transform("sizes", lambda _, i: F.aggregate(
        F.slice("sizes", 1, i + 1), F.lit(0), lambda a, b: a + b))
    said = said.withColumn("ends", ends)
    spans = F.filter(F.transform("said", lambda x, i: F.struct(
        (F.get("ends", i) - F.char_length(x["text"]) - len(END)).alias("start"),
        F.get("ends", i).alias("end"), x["loss"].alias("loss"))), lambda s: s["loss"])
    return said.select(
        "conv_id", "perspective", "piece", F.size("said").cast("long").alias("n_turns"),
        F.array_join(F.transform("said", lambda x: F.concat(x["head"], x["text"], F.lit(END))), "")
        .alias("text"),
        F.transform(spans, lambda s: F.struct(s["start"], s["end"])).alias("loss_spans"))
