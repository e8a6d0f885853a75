"""Preference formatting: a common prompt once, and two masked completions.

DataFrame functions only. A conversation is an array of turns; the longest
common turn prefix of the chosen and the rejected one is rendered as prompt,
the rest of each as completion, with the character spans that are to be
learned (the assistant's turns and their end marks). Apart from gathering a
conversation's own turns nothing is shuffled or compared across rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the ChatML layout.
START, END = "<|im_start|>", "<|im_end|>"


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns (role, text) of each conversation in order of
    turn (nulls first), ties by role and text. A null role is "user", a null
    text is empty; the rows without a conv_id are one conversation together. A
    conversation is one array, so it has to fit a task's memory. An empty table
    gives none."""
    turn = F.struct(F.col("turn").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("user")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    gathered = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return gathered.withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))


def _shown(turn: Column) -> Column:
    """A turn as text. Marks within roles and texts are broken up, so they end no turn."""
    safe = [F.replace(turn[f], F.lit("<|"), F.lit("< |")) for f in ("role", "text")]
    return F.concat(F.lit(START), safe[0], F.lit("\n"), safe[1], F.lit(END), F.lit("\n"))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _shown), "")


def _spans(turns: Column) -> Column:
    """array<struct<start, end>>: where the assistant's texts and end marks are in
    the rendered turns, in characters, the end exclusive."""
    none = F.array().cast("array<struct<start:int,end:int>>")

    def add(found, t):
        shown = F.length(_shown(t))
        head = F.lit(len(START) + 1) + F.length(F.replace(t["role"], F.lit("<|"), F.lit("< |")))
        span = F.struct((found["at"] + head).alias("start"), (found["at"] + shown - 1).alias("end"))
        spans = F.when(t["role"] == "assistant", F.array_append(found["spans"], span)).otherwise(found["spans"])
        return F.struct((found["at"] + shown).alias("at"), spans.alias("spans"))

    # one pass over the turns: the place is carried along
    return F.aggregate(turns, F.struct(F.lit(0).alias("at"), none.alias("spans")), add, lambda found: found["spans"])


def common_prefix(a: Column, b: Column) -> Column:
    """The number of leading turns that are equal."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    first = F.array_position(same, False)
    return F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")


def preference_pairs(pairs: DataFrame) -> DataFrame:
    """pairs: pair_id, chosen and rejected (arrays of (role, text), as turns_of
    makes them). Result: pair_id, n_common, prompt, chosen, rejected,
    chosen_spans, rejected_spans, differs.

    Equal conversations are all prompt with two empty completions (differs is
    false); where one is the other's prefix its completion is empty. A null
    array counts as no turns. Repeated rows give repeated results.
    """
    empty = F.array().cast("array<struct<role:string,text:string>>")
    rows = pairs.select("pair_id", F.coalesce("chosen", empty).alias("a"), F.coalesce("rejected", empty).alias("b"))
    rows = rows.withColumn("n_common", common_prefix(F.col("a"), F.col("b")))

    def after(name):
        return F.slice(name, F.col("n_common") + 1, F.greatest(F.size(name) - F.col("n_common"), F.lit(0)))

    rows = rows.select("pair_id", "n_common", F.slice("a", F.lit(1), F.col("n_common")).alias("p"), after("a").alias("a"), after("b").alias("b"))
    return rows.select(
        "pair_id",
        "n_common",
        _rendered(F.col("p")).alias("prompt"),
        _rendered(F.col("a")).alias("chosen"),
        _rendered(F.col("b")).alias("rejected"),
        _spans(F.col("a")).alias("chosen_spans"),
        _spans(F.col("b")).alias("rejected_spans"),
        ((F.size("a") > 0) | (F.size("b") > 0)).alias("differs"),
    )


def weaker_reply(turns: Column) -> Column:
    """A rejected version of a conversation: its last assistant turn says again
    what the assistant turn before said (nothing, if there is none)."""
    own = F.filter(F.transform(turns, lambda t, i: F.struct(t["role"].alias("role"), t["text"].alias("text"), i.alias("i"))), lambda t: t["role"] == "assistant")
    last, before = F.try_element_at(own, F.lit(-1)), F.try_element_at(own, F.lit(-2))
    return F.transform(turns, lambda t, i: F.when(i == last["i"], F.struct(t["role"].alias("role"), F.coalesce(before["text"], F.lit("")).alias("text"))).otherwise(t))


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",")
