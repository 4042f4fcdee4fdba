"""Preference formatting of chosen and rejected conversations.

The turns of both sides are joined by pair and turn; the first turn at which they differ ends the common prefix. The
prefix is rendered once as the prompt, and each side's remaining turns are its completion, with a mask of the
character spans that are trained on: the text and end mark of the assistant's turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from marketspark.llm.common import settled

TURN = ["pair_id", "turn"]
OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"
TRAINED = "assistant"


def turns(conversations: DataFrame) -> DataFrame:
    """One row for each conversation and turn; of repeated ones the first by role and text stays, nulls last."""
    said = F.struct(F.col("role").isNull().alias("a"), "role", F.col("text").isNull().alias("b"), "text")
    return conversations.groupBy(*TURN).agg(F.min(said).alias("said")).select(*TURN, F.coalesce("said.role", F.lit("")).alias("role"), F.coalesce("said.text", F.lit("")).alias("text"))


def _completion(side: str) -> tuple[Column, Column]:
    """Text and mask of one side from its ordered turns, structs of turn, head and body (text and end mark)."""
    parts = F.array_sort(F.col(side))
    text = F.array_join(F.transform(parts, lambda p: F.concat(p["head"], p["body"])), "")
    spans = F.expr(
        f"""aggregate(array_sort({side}), named_struct('at', 0, 'spans', CAST(array() AS array<string>)),
            (s, p) -> named_struct('at', s.at + char_length(p.head) + char_length(p.body),
                'spans', CASE WHEN p.trained THEN concat(s.spans, array(concat(s.at + char_length(p.head), '-', s.at + char_length(p.head) + char_length(p.body)))) ELSE s.spans END),
            s -> array_join(s.spans, ','))"""
    )
    return text, spans


def format_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """pair_id, n_common, prompt, chosen, chosen_mask, rejected and rejected_mask of every pair on both sides.

    Both inputs have pair_id, turn, role and text. Turns are in the order of `turn`, a null turn first; null roles
    and texts are empty. A mask lists spans "start-end" in characters of its completion. Pairs without a common
    turn have an empty prompt; equal conversations have two empty completions; a pair on one side only, or with a
    null id, is none. A conversation is one value of the result, so its turns meet in one task; conversations do not.
    """
    a, b = turns(chosen).withColumn("side", F.lit(0)), turns(rejected).withColumn("side", F.lit(1))
    said = F.struct("role", "text")
    both = a.unionByName(b).groupBy(*TURN).agg(F.max(F.when(F.col("side") == 0, said)).alias("chosen"), F.max(F.when(F.col("side") == 1, said)).alias("rejected"))
    differs = ~F.col("chosen").eqNullSafe(F.col("rejected"))
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    both = both.withColumn("order", order)
    ends = both.groupBy("pair_id").agg(
        F.min(F.when(differs, F.col("order"))).alias("first"), F.count("chosen").alias("n_chosen"), F.count("rejected").alias("n_rejected")
    ).where("n_chosen > 0 AND n_rejected > 0 AND pair_id IS NOT NULL")
    both = both.join(ends, "pair_id").withColumn("common", F.col("first").isNull() | (F.col("order") < F.col("first")))

    def part(side: str, when: Column) -> Column:
        head = F.concat(F.lit(OPEN), F.col(f"{side}.role"), F.lit(CLOSE))
        body = F.concat(F.col(f"{side}.text"), F.lit(END))
        turn = F.struct("order", head.alias("head"), body.alias("body"), (F.col(f"{side}.role") == TRAINED).alias("trained"))
        return F.collect_list(F.when(when & F.col(side).isNotNull(), turn))

    found = both.groupBy("pair_id").agg(
        part("chosen", F.col("common")).alias("prompt_turns"),
        part("chosen", ~F.col("common")).alias("chosen_turns"),
        part("rejected", ~F.col("common")).alias("rejected_turns"),
    )
    prompt, _ = _completion("prompt_turns")
    (good, good_mask), (bad, bad_mask) = _completion("chosen_turns"), _completion("rejected_turns")
    return found.select(
        "pair_id", F.size("prompt_turns").cast("long").alias("n_common"), prompt.alias("prompt"),
        good.alias("chosen"), good_mask.alias("chosen_mask"), bad.alias("rejected"), bad_mask.alias("rejected_mask"),
    )


def _next_replies(last: DataFrame) -> DataFrame:
    """For the replies (pair_id, reply) the reply of the next pair_id in order; after the last comes the first.

    Replies are range-partitioned by id and numbered by part; inside a part the next row has it, and the last row of a part
    takes the first of the next part that has rows.
    """
    rows = settled(last.repartitionByRange("pair_id").withColumn("part", F.spark_partition_id()), "preference-replies")
    inside = Window.partitionBy("part").orderBy("pair_id")
    rows = rows.withColumn("next", F.lead(F.struct("reply")).over(inside))
    firsts = rows.groupBy("part").agg(F.min(F.struct("pair_id", "reply")).alias("first"))  # a row per part
    over = Window.orderBy("part")
    whole = over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = firsts.select("part", F.coalesce(F.lead("first").over(over), F.first("first").over(whole))["reply"].alias("after"))
    return rows.join(after, "part").select("pair_id", F.when(F.col("next").isNotNull(), F.col("next.reply")).otherwise(F.col("after")).alias("reply"))


def with_next_reply(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected sides from plain conversations (conv_id, turn, role, text).

    Chosen is a conversation with all its turns; rejected is the same with its last assistant turn replaced by that of
    the next conversation in the order of ids that has one, a reply to something else; after the last id comes the first.
    Conversations without an assistant turn, and those without an id, form no pair; a single one with a reply meets
    itself, and its sides are equal. Turns after the last reply and null turns stay on both sides. An empty table gives no rows.
    """
    rows = turns(conversations.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text").where(F.col("pair_id").isNotNull()))
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    last = rows.where(F.col("role") == TRAINED).groupBy("pair_id").agg(F.max(F.struct(order.alias("order"), "text")).alias("last"))
    other = _next_replies(last.select("pair_id", F.col("last.text").alias("reply")))
    ends = last.select("pair_id", F.col("last.order.turn").alias("end")).join(other, "pair_id")
    rows = rows.join(ends, "pair_id")
    swapped = F.when(F.col("turn").eqNullSafe(F.col("end")), F.col("reply")).otherwise(F.col("text"))
    return rows.select(*TURN, "role", "text"), rows.select(*TURN, "role", swapped.alias("text"))
