"""Chat formatting for preference data: shared prompt, paired completions, masks of what to learn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.arrays import running_sums

#: Rendering of one turn.
START, MIDDLE, END = "<|", "|>\n", "\n"
SAFE = "< |"
LEARNED_ROLE = "assistant"


def turn_of() -> Column:
    """A turn as (turn, role, text), which sorts as turns follow each other."""
    safe = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit(START), F.lit(SAFE)).alias(c)
    return F.struct(F.col("turn"), safe("role"), safe("text"))


def counted(turns: DataFrame) -> DataFrame:
    return turns.where(F.col("pair_id").isNotNull() & (F.col("role").isNotNull() | F.col("text").isNotNull()))


def last_turns(turns: DataFrame, name: str) -> DataFrame:
    """(pair_id, name): each conversation's last turn as (role, text); only one a task and conversation is shuffled."""
    return counted(turns).groupBy("pair_id").agg(F.max(turn_of()).alias("last")).select("pair_id", F.struct("last.role", "last.text").alias(name))


def ordered_turns(turns: DataFrame, name: str) -> DataFrame:
    """(pair_id, name): each conversation's turns in order as an array of (role, text).

    turns: (pair_id, turn, role, text). Order is by turn (null first), then role and text. Rows with
    neither role nor text don't count; a null role or text is empty. What opens a turn can't stand in
    one: START in a role or text becomes SAFE.
    """
    grouped = counted(turns).groupBy("pair_id").agg(F.sort_array(F.collect_list(turn_of())).alias("all"))
    return grouped.select("pair_id", F.transform("all", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias(name))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), t["role"], F.lit(MIDDLE), t["text"], F.lit(END))), "")


def learned_spans(turns: Column) -> Column:
    """start:end of each learned text in the rendered turns, comma-joined; code points, end exclusive."""
    fixed = len(START) + len(MIDDLE) + len(END)
    sizes = F.transform(turns, lambda t: fixed + F.length(t["role"]) + F.length(t["text"]))
    ends = running_sums(sizes)
    told = F.zip_with(turns, ends, lambda t, e: F.when(t["role"] == LEARNED_ROLE, F.concat_ws(":", (e - len(END) - F.length(t["text"])).cast("string"), (e - len(END)).cast("string"))))
    return F.array_join(told, ",")


def common_prefix(a: Column, b: Column) -> Column:
    """How many turns from the start are the same in both."""
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x == y)
    first = F.array_position(same, False)
    return F.when(first > 0, first.cast("int") - 1).otherwise(n)


def format_preferences(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row for each pair_id of both chosen and rejected turns (pair_id, turn, role, text).

    The longest common prefix of turns is rendered once as prompt; what is left of each side is its
    completion, with the spans of the assistant's texts as mask. Identical sides have empty
    completions. Pairs without turns on one side are left out, as are null pair_ids. A repeated turn
    row is a turn of its own. Columns: pair_id, prompt_turns, prompt, chosen, chosen_mask, rejected,
    rejected_mask. Only SQL functions; two groupings by pair_id and a join on the same key, so each
    side is shuffled once. A pair's turns come together, as its texts do in one row.
    """
    return format_turns(ordered_turns(chosen, "c").join(ordered_turns(rejected, "r"), "pair_id"))


def format_turns(both: DataFrame) -> DataFrame:
    """format_preferences of (pair_id, c, r) whose turns are arrays already, as ordered_turns makes them."""
    both = both.withColumn("k", common_prefix(F.col("c"), F.col("r")))
    rest = lambda side: F.slice(side, F.col("k") + 1, F.size(side))
    both = both.select("pair_id", "k", F.slice("c", F.lit(1), F.col("k")).alias("p"), rest(F.col("c")).alias("c"), rest(F.col("r")).alias("r"))
    return both.select(
        "pair_id", F.col("k").alias("prompt_turns"), rendered(F.col("p")).alias("prompt"),
        rendered(F.col("c")).alias("chosen"), learned_spans(F.col("c")).alias("chosen_mask"),
        rendered(F.col("r")).alias("rejected"), learned_spans(F.col("r")).alias("rejected_mask"),
    )
