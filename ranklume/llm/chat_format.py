"""Preference formatting of chats (DataFrame operations only).

A pair has a chosen and a rejected conversation.  Their longest common turn
prefix (equal role and text) is rendered once, as the prompt; the remaining
turns of either side are rendered as its completion, with a loss mask that is
run-length coded: for each turn the length of its header (masked) and of its
content with the end marker (trained on if the role is the assistant's).

The markers of turns can't be forged: in roles and texts a backslash is put in
every ``<|``, and in roles in every ``|>`` (and one more where there are some), so
that the rendered form can be read back.

Nulls: a null role is rendered as ``unknown``, a null text as empty; turns with
a null conversation id belong to no pair and are left out, turns are ordered by
(turn, role, text) with nulls first, so repeated and tied turns have a defined
place.  A pair that lacks one side has an empty prompt, an empty completion for
that side and ``complete`` false.  Empty input: no rows.

A conversation is one output row, so its turns meet in one task; conversations
themselves are spread by pair id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The rendered form of a turn.
OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"


def escaped(text: F.Column, role: bool = False) -> F.Column:
    """A text (or role) without the markers of turns: ``<|`` becomes ``<\\|``, and what looks like that gets one more backslash."""
    text = F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")
    return F.regexp_replace(text, r"\|(\\*)>", r"|\\$1>") if role else text


def _render(turns: F.Column) -> F.Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(CLOSE), t["text"], F.lit(END))), "")


def _mask(turns: F.Column, trained: str) -> F.Column:
    head = len(OPEN) + len(CLOSE)
    run = lambda n, on: F.struct(n.cast("long").alias("length"), on.alias("trained"))
    return F.flatten(F.transform(turns, lambda t: F.array(run(F.char_length(t["role"]) + head, F.lit(False)), run(F.char_length(t["text"]) + len(END), t["kind"] == trained))))


def format_preferences(turns: DataFrame, pair: F.Column, is_chosen: F.Column, turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained: str = "assistant") -> DataFrame:
    """One row a pair: ``pair_id, complete, n_prompt, prompt, chosen, rejected, chosen_mask, rejected_mask``.

    ``pair`` and ``is_chosen`` are columns of ``turns`` that tell the pair and
    the side of each turn.
    """
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("unknown")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sides = turns.select(pair.alias("pair_id"), is_chosen.alias("side"), turn.alias("t")).where(F.col("pair_id").isNotNull() & F.col("side").isNotNull())
    sides = sides.groupBy("pair_id").agg(F.sort_array(F.collect_list(F.when(F.col("side"), F.col("t")))).alias("c"), F.sort_array(F.collect_list(F.when(~F.col("side"), F.col("t")))).alias("r"))
    differs = F.expr("filter(transform(arrays_zip(c, r), (x, i) -> if(x.c is not null and x.r is not null and x.c.role = x.r.role and x.c.text = x.r.text, null, i)), i -> i is not null)")
    shared = F.coalesce(F.array_min(differs), F.size("c")).cast("int")
    # turns are compared as they are and rendered without markers of their own
    safe = lambda t: F.struct(t["role"].alias("kind"), escaped(t["role"], True).alias("role"), escaped(t["text"]).alias("text"))
    split = sides.withColumn("n_prompt", shared).withColumns({c: F.transform(c, safe) for c in ("c", "r")})
    rest = lambda side: F.slice(F.col(side), F.col("n_prompt") + 1, F.greatest(F.size(side) - F.col("n_prompt"), F.lit(0)))
    split = split.withColumn("complete", (F.size("c") > 0) & (F.size("r") > 0)).withColumn("p", F.slice("c", 1, F.col("n_prompt"))).withColumn("c", rest("c")).withColumn("r", rest("r"))
    return split.select("pair_id", "complete", F.col("n_prompt").cast("long").alias("n_prompt"), _render(F.col("p")).alias("prompt"), _render(F.col("c")).alias("chosen"), _render(F.col("r")).alias("rejected"), _mask(F.col("c"), trained).alias("chosen_mask"), _mask(F.col("r"), trained).alias("rejected_mask"))


def mask_text(mask: F.Column) -> F.Column:
    """A mask as ``length:0|1`` runs joined by commas."""
    return F.array_join(F.transform(mask, lambda m: F.concat(m["length"].cast("string"), F.lit(":"), m["trained"].cast("int").cast("string"))), ",")
