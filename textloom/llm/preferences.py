"""Preference formatting: one prompt, two masked completions.

A pair is two conversations, chosen and rejected. Their longest common prefix of turns (same role and text) is rendered
once as the prompt; what follows in each is a completion. A completion's mask lists the spans, in code points, of
assistant turns' contents with their end mark: the places that count for the loss.

Defined cases: rows without conv_id belong to no conversation; turns with equal number follow by role and text; null
role and text are empty; equal conversations share everything, their completions are empty and `same` is true; a
conversation without assistant turn has no reply to replace and is paired with itself; turns that repeat in full count
each; very long texts are rendered whole; an empty table gives no rows; only conv_id, turn, role and text are read, so
no further column clashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, next_keys, table

END = "<|end|>\n"


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id and its turns, an array of struct<turn, role, text> in order."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))


def common_turns(a: Column, b: Column) -> Column:
    """How many turns at the start of two conversations have the same role and text."""
    n = F.least(F.size(a), F.size(b))
    same = F.transform(F.slice(F.arrays_zip(a.alias("a"), b.alias("b")), F.lit(1), n), lambda z: (z["a"]["role"] == z["b"]["role"]) & (z["a"]["text"] == z["b"]["text"]))
    first = F.array_position(same, F.lit(False))
    return F.when(first > 0, first - 1).otherwise(n).cast("int")


def head(role: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(head(t["role"]), t["text"], F.lit(END))), "")


def mask(turns: Column) -> Column:
    """Spans of the assistant's contents in render(turns), as start:end, comma-joined."""
    step = F.aggregate(
        turns,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans")),
        lambda s, t: F.struct(
            (s["at"] + F.length(head(t["role"])) + F.length(t["text"]) + len(END)).alias("at"),
            F.when(t["role"] == "assistant", F.concat(s["spans"], F.array(F.concat_ws(":", (s["at"] + F.length(head(t["role"]))).cast("string"), (s["at"] + F.length(head(t["role"])) + F.length(t["text"]) + len(END)).cast("string"))))).otherwise(s["spans"]).alias("spans"),
        ),
    )
    return F.array_join(step["spans"], ",")


def preferences(pairs: DataFrame) -> DataFrame:
    """pairs with columns chosen and rejected (arrays of turns) replaced by prompt, completions and masks."""
    n = common_turns(F.col("chosen"), F.col("rejected"))
    cutoff = pairs.withColumn("n_prompt_turns", n)
    rest = lambda c: F.slice(F.col(c), F.col("n_prompt_turns") + 1, F.greatest(F.size(c) - F.col("n_prompt_turns"), F.lit(0)))
    keep = [c for c in pairs.columns if c not in ("chosen", "rejected")]
    split = cutoff.select(*keep, "n_prompt_turns", F.slice("chosen", 1, F.col("n_prompt_turns")).alias("_p"), rest("chosen").alias("_c"), rest("rejected").alias("_r"))
    return split.select(*keep, "n_prompt_turns", render(F.col("_p")).alias("prompt"), render(F.col("_c")).alias("chosen"), render(F.col("_r")).alias("rejected"), mask(F.col("_c")).alias("chosen_mask"), mask(F.col("_r")).alias("rejected_mask"), ((F.size("_c") == 0) & (F.size("_r") == 0)).alias("same"))


def last_reply(turns: Column) -> Column:
    """The place (from 1) of the last assistant turn, 0 if there is none."""
    return F.coalesce(F.array_max(F.transform(turns, lambda t, i: F.when(t["role"] == "assistant", i + 1))), F.lit(0))


def answered_by_next(convs: DataFrame) -> DataFrame:
    """Pairs: each conversation, and the same with its last assistant turn's text taken from the next conversation's (by conv_id, after the last the first)."""
    follow = cut(next_keys(convs, "conv_id", "next_id"))
    replies = convs.select(F.col("conv_id").alias("next_id"), F.when(last_reply(F.col("turns")) > 0, F.element_at("turns", last_reply(F.col("turns")))["text"]).alias("_reply"))
    joined = convs.join(follow, "conv_id").join(replies, "next_id", "left")
    at = last_reply(F.col("turns"))
    other = F.transform("turns", lambda t, i: F.when((i + 1 == at) & F.col("_reply").isNotNull(), F.struct(t["turn"].alias("turn"), t["role"].alias("role"), F.col("_reply").alias("text"))).otherwise(t))
    return joined.select("conv_id", "next_id", F.col("turns").alias("chosen"), other.alias("rejected"))


def op7_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preferences(answered_by_next(conversations(table(spark, sf_dir, "conversations"))))


OP7_SQL = r"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(role, ''), coalesce(text, '')) AS i, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS n, coalesce(max(i) FILTER (WHERE role = 'assistant'), 0) AS la FROM t GROUP BY conv_id),
f AS (SELECT conv_id, n, la, coalesce(lead(conv_id) OVER (ORDER BY conv_id), first_value(conv_id) OVER (ORDER BY conv_id)) AS next_id FROM c),
r AS (SELECT f.conv_id, f.next_id, f.n, f.la, t.text AS reply FROM f JOIN c g ON g.conv_id = f.next_id LEFT JOIN t ON t.conv_id = f.next_id AND t.i = g.la),
w AS (
  SELECT t.conv_id, r.next_id, r.n, t.i, t.role, t.text,
    CASE WHEN t.i = r.la AND r.reply IS NOT NULL THEN r.reply ELSE t.text END AS other,
    CASE WHEN r.la = 0 OR r.reply IS NULL OR own.text = r.reply THEN r.n ELSE r.la - 1 END AS p
  FROM t JOIN r USING (conv_id) LEFT JOIN t own ON own.conv_id = r.conv_id AND own.i = r.la),
x AS (
  SELECT *, '<|' || role || chr(124) || '>' || chr(10) AS h, coalesce(sum(length(role) + 4 + length(text) + 8) FILTER (WHERE i > p) OVER q, 0) AS ca, coalesce(sum(length(role) + 4 + length(other) + 8) FILTER (WHERE i > p) OVER q, 0) AS ra
  FROM w WINDOW q AS (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT conv_id, next_id, CAST(any_value(p) AS INTEGER) AS n_prompt_turns,
  coalesce(string_agg(h || text || '<|end|>' || chr(10), '' ORDER BY i) FILTER (WHERE i <= p), '') AS prompt,
  coalesce(string_agg(h || text || '<|end|>' || chr(10), '' ORDER BY i) FILTER (WHERE i > p), '') AS chosen,
  coalesce(string_agg(h || other || '<|end|>' || chr(10), '' ORDER BY i) FILTER (WHERE i > p), '') AS rejected,
  coalesce(string_agg((ca + length(h))::BIGINT || ':' || (ca + length(h) + length(text) + 8)::BIGINT, ',' ORDER BY i) FILTER (WHERE i > p AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg((ra + length(h))::BIGINT || ':' || (ra + length(h) + length(other) + 8)::BIGINT, ',' ORDER BY i) FILTER (WHERE i > p AND role = 'assistant'), '') AS rejected_mask,
  any_value(p) >= any_value(n) AS same
FROM x GROUP BY conv_id, next_id
"""
