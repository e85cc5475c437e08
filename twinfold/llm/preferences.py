"""Preference formatting: one prompt from the longest common turn prefix, and two masked completions.

Works on turns ``(pair_id, side, conv_id, turn, role, text)`` with side ``chosen`` or ``rejected``.  The turns of a pair are
gathered in order; the longest run of leading turns with the same role and text on both sides is rendered once as
``prompt``, the rest of each side as its completion.  A completion's mask lists the code-point ranges of it that a
trainer learns from: what the assistant says, with the end mark of the turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"
LEARNED_ROLE = "assistant"


def _head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(turn.role, F.lit("")), F.lit(MIDDLE))


def _body(turn: Column) -> Column:
    return F.concat(F.coalesce(turn.text, F.lit("")), F.lit(CLOSE))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


def _mask(turns: Column) -> Column:
    """``start-end`` of each learned range, comma-joined."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(state: Column, t: Column) -> Column:
        begin = state.at + F.char_length(_head(t))
        end = begin + F.char_length(_body(t))
        span = F.concat_ws("-", begin.cast("string"), end.cast("string"))
        return F.struct(end.cast("long").alias("at"), F.when(t.role == LEARNED_ROLE, F.concat(state.spans, F.array(span))).otherwise(state.spans).alias("spans"))

    return F.array_join(F.aggregate(turns, start, step).spans, ",")


def format_preferences(turns: DataFrame) -> DataFrame:
    """One row for each pair that has turns on both sides.

    Returns ``pair_id, chosen_id, rejected_id, prefix_turns, prompt, chosen, rejected, chosen_mask, rejected_mask``.  Turns
    are ordered by number, role and text, nulls first, so repeated or tied rows have one order; null roles and texts
    render as empty but equal only null.  Where a side is a prefix of the other its completion is empty, and where both are
    equal both are.  Rows with a null pair_id belong to no pair; an empty table gives no rows.
    """
    one = F.struct("turn", "role", "text")
    side = lambda s: F.array_sort(F.collect_list(F.when(F.col("side") == s, one)), lambda a, b: _order(a, b))
    conv = lambda s: F.min(F.when(F.col("side") == s, F.col("conv_id")))
    rows = turns.where(F.col("pair_id").isNotNull()).groupBy("pair_id").agg(conv("chosen").alias("chosen_id"), conv("rejected").alias("rejected_id"), side("chosen").alias("c"), side("rejected").alias("r"))
    rows = rows.where((F.size("c") > 0) & (F.size("r") > 0))
    shorter = F.least(F.size("c"), F.size("r"))
    same = F.zip_with("c", "r", lambda a, b: a.role.eqNullSafe(b.role) & a.text.eqNullSafe(b.text))
    differs = F.array_position(F.slice(same, F.lit(1), shorter), False)
    rows = rows.withColumn("n", F.when(differs == 0, shorter).otherwise(differs - 1).cast("int"))
    rest = lambda c: F.slice(c, F.col("n") + 1, F.greatest(F.size(c) - F.col("n"), F.lit(0)))
    return rows.select(
        "pair_id",
        "chosen_id",
        "rejected_id",
        F.col("n").cast("long").alias("prefix_turns"),
        _render(F.slice("c", F.lit(1), F.col("n"))).alias("prompt"),
        _render(rest(F.col("c"))).alias("chosen"),
        _render(rest(F.col("r"))).alias("rejected"),
        _mask(rest(F.col("c"))).alias("chosen_mask"),
        _mask(rest(F.col("r"))).alias("rejected_mask"),
    )


def _order(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by turn, role and text, nulls first."""
    out = F.lit(0)
    for name in ("text", "role", "turn"):
        x, y = a.getField(name), b.getField(name)
        out = F.when(x.isNull() & y.isNull(), out).when(x.isNull(), -1).when(y.isNull(), 1).when(x < y, -1).when(x > y, 1).otherwise(out)
    return out


def neighbouring_pairs(conversations: DataFrame) -> DataFrame:
    """Turns of pairs made of conversations 2 k (chosen) and 2 k + 1 (rejected)."""
    conv = F.col("conv_id").cast("long")
    side = F.when(conv.bitwiseAND(F.lit(1).cast("long")) == 0, "chosen").otherwise("rejected")
    return conversations.select(F.shiftright(conv, 1).alias("pair_id"), side.alias("side"), conv.alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))


_ORDER_SQL = "turn ASC NULLS FIRST, role ASC NULLS FIRST, text ASC NULLS FIRST"
ORACLE = f"""
WITH t AS (SELECT conv_id // 2 AS pair_id, conv_id % 2 AS side, conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY {_ORDER_SQL}) AS k,
                  '<|' || coalesce(role, '') || '|>' || chr(10) AS head, coalesce(text, '') || '<|end|>' || chr(10) AS body FROM conversations WHERE conv_id IS NOT NULL),
sizes AS (SELECT pair_id, count(*) FILTER (WHERE side = 0) AS nc, count(*) FILTER (WHERE side = 1) AS nr FROM t GROUP BY pair_id HAVING nc > 0 AND nr > 0),
first AS (SELECT a.pair_id, min(a.k) AS k FROM t a JOIN t b ON a.pair_id = b.pair_id AND a.side = 0 AND b.side = 1 AND a.k = b.k WHERE a.role IS DISTINCT FROM b.role OR a.text IS DISTINCT FROM b.text GROUP BY a.pair_id),
n AS (SELECT s.pair_id, coalesce(f.k - 1, least(s.nc, s.nr)) AS n FROM sizes s LEFT JOIN first f ON s.pair_id = f.pair_id),
placed AS (SELECT t.*, n.n, t.k <= n.n AS common, coalesce(sum(length(head) + length(body)) FILTER (WHERE t.k > n.n) OVER (PARTITION BY t.pair_id, t.side ORDER BY t.k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM t JOIN n ON t.pair_id = n.pair_id)
SELECT pair_id, min(conv_id) FILTER (WHERE side = 0) AS chosen_id, min(conv_id) FILTER (WHERE side = 1) AS rejected_id, any_value(n)::BIGINT AS prefix_turns,
       coalesce(string_agg(head || body, '' ORDER BY k) FILTER (WHERE side = 0 AND common), '') AS prompt,
       coalesce(string_agg(head || body, '' ORDER BY k) FILTER (WHERE side = 0 AND NOT common), '') AS chosen,
       coalesce(string_agg(head || body, '' ORDER BY k) FILTER (WHERE side = 1 AND NOT common), '') AS rejected,
       coalesce(string_agg((pos + length(head)) || '-' || (pos + length(head) + length(body)), ',' ORDER BY k) FILTER (WHERE side = 0 AND NOT common AND role = 'assistant'), '') AS chosen_mask,
       coalesce(string_agg((pos + length(head)) || '-' || (pos + length(head) + length(body)), ',' ORDER BY k) FILTER (WHERE side = 1 AND NOT common AND role = 'assistant'), '') AS rejected_mask
FROM placed GROUP BY pair_id
"""
