"""Preference formatting: chosen and rejected conversations as one shared prompt and two masked completions.

The longest common turn prefix of a pair is rendered once, as the prompt; the turns after it are the completions, each
with the spans of characters that count for the loss: what assistant turns say, with their end mark. Turns stay rows
until the last step, so finding the prefix needs one aggregation over turns and no list of a conversation's turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from floorwright.llm.common import table

#: The marks of the rendered form.
HEAD, HEAD_END, TURN_END, TRAINED = "<|", "|>\n", "<|end|>\n", "assistant"


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): one row for each place; a null role or text counts as empty, rows without a conv_id or
    turn are passed over, and of rows that repeat a place the least (role, text) stays."""
    own = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("said"))
    own = own.where("conv_id is not null and turn is not null").groupBy("conv_id", "turn").agg(F.min("said").alias("said"))
    return own.select("conv_id", "turn", "said.role", "said.text")


def preference_rows(pairs: DataFrame) -> DataFrame:
    """(pair_id, part, turn, role, text) with part prompt, chosen or rejected, from pairs (pair_id, side, turn, role, text).

    side is chosen or rejected; each side has one row at most for each turn. The prompt are the turns before the first at
    which the sides differ or one has ended.
    """
    said = F.struct("role", "text")
    both = pairs.groupBy("pair_id", "turn").agg(F.max(F.when(F.col("side") == "chosen", said)).alias("c"), F.max(F.when(F.col("side") == "rejected", said)).alias("r"))
    first = both.where(~F.col("c").eqNullSafe(F.col("r"))).groupBy("pair_id").agg(F.min("turn").alias("fork"))
    forked = both.join(first, "pair_id", "left")
    shared = F.col("fork").isNull() | (F.col("turn") < F.col("fork"))
    part = F.array(F.when(shared, F.struct(F.lit("prompt").alias("part"), F.col("c").alias("said"))), F.when(~shared & F.col("c").isNotNull(), F.struct(F.lit("chosen").alias("part"), F.col("c").alias("said"))), F.when(~shared & F.col("r").isNotNull(), F.struct(F.lit("rejected").alias("part"), F.col("r").alias("said"))))
    out = forked.select("pair_id", "turn", F.explode(F.filter(part, lambda x: x.isNotNull())).alias("p"))
    return out.select("pair_id", "p.part", "turn", "p.said.role", "p.said.text")


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(HEAD), role, F.lit(HEAD_END), text, F.lit(TURN_END))


def format_pairs(pairs: DataFrame) -> DataFrame:
    """(pair_id, prompt_turns, prompt, chosen, rejected, chosen_spans, rejected_spans), one row for each pair.

    Spans are [start, end) in characters of the completion. All turns of a pair are in its one row. Two equal sides are all prompt and have empty completions; a
    pair of which one side is missing has an empty prompt.
    """
    rows = preference_rows(pairs).withColumn("s", rendered(F.col("role"), F.col("text")))
    rows = rows.withColumn("head", F.length(F.concat(F.lit(HEAD), F.col("role"), F.lit(HEAD_END))))
    piece = F.struct("turn", "s", "head", (F.col("role") == TRAINED).alias("trained"))
    own = rows.groupBy("pair_id").agg(*[F.sort_array(F.collect_list(F.when(F.col("part") == p, piece))).alias(p) for p in ("prompt", "chosen", "rejected")])
    text = lambda p: F.array_join(F.transform(p, lambda x: x["s"]), "")

    def spans(p: str) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("spans"))

        def step(acc: Column, x: Column) -> Column:
            end = acc["at"] + F.length(x["s"])
            span = F.array(F.array(acc["at"] + x["head"], end))
            return F.struct(end.alias("at"), F.when(x["trained"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

        return F.aggregate(p, start, step)["spans"]

    return own.select("pair_id", F.size("prompt").cast("long").alias("prompt_turns"), text("prompt").alias("prompt"), text("chosen").alias("chosen"), text("rejected").alias("rejected"), spans("chosen").alias("chosen_spans"), spans("rejected").alias("rejected_spans"))


def swapped_pairs(conversations: DataFrame) -> DataFrame:
    """Pairs from a table that has none, one for each conversation: chosen is the whole conversation, rejected the same with
    its last assistant turn taken from its neighbour (conv_id with the last bit flipped). Where that one has no assistant
    turn, or isn't there, the rejected turn is empty; a conversation without an assistant turn has two equal sides, which
    are all prompt. Turns behind the last assistant turn stay on both sides."""
    own = turns(conversations)
    last = own.where(F.col("role") == TRAINED).groupBy("conv_id").agg(F.max("turn").alias("last"), F.max_by("text", "turn").alias("said"))
    other = last.select(F.col("conv_id").bitwiseXOR(F.lit(1).cast("long")).alias("conv_id"), F.col("said").alias("other"))
    ends = last.join(other, "conv_id", "left").select("conv_id", "last", F.coalesce("other", F.lit("")).alias("other"))
    rows = own.join(ends, "conv_id", "left")
    sides = F.explode(F.array(F.struct(F.lit("chosen").alias("side"), F.col("text").alias("text")), F.struct(F.lit("rejected").alias("side"), F.when(F.col("turn") == F.col("last"), F.col("other")).otherwise(F.col("text")).alias("text"))))
    return rows.select(F.col("conv_id").alias("pair_id"), "turn", "role", sides.alias("x")).select("pair_id", "x.side", "turn", "role", "x.text")


def op1_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = format_pairs(swapped_pairs(table(spark, sf_dir, "conversations")))
    flat = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("-", x[0].cast("string"), x[1].cast("string"))), ",")
    return out.select("pair_id", "prompt_turns", "prompt", "chosen", "rejected", flat("chosen_spans").alias("chosen_spans"), flat("rejected_spans").alias("rejected_spans"))


_TURN_END = "<|end|>' || chr(10)"
ORACLE = f"""
with t as (select conv_id, turn, min(struct_pack(r := coalesce(role, ''), x := coalesce(text, ''))) s from conversations
           where conv_id is not null and turn is not null group by conv_id, turn),
l as (select conv_id, max(turn) turn, arg_max(s, turn) s from t where s.r = 'assistant' group by conv_id),
e as (select a.conv_id, a.turn fin, coalesce(b.s.x, '') other from l a left join l b on b.conv_id = xor(a.conv_id, 1)),
p as (select t.conv_id, t.turn, t.s.r r, t.s.x c, case when t.turn = fin then other else t.s.x end j from t left join e using (conv_id)),
f as (select conv_id, min(turn) filter (where c <> j) fork from p group by conv_id),
q as (select p.*, fork is null or turn < fork shared, '<|' || r || '|>' || chr(10) head from p join f using (conv_id)),
k as (select conv_id, turn, r, shared, length(head) h, head || c || '{_TURN_END} cs, head || j || '{_TURN_END} js from q),
w as (select *, sum(length(cs)) over (partition by conv_id, shared order by turn) ce, sum(length(js)) over (partition by conv_id, shared order by turn) je from k)
select conv_id pair_id, count(*) filter (where shared) prompt_turns,
  coalesce(string_agg(cs, '' order by turn) filter (where shared), '') prompt,
  coalesce(string_agg(cs, '' order by turn) filter (where not shared), '') chosen,
  coalesce(string_agg(js, '' order by turn) filter (where not shared), '') rejected,
  coalesce(string_agg((ce - length(cs) + h)::bigint || '-' || ce::bigint, ',' order by turn) filter (where not shared and r = 'assistant'), '') chosen_spans,
  coalesce(string_agg((je - length(js) + h)::bigint || '-' || je::bigint, ',' order by turn) filter (where not shared and r = 'assistant'), '') rejected_spans
from w group by conv_id
"""
