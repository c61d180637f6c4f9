"""Instance matching of predicted against true rooms and openings: greedy, one to one, within each plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _one_to_one(pairs: DataFrame, by: list[str], left: str, right: str, order: list[Column]) -> DataFrame:
    """Of the pairs of each group, taken in order, those of which neither side was taken before: a fold over the sorted pairs."""
    kept = [c for c in pairs.columns if c not in by]
    row = F.struct(*[c.alias(f"_{i}") for i, c in enumerate(order)], *kept)
    listed = pairs.groupBy(*by).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    ids = pairs.schema[left].dataType.simpleString(), pairs.schema[right].dataType.simpleString()
    fields = ",".join(f"{c}:{pairs.schema[c].dataType.simpleString()}" for c in kept)
    empty = F.struct(F.array().cast(f"array<{ids[0]}>").alias("a"), F.array().cast(f"array<{ids[1]}>").alias("b"), F.array().cast(f"array<struct<{fields}>>").alias("m"))

    def take(state: Column, x: Column) -> Column:
        more = F.struct(F.array_append(state["a"], x[left]).alias("a"), F.array_append(state["b"], x[right]).alias("b"), F.array_append(state["m"], F.struct(*[x[c].alias(c) for c in kept])).alias("m"))
        return F.when(F.array_contains(state["a"], x[left]) | F.array_contains(state["b"], x[right]), state).otherwise(more)

    chosen = listed.select(*by, F.explode(F.aggregate("rows", empty, take, lambda s: s["m"])).alias("m"))
    return chosen.select(*by, *[F.col("m")[c].alias(c) for c in kept])


def match_rooms(pairs: DataFrame, least: float = 0.5) -> DataFrame:
    """(plan_id, pred, true, iou): greedy matches of pairs (plan_id, pred, true, iou), best first, IoU of at least `least`.

    Of equal IoU the larger pred, then the larger true goes first. A plan's pairs are a few per room: one array each.
    """
    own = pairs.where(F.col("iou") >= least).select("plan_id", F.col("pred").cast("long"), F.col("true").cast("long"), F.col("iou").cast("double"))
    return _one_to_one(own, ["plan_id"], "pred", "true", [-F.col("iou"), -F.col("pred"), -F.col("true")])


def match_openings(pred: DataFrame, true: DataFrame, by: list[str], floor: float) -> DataFrame:
    """(by.., true_id, pred_id, dist): for each true opening in order of id the nearest unused prediction in reach.

    Reach is max(width / 2, floor); of equal distances the later prediction. pred: by.., pred_id, x, y; true: by..,
    true_id, tx, ty, width. Candidates are cut by reach in the join, the greedy choice sees only those.
    """
    d = F.sqrt(F.pow(F.col("x") - F.col("tx"), 2) + F.pow(F.col("y") - F.col("ty"), 2))
    near = true.join(pred, by).withColumn("dist", d).where(F.col("dist") <= F.greatest(F.col("width") / 2, F.lit(floor)))
    near = near.select(*by, F.col("true_id").cast("long"), F.col("pred_id").cast("long"), "dist")
    return _one_to_one(near, by, "true_id", "pred_id", [F.col("true_id"), F.col("dist"), -F.col("pred_id")])


def plan_scores(matches: DataFrame, pred: DataFrame, true: DataFrame) -> DataFrame:
    """(plan_id, tp, n_pred, n_true, iou_sum) for each plan that has any of them."""
    m = matches.groupBy("plan_id").agg(F.count("*").alias("tp"), F.sum("iou").alias("iou_sum"))
    out = pred.groupBy("plan_id").agg(F.count("*").alias("n_pred")).join(true.groupBy("plan_id").agg(F.count("*").alias("n_true")), "plan_id", "full").join(m.hint("merge"), "plan_id", "left")
    return out.na.fill(0).select("plan_id", "tp", "n_pred", "n_true", "iou_sum")


