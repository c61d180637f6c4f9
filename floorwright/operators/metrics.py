"""Segmentation metrics and losses over (target, pred) rows, per-class tables and probability arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floorwright.functions.taxonomy import IGNORE

EPS = 1e-6


def softmax(logits: Column) -> Column:
    """Probabilities of an array of logits, shifted by their maximum."""
    e = F.transform(logits, lambda v: F.exp(v.cast("double") - F.array_max(logits).cast("double")))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, x: a + x))


def argmax(values: Column) -> Column:
    """Index of the first maximum."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def confusion(df: DataFrame, target: str = "target", pred: str = "pred", by: tuple[str, ...] = ()) -> DataFrame:
    """(by.., target, pred, n) without ignored pixels; counted before the shuffle."""
    return df.where(F.col(target).isNotNull() & (F.col(target) != IGNORE)).groupBy(*by, F.col(target).alias("target"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def per_class(conf: DataFrame, classes: int) -> DataFrame:
    """(class_id, tp, gt, pr, iou) for each class 0..classes-1, from a confusion table; unions count as 1 at least."""
    spine = conf.sparkSession.range(classes).select(F.col("id").cast("int").alias("class_id"))
    hits = F.when(F.col("target") == F.col("pred"), F.col("n")).otherwise(0)
    gt = conf.groupBy(F.col("target").cast("int").alias("class_id")).agg(F.sum("n").alias("gt"), F.sum(hits).alias("tp"))
    pr = conf.groupBy(F.col("pred").cast("int").alias("class_id")).agg(F.sum("n").alias("pr"))
    all_ = spine.join(gt, "class_id", "left").join(pr, "class_id", "left").na.fill(0, ["gt", "tp", "pr"])
    return all_.select("class_id", "tp", "gt", "pr", (F.col("tp") / F.greatest(F.col("gt") + F.col("pr") - F.col("tp"), F.lit(1))).alias("iou"))


def summary(classes: DataFrame) -> DataFrame:
    """One row (miou, fwiou, pixel_acc, mean_acc) from a per-class table. Means are over classes that have pixels."""
    total = F.greatest(F.sum("gt"), F.lit(1))
    there = F.col("gt") > 0
    return classes.agg(
        F.coalesce(F.avg(F.when(there, F.col("iou"))), F.lit(0.0)).alias("miou"),
        (F.sum(F.col("gt") * F.col("iou")) / total).alias("fwiou"),
        (F.sum("tp") / total).alias("pixel_acc"),
        F.coalesce(F.avg(F.when(there, F.col("tp") / F.col("gt"))), F.lit(0.0)).alias("mean_acc"),
    )


def histogram(df: DataFrame, label: str = "label") -> DataFrame:
    """(class_id, n), pre-aggregated."""
    return df.where(F.col(label).isNotNull() & (F.col(label) != IGNORE)).groupBy(F.col(label).cast("int").alias("class_id")).agg(F.count("*").alias("n"))


def class_weights(hist: DataFrame) -> DataFrame:
    """(class_id, n, freq, weight): inverse square root of the frequency, of mean 1."""
    total = hist.agg(F.sum("n").alias("total"))
    raw = hist.crossJoin(F.broadcast(total)).select("class_id", "n", (F.col("n") / F.col("total")).alias("freq"))
    raw = raw.withColumn("raw", 1 / F.sqrt(F.col("freq") + EPS))
    return raw.crossJoin(F.broadcast(raw.agg(F.avg("raw").alias("mean")))).select("class_id", "n", "freq", (F.col("raw") / F.col("mean")).alias("weight"))


def class_share(hist: DataFrame) -> DataFrame:
    """(class_id, n, share)."""
    return hist.crossJoin(F.broadcast(hist.agg(F.sum("n").alias("total")))).select("class_id", "n", (F.col("n") / F.col("total")).alias("share"))


def mean_confidence(df: DataFrame, probs: str = "probs") -> DataFrame:
    return df.agg(F.avg(F.array_max(F.col(probs))).alias("confidence"))


def precision_recall(tp: Column, predicted: Column, truth: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1 to four places; 1 where nothing was predicted or there, F1 0 if both are 0."""
    p = F.when(predicted == 0, 1.0).otherwise(tp / F.when(predicted == 0, 1).otherwise(predicted))
    r = F.when(truth == 0, 1.0).otherwise(tp / F.when(truth == 0, 1).otherwise(truth))
    f = F.when(p + r == 0, 0.0).otherwise(2 * p * r / F.when(p + r == 0, 1.0).otherwise(p + r))
    four = lambda v: F.floor(v * 10000.0 + 0.5) / 10000.0
    return four(p), four(r), four(f)


def matching_totals(plans: DataFrame) -> DataFrame:
    """Micro totals over plans (tp, n_pred, n_true, iou_sum): precision, recall, f1, share of plans with equal counts, mean IoU of matches."""
    tot = plans.agg(F.sum("tp").alias("tp"), F.sum("n_pred").alias("n_pred"), F.sum("n_true").alias("n_true"), F.avg((F.col("n_pred") == F.col("n_true")).cast("double")).alias("exact_rate"), F.sum("iou_sum").alias("iou_sum"))
    p, r, f = precision_recall(F.col("tp"), F.col("n_pred"), F.col("n_true"))
    return tot.select("tp", "n_pred", "n_true", p.alias("precision"), r.alias("recall"), f.alias("f1"), "exact_rate", F.when(F.col("tp") > 0, F.col("iou_sum") / F.col("tp")).otherwise(0.0).alias("mean_iou"))


def soft_dice(df: DataFrame, target: str = "target", probs: str = "probs") -> DataFrame:
    """(class_id, inter, p_sum, t_sum, dice) over non-ignored rows, smoothed by 1."""
    own = df.where(F.col(target) != IGNORE).select(F.col(target).alias("t"), F.posexplode(probs).alias("class_id", "p"))
    hit = (F.col("t") == F.col("class_id")).cast("double")
    sums = own.groupBy("class_id").agg(F.sum(F.col("p") * hit).alias("inter"), F.sum("p").alias("p_sum"), F.sum(hit).alias("t_sum"))
    return sums.withColumn("dice", (2 * F.col("inter") + 1) / (F.col("p_sum") + F.col("t_sum") + 1))


def dice_loss(df: DataFrame, target: str = "target", probs: str = "probs") -> DataFrame:
    """One row: 1 minus the mean dice over classes that are there."""
    return soft_dice(df, target, probs).where("t_sum > 0").agg((1 - F.coalesce(F.avg("dice"), F.lit(1.0))).alias("dice_loss"))


def weighted_cross_entropy(df: DataFrame, boost: float = 0.0, smoothing: float = 0.0, class_weight: dict[int, float] | None = None, target: str = "target", logits: str = "logits", edge: str | None = None) -> DataFrame:
    """One row: sum(ce * w) / max(sum(w), 1) with w = 1 + boost * edge over non-ignored rows."""
    x = F.col(logits)
    top = F.array_max(x).cast("double")
    norm = top + F.log(F.aggregate(x, F.lit(0.0), lambda a, v: a + F.exp(v.cast("double") - top)))
    own = norm - F.get(x, F.col(target)).cast("double")
    mean = norm - F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double")) / F.size(x)
    ce = (1 - smoothing) * own + smoothing * mean
    if class_weight:
        ce = ce * F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in class_weight.items() for v in kv]), F.col(target)), F.lit(1.0))
    w = F.lit(1.0) if edge is None else 1.0 + boost * F.col(edge).cast("double")
    return df.where(F.col(target) != IGNORE).agg((F.sum(ce * w) / F.greatest(F.sum(w), F.lit(1.0))).alias("ce"))


def total_loss(ce: Column, dice: Column, aux: Column | None = None, dice_weight: float = 1.0, aux_weight: float = 0.4) -> Column:
    out = ce + dice_weight * dice
    return out if aux is None else out + aux_weight * aux


def lr_schedule(steps: DataFrame, base: float, total: int, warmup: int, power: float = 0.9, it: str = "it") -> DataFrame:
    """steps with lr: linear warm-up, then a polynomial fall to 0."""
    i = F.col(it)
    rest = F.greatest(F.lit(0.0), 1.0 - (i - warmup) / float(max(1, total - warmup)))
    return steps.withColumn("lr", base * F.when(i < warmup, (i + 1) / float(max(1, warmup))).otherwise(F.pow(rest, F.lit(power))))


def ema(values: Column, decay: float = 0.999) -> Column:
    """Exponential mean over an ordered array, the decay rising with the update: min(decay, (1 + u) / (10 + u))."""
    start = F.struct(F.lit(0).alias("u"), F.get(values, F.lit(0)).cast("double").alias("e"))

    def step(a: Column, v: Column) -> Column:
        u = a["u"] + 1
        d = F.least(F.lit(decay), (1.0 + u) / (10.0 + u))
        return F.struct(u.alias("u"), (a["e"] * d + v.cast("double") * (1.0 - d)).alias("e"))

    return F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), start, step)["e"]


def parity(a: Column, b: Column) -> Column:
    """Largest absolute difference over rows of two numbers."""
    return F.max(F.abs(a - b))


def quality_gate(scores: DataFrame, most: float = 0.01) -> DataFrame:
    """scores (artifact fp32 or int8, miou): the artifact to take; int8 if its mIoU is at most so much lower."""
    at = lambda n: F.max(F.when(F.col("artifact") == n, F.col("miou")))
    one = scores.agg(at("fp32").alias("fp32"), at("int8").alias("int8"))
    return one.select("fp32", "int8", F.when(F.col("fp32") - F.col("int8") <= most, "int8").otherwise("fp32").alias("chosen"))


def best_so_far(evals: DataFrame, order: str, metric: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by.., best order, best metric): the largest metric, its earliest row."""
    return evals.groupBy(*by).agg(F.max(F.struct(F.col(metric).alias("m"), (-F.col(order)).alias("o"))).alias("b")).select(*by, (-F.col("b.o")).alias(order), F.col("b.m").alias(metric))
