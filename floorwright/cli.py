"""Command line: evaluate, vectorize and predict over tables of masks and images."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from floorwright.functions import taxonomy
from floorwright.operators import metrics, tiles
from floorwright.plans import vectorize
from floorwright.sources import exports


def evaluate(spark: SparkSession, args: argparse.Namespace) -> None:
    """Pixel tables (plan_id, y, x, label) of predictions and truth."""
    pred, true = (spark.read.parquet(p).select("plan_id", "y", "x", F.col("label").alias(n)) for p, n in ((args.pred, "pred"), (args.true, "target")))
    conf = metrics.confusion(true.join(pred, ["plan_id", "y", "x"]))
    metrics.summary(metrics.per_class(conf, len(taxonomy.taxonomy(args.taxonomy).classes))).write.mode("overwrite").json(args.out)


def run_vectorize(spark: SparkSession, args: argparse.Namespace) -> None:
    docs = vectorize.vectorize(spark.read.parquet(args.masks), vectorize.config(overrides=args.set), taxonomy.taxonomy(args.taxonomy))
    for kind in args.formats:
        docs = exports.exported(docs, kind)
    docs.write.mode("overwrite").parquet(args.out)


def predict(spark: SparkSession, args: argparse.Namespace) -> None:
    tiles.predict(spark.read.parquet(args.images), tiles.onnx_scorer(args.model), args.tile, args.overlap, args.tta).write.mode("overwrite").parquet(args.out)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="floorwright")
    sub = p.add_subparsers(dest="command", required=True)
    e = sub.add_parser("evaluate")
    e.add_argument("pred")
    e.add_argument("true")
    e.set_defaults(run=evaluate)
    v = sub.add_parser("vectorize")
    v.add_argument("masks")
    v.add_argument("--set", nargs="*", default=[], metavar="KEY=VALUE")
    v.add_argument("--formats", nargs="*", default=[], choices=sorted(exports.FORMATS))
    v.set_defaults(run=run_vectorize)
    q = sub.add_parser("predict")
    q.add_argument("images")
    q.add_argument("model")
    q.add_argument("--tile", type=int, default=512)
    q.add_argument("--overlap", type=float, default=0.25)
    q.add_argument("--tta", action="store_true")
    q.set_defaults(run=predict)
    for s in (e, v, q):
        s.add_argument("--out", required=True)
        s.add_argument("--taxonomy", default="coarse", choices=sorted(taxonomy.TAXONOMIES))
    args = p.parse_args(argv)
    args.run(SparkSession.builder.appName("floorwright").getOrCreate(), args)


if __name__ == "__main__":
    main()
