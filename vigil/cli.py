"""Command-line entry points, one per original program: generate training data, train and
save the model, print the cutoff table, and score a line stream per reporting interval.

    spark-submit -m vigil.cli generate N_ROWS N_SENSORS N_PARTITIONS OUT [--cutoff C] [--first-weight W]
    spark-submit -m vigil.cli train IN MODEL [--intercept]
    spark-submit -m vigil.cli cutoffs N_ROWS N_SENSORS [--partitions P]
    spark-submit -m vigil.cli score-stream N_SENSORS INTERVAL_S MODEL OUT CHECKPOINT
                  (--files DIR | --socket HOST PORT | --kafka SERVERS TOPIC) [--neutral 0.5]

Paths are URIs (hdfs://, s3a://, file:) handed to Spark as they are.
"""

from __future__ import annotations

import argparse
import sys
import time
from datetime import datetime, timezone

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from vigil.functions import vectors as fv
from vigil.operators import models as om
from vigil.operators import vectors as ov
from vigil.operators.intervals import LinearModel
from vigil.sinks import write_lines
from vigil.sources import lines as sl
from vigil.streaming import scoring as ss


def _stamp() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="milliseconds")


def generate(spark: SparkSession, a) -> None:
    t0 = time.time()
    g = ov.generate_range(spark, a.n_rows, a.n_sensors, a.n_partitions, seed=a.seed, cutoff=a.cutoff,
                          first_weight=a.first_weight)
    write_lines(g, fv.encode_vector(F.col("label"), F.col("features")), a.out)
    rows = -(-a.n_rows // a.n_partitions) * a.n_partitions
    print(f"{_stamp()} generate: rows={rows} sensors={a.n_sensors} out={a.out} elapsed={time.time() - t0:.1f}s")


def train(spark: SparkSession, a) -> None:
    t0 = time.time()
    lines = sl.read_lines(spark, a.input)
    first = lines.first()
    width = first["value"].count(",") if first else 0
    status = {r["status"]: r["n"] for r in om.training_status(lines, width).collect()}  # three rows at most
    model = om.train_lr(om.training_frame(lines, width), fit_intercept=a.intercept)
    om.save_model(model, a.model)
    print(f"{_stamp()} train: lines={status} model={a.model} elapsed={time.time() - t0:.1f}s")


def cutoffs(spark: SparkSession, a) -> None:
    g = ov.generate_range(spark, a.n_rows, a.n_sensors, a.partitions, seed=a.seed)
    table = ov.score_cutoffs(g.select("score")).orderBy(F.col("pct").desc())
    print(f"{_stamp()} cutoffs: rows={a.n_rows} sensors={a.n_sensors}")
    for r in table.collect():  # 99 rows
        print(f"{r['pct']} {r['cutoff']:.0f}")


def score_stream(spark: SparkSession, a) -> None:
    if a.files:
        lines = sl.text_stream(spark, a.files)
    elif a.socket:
        lines = sl.socket_stream(spark, a.socket[0], int(a.socket[1]))
    else:
        lines = sl.kafka_stream(spark, a.kafka[0], a.kafka[1])
    model = LinearModel.from_spark_ml(om.load_model(a.model))
    if model.n != a.n_sensors:
        raise SystemExit(f"model has {model.n} weights, expected {a.n_sensors}")
    q = ss.start_interval_scoring(lines, model, a.neutral, a.interval, a.out, a.checkpoint,
                                  delay=a.delay, processing_time=f"{a.interval} seconds",
                                  state_partitions=spark.sparkContext.defaultParallelism)
    t0 = time.time()
    ss.stop_on_sentinel(q)
    s = spark.read.parquet(a.out).agg(F.count(F.lit(1)).alias("n"), F.sum("n_events").alias("e")).first()
    elapsed = time.time() - t0
    n, rate = s["e"] or 0, (s["e"] or 0) / max(elapsed, 1e-9)
    print(f"{_stamp()} score-stream: events={n} intervals={s['n']} elapsed={elapsed:.1f}s rate={rate:.0f}/s")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="vigil")
    sub = p.add_subparsers(dest="cmd", required=True)
    g = sub.add_parser("generate")
    g.add_argument("n_rows", type=int)
    g.add_argument("n_sensors", type=int)
    g.add_argument("n_partitions", type=int)
    g.add_argument("out")
    g.add_argument("--cutoff", type=float)
    g.add_argument("--first-weight", type=int, default=1)
    g.add_argument("--seed", type=int, default=42)
    t = sub.add_parser("train")
    t.add_argument("input")
    t.add_argument("model")
    t.add_argument("--intercept", action="store_true")
    c = sub.add_parser("cutoffs")
    c.add_argument("n_rows", type=int)
    c.add_argument("n_sensors", type=int)
    c.add_argument("--partitions", type=int, default=8)
    c.add_argument("--seed", type=int, default=42)
    s = sub.add_parser("score-stream")
    s.add_argument("n_sensors", type=int)
    s.add_argument("interval", type=float)
    s.add_argument("model")
    s.add_argument("out")
    s.add_argument("checkpoint")
    src = s.add_mutually_exclusive_group(required=True)
    src.add_argument("--files")
    src.add_argument("--socket", nargs=2, metavar=("HOST", "PORT"))
    src.add_argument("--kafka", nargs=2, metavar=("SERVERS", "TOPIC"))
    s.add_argument("--neutral", type=float, default=0.5)
    s.add_argument("--delay", default="0 seconds", help="watermark delay for late readings")
    return p


COMMANDS = {"generate": generate, "train": train, "cutoffs": cutoffs, "score-stream": score_stream}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName(f"vigil-{a.cmd}").getOrCreate()
    COMMANDS[a.cmd](spark, a)


if __name__ == "__main__":
    main(sys.argv[1:])
