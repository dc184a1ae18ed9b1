"""Command line: python -m coppice.cli COMMAND ... over Parquet paths that Spark can read."""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import GroupingConfig
from .model import Forest
from .operators import estimates, prep, schedule, stats, structure
from .plans.options import Options
from .plans.predictor import Predictor
from .session import importable
from .sources import tables


def _names(text: str) -> list[str]:
    return [c for c in text.split(",") if c]


def score(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Scores the rows of a table."""
    forest = Forest.load(a.model)
    with open(a.config) as file:
        config = GroupingConfig.from_json(file.read())
    return Predictor(forest, config, _names(a.features)).predict(spark.read.parquet(a.input), a.plan, group=a.group, order=_names(a.order), options=Options(heavy_first=not a.no_heavy_first, small_methods=not a.no_small_methods))


def nodes(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """The nodes of a model."""
    return structure.nodes(spark, Forest.load(a.model))


def stats_of_model(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Size, varying share and expected steps of a model."""
    return structure.model_stats(spark, Forest.load(a.model), map(int, _names(a.varying)))


def manifest(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Cells of a run by their names, with the seed of each."""
    with open(a.input) as file:
        cells = json.load(file)
    frame = spark.createDataFrame([(c, str(schedule.name_seed(a.seed, c))) for c in cells], "cell STRING, seed STRING")
    return frame.select("cell", "seed", prep.cell_parts(F.col("cell")).alias("design")).select("cell", "seed", "design.*")


def pack(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Tables of one schema as one table, checked and read back."""
    parts = [spark.read.parquet(p) for p in a.inputs]
    tables.pack(parts, parts[0].schema, a.out)
    return tables.fingerprint(spark.read.parquet(a.out))


def summarize(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Latency of each method and its ratio to the reference's, with intervals."""
    return estimates.nested_median_ratios(spark.read.parquet(a.input), a.cell, a.method, a.block, a.entity, a.round, a.value, a.reference, a.draws, a.seed)


def retime(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Cells whose interval is wider than a percentage of their ratio."""
    return estimates.wide_intervals(spark.read.parquet(a.input), [a.cell], a.percent)


def check_run(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Strata whose sample contradicts its record."""
    return schedule.design_faults(spark.read.parquet(a.input), a.size, spark.read.parquet(a.strata)).where("counts or drift")


def audit(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Which of two columns is closer to the exact one."""
    return stats.precision_audit(spark.read.parquet(a.input), _names(a.keys), F.col(a.exact), F.col(a.a), F.col(a.b))


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="coppice", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name: str, run, **options) -> None:
        sub = commands.add_parser(name, help=run.__doc__)
        for option, default in options.items():
            flag = "--" + option.replace("_", "-")
            if default is None:
                sub.add_argument(flag, required=True)
            elif default is False:
                sub.add_argument(flag, action="store_true")
            elif isinstance(default, list):
                sub.add_argument(flag, nargs="+", required=True)
            else:
                sub.add_argument(flag, default=default, type=type(default))
        if name != "pack":
            sub.add_argument("--out", help="Parquet path; rows are shown without one")
        sub.set_defaults(run=run)

    command("score", score, model=None, config=None, features=None, input=None, plan="", group="", order="", no_heavy_first=False, no_small_methods=False)
    command("nodes", nodes, model=None)
    command("model-stats", stats_of_model, model=None, varying="")
    command("manifest", manifest, input=None, seed=0)
    command("pack", pack, inputs=[], out=None)
    command("summarize", summarize, input=None, cell="cell", method="method", block="block", entity="entity", round="round", value="ticks", reference="base", draws=1000, seed=0)
    command("retime", retime, input=None, cell="cell", percent=1.0)
    command("check-run", check_run, input=None, strata=None, size="rows")
    command("audit", audit, input=None, keys=None, exact=None, a=None, b=None)
    return parser


def main(arguments: Sequence[str] | None = None, spark: SparkSession | None = None) -> DataFrame:
    a = _parser().parse_args(arguments)
    out = a.run(importable(spark or SparkSession.builder.appName("coppice").getOrCreate()), a)
    if a.command != "pack" and a.out:
        out.write.parquet(a.out)
    else:
        out.show(50, truncate=False)
    return out


if __name__ == "__main__":
    main()
