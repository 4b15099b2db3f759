"""Command line: ``python -m tracewise onset|manifest|latency|ingest|validate|replay``. Paths may be on any file system of Spark's."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewise.functions.formats import describe_match
from tracewise.operators import recipes, validation
from tracewise.plans import cohort, published, session
from tracewise.plans.lineage import checkpointed
from tracewise.plans.specs import CohortConfig, load_config, load_manifest
from tracewise.plans.store import Store
from tracewise.sources import event_files, nested
from tracewise.sources import tables as T


def _arguments(args: list[str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="tracewise", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, needs in (("onset", "config"), ("manifest", "manifest"), ("latency", "manifest")):
        sub = commands.add_parser(name)
        sub.add_argument(f"--{needs}", required=True, help="a YAML file" + (f", or one of {', '.join(published.MANIFESTS)}" if needs == "manifest" else ""))
        sub.add_argument("--source", required=True, help="folder of event and frequency files")
        sub.add_argument("--converted", required=True, help="folder of converted tables")
        sub.add_argument("--out", help="folder for results; by default below the derivatives root")
    commands.choices["latency"].add_argument("--state", required=True, help="how the state's run id begins")
    commands.choices["latency"].add_argument("--group", default="passive_axons")
    ingest = commands.add_parser("ingest")
    ingest.add_argument("--source", required=True, help="folder of nested JSON sources")
    ingest.add_argument("--dest", required=True)
    replay = commands.add_parser("replay")
    for name in ("--root", "--key", "--out"):
        replay.add_argument(name, required=True)
    validate = commands.add_parser("validate")
    validate.add_argument("--source", required=True)
    validate.add_argument("--converted", required=True)
    validate.add_argument("--alignment", default="reward")
    validate.add_argument("--floor", type=float, default=0.0, help="the exact fraction below which the exit code is 1")
    return parser.parse_args(args)


def configs_of(name: str) -> tuple[CohortConfig, ...]:
    """The analyses of a manifest by name or file."""
    return published.MANIFESTS[name]() if name in published.MANIFESTS else load_manifest(name)


def _write(df: DataFrame, folder: str, name: str) -> None:
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
    df.sparkSession.read.parquet(f"{folder}/{name}").show(100, truncate=False)


def _inputs(spark: SparkSession, configs: tuple[CohortConfig, ...], args: argparse.Namespace) -> dict[str, cohort.Inputs]:
    tables = T.read_converted(spark, args.converted)
    return {c.alignment: cohort.read_inputs(spark, c, args.source, tables) for c in configs}


def validate(spark: SparkSession, source: str, converted: str, alignment: str) -> DataFrame:
    """Match report of events found again against the files of all groups that have a recipe."""
    names = list(recipes.RECIPES)
    found = recipes.regenerate(T.read_converted(spark, converted, tuple(recipes.recipe_tables(names))), cohort.CohortConfig("validate", alignment).event_tables, alignment, names)
    sides = zip(("target", "reference"), event_files.SUFFIXES[alignment], strict=True)
    files = [event_files.read_event_folder(spark, source, suffix).withColumn("side", F.lit(side)) for side, suffix in sides]
    reference = checkpointed(files[0].unionByName(files[1])).withColumnRenamed("stem", "group").where(F.col("group").isin(*names))
    return validation.match_report(found, reference).withColumn("sentence", describe_match())


def main(args: list[str] | None = None) -> int:
    """Exit code: 0, or 1 if validation is below its floor."""
    args = _arguments(sys.argv[1:] if args is None else args)
    spark = SparkSession.builder.appName("tracewise").getOrCreate()
    if args.command == "ingest":
        for name, path in sorted(nested.convert_all(spark, args.source, args.dest).items()):
            print(f"{name}: {path}")
        return 0
    if args.command == "replay":
        _write(Store(spark, args.root).remade(args.key), args.out, args.key)
        return 0
    if args.command == "validate":
        report = validate(spark, args.source, args.converted, args.alignment).collect()
        for row in report:
            print(row.sentence)
        return int(any(row.exact_fraction < args.floor for row in report))
    out = args.out or f"{session.derivatives_root()}/tracewise"
    if args.command == "onset":
        config = load_config(args.config)
        made = cohort.run_onset_analysis(config, _inputs(spark, (config,), args)[config.alignment])
        for name in ("totals", "proportions", "results", "histogram"):
            if getattr(made, name) is not None:
                _write(getattr(made, name), f"{out}/{config.run_id}", name)
        return 0
    configs = configs_of(args.manifest)
    if args.command == "manifest":
        _write(cohort.run_manifest(configs, _inputs(spark, configs, args)), out, "results")
        return 0
    chosen = [c for c in configs if c.run_id.startswith(args.state)]
    if len(chosen) != 1:
        raise SystemExit(f"--state {args.state!r} fits {len(chosen)} states: {[c.run_id for c in chosen]}")
    points, line = cohort.run_latency_correlation(chosen[0], _inputs(spark, tuple(chosen), args)[chosen[0].alignment], args.group)
    _write(points, f"{out}/{chosen[0].run_id}", "latency_points")
    _write(line, f"{out}/{chosen[0].run_id}", "latency")
    return 0


if __name__ == "__main__":
    sys.exit(main())
