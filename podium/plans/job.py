"""Command-line job: read the results file once, write the chosen analyses.

    spark-submit --py-files podium.zip podium/plans/job.py --environment local \
        --environments environments.json

An environments file holds, per name, ``input``, ``output`` and optionally
``conf`` with Spark settings such as those of an object store.
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.functions.predicates import violates_format
from podium.operators.quality import (
    column_catalog,
    distinct_row_count,
    impute_means,
    missing_by_group,
    null_fractions,
    null_profile,
    sentinel_profile,
    table_profile,
)
from podium.plans import games
from podium.session import build_session
from podium.sources.quarantine import checked_frames, read_csv_checked
from podium.sources.readers import read_csv_text
from podium.sources.scratch import clear, scratch_path
from podium.sources.scratch import stage as staged
from podium.sources.sinks import observed, refuse_existing, write_csv, write_parquet


@dataclass(frozen=True)
class Environment:
    input: str
    output: str
    conf: dict[str, str] = field(default_factory=dict)


def resolve(name: str, environments: Mapping[str, Environment]) -> Environment:
    """The environment of that name; an unknown name is an error."""
    if name not in environments:
        known = ", ".join(sorted(environments))
        raise ValueError(f"unknown environment {name!r}; known are: {known}")
    return environments[name]


def load_environments(path: str) -> dict[str, Environment]:
    with open(path, encoding="UTF-8") as file:
        return {name: Environment(**entry) for name, entry in json.load(file).items()}


MEASURES = ["Age", "Height", "Weight"]

ANALYSES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "gender_ratio": lambda df: games.participation(df).orderBy("Year", "Sex"),
    "top10_countries": games.top_countries,
    "dominant_sports": games.dominant_sports,
    "height_weight_age": games.winner_profile,
    "host_country_medals": games.host_advantage,
    "host_enrichment": games.with_host,
    "format_check": games.format_check,
    "format_violations": lambda df: df.filter(violates_format("Games", games.GAMES_FORMAT, include_null=True)),
    "null_profile": null_profile,
    "sentinel_profile": sentinel_profile,
    "distinct_rows": distinct_row_count,
    "column_catalog": column_catalog,
    "complete_rows": lambda df: df.na.drop(how="any"),
    "table_profile": table_profile,
    "missing_fractions": null_fractions,
    "missing_by_games": lambda df: missing_by_group(
        df, "Games", {"Weight_NA_Count": "Weight", "Height_NA_Count": "Height"}
    ),
    "imputed": lambda df: impute_means(df, MEASURES),
}
#: Records of the file that do not fit its columns, with file and reason.
REJECTED = "rejected_records"
ANALYSES[REJECTED] = lambda rejected: rejected.select(
    "file", F.regexp_replace(F.regexp_replace("record", "\\r", r"\\r"), "\\n", r"\\n").alias("record"), F.array_join("reasons", ", ").alias("reasons")
)
#: These look at the table as it was read, whatever the season and year: what they are to find may lie anywhere.
AS_READ = {
    "host_enrichment", "format_check", "format_violations", "null_profile", "sentinel_profile", "distinct_rows", "column_catalog",
    "complete_rows", "table_profile", "missing_fractions", "missing_by_games", "imputed",
}
#: The published results; the others are checks and repairs that a run asks for by name.
DEFAULT_ANALYSES = [
    "gender_ratio",
    "top10_countries",
    "dominant_sports",
    "height_weight_age",
    "host_country_medals",
]


def run(
    spark: SparkSession,
    environment: Environment,
    *,
    analyses: list[str] | None = None,
    fmt: str = "csv",
    mode: str = "overwrite",
    stage: bool = True,
    preview: int = 0,
    explain: bool = False,
    sep: str = ",",
    null_value: str | None = None,
    counts: dict[str, dict] | None = None,
) -> dict[str, str]:
    """Write each analysis below the output path; returns the path of each.

    Records that do not fit the columns take no part; ``rejected_records`` lists them. Profiles, checks, repairs and the enrichment see all other
    records, the published results those in scope.

    ``stage`` parses the text file once, for all analyses: records that fit and records that do not go to the shared folder as parquet, and each analysis reads only the
    columns it needs. What the published results count is then counted once, by one scan and one shuffle. It survives lost executors, unlike a cache. The run's
    copies are removed at its end.

    With ``mode="errorifexists"`` a run that finds any of its results there fails before it reads or writes anything.

    ``sep`` and ``null_value`` are those of the results file. ``counts``, if given, gets rows and NULLs of each result, taken while it is written.
    """
    chosen = analyses or DEFAULT_ANALYSES
    targets = {name: f"{environment.output.rstrip('/')}/{name}" for name in chosen}
    if mode == "errorifexists":
        refuse_existing(spark, targets.values())
    folder = scratch_path(spark, "job")

    def keep(df: DataFrame, name: str) -> DataFrame:
        return staged(df, name, folder)

    options = {"sep": sep, "null_value": null_value}
    written = {}
    try:
        if stage:
            table = read_csv_checked(spark, environment.input, games.RESULTS_SCHEMA, target=f"{folder}/records", **options)
        else:
            table = checked_frames(spark, environment.input, games.RESULTS_SCHEMA, **options)
        entries = games.scope(table.rows)
        published = [name for name in chosen if name in DEFAULT_ANALYSES]
        shared = games.from_shared(games.shared(entries).stored(keep)) if stage and len(published) > 1 else {}
        for name in chosen:
            if name in shared:
                result = shared[name]
            else:
                result = ANALYSES[name](table.rejected if name == REJECTED else table.rows if name in AS_READ else entries)
            if explain:
                result.explain("formatted")
            target = targets[name]
            watched, found = observed(result)
            if fmt == "parquet":
                write_parquet(watched, target, mode=mode)
            else:
                write_csv(watched, target, mode=mode)
            if counts is not None:
                counts[name] = found()
            if preview:
                written_rows = spark.read.parquet(target) if fmt == "parquet" else read_csv_text(spark, target)
                written_rows.show(preview, truncate=False)
            written[name] = target
    finally:
        clear(spark, folder)
    return written


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawTextHelpFormatter)
    parser.add_argument("--environment", default="local")
    parser.add_argument("--environments", help="JSON file with the known environments")
    parser.add_argument("--input", help="results file; makes an environment file unnecessary")
    parser.add_argument("--output", help="folder for the results")
    parser.add_argument("--analyses", nargs="+", choices=list(ANALYSES))
    parser.add_argument("--format", choices=["csv", "parquet"], default="csv")
    parser.add_argument("--mode", choices=["overwrite", "errorifexists"], default="overwrite")
    parser.add_argument("--no-stage", dest="stage", action="store_false", help="parse the text file for each analysis")
    parser.add_argument("--sep", default=",", help="separator of the results file")
    parser.add_argument("--null-value", help="text that stands for a missing value in every column")
    parser.add_argument("--preview", type=int, default=0, help="print this many rows of each result")
    parser.add_argument("--explain", action="store_true", help="print the plans")
    args = parser.parse_args(argv)

    if args.input and args.output:
        environment = Environment(args.input, args.output)
    elif args.environments:
        environment = resolve(args.environment, load_environments(args.environments))
    else:
        parser.error("give --environments, or --input and --output")
    spark = build_session("podium", conf=environment.conf)
    counts: dict[str, dict] = {}
    try:
        written = run(
            spark,
            environment,
            analyses=args.analyses,
            fmt=args.format,
            mode=args.mode,
            stage=args.stage,
            preview=args.preview,
            explain=args.explain,
            sep=args.sep,
            null_value=args.null_value,
            counts=counts,
        )
        for name, target in written.items():
            missing = sum(counts[name]["nulls"].values())
            print(f"{name}: {counts[name]['rows']} rows, {missing} missing values, {target}")
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
