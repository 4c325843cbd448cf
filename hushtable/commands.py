"""Commands: release, decode, generate, bound, correct, and run, which does them in turn. `python -m hushtable <command> --help`."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from hushtable.functions.bins import Schema
from hushtable.operators import assess, decode, fitted, ranks, stage
from hushtable.operators.audit import require
from hushtable.sources.documents import read_release, write_release
from hushtable.sources.schemas import load_schema
from hushtable.sources.sinks import without_provenance, write_document, write_record, write_table
from hushtable.sources.tables import read_table
from hushtable.streaming import generation


def parser() -> argparse.ArgumentParser:
    ap = argparse.ArgumentParser(prog="hushtable", description=__doc__)
    commands = ap.add_subparsers(dest="command", required=True)

    def command(name: str, help: str, *wanted: str) -> None:
        p = commands.add_parser(name, help=help)
        p.add_argument("--schema", required=True, help="a Python file that defines SCHEMA, or JSON")
        p.add_argument("--out", required=True, help="a new folder for the results")
        texts = {"data": "the private table (Parquet, or .csv)", "release": "a written release", "synthetic": "the synthetic table", "ids": "columns that tell rows apart, by commas", "columns": "columns to condition on, by commas (default: the first level)"}
        for w in wanted:
            kind = {"n-rows": int, "pool-factor": int, "draws": int, "seed": int, "per-person": int, "n-min": int, "epsilon": float, "bound-epsilon": float, "tolerance": float}.get(w, str)
            default = {"n-rows": 300, "pool-factor": 3, "draws": 1, "seed": 0, "per-person": 1, "n-min": 150, "epsilon": 2.0, "bound-epsilon": 1.0}.get(w)
            optional = w in ("columns", "holdout", "tolerance") or default is not None
            p.add_argument(f"--{w}", required=not optional, type=kind, default=default, help=texts.get(w))
        p.add_argument("--all-forms", action="store_true", help="records as CSV and Markdown too")
        if name in ("decode", "run"):
            p.add_argument("--no-select", action="store_true", help="rows as drawn, without selection to the release")
        if name == "run":
            p.add_argument("--mock", action="store_true", help="rows from the mock generator, not the decoder")
            p.add_argument("--evaluate", action="store_true", help="distances and students too")

    command("release", "noisy tables of the private table", "data", "epsilon", "n-min", "per-person")
    command("decode", "rows from a release alone", "release", "n-rows", "draws", "pool-factor", "seed")
    command("generate", "rows from the mock generator, by exact quotas of a release", "release", "n-rows", "seed")
    command("bound", "how far conditional rates may be off, with controls", "data", "synthetic", "holdout", "release", "ids", "columns", "bound-epsilon", "n-min", "per-person", "tolerance", "seed")
    command("correct", "a synthetic table with released conditional rates", "data", "synthetic", "ids", "columns", "epsilon", "n-min", "seed")
    command("run", "release, rows, bound", "data", "holdout", "ids", "columns", "epsilon", "bound-epsilon", "n-min", "per-person", "n-rows", "pool-factor", "tolerance", "seed")
    return ap


def table(spark: SparkSession, path: str, schema: Schema, ids: list[str] = ()) -> DataFrame:
    """A private or synthetic table, refused with its problems if it doesn't fit the schema."""
    columns = list(dict.fromkeys([*ids, *schema.numeric, *schema.categorical, schema.stratify, schema.target]))
    return require(read_table(spark, path, columns), schema)


def names(text: str | None) -> tuple[str, ...]:
    return tuple(x.strip() for x in (text or "").split(",") if x.strip())


def make_release(spark: SparkSession, df: DataFrame, schema: Schema, a) -> stage.Release:
    cohorts = [v for v in schema.categorical.get(schema.stratify, ())]
    if not cohorts:
        raise ValueError(f"{schema.stratify} needs declared values to be the cohorts")
    made = stage.release(df, schema, cohorts, a.epsilon, n_min=a.n_min, rows_per_person=a.per_person)
    write_release(spark, made, f"{a.out}/release")
    write_document(spark, made.audit, f"{a.out}/audit")
    return made


def decoded(spark: SparkSession, release: stage.Release, schema: Schema, a, draws: int) -> list[str]:
    """Draws of rows, and a manifest of what they were made from; no private row is read."""
    model = fitted.fit_release(release, schema)
    paths = []
    for k in range(draws):
        rows = decode.draw(spark, release, schema, a.n_rows * (1 if a.no_select else a.pool_factor), a.seed + k, model)
        if not a.no_select:
            rows = decode.select_to_release(rows, release, schema, a.n_rows, ["row"], a.seed + k)
        paths.append(f"{a.out}/decoded_{k}.csv")
        write_table(without_provenance(rows), paths[-1])
    far = fitted.apart(model, release, schema)
    measured = [{"columns": m.columns, "counts": int(m.counts.size), "noise": float(m.noise if isinstance(m.noise, float) else m.noise.max())} for m in fitted.tables_of(release, schema)]
    write_document(spark, {"n_rows": a.n_rows, "draws": draws, "pool_factor": a.pool_factor, "selected": not a.no_select, "seed": a.seed, "rounds": model.rounds, "gap": model.gap, "notes": model.notes, "total": model.total, "mean_distance": sum(x[0] for x in far) / max(len(far), 1), "worst": far[:5], "measured": measured, "private_data_read": False, "privacy_cost": 0.0, "files": paths}, f"{a.out}/manifest")
    return paths


def generated(spark: SparkSession, release: stage.Release, schema: Schema, a) -> str:
    quotas = generation.cohort_quotas(release, schema, a.n_rows, a.seed)
    rows = generation.generate(spark, quotas, schema, f"{a.out}/generation", generation.exact_mock(schema, a.seed), seed=a.seed)
    write_table(without_provenance(rows), f"{a.out}/generated.csv")
    write_record(spark, {"rows": a.n_rows, "generator": "mock"}, {"quotas": generation.status(spark, f"{a.out}/generation")}, f"{a.out}/generation_record", a.all_forms)
    return f"{a.out}/generated.csv"


def bounded(spark: SparkSession, private: DataFrame, synthetic: DataFrame, holdout: DataFrame, release: stage.Release, schema: Schema, a) -> dict:
    """The bound with its controls on the released cells of the level that has the asked columns."""
    columns = names(a.columns) or schema.levels[0]
    if columns not in schema.levels:
        raise ValueError(f"no level of the schema has the columns {', '.join(columns)}")
    own = release.cells[release.cells["level"] == schema.levels.index(columns)]
    if not len(own):
        raise ValueError("the release has no cell of these columns")
    cells = spark.createDataFrame(own[["cell", "support", "rate"]])
    report = assess.bound_with_controls(private, synthetic, holdout, release, cells, schema, columns, list(names(a.ids)), a.bound_epsilon, a.per_person, a.n_min, allowed=a.tolerance, seed=a.seed, gate=True)
    write_document(spark, report, f"{a.out}/bound")
    return report


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0 where a command did its work, 2 with the reason on stderr where it refused."""
    a = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("hushtable").getOrCreate()
    try:
        schema, ids = load_schema(a.schema), names(getattr(a, "ids", None))
        if a.command == "release":
            make_release(spark, table(spark, a.data, schema), schema, a)
        elif a.command == "decode":
            decoded(spark, read_release(spark, a.release), schema, a, a.draws)
        elif a.command == "generate":
            generated(spark, read_release(spark, a.release), schema, a)
        elif a.command == "correct":
            columns = names(a.columns) or schema.levels[0]
            synthetic = table(spark, a.synthetic, schema, ids)
            after, told = assess.correct(table(spark, a.data, schema), synthetic, schema, columns, list(ids), a.epsilon, a.n_min, a.seed)
            write_table(after, f"{a.out}/corrected.csv")
            write_record(spark, told, {}, f"{a.out}/correction", a.all_forms)
        else:
            private = table(spark, a.data, schema, ids)
            if a.holdout:
                holdout = table(spark, a.holdout, schema, ids)
            else:
                split = ranks.holdout_split(private, schema.target, 0.2, list(ids), a.seed)
                private, holdout = split.where("not held_out").drop("held_out"), split.where("held_out").drop("held_out")
            if a.command == "run":
                release = make_release(spark, private, schema, a)
                path = generated(spark, release, schema, a) if a.mock else decoded(spark, release, schema, a, 1)[0]
            else:
                release, path = read_release(spark, a.release), a.synthetic
            synthetic = table(spark, path, schema)
            report = bounded(spark, private, synthetic, holdout, release, schema, a)
            if a.command == "run":
                made = {"synthetic rows": synthetic.count(), "release budget": release.audit["total"], "verdict": report["verdict"]}
                tables = {"evaluation": assess.evaluate({"synthetic": synthetic}, private, holdout, schema, list(ids), a.n_rows, draws=2)} if a.evaluate else {}
                write_record(spark, made, tables, f"{a.out}/record", a.all_forms)
    except ValueError as refused:
        print(f"refused: {refused}", file=sys.stderr)
        return 2
    return 0
