"""Command line: the steps one by one, on Parquet tables.

python -m tidemark cycles PRODUCTS OUT MISSION           cycle tables, from pass records under canonical names
python -m tidemark observations CYCLES OUT MISSION       observations with weights, from cycle tables
python -m tidemark model OBSERVATIONS OUT                the direct method's model, from observations
python -m tidemark pairs CYCLES OUT MISSION METHOD       a model of differences: collinear, crossover or joint
python -m tidemark errors CYCLES OUT MISSION VARIABLE    the model of another variable; with --err on perturbed rows
python -m tidemark tandem CYCLES_A CYCLES_B OUT PHASE    matches of a tandem phase's two missions
python -m tidemark calibrate CYCLES KU C OUT MISSION     the ionosphere's bias by two bands' models
python -m tidemark apply CYCLES KU C OUT                 track records with the models' bias and ionosphere

KU and C are folders that `model`, `pairs` or `errors` wrote; their formal errors are the errors that `apply` draws from.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.grid import Axis, Grid
from .plans import applying, steps
from .sources import tables

COMMANDS = {
    "cycles": ("products", "out", "mission"), "observations": ("cycles", "out", "mission"), "model": ("observations", "out"), "pairs": ("cycles", "out", "mission", "method"),
    "errors": ("cycles", "out", "mission", "variable"), "tandem": ("cycles_a", "cycles_b", "out", "phase"), "calibrate": ("cycles", "ku", "c", "out", "mission"), "apply": ("cycles", "ku", "c", "out"),
}
#: Metres within which tracks cross, and days between them at most.
CROSSING = {"radius": 7000.0, "max_days": 2.0}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="python -m tidemark", add_help=False)
    commands = out.add_subparsers(dest="command", required=True)
    for name, fields in COMMANDS.items():
        c = commands.add_parser(name)
        for f in fields:
            c.add_argument(f, choices=("collinear", "crossover", "joint") if f == "method" else None)
        c.add_argument("--band", choices=("ku", "c"), default="ku", help="whose height is fitted")
        c.add_argument("--err", help="a perturbation")
        c.add_argument("--least", type=int, default=steps.LEAST, help="observations of a node at least")
        c.add_argument("--gaps", action="store_true", help="models reach across their unknown nodes")
        c.add_argument("--step", type=float, default=1.2, help="seconds between a track's records at most, 0 for any")
        for axis in "xy":
            c.add_argument(f"--{axis}", nargs=3, type=float, metavar=("FIRST", "STEP", "COUNT"), help="a grid axis other than the standard one")
    return out


def _grid(a: argparse.Namespace) -> Grid:
    axis = lambda given, standard: Axis(given[0], given[1], int(given[2])) if given else standard
    return Grid(axis(a.x, steps.STANDARD_GRID.x), axis(a.y, steps.STANDARD_GRID.y))


def _write(m: steps.Model, spark: SparkSession, path: str) -> None:
    per = spark.createDataFrame([(int(k), float(v)) for k, v, _ in m.cycle_levels], "cycle int, level double")  # a row a cycle
    tables.write_model(m.nodes, per, spark.createDataFrame([(float(m.bias),)], "model_bias double"), path)


def _archive(products: DataFrame, mission: str) -> DataFrame:
    """Records of valid passes within the limits, with heights free of corrections that depend on the frequency."""
    kept = tables.stack_passes(products, mission).drop("usla_ku", "usla_c", "ssha_free")
    if "ssha" not in kept.columns:
        kept = kept.withColumn("ssha", tables.height_anomaly(F.col))
    return steps.with_uncorrected(kept, mission).withColumn("mission", F.lit(mission))


def run(spark: SparkSession, a: argparse.Namespace) -> None:
    """One command on a session of the caller's."""
    grid, max_step = _grid(a), a.step or None
    cycles = lambda: tables.read_cycles(spark, a.cycles, a.mission)
    nodes = lambda path: tables.read_model(spark, path)["model_node"]
    if a.command == "cycles":
        tables.write_cycles(_archive(spark.read.parquet(a.products), a.mission), a.out)
    elif a.command == "observations":
        tables.write_observations(steps.direct(cycles(), grid, a.mission, band=a.band, err=a.err), a.out)
    elif a.command == "model":
        _write(steps.fit_model(tables.read_observations(spark, a.observations)[0], grid, least=a.least, err=a.err), spark, a.out)
    elif a.command == "pairs":
        points = steps.filters.without_bad_cycles(steps.filters.level1(cycles(), a.mission), a.mission, collinear=a.method != "crossover")
        designs = []
        if a.method != "collinear":
            designs.append(steps.crossover_rows(points, grid, **CROSSING))
        if a.method != "crossover":
            designs.append(steps.collinear_rows(points, grid, steps.match.collinear_radius(a.mission), timed=a.method == "joint"))
        _write(steps.fit_pairs(designs, steps.direct(cycles(), grid, a.mission), grid, least=a.least), spark, a.out)
    elif a.command == "errors":
        _write(steps.error_analysis(cycles(), grid, a.mission, variable=a.variable, err=a.err, band=a.band, least=a.least, max_step=max_step), spark, a.out)
    elif a.command == "tandem":
        steps.tandem_tables(spark.read.parquet(a.cycles_a), spark.read.parquet(a.cycles_b), a.phase).write.mode("overwrite").parquet(a.out)
    elif a.command == "calibrate":
        found, bias = steps.iono_calibration(cycles(), nodes(a.ku), nodes(a.c), grid, ranges=steps.calibration_ranges(err=a.err), max_step=max_step)
        rows = [(int(k), float(x), float(g), float(bias) * steps.physics.TEC_TO_METRES) for k, x, g in found]  # a row a cycle
        spark.createDataFrame(rows, "cycle int, alt double, gim double, bias double").write.mode("overwrite").parquet(a.out)
    else:
        models = {"ku": nodes(a.ku), "c": nodes(a.c)}
        errors = {f"error_{b}": m.select("node", F.col("error").alias("value")) for b, m in models.items()}
        applying.write_applied(spark.read.parquet(a.cycles), models | errors, grid, a.out, max_step=max_step, gaps=a.gaps)


def main(args: list[str]) -> int:
    try:
        found = parser().parse_args(args)
    except SystemExit:
        print(__doc__)
        return 2
    spark = SparkSession.builder.getOrCreate()
    try:
        run(spark, found)
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
