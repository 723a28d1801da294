"""Named experiments: which files, priors, depths and grids, and what is asked of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillbit.operators import report, search
from quillbit.plans import score
from quillbit.plans.spec import BASES, tuned

# The priors and depths of the experiments, steps of their grids, and the named codecs beside them.
PRIORS = ("uniform_byte", "uniform_token", "polya_token", "polya_stoken_uniform_token", "polya_stoken_uniform_byte")
DEPTHS = tuple(range(10))
STEPS = (0, 5, 10, 20)
GRID_STEPS = 10
SIMPLE_LAYERS = ("none", "crp", "lzw", *(f"ppm{d}" for d in (4, 5, 6)))

Experiment = Callable[..., DataFrame]
EXPERIMENTS: dict[str, Experiment] = {}


def experiment(f: Experiment) -> Experiment:
    """Add an experiment (spark, files with ``file`` and ``content``, options) by its name."""
    EXPERIMENTS[f.__name__] = f
    return f


def run(name: str, spark: SparkSession, files: DataFrame, **options) -> DataFrame:
    if name not in EXPERIMENTS:
        raise ValueError(f"no experiment {name!r}; there are {', '.join(sorted(EXPERIMENTS))}")
    return EXPERIMENTS[name](spark, files, **options)


def algorithms(parameters: dict[str, list] | None = None) -> dict[str, str]:
    """Every algorithm of the final benchmark: plain ones by prior, those tuned on each set of files, and codecs."""
    names = [f"{layer}_{prior}" for layer in SIMPLE_LAYERS for prior in PRIORS] + ["none_lzw_byte"]
    out = {n: n for n in names} | {f"ref_{c}": f"ref_{c}" for c in score.CODECS}
    for files, best in (parameters or {}).items():
        out |= tuned(best, files)
    return out


@experiment
def contour_plot(spark, files, prior="uniform_byte", depth=5, steps=GRID_STEPS, a=(0.0, 1.0), b=(0.0, 1.0)):
    """(alpha, beta, efficiency) of all files together, cell by cell."""
    return search.contour(spark, files, prior, depth, a, b, steps)


@experiment
def contour_plot_by_file(spark, files, prior="uniform_byte", depth=5, steps=GRID_STEPS, a=(0.0, 1.0), b=(0.0, 1.0)):
    """The same for every file alone."""
    out = None
    for r in files.select("file").distinct().orderBy("file").collect():
        one = search.contour(spark, files.where(F.col("file") == r["file"]), prior, depth, a, b, steps).withColumn("file", F.lit(r["file"]))
        out = one if out is None else out.unionByName(one)
    return out


@experiment
def optimal_by_depth(spark, files, prior="uniform_byte", depths=DEPTHS, steps=GRID_STEPS):
    """The optimum of every depth over all files."""
    return search.optima(spark, files, prior, depths, steps=steps)


@experiment
def optimal(spark, files, prior="uniform_byte", depths=DEPTHS, steps=GRID_STEPS):
    """The best optimum over the depths."""
    found = search.optima(spark, files, prior, depths, steps=steps).withColumn("prior", F.lit(prior))
    return report.best_by(found, "efficiency", ["depth"], ["depth", "alpha", "beta"], "prior")


@experiment
def optimal_by_file(spark, files, prior="uniform_byte", depths=DEPTHS, steps=GRID_STEPS):
    """The best optimum of every file alone."""
    out = None
    for r in files.select("file").distinct().orderBy("file").collect():
        one = optimal(spark, files.where(F.col("file") == r["file"]), prior, depths, steps).withColumn("file", F.lit(r["file"]))
        out = one if out is None else out.unionByName(one)
    return out


@experiment
def grid_steps(spark, files, prior="uniform_byte", depth=5, steps=STEPS):
    """How the optimum depends on the steps of the grid it starts from."""
    out = None
    for n in steps:
        one = search.optima(spark, files, prior, [depth], steps=n).withColumn("steps", F.lit(n))
        out = one if out is None else out.unionByName(one)
    return out


@experiment
def benchmark(spark, files, parameters=None, paranoid=True, timeout=600.0, names=None):
    """Every file by every algorithm, unpacked and compared."""
    found = algorithms(parameters)
    return score.grid(files, {n: found[n] for n in names} if names else found, paranoid=paranoid, timeout=timeout)


@experiment
def resources(spark, files, names=("lzw_uniform_byte", "ppm5_uniform_byte"), replications=20):
    """(algo, measure, mean, error) of wall and processor time and memory over repetitions."""
    done = score.grid(files, list(names), paranoid=True, replications=replications)
    long = done.select("algo", F.explode(F.create_map(*(x for m in ("wall", "cpu", "memory") for x in (F.lit(m), F.col(m).cast("double"))))).alias("measure", "value"))
    return report.mean_and_error(long, "value", "algo", "measure")


@experiment
def bases(spark, files):
    """(file, base, bits): every base without a layer."""
    done = score.grid(files, {b: f"none/{b}" for b in BASES})
    return done.select("file", F.col("algo").alias("base"), "bits_per_byte")
