"""Result tables: CSV in, CSV, JSON, console and LaTeX out."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RESOURCES = "file string, replication int, compressor string, wall_runtime double, cpu_runtime double, memory bigint"


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", "true")
    return reader.schema(schema).csv(path) if schema else reader.csv(path)


def unpivot_benchmark(wide: DataFrame, file: str = "File", size: str = "Size") -> DataFrame:
    """A wide table (file, size, one column for each algorithm) as (file, size, algo, csize, status, bits_per_byte).

    Cells that are no finite number give a null size and a status.
    """
    algos = [c for c in wide.columns if c not in (file, size)]
    # a null cell keeps its row: it is a result that is missing
    long = wide.select(
        F.col(file).alias("file"), F.col(size).cast("long").alias("size"),
        F.explode(F.array(*(F.struct(F.lit(a).alias("algo"), F.col(f"`{a}`").cast("string").alias("cell")) for a in algos))).alias("x"),
    ).select("file", "size", "x.algo", "x.cell")
    value = F.expr("try_cast(cell AS DOUBLE)")
    good = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    return long.select(
        "file", "size", "algo",
        F.when(good, value).alias("csize"),
        F.when(good, "ok").when(F.col("cell").isNull(), "missing").otherwise(F.col("cell")).alias("status"),
        F.when(good, value / F.col("size") * 8).alias("bits_per_byte"),
    )


def shown(value: Column) -> Column:
    """A size for presentation: infinity where there is none."""
    return F.coalesce(value, F.lit(float("inf")))


def unpivot_parameters(wide: DataFrame, priors: list[str], key: str = "depth") -> DataFrame:
    """(key, prior, alpha, beta, mean_efficiency) from columns ``<prior>_alpha`` and so on."""
    rows = [
        F.struct(F.lit(p).alias("prior"), *(F.col(f"{p}_{c}").cast("double").alias(c) for c in ("alpha", "beta", "mean_efficiency")))
        for p in priors
    ]
    return wide.select(F.col(key), F.explode(F.array(*rows)).alias("x")).select(key, "x.*")


def consolidate(tables: dict[str, DataFrame], key: str = "depth") -> DataFrame:
    """Tables with one key joined side by side, their columns prefixed by name, in order of key."""
    out = None
    for name, t in tables.items():
        part = t.select(key, *(F.col(c).alias(f"{name}_{c}") for c in t.columns if c != key))
        out = part if out is None else out.join(part, key)
    return out.orderBy(key)


def pivot_benchmark(long: DataFrame, algos: list[str], value: str = "csize") -> DataFrame:
    """(file, size, one column for each algorithm)."""
    return long.groupBy("file", "size").pivot("algo", algos).agg(F.first(value, ignorenulls=True))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def corpus_json(long: DataFrame, groups: DataFrame) -> DataFrame:
    """(corpus, json): sizes of each algorithm as lists in the order of the corpus; missing ones say ``fail``."""
    joined = groups.join(long, "file")
    cell = F.coalesce(F.ceil("csize").cast("string"), F.lit('"fail"'))
    lists = joined.groupBy("corpus", "algo").agg(F.array_sort(F.collect_list(F.struct("ord", cell.alias("v")))).alias("rows"))
    text = F.concat(F.lit('"'), F.col("algo"), F.lit('":['), F.array_join(F.transform("rows", lambda r: r["v"]), ","), F.lit("]"))
    return (
        lists.select("corpus", F.struct("algo", text.alias("t")).alias("x"))
        .groupBy("corpus")
        .agg(F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), ","), F.lit("}")).alias("json"))
    )


def javascript(rows: list, name: str = "benchmark_results") -> str:
    """A script that holds the corpora of ``corpus_json``."""
    return f"var {name} = {json.dumps({r['corpus']: json.loads(r['json']) for r in rows}, sort_keys=True)};"


def console(rows: list, value: str = "bits", algos: list[str] | None = None) -> str:
    """A table of results in ``bits`` for each byte, ``per`` cent or ``size``."""
    algos = algos or sorted({r["algo"] for r in rows})
    show = {
        "bits": lambda r: f"{r['csize'] * 8 / r['size']:.3f}",
        "per": lambda r: f"{r['csize'] * 100 / r['size']:.1f}%",
        "size": lambda r: f"{int(r['csize'])}",
    }[value]
    cells: dict[str, dict[str, str]] = {}
    for r in rows:
        cells.setdefault(r["file"], {})[r["algo"]] = "fail" if r["csize"] is None else show(r)
    table = [["file", *algos]] + [[f, *(row.get(a, "") for a in algos)] for f, row in sorted(cells.items())]
    widths = [max(len(line[i]) for line in table) for i in range(len(table[0]))]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(line, widths, strict=True)).rstrip() for line in table)


def latex(rows: list, columns: list[str], best: str | None = None) -> str:
    """A tabular of rows; cells of a true ``best`` column are set bold."""
    body = []
    for r in rows:
        cells = [str(r[c]) for c in columns]
        if best and r[best]:
            cells[-1] = rf"\textbf{{{cells[-1]}}}"
        body.append(" & ".join(cells) + r" \\")
    return "\n".join([rf"\begin{{tabular}}{{{'l' * len(columns)}}}", " & ".join(columns) + r" \\ \hline", *body, r"\end{tabular}"])


def context_dot(edges: list) -> str:
    """Graphviz text of a context tree from rows (ctx, sym, n)."""
    lines = [f'  "{e["ctx"]}" -> "{e["ctx"]},{e["sym"]}" [label="{e["n"]}"];' for e in edges]
    return "\n".join(["digraph contexts {", *lines, "}"])
