"""Counts of adaptive models as tables: kept as Parquet, read back, and drawn as trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillbit.operators.sequential import CRP, PPM, Context

SCHEMA = "context array<int>, sym int, n long"


def _contexts(model) -> list[tuple[list[int], dict[int, int]]]:
    """(context, counts); the context's last symbol is the nearest one."""
    if isinstance(model, CRP):
        return [([], model.counts)]
    out, todo = [], [([], model.root)]
    while todo:
        path, node = todo.pop()
        out.append((path, node.counts))
        todo += [([*path, x], child) for x, child in node.deeper.items()]
    return out


def counts(spark: SparkSession, model) -> DataFrame:
    """(context, sym, n) of a restaurant or a context model, in the order in which symbols were met."""
    rows = [(path, x, n) for path, found in _contexts(model) for x, n in found.items()]
    return spark.createDataFrame(rows, SCHEMA).coalesce(1)


def edges(table: DataFrame) -> DataFrame:
    """(ctx, sym, n) of a tree of contexts, as ``quillbit.sources.tables.context_dot`` draws it."""
    return table.selectExpr("array_join(context, ',') AS ctx", "sym", "n").orderBy("ctx", "sym")


def restore(table: DataFrame, model):
    """Counts back into an empty model of the same kind, which then goes on as the one that was kept; a context model
    starts anew at its root."""
    for row in table.toLocalIterator():
        if isinstance(model, CRP):
            model.counts[row["sym"]] = row["n"]
            model.n += row["n"]
            continue
        node = _context(model, row["context"])
        node.counts[row["sym"]] = row["n"]
        node.n += row["n"]
    return model


def _context(model: PPM, path: list[int]) -> Context:
    node = model.root
    for depth, x in enumerate(path):
        if x not in node.deeper:
            node.deeper[x] = Context(_context(model, path[1 : depth + 1]))
        node = node.deeper[x]
    return node
