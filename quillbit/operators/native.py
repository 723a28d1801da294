"""PPM, LZW and restaurants over texts in the executors' JVM: ``Kernel.java``, which repeats the Python models bit for bit.

The driver compiles the source with the compiler that Spark brings along (Janino) and adds the
classes as a jar, once for each Spark context. Stacks that the kernel does not know, and
sessions without a JVM at hand, give None: then the Python models code.
"""

from __future__ import annotations

import tempfile
import zipfile
from functools import cache
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillbit.operators import sequential as M
from quillbit.plans.spec import RANDOM_BYTES, ModelSpec, exact

SOURCE = Path(__file__).with_name("Kernel.java")
CLASS = "quillbit.Kernel"
RETURNS = {
    "check": T.StructType([T.StructField("bits", T.LongType()), T.StructField("ideal", T.DoubleType()), T.StructField("same", T.BooleanType())]),
    "score": T.ArrayType(T.StructType([T.StructField(n, t()) for n, t in (("algo", T.StringType), ("replication", T.IntegerType), ("csize", T.LongType), ("bits", T.LongType), ("status", T.StringType),
                                       ("wall", T.DoubleType), ("cpu", T.DoubleType), ("memory", T.LongType), ("grown", T.LongType))])),
    "regions": T.StructType([T.StructField("steps", T.LongType()), T.StructField("inside", T.BooleanType())]),
    "pack": T.BinaryType(), "unpack": T.BinaryType(), "measure": T.LongType(), "entropies": T.ArrayType(T.DoubleType()),
}
#: Longest text, and largest total of a restaurant, in bits.
LENGTH, TOTAL = 31, 62
#: Bases of the kernel, by name: None for even priors, else the ranges whose masses the priors follow.
BASES = {"uniform_byte": None, "uniform_stoken": None, "lzw_byte": None, "polya_byte": None, "polya_stoken": None, "polya_stoken_uniform_byte": RANDOM_BYTES, "polya_stoken_uniform_token": "even"}


@cache
def arguments(spec: ModelSpec) -> tuple[str, ...] | None:
    """What ``Kernel.with`` is told of a stack, after the work. Restaurants are known over uniform tokens of the simple alphabet."""
    stack = spec.build()
    base, top = stack[0], stack[-1]
    if spec.base.name not in BASES or len(stack) > 2:
        return None
    if isinstance(top, M.PPM) and top.special is None:
        kind, layer = "ppm", (top.depth, top.a, top.b, top.unit)
    elif isinstance(top, M.LZW):
        kind, layer, base = "lzw" if top.seeded else "lzwEscape", (0, 0, 0, 1), top.base
    elif isinstance(top, M.CRP) and spec.base.name == "uniform_stoken" and ((top.unit << LENGTH) + abs(top.a)) * base.size < 1 << TOTAL:
        kind, layer = "crp", (0, top.a, top.b, top.unit)
    else:
        return None
    tree, ranges, num, den = isinstance(base, M.PolyaTree), [], 0, 1
    if tree:
        a = exact(spec.base.get("a", "0.5"))
        num, den = a.numerator, a.denominator
        ranges = BASES[spec.base.name] or []
        if ranges == "even":
            ranges = [(0, base.size - 1, 1)]
    return kind, spec.alphabet, *(",".join(map(str, x)) for x in (layer, (base.size, spec.end, int(tree), num, den), [n for r in ranges for n in r]))


#: By Spark context the loader of the compiled class.
_loaders: dict[str, object] = {}


def _loader(sc: SparkContext):
    found = _loaders.get(sc.applicationId)
    if found is None:
        compiler = sc._jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(sc._jvm.java.lang.Thread.currentThread().getContextClassLoader())
        compiler.cook(SOURCE.read_text())
        jar = Path(tempfile.mkdtemp(prefix="quillbit-")) / "quillbit-kernel.jar"
        with zipfile.ZipFile(jar, "w") as z:
            for name, code in dict(compiler.getBytecodes()).items():
                z.writestr(f"{name.replace('.', '/')}.class", bytes(code))
        sc._jsc.addJar(str(jar.resolve()))
        found = _loaders[sc.applicationId] = compiler.getClassLoader()
    return found


def column(data: Column, work: str, spec: ModelSpec, asked: list[int] | None = None, scoring: tuple[str, int, bool] | None = None) -> Column | None:
    """What the kernel says of each value: ``check`` (bits, ideal, same), ``regions`` (steps, inside), ``pack``, ``unpack``, ``measure``,
    ``entropies`` over the symbols ``asked`` for, or ``score`` under a name, so many times, unpacked as well or not (``scoring``)."""
    told, sc = arguments(spec), SparkContext._active_spark_context
    if told is None or sc is None or sc._jvm is None:
        return None
    from pyspark.sql.classic.column import Column as Classic
    from pyspark.sql.classic.column import _to_java_column, _to_seq

    kernel = _loader(sc).loadClass(CLASS).newInstance()
    kernel = getattr(kernel, "with")(work, *told, ",".join(map(str, asked or [])))
    if scoring:
        kernel = kernel.scoring(*scoring)
    returns = sc._jvm.org.apache.spark.sql.types.DataType.fromJson(RETURNS[work].json())
    return Classic(kernel.function(returns).apply(_to_seq(sc, [data.cast("binary")], _to_java_column)))
