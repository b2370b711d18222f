"""Kernels that run inside the JVM: Java sources of this subpackage, compiled when first needed.

Chains of decisions that depend on each other (range coding, splitting) have no form as array operations. Their Java sources are compiled
by Janino, the compiler that Spark itself uses for generated code, packed to a jar in the shared folder, and given to Spark, which hands
the jar to every executor. Kernels are functions of one row; Split may share a dictionary between the rows of a task, which its reader checks.
"""

from __future__ import annotations

import io
import zipfile
from pathlib import Path

from py4j.java_gateway import JavaObject
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from memloom.llm.common import scratch

_PACKAGE = "memloom.kernel"
#: Applications whose executors have the jar.
_LOADED: set[str] = set()


def _jar(spark: SparkSession) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(Path(__file__).with_name("java").glob("*.java")):
            compiler = spark.sparkContext._jvm.org.codehaus.janino.SimpleCompiler()
            compiler.cook(source.read_text())
            found = compiler.getBytecodes()
            for name in found.keySet():
                z.writestr(name.replace(".", "/") + ".class", bytes(found.get(name)))
    return out.getvalue()


def _class(spark: SparkSession, name: str) -> JavaObject:
    """The class, known to the driver and to the executors."""
    sc = spark.sparkContext
    if sc.applicationId not in _LOADED:
        to = scratch(spark, "kernels") + ".jar"
        p = sc._jvm.org.apache.hadoop.fs.Path(to)
        f = p.getFileSystem(sc._jsc.hadoopConfiguration()).create(p)
        f.write(_jar(spark))
        f.close()
        spark.sql(f"ADD JAR '{to}'")
        _LOADED.add(sc.applicationId)
    return spark._jsparkSession.sharedState().jarClassLoader().loadClass(f"{_PACKAGE}.{name}")


def _function(spark: SparkSession, name: str, kernel: str, *args: object) -> str:
    """Register a kernel made with the arguments as a function from binary to binary."""
    sc = spark.sparkContext
    made = _class(spark, kernel).getConstructors()[0]
    given = sc._gateway.new_array(sc._jvm.java.lang.Object, len(args))
    for k, a in enumerate(args):
        given[k] = a
    spark._jsparkSession.udf().register(name, made.newInstance(given), sc._jvm.org.apache.spark.sql.types.DataType.fromJson('"binary"'))
    return name


def split(spark: SparkSession, text: Column, classes: str, special: list[str], remembers: bool = False) -> Column:
    """The pre-tokens of a text; see Split.java for the bytes that it gives, and splitter.unpacked for reading them.

    remembers: the texts of a task share a dictionary; the rows must reach their reader in order, next in the same task.
    """
    name = _function(spark, "memloom_split_on" if remembers else "memloom_split", "Split", classes, "\n".join(s.encode().hex() for s in special), remembers)
    return F.call_function(name, F.coalesce(text.cast("binary"), F.lit(b"")))


def coded(spark: SparkSession, one: Column, n: Column, two: Column, m: Column, bits: Column) -> Column:
    """n ids and m ids, as Coder.java has them, to two coded blocks; the second may be null."""
    return F.call_function(_function(spark, "memloom_code", "Coder", False), one, n, two, m, bits)


def decoded(spark: SparkSession, one: Column, n: Column, two: Column, m: Column, bits: Column) -> Column:
    """The n ids and m ids of two coded blocks."""
    return F.call_function(_function(spark, "memloom_decode", "Coder", True), one, n, two, m, bits)
