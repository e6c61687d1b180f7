"""Ratcliff-Obershelp ratio of two texts, for which Spark has no expression: a JVM function, so that texts don't go to Python.

SequenceRatio.java beside this file is compiled by Janino, which Spark itself compiles its plans with, and sent to the
executors as a jar by Spark; nobody needs a JDK.
"""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

SOURCE = Path(__file__).with_name("SequenceRatio.java")
NAME, CLASS = "kinmatch_sequence_ratio", "kinmatch.SequenceRatio"
_known: set[tuple[str, str]] = set()


def _jar(spark: SparkSession) -> str:
    compiler = spark._jvm.org.codehaus.janino.SimpleCompiler()
    compiler.setParentClassLoader(spark._jvm.java.lang.Thread.currentThread().getContextClassLoader())
    compiler.cook(SOURCE.read_text())
    at = f"{tempfile.mkdtemp(prefix='kinmatch-')}/kinmatch-sequence.jar"
    with zipfile.ZipFile(at, "w") as jar:
        for name, code in sorted(dict(compiler.getBytecodes()).items()):
            jar.writestr(f"{name.replace('.', '/')}.class", bytes(code))
    return at


def ratio(spark: SparkSession, left: Column, right: Column) -> Column:
    """SequenceMatcher(None, left, right).ratio(), with its heuristic for long texts on; null where one is null."""
    key = (spark.sparkContext.applicationId, spark._jsparkSession.sessionUUID())
    if key not in _known:
        jar, gateway = _jar(spark), spark.sparkContext._gateway
        spark.sql(f"ADD JAR '{jar}'")
        # registerJavaFunction() asks for a generic signature, which Janino doesn't write; so an instance is registered.
        urls = gateway.new_array(gateway.jvm.java.net.URL, 1)
        urls[0] = gateway.jvm.java.io.File(jar).toURI().toURL()
        loader = gateway.jvm.java.net.URLClassLoader(urls, gateway.jvm.java.lang.Thread.currentThread().getContextClassLoader())
        double = spark._jsparkSession.parseDataType(DoubleType().json())
        spark._jsparkSession.udf().register(NAME, loader.loadClass(CLASS).newInstance(), double)
        _known.add(key)
    return F.call_function(NAME, left, right)
