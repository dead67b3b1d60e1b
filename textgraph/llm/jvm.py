"""Functions that run in the JVM: Java sources of this package, compiled in the session with Spark's own compiler.

What steps through values one by one has no vectorised form.  Such a loop is a Java file beside this module.  It is
compiled by Janino, which Spark itself uses for generated code, put into a jar in the shared folder, sent to the
executors as any jar of a session, and called as a SQL function over binary columns.
"""

from __future__ import annotations

import io
import os
import zipfile

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from textgraph.llm import files
from textgraph.llm.common import work_dir

_HERE = os.path.join(os.path.dirname(os.path.abspath(__file__)), "java")
_LOADED: dict[tuple[str, str], object] = {}


def _loader(spark: SparkSession, name: str):
    """A class loader with the classes of java/<name>.java; executors get them as a jar, once in an application."""
    key = spark.sparkContext.applicationId, name
    if key not in _LOADED:
        with open(os.path.join(_HERE, f"{name}.java"), encoding="utf-8") as f:
            source = f.read()
        compiler = spark._jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(spark._jvm.java.lang.Thread.currentThread().getContextClassLoader())
        compiler.cook(source)
        classes = compiler.getBytecodes()
        jar = io.BytesIO()
        with zipfile.ZipFile(jar, "w") as z:
            for cls in sorted(classes):
                z.writestr(cls.replace(".", "/") + ".class", bytes(classes[cls]))
        uri = f"{work_dir(spark, 'classes')}/{name}.jar"
        files.put(uri, jar.getvalue())
        spark.sparkContext._jsc.addJar(uri)
        _LOADED[key] = compiler.getClassLoader()
    return _LOADED[key]


def function(spark: SparkSession, source: str, cls: str, returns: DataType, *columns: Column) -> Column:
    """The function that class ``cls`` of java/<source>.java is, applied to columns; it is pure, and null for null."""
    name = f"jvm_{source}_{cls}".lower()
    instance = _loader(spark, source).loadClass(f"textgraph.{source}${cls}").getDeclaredConstructors()[0].newInstance(spark.sparkContext._gateway.new_array(spark._jvm.java.lang.Object, 0))
    spark._jsparkSession.udf().register(name, instance, spark._jsparkSession.parseDataType(returns.json()))
    return F.call_function(name, *columns)
