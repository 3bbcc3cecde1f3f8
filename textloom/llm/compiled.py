"""Java sources of this folder as functions of columns, compiled by the driver with the compiler inside Spark (Janino).

The classes go to the executors as a jar, which the driver serves as it serves any jar that is added, so an executor needs
neither a compiler nor a shared folder for them.
"""

from __future__ import annotations

import atexit
import hashlib
import os
import pkgutil
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

#: By application and source: the loader of the classes.
_LOADERS: dict[tuple[str, str], object] = {}


def _loader(spark: SparkSession, name: str):
    key = spark.sparkContext.applicationId, name
    if key not in _LOADERS:
        source, jvm = pkgutil.get_data(__package__, f"{name}.java").decode(), spark._jvm
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(jvm.org.apache.spark.util.Utils.getContextOrSparkClassLoader())
        compiler.cook(source)
        folder = os.path.realpath(tempfile.mkdtemp(prefix="textloom-jar-"))
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        jar = f"{folder}/textloom-{name}-{hashlib.sha256(source.encode()).hexdigest()[:16]}.jar"
        with zipfile.ZipFile(jar, "w") as z:
            for kind, code in compiler.getBytecodes().items():
                z.writestr(f"{kind.replace('.', '/')}.class", bytes(code))
        spark.sparkContext._jsc.addJar(jar)
        _LOADERS[key] = compiler.getClassLoader()
    return _LOADERS[key]


def instance(spark: SparkSession, name: str, part: str):
    """An object of the class `part` within the class `name` of the package textloom."""
    gateway, jvm = spark.sparkContext._gateway, spark._jvm
    kind = _loader(spark, name).loadClass(f"textloom.{name}${part}")
    return kind.getConstructor(gateway.new_array(jvm.java.lang.Class, 0)).newInstance(gateway.new_array(jvm.java.lang.Object, 0))


def function(spark: SparkSession, name: str, part: str, kind: DataType):
    """That object's call() as a function of columns, which gives `kind`. The session knows it as textloom_<name>_<part>."""
    own = f"textloom_{name}_{part}".lower()
    _loader(spark, name)
    if not spark.catalog.functionExists(own):
        spark._jsparkSession.udf().register(own, instance(spark, name, part), spark._jsparkSession.parseDataType(kind.json()))
    return lambda *columns: F.call_function(own, *columns)
