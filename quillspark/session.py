"""Making this package importable on executors."""

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors as a zip, once for each application."""
    context, here = spark.sparkContext, os.path.dirname(os.path.abspath(__file__))
    if getattr(context, "_quillspark_shipped", False) or not os.path.isdir(here):
        return spark
    path = os.path.join(tempfile.mkdtemp(prefix="quillspark-"), "quillspark.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("quillspark", os.path.relpath(full, here)))
    context.addPyFile(path)
    context._quillspark_shipped = True
    return spark
