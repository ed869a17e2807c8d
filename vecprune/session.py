"""What a session needs before the operators with Python kernels can run on executors."""

from __future__ import annotations

import pathlib
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application.

    Not needed where the package is installed on every node or passed with ``--py-files``.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = pathlib.Path(__file__).resolve().parent
    archive = pathlib.Path(tempfile.mkdtemp(prefix="vecprune-pkg-")) / "vecprune.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, pathlib.Path(package.name) / source.relative_to(package))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)
