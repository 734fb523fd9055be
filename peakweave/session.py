"""Makes the package importable on executors that did not get it any other way."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package's sources to the executors of this application, once."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).parent
    path = Path(tempfile.mkdtemp()) / "peakweave_package.zip"
    with zipfile.ZipFile(path, "w") as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, Path(root.name) / source.relative_to(root))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)
