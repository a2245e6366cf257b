"""Sessions and the package's way to the executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

HERE = Path(__file__).resolve().parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per application, so Python workers can import it wherever they run."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="starloom-code-")
    atexit.register(shutil.rmtree, folder, True)
    path = Path(folder) / "starloom.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(HERE.rglob("*.py")):
            z.write(f, f.relative_to(HERE.parent))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)


def session(name: str = "starloom", cores: int | str = "*", partitions: int | None = None, **conf: str) -> SparkSession:
    """A local session with the settings that the queries expect; on a cluster pass your own session instead."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.adaptive.enabled", "true")
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
