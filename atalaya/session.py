"""Session helpers: a local session for tests, and the package's code on the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent


def local_session(name: str = "atalaya", cores: str = "*") -> SparkSession:
    """A UTC session with adaptive execution and few shuffle partitions."""
    conf = {"spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "6g"}
    return SparkSession.builder.master(f"local[{cores}]").appName(name).config(map=conf).getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the Python workers, unless they find it by PYTHONPATH; once for each Spark context."""
    sc = spark.sparkContext
    on_path = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if str(ROOT) not in on_path and not getattr(sc, "_atalaya_shipped", False):
        to = os.path.join(tempfile.mkdtemp(prefix="spark-code-"), "atalaya_code.zip")
        with zipfile.ZipFile(to, "w") as z:
            for p in sorted((ROOT / "atalaya").rglob("*.py")):
                z.write(p, p.relative_to(ROOT))
        sc.addPyFile(to)
        sc._atalaya_shipped = True
    return spark
