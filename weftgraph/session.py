"""Session helpers: a local session for tests and benches, and shipping of the package to executors."""

from __future__ import annotations

import io
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from .storage import shared_folder

_shipped: set[str] = set()


def local_session(cpus: int = 8, memory: str = "8g", partitions: int | None = None, name: str = "weftgraph") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, once for each application.

    The package goes to the shared folder as a zip file, from where Spark hands it to the executors.
    """
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root, held = Path(__file__).resolve().parent, io.BytesIO()
        with zipfile.ZipFile(held, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, str(p.relative_to(root.parent)))
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/weftgraph/package-{uuid.uuid4().hex}.zip")
        out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
        out.write(bytearray(held.getvalue()))
        out.close()
        spark.sparkContext.addPyFile(path.toString())
        _shipped.add(app)
    return spark
