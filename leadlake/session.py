"""Session construction and shipping of this package to executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build(app: str = "leadlake", master: str | None = None, partitions: int = 8) -> SparkSession:
    """A session with the settings the plans assume: UTC, adaptive execution, Arrow."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    return (
        b.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir; its own only in local mode where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    base = f"file://{tempfile.mkdtemp(prefix='leadlake-shared-')}"
    spark.sparkContext.setCheckpointDir(base)
    return base


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: the lineage ends here."""
    path = f"{shared_dir(df.sparkSession)}/leadlake-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


#: Rows of a batch that goes to Python: whole texts travel, so Spark's own 10,000 would keep much memory on both sides.
BATCH_ROWS = 2500


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once for each application, for Python workers that can't import it; batches of texts are kept small."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="leadlake-"), "leadlake_pkg.zip")
    with zipfile.ZipFile(out, "w") as z:
        for at, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    p = os.path.join(at, n)
                    z.write(p, os.path.join("leadlake", os.path.relpath(p, root)))
    spark.sparkContext.addPyFile(out)
    _SHIPPED.add(app)
