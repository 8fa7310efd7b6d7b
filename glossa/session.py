"""Session helpers."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def _put(spark: SparkSession, data: bytes) -> str:
    """The URI of a new file with data: in the folder of spark.checkpoint.dir, or, where that is unset, in a temporary one of the driver's."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = Path(tempfile.mkdtemp(prefix="glossa-code-")) / "glossa.zip"
        path.write_bytes(data)
        return str(path)
    name = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared.rstrip('/')}/code-{uuid.uuid4().hex}/glossa.zip")
    stream = name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(name)
    stream.write(bytearray(data))
    stream.close()
    return str(name)


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package's code to the Python workers, once for each application, and bounds the batches that they get."""
    sc = spark.sparkContext
    if spark.conf.get(_BATCH) == "67108864b":  # Spark's own default: texts and media come many megabytes a batch, and are held more than once
        spark.conf.set(_BATCH, "16m")
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        buf = io.BytesIO()
        with zipfile.ZipFile(buf, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, str(p.relative_to(root.parent)))
        sc.addPyFile(_put(spark, buf.getvalue()))
        _shipped.add(sc.applicationId)
    return spark
