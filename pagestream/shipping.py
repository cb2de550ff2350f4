"""Makes the package importable in the Python workers, wherever the driver found it."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_DONE: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once per application."""
    context = spark.sparkContext
    if context.applicationId in _DONE:
        return
    _DONE.add(context.applicationId)
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="pagestream-"), "pagestream_sources.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for p in sorted(root.rglob("*.py")):
            out.write(p, f"{root.name}/{p.relative_to(root)}")
    context.addPyFile(target)


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder that all nodes share, below spark.checkpoint.dir; a local one only if that is unset and all runs in this process."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.gettempdir()
    return f"{where.rstrip('/')}/{label}-{uuid.uuid4().hex}"
