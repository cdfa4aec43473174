"""What a session needs before Python runs on its executors."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a fresh local one, for a session in one process only."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        where = _local_dirs.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="spark-shared-")
        _local_dirs[spark.sparkContext.applicationId] = where
    return where.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for an application: they need no copy of their own."""
    sc = spark.sparkContext
    root = Path(__file__).resolve().parent.parent
    if sc.applicationId in _shipped or not (root / "rosterlake").is_dir():
        return
    _shipped.add(sc.applicationId)
    packed = Path(tempfile.mkdtemp(prefix="rosterlake-")) / "rosterlake.zip"
    with zipfile.ZipFile(packed, "w") as z:
        for p in sorted((root / "rosterlake").rglob("*.py")):
            z.write(p, p.relative_to(root))
    sc.addPyFile(str(packed))
