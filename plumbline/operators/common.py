"""Checkpoints, and the package itself on the executors."""

from __future__ import annotations

import hashlib
import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once an application, so that their Python workers can import it.

    Needed wherever a kernel of this package runs in Python workers: they may not have it installed.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root, packed = Path(__file__).resolve().parent.parent, io.BytesIO()
    if not root.is_dir():  # already inside a shipped zip
        return
    with zipfile.ZipFile(packed, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.writestr(zipfile.ZipInfo(str(p.relative_to(root.parent))), p.read_bytes())
    name = f"plumbline-{hashlib.sha256(packed.getvalue()).hexdigest()[:12]}.zip"
    path = Path(tempfile.mkdtemp(prefix="plumbline-")) / name
    path.write_bytes(packed.getvalue())
    sc.addPyFile(str(path))
    _shipped[sc.applicationId] = name


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: lineage ends in files that every executor can read.

    The folder is spark.checkpoint.dir of the session; where it is unset, a local session gets a temporary one.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(found or "file://" + tempfile.mkdtemp(prefix="plumbline-"))
    return df.checkpoint(eager=True)
