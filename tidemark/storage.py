"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import io
import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_SENT: set[str] = set()


def shared_dir(spark: SparkSession, kind: str) -> str:
    """A new place in the folder of spark.checkpoint.dir; a temporary one where a local session names none, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not is_local(spark):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        base = _OWN[app]
    return f"{base.rstrip('/')}/tidemark/{kind}-{uuid.uuid4().hex}"


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process."""
    return re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master) is not None


def materialize(df: DataFrame, kind: str = "table") -> DataFrame:
    """Write a result and read it back: it cuts the lineage and survives lost executors."""
    path = shared_dir(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def reach(spark: SparkSession) -> None:
    """Let Python workers import this library, whatever folder they start in.

    On one machine they find it where the driver did; on a cluster its modules go to the executors as an archive.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    context = spark.sparkContext
    if context.master.startswith("local"):
        known = [p for p in context.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
        if root not in known:
            context.environment["PYTHONPATH"] = os.pathsep.join([root, *known])
    elif context.applicationId not in _SENT:
        context.addPyFile(archive(root, shared_dir(spark, "library")))
        _SENT.add(context.applicationId)


def archive(root: str, directory: str) -> str:
    """An archive of the library's modules in a shared folder; returns its address."""
    from pyarrow import fs

    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "tidemark")):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, root))
    address = f"{directory}/tidemark.zip"
    system, path = fs.FileSystem.from_uri(address)
    system.create_dir(os.path.dirname(path), recursive=True)
    with system.open_output_stream(path, compression=None) as out:
        out.write(packed.getvalue())
    return address
