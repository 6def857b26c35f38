"""Session helpers: shared scratch folder, lineage cuts, size-checked broadcasts."""

from __future__ import annotations

import atexit
import re
import shutil
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``. Where that is unset, a local session gets a folder of
    its own beside the warehouse, which goes when Python ends; a cluster is refused.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    if sc.getCheckpointDir() is None:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}-scratch/{uuid.uuid4().hex}"
        sc.setCheckpointDir(folder)
        if urlparse(folder).scheme in ("", "file"):
            atexit.register(shutil.rmtree, urlparse(folder).path, ignore_errors=True)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to reliable storage once and continue from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str = "stored") -> DataFrame:
    """Write ``df`` to the shared folder once and go on from there.

    For loops that join: a checkpoint passes on its estimated size, and products of estimates grow without end;
    a stored table has the size it has.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Fix ``df`` in reliable storage and mark it for broadcast only if its row count is bounded.

    Above the bound the unmarked table is returned and the join shuffles as usual.
    """
    fixed = cut(df)
    return F.broadcast(fixed) if fixed.count() <= max_rows else fixed


@contextmanager
def session_options(spark: SparkSession, options: dict[str, str]) -> Iterator[None]:
    """Options that hold inside the block only; afterwards the caller's own are back."""
    before = {k: spark.conf.get(k, None) for k in options}
    try:
        for k, v in options.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
