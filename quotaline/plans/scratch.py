"""Where jobs put intermediate tables, and how these go again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

from quotaline.sinks import folders

_own: list[str] = []
_made: list[str] = []


def _local_root() -> str:
    """One folder of this machine for the process, removed when it ends."""
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="quotaline-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return _own[0]


def scratch_folder(spark: SparkSession, label: str, root: str | None = None) -> str:
    """A fresh folder under ``root``, or else under the shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of this machine.
    """
    root = root or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        root = _local_root()
    _made.append(f"{root.rstrip('/')}/quotaline/{label}-{uuid.uuid4().hex}")
    return _made[-1]


def discard(spark: SparkSession) -> None:
    """Remove all scratch folders of this process. Frames that read them can no longer be used."""
    while _made:
        folders.remove(spark, _made.pop())
