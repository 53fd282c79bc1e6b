"""Where jobs keep the tables they share: the folder the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from threading import Lock

from pyspark.sql import SparkSession


_own: dict[str, str] = {}

#: Spark's own size of a task's input and the one that wide lines need: 128 MB of a compressed, narrow scan or 64 MB of a shuffle
#: are gigabytes of rows once they are widened, which a task's share of memory cannot sort.
TASK_INPUT = {
    "spark.sql.files.maxPartitionBytes": ("134217728b", "16m"),
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": ("67108864b", "32m"),
}
#: HotSpot does not compile methods of 8,000 bytes or more. Spark runs a stage with such a method as generated, so that it is interpreted
#: for every row; under this limit it runs the stage operator by operator, in methods that it keeps short.
METHOD_BYTES = ("spark.sql.codegen.hugeMethodLimit", "65535", "8000")
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_writing: Counter[str] = Counter()
_before: dict[str, str] = {}
_lock = Lock()


def bounded_tasks(spark: SparkSession) -> None:
    """Bound what one task reads and the length of generated methods, where the session still has Spark's defaults; what somebody has
    set stays."""
    method, *lengths = METHOD_BYTES
    for key, (default, bounded) in (TASK_INPUT | {method: lengths}).items():
        if spark.conf.get(key) == default:
            spark.conf.set(key, bounded)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the writes inside go when each has ended. Otherwise they stay until the driver collects garbage, and a
    job of many steps holds the shuffles of all of them on disk. Writes of several threads may overlap."""
    application = spark.sparkContext.applicationId
    with _lock:
        if not _writing[application]:
            _before[application] = spark.conf.get(SHUFFLE_CLEANUP)
        _writing[application] += 1
        spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            _writing[application] -= 1
            if not _writing[application]:
                spark.conf.set(SHUFFLE_CLEANUP, _before[application])


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only in local mode, where driver and executors are one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    application = spark.sparkContext.applicationId
    if application not in _own:
        _own[application] = tempfile.mkdtemp(prefix="bazaar-")
    return _own[application]


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder that nothing else uses."""
    return f"{shared_folder(spark)}/bazaar/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
