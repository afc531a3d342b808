"""What a session needs before Python workers can run this package, and how it is set up."""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.storagelevel import StorageLevel

from .errors import CubeError


def reachable(spark: SparkSession) -> SparkSession:
    """Lets workers import this package from where the driver has it.

    On a cluster the package is installed or shipped (``--py-files``) as usual; this adds the
    driver's own folder for sessions that were started elsewhere on the same machine.
    """
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    return spark


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder name under spark.checkpoint.dir, which driver and executors share.

    Where the setting is missing, a folder of this machine is taken if Spark runs on this machine
    alone (tests); on a cluster it raises, since a folder there is another one on every machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            root = found.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            root = "file:///tmp/checkpoints"
        else:
            raise CubeError("invalid_argument", "set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"


@dataclass(frozen=True)
class Context:
    """How much a session may use: cores that read and decode, and bytes of decoded pixels that are kept (0: none are)."""

    cache_bytes: int = 0
    io_threads: int = 0
    decode_threads: int = 0

    def __post_init__(self):
        if min(self.cache_bytes, self.io_threads, self.decode_threads) < 0:
            raise CubeError("invalid_argument", f"negative limits: {self}")

    def settings(self) -> dict[str, str]:
        """Session settings.  A task reads and decodes in one thread, so cores are the larger of the two counts; kept pixels lie in storage memory."""
        cores = max(self.io_threads, self.decode_threads)
        out = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(1 << 18)}
        if cores:
            out |= {"spark.master": f"local[{cores}]", "spark.default.parallelism": str(cores), "spark.sql.shuffle.partitions": str(cores)}
        if self.cache_bytes:
            # Half of the heap that is not reserved is storage, so the heap is taken for four times what is kept.
            out["spark.driver.memory"] = f"{max(1024, 4 * self.cache_bytes >> 20)}m"
        return out

    def builder(self):
        made = SparkSession.builder
        for k, v in self.settings().items():
            made = made.config(k, v)
        return made

    @property
    def storage(self) -> StorageLevel | None:
        """Where decoded pixels are kept, if they are."""
        return StorageLevel.MEMORY_AND_DISK if self.cache_bytes else None
