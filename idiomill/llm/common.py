"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import gc
import time
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

U64 = np.uint64
MIX_A, MIX_B = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
GOLDEN = U64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables written to the shared folder. They cut lineage and survive lost executors."""

    live: list[Scratch] = []

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/idiomill-{label}-{uuid.uuid4().hex}"
        Scratch.live.append(self)

    def keep(self, df: DataFrame, name: str, **options) -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.options(compression="zstd", **options).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            self._delete(df._scratch_path)

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def release(self) -> None:
        """Lets Spark remove the shuffle files of plans that are no longer referenced."""
        for _ in range(2):  # the gateway tells the JVM of dropped frames up to a second later
            gc.collect()
            self.spark._jvm.System.gc()
            time.sleep(1.1)


@atexit.register
def _remove_scratch() -> None:
    for s in Scratch.live:
        try:
            if s.spark.sparkContext._jsc is not None:
                s._delete(s.root)
        except Exception:  # noqa: BLE001  the JVM may be gone at exit
            continue


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over an array of unsigned integers."""
    x = x ^ (x >> U64(30))
    x = x * MIX_A
    x ^= x >> U64(27)
    x = x * MIX_B
    x ^= x >> U64(31)
    return x


def crc_bucket(column: str, parts: int):
    """crc32 of a column as text, modulo parts."""
    return F.crc32(F.col(column).cast("string")) % parts
