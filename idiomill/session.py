"""Session settings and shipping of this package to executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_HERE = os.path.dirname(os.path.abspath(__file__))


def build(master: str = "local[8]", app: str = "idiomill", **conf: str) -> SparkSession:
    """A session with the engine's defaults; conf entries override them."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    return SparkSession.builder.master(master).appName(app).config(map=settings).getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Makes this package importable by Python workers, wherever the driver was started."""
    sc = spark.sparkContext
    if not getattr(sc, "_idiomill_shipped", False):
        path = os.path.join(tempfile.mkdtemp(prefix="idiomill-ship-"), "idiomill.zip")
        root = os.path.dirname(_HERE)
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(_HERE):
                for n in sorted(names):
                    if n.endswith(".py"):
                        full = os.path.join(folder, n)
                        z.write(full, os.path.relpath(full, root))
        sc.addPyFile(path)
        sc._idiomill_shipped = True
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where none is set and the session is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder shared by the cluster")
        folder = getattr(shared_folder, "own", None) or tempfile.mkdtemp(prefix="idiomill-")
        shared_folder.own = folder
    return folder.rstrip("/")


def kept(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read again, so that it is made once."""
    path = f"{shared_folder(df.sparkSession)}/idiomill-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
