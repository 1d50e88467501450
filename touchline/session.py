"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folder of a local session that names none, by application.
_PRIVATE: dict[str, str] = {}


def build_session(app_name: str = "touchline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on; a cluster may override any of them."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a written table in the shared folder.

    Parquet keeps later reads to the columns they need, and lost executors re-read files instead of
    computing the plan again.
    """
    folder = f"{shared_folder(df.sparkSession, 'table')}/rows"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with more columns, each computed once a row however often it is used.

    A plain projection is written into every rule that reads it; a row generator of one row is not.
    """
    return df.select("*", F.inline(F.array(F.struct(*[value.alias(name) for name, value in columns.items()]))))


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt by ``key`` over all tasks, before work that is heavy for the few bytes of a row.

    A small file is one task, whatever its rows cost; a number of parts keeps small ones from being put together.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for written tables, inside the shared checkpoint folder that the session names.

    Only a session whose executors are threads of the driver may go without one: there a private
    temporary folder is chosen and set. On a cluster an unset folder is an error, since every executor
    would write to its own disk and the tables would be read back in part.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or _PRIVATE.get(spark.sparkContext.applicationId)
    if shared is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = _PRIVATE[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="spark-tables-")
    return f"{shared.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
