"""Run a plan once and go on from reliable storage: fitted parameter tables and reused intermediates.

Tables go to the shared folder the cluster names in `spark.checkpoint.dir`, so a lost executor costs nothing that
was written. Reading them back as parquet gives the optimizer their true size: a small parameter table is broadcast
because it was measured, a large one is shuffled.
"""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    # A single-machine session (tests): one scratch folder per application.
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="run-")
    return _LOCAL[app]


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write the table under the shared folder and return it as a scan."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tarnwatch/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
