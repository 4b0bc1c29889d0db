"""Sessions, and tables in the folder that all machines share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "4g", **conf: str) -> SparkSession:
    """A session for tests and single machines; on a cluster, bring your own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("scoreweave")
    own = {
        "spark.sql.shuffle.partitions": str(partitions), "spark.sql.session.timeZone": "UTC", "spark.driver.memory": memory,
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.adaptive.enabled": "true",
    }
    for k, v in (own | conf).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir; where unset, a temporary one in
    local mode and the warehouse otherwise."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told
    if spark.sparkContext.master.startswith("local["):
        told = tempfile.mkdtemp(prefix="scoreweave-")
        atexit.register(shutil.rmtree, told, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", told)
        return told
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"


#: Rows of an Arrow batch while a table is written; rows may hold long texts, and a batch is in memory two or three times.
BATCH_ROWS = "1000"


#: Whether Spark removes a write's shuffle files as it ends. By default they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The folder of each settled table that is still held.
_folders: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def settle(df: DataFrame, name: str, codec: str | None = None, level: int | None = None, tidy: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and a lost executor costs nothing of it. codec: how to compress
    it, if not as the session does; level: of zstd, if not Parquet's. tidy: shuffle files of the write go with its end."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    own = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS} | ({CLEANUP: "true"} if tidy else {})
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        told = {"compression": codec, "parquet.compression.codec.zstd.level": level}
        df.write.options(**{k: v for k, v in told.items() if v is not None}).parquet(path)
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    _folders[out] = path
    return out


def forget(*tables: DataFrame) -> None:
    """Remove settled tables. Whatever was made of them must be settled itself by now."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(_folders.pop(table))
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
