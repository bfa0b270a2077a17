"""Sessions, table loading and the shared work folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, app: str = "lacuna", **conf: str) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, with timestamps as session timestamps."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders of local sessions that name none.
_LOCAL: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir where it is set, else a local one (tests only)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rsplit("/", 1)[0]
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="lacuna-")
        atexit.register(shutil.rmtree, _LOCAL[app][7:], ignore_errors=True)
    return _LOCAL[app]


class WorkDir:
    """A folder of this run's intermediate tables, in the shared folder. Reading a saved table back cuts the lineage, and the
    files outlive any executor."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.path = f"{shared_root(spark)}/lacuna-{label}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        self.tables: list[str] = []
        atexit.register(self.remove)

    def place(self, name: str) -> str:
        self._n += 1
        return f"{self.path}/{self._n:04d}-{name}"

    def save(self, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        at = self.place(name)
        w = df.write.mode("overwrite")
        (w.partitionBy(partition_by) if partition_by else w).parquet(at)
        # the schema is given, as a table without rows has no file to take it from
        return self.spark.read.schema(df.schema).parquet(at)

    def sorted_run(self, df: DataFrame, name: str, keys: list[str], buckets: int) -> DataFrame:
        """Saved in sorted buckets by the hash of the keys, so that joins on them need no shuffle of this side. df is to be
        hashed by the keys into as many partitions, so that each task writes one bucket."""
        at, tab = self.place(name), f"lacuna_{uuid.uuid4().hex[:12]}"
        df.write.mode("overwrite").option("path", at).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(tab)
        self.tables.append(tab)
        return self.spark.table(tab)

    def remove(self) -> None:
        """Deletes the folder; used when its results are no longer read, and at exit."""
        try:
            for t in self.tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {t}")
            jvm = self.spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(self.path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended
            if self.path.startswith("file://"):
                shutil.rmtree(self.path[7:], ignore_errors=True)


def default_tokenizer(name: str = "byte_bpe_50k.json") -> str:
    """Where the public tokenizers' files are; callers may give any other path."""
    return os.path.join(os.environ.get("LACUNA_TOKENIZERS", "/opt/tokenizers"), name)
