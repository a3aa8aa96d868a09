"""Session settings and the folder used to cut lineage."""

import os
import tempfile
import uuid
from contextvars import ContextVar

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def build(app="groundwork", cores=None, **conf):
    """A session with the settings the plans assume; extra settings win."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Split a hot key even when the split costs one more exchange downstream.
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    settings.update(conf)
    builder = SparkSession.builder.appName(app)
    if cores:
        builder = builder.master(f"local[{cores}]")
        settings.setdefault("spark.sql.shuffle.partitions", str(cores))
        # Rows are cheap to move and costly to read: on one machine small shuffles are split among all cores.
        settings.setdefault("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        settings.setdefault("spark.driver.memory", os.environ.get("GROUNDWORK_DRIVER_MEMORY", "8g"))
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark):
    """Use the shared folder the cluster names; only a local session gets its own."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        context.setCheckpointDir(named)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="groundwork-checkpoint-"))
    else:
        raise RuntimeError("Set spark.checkpoint.dir to a folder every executor can reach.")


#: Bytes of a staged table that ``in_slices`` works on at a time.
SLICE_BYTES = 1 << 30

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_made = ContextVar("paths staged since settled() began", default=None)


def _fresh(spark):
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/stage-{uuid.uuid4().hex}"


def _store(spark, path):
    """Path and file system as Hadoop knows them, since the folder may lie in any store."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def stage(rows, path=None):
    """Rows written once as Parquet in the shared checkpoint folder, for tables several steps read.

    One write spares each reader the whole computation, and readers still take only
    the columns they need. Lost executors do not matter, since the files are not
    theirs, and the known size lets Spark choose joins. Shuffles of the write go when
    it ends: nothing reads them again. ``path`` names a staged table to append to.
    """
    spark = rows.sparkSession
    path = path or _fresh(spark)
    if _made.get() is not None:
        _made.get().append(path)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        rows.write.mode("append").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(rows.schema).parquet(path)


def settled(make, path=None):
    """Stage the table ``make()`` returns and delete those staged on the way to it.

    Only for a ``make`` that gives away none of its tables but the one it returns.
    """
    token = _made.set([])
    try:
        rows, spent = make(), _made.get()
    finally:
        _made.reset(token)
    kept = stage(rows, path)
    for gone in spent:
        at, store = _store(rows.sparkSession, gone)
        store.delete(at, True)
    return kept


def in_slices(work, key, *tables, most=None):
    """``work(*tables)``, done for some keys after others where the first, a staged table, has more than ``most`` bytes.

    For work that treats every value of ``key`` by itself. A slice holds the keys of one remainder of a hash, and
    its result is appended to a staged table; its shuffles and the tables staged for it are then gone, so
    only a slice of them is on disk at any time. Every row of every table is in one slice.
    """
    spark = tables[0].sparkSession
    folders = {file.rpartition("/")[0] for file in tables[0].inputFiles()}
    found = [_store(spark, folder) for folder in folders]
    n = -(-sum(store.getContentSummary(at).getLength() for at, store in found) // (most or SLICE_BYTES))
    if n <= 1:
        return work(*tables)
    path = _fresh(spark)
    for k in range(n):
        rows = settled(lambda: work(*[t.filter(F.pmod(F.xxhash64(key), F.lit(n)) == k) for t in tables]), path)
    return rows
