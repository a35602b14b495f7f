"""Shared storage: where lineage is cut and intermediate tables live."""

from __future__ import annotations

import gc
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


#: Bytes of a hash join's build side that one partition may hold.
HASH_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; where that is unset, a local one for a local master, else an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = getattr(spark, "_planwise_dir", None)
        if not path and not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not path:
            path = spark._planwise_dir = "file://" + tempfile.mkdtemp(prefix="planwise-")
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, and any executor can be lost afterwards."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._planwise_path = path
    return out


def drop(*frames: DataFrame) -> None:
    """Delete tables that materialize() wrote, once nothing reads them any more."""
    for df in frames:
        path = getattr(df, "_planwise_path", None)
        if path:
            delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def collect(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished queries now: it does so once the driver's JVM has collected the plans that made them.

    What the JVM freed outside its heap (the compilers, ended threads) stays in its allocator, and goes back to the system where the JVM can do that.
    """
    gc.collect()
    jvm, new_array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    jvm.System.gc()
    try:
        kinds, values = new_array(jvm.Class, 4), new_array(jvm.Object, 4)
        for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[i] = jvm.Class.forName(kind)
        values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        jvm.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)
    except Py4JError:  # not this JVM
        pass


def shrink(spark: SparkSession) -> None:
    """Have the executors' JVMs collect their garbage and give the heap that this frees back to the system: else it stays theirs, beside what the next step's Python workers need."""
    n = spark.sparkContext.defaultParallelism  # a task for each core, so each executor has one
    spark.range(0, n, 1, n).selectExpr("java_method('java.lang.System', 'gc')").collect()


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name like `name` that no frame has."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def hash_side(written: DataFrame, row_bytes: int, side: DataFrame | None = None) -> DataFrame:
    """`side`, made of a written table or the table itself, hinted as the build side of a shuffled hash join if a partition's share of the table is small; joins with a larger one sort, and can spill."""
    side, most = written if side is None else side, HASH_BYTES * int(written.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return side.hint("shuffle_hash") if written.count() * row_bytes <= most else side
