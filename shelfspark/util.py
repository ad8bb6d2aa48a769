"""Small helpers shared by the operators: tables, shared folder, hot keys, blanks."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: White space of any kind (no-break spaces included), U+200B and U+FEFF, as a regular expression class.
BLANK = r"[\s\p{Z}\x{85}\x{1c}-\x{1f}\x{200B}\x{FEFF}]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test table."""
    return spread_rows(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def spread_rows(df: DataFrame, least: int = 1 << 20) -> DataFrame:
    """Rows over all cores, where a scan can't spread them: a file of a single row group is read by one task, and so would
    be all work on its texts. A table of fewer bytes than `least`, or of as many parts as there are cores, stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution()
    if int(plan.optimizedPlan().stats().sizeInBytes()) < least or df._jdf.rdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or, on a local master only, a temporary one."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="shelfspark-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_WRITTEN: list[tuple[SparkSession, str]] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a table in the shared folder: later stages read files, not lost shuffle blocks.

    The table is removed when the program ends, or by `clear_written`.
    """
    path = fresh_dir(df.sparkSession, name)
    df.write.parquet(path)
    _WRITTEN.append((df.sparkSession, path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_written() -> None:
    """Remove the tables `written` made so far: no result that reads them is needed any more."""
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session has ended; the folder is its owner's to clean
            pass


atexit.register(clear_written)


_BLANKS = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200C))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def strip_blank(c: Column) -> Column:
    """Without outer blanks (see BLANK)."""
    return F.btrim(c, F.lit(_BLANKS))


def is_blank(c: Column) -> Column:
    """True for a text without any character but blanks; null stays null."""
    return ~c.rlike(f"[^{BLANK[1:-1]}]")


def hot_keys(df: DataFrame, keys: Sequence[str], share: float = 1 / 512, least: int = 10_000) -> DataFrame:
    """Keys that hold at least `share` of the rows (and `least` rows): never more than 1/share of them.

    Counts are combined on the map side. The result is small whatever the data: that bound is what
    makes it safe to broadcast.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = df.agg(F.count(F.lit(1)).alias("_all"))
    return (
        counts.crossJoin(F.broadcast(total))  # one row on the right
        .filter((F.col("_n") >= least) & (F.col("_n") >= F.col("_all") * F.lit(share)))
        .select(*keys)
    )


def salted(df: DataFrame, hot: DataFrame, keys: Sequence[str], by: Column, salts: int) -> DataFrame:
    """`_salt`: 0, or for rows of hot keys one of `salts` values that follows `by`."""
    marked = df.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), list(keys), "left")
    return marked.withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(by), F.lit(salts))).otherwise(F.lit(0)).cast("int")).drop("_hot")


def replicated(df: DataFrame, hot: DataFrame, keys: Sequence[str], salts: int) -> DataFrame:
    """The other side of `salted`: rows of hot keys once for each salt."""
    marked = df.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), list(keys), "left")
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return marked.withColumn("_salt", F.explode(every)).drop("_hot")


def bounded_sample(df: DataFrame, id_col: str, n: int) -> DataFrame:
    """Rows of the (at most) n ids with the smallest hash, one row for each id.

    Only hashes are ranked, n of them for each task, before the rows themselves are read; so what moves is
    bounded by n whatever the size of the rows, the table, or the number of copies of an id.
    """
    h = F.xxhash64(F.col(id_col))
    last = df.select(h.alias("h")).distinct().orderBy("h").limit(n).agg(F.max("h").alias("h")).first().h
    return df.filter(h <= F.lit(last)).dropDuplicates([id_col]) if last is not None else df.limit(0)


def numbered(rows: DataFrame, key: str, order: list[Column], bucket: Column, name: str) -> DataFrame:
    """`name`: 1.. for the rows of each key by bucket and order, without a task ever holding a whole key.

    bucket must rise with the order. Rows are numbered within (key, bucket); the offset of a bucket is the
    sum of the counts of those before it, one small row each.
    """
    b = rows.withColumn("_b", bucket)
    inner = b.withColumn("_n", F.row_number().over(W.partitionBy(key, "_b").orderBy(*order)))
    counts = b.groupBy(key, "_b").agg(F.count(F.lit(1)).alias("_c"))
    before = W.partitionBy(key).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(F.col(key).alias("_k"), F.col("_b").alias("_kb"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"))
    joined = inner.join(offsets, F.col(key).eqNullSafe(F.col("_k")) & F.col("_b").eqNullSafe(F.col("_kb")), "left")
    return joined.withColumn(name, (F.col("_n") + F.col("_o")).cast("int")).drop("_b", "_n", "_o", "_k", "_kb")


def ranked(df: DataFrame, order: list[Column], name: str, first: int = 1) -> DataFrame:
    """`name`: first.. by `order` over all rows, without one task ever holding them.

    Rows are sorted by range and written; each part's count, one small row each, gives the next part its first number.
    """
    k = (F.monotonically_increasing_id() % (1 << 33)).alias("_k")
    rows = written(df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_part"), k), "ranked")
    starts, at = [], first
    for part, n in sorted((r["_part"], r["n"]) for r in rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()):  # a row for each part
        starts.append((part, at))
        at += n
    offsets = df.sparkSession.createDataFrame(starts, "_part int, _first long")
    return rows.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_first") + F.col("_k")).drop("_part", "_first", "_k")
