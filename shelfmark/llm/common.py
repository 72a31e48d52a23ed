"""Shared building blocks of the training-data operators.

Everything here is DataFrame-native.  Three rules recur:

* lineage is cut by writing a table to the folder that the session names in
  ``spark.checkpoint.dir`` (never ``localCheckpoint``), so a lost executor costs a re-read;
* a side is broadcast only when its size has a bound that does not depend on the data
  (``HOT_KEYS`` rows, or a bitmap of ``FILTER_BITS`` bits);
* a hot key is spread over ``SPREAD`` salts instead of landing in one task.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.tables import scratch, staged

__all__ = ["col", "discard", "free_shuffles", "global_rank", "located", "members_bitmap", "scratch", "spread_join", "staged", "text_or_empty", "with_maybe", "without"]

#: A group is hot when it holds more than one row in this many, so at most this many are hot.
HOT_KEYS = 1000
#: Number of salts over which the rows of a hot group are spread.
SPREAD = 64
#: Bits of the membership bitmap (4 MB as broadcast, whatever the size of the data).
FILTER_BITS = 1 << 25

#: Plan nodes above a scan through which a row's address stays that of one row.
PLAIN = ("Project", "Filter", "SubqueryAlias")


def col(name: str) -> Column:
    """The column of that very name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_plain_scan(docs: DataFrame) -> bool:
    """Whether ``docs`` is a scan of files with filters and projections at most, in a format whose
    rows have an index (of Spark's own formats only Parquet)."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in PLAIN:
        plan = plan.child()
    if plan.nodeName() != "LogicalRelation":
        return False
    try:
        metadata = docs.select(docs.metadataColumn("_metadata")).schema[0].dataType
    except AnalysisException:  # no files behind the relation (JDBC)
        return False
    return "row_index" in metadata.names


def located(docs: DataFrame, **cols: Column) -> DataFrame:
    """Columns ``all`` (a struct of the columns of ``docs``), those asked for, and a stable row
    address: ``file`` and ``row`` (its index in the file).

    The names of ``docs`` can't clash with others, since they are inside ``all``.  A DataFrame
    that is not a plain scan of files has no address; it is staged first.
    """
    wanted = [F.struct(*[col(c) for c in docs.columns]).alias("all"), *[c.alias(n) for n, c in cols.items()]]
    if not is_plain_scan(docs):
        docs, wanted = staged(docs.select(*wanted), "rows"), ["*"]
    at = docs.metadataColumn("_metadata")
    return docs.select(*wanted, at["file_path"].alias("file"), at["row_index"].alias("row"))


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that no later step reads."""
    for table in tables:
        spark, files = table.sparkSession, table.inputFiles()
        if files:
            path = spark._jvm.org.apache.hadoop.fs.Path(files[0].rpartition("/")[0])
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of queries that have ended.

    Its cleaner deletes them once the driver's garbage collector has found their plans, which on a
    driver with memory to spare may be long after; operators that shuffle several times their input
    call this between their staged tables.  Shuffles that a plan still refers to stay.
    """
    spark._jvm.System.gc()


def text_or_empty(text_col: str) -> Column:
    return F.coalesce(col(text_col).cast("string"), F.lit(""))


def members_bitmap(keys: DataFrame, *cols: str) -> DataFrame:
    """Bitmap (bucket, bits) of hashed keys: at most FILTER_BITS / 32768 rows of 4 KB."""
    x = F.pmod(F.xxhash64(*cols), F.lit(FILTER_BITS)) + 1
    return (
        keys.select(x.alias("__x"))
        .groupBy(F.bitmap_bucket_number("__x").alias("__bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("__x")).alias("__bits"))
    )


def with_maybe(rows: DataFrame, bitmap: DataFrame, *cols: str, flag: str = "__maybe") -> DataFrame:
    """Flag rows whose key may be among the bitmap's (no false negatives); rows don't move."""
    x = F.pmod(F.xxhash64(*cols), F.lit(FILTER_BITS)) + 1
    pos = F.bitmap_bit_position(x)
    byte = F.conv(F.hex(F.substring(F.col("__bits"), (pos / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return (
        rows.withColumn("__bucket", F.bitmap_bucket_number(x))
        .join(F.broadcast(bitmap), "__bucket", "left")
        .withColumn("__pos", (pos % 8).cast("int"))
        .withColumn("__byte", byte)
        .withColumn(flag, F.coalesce(F.expr("(shiftright(__byte, __pos) & 1) = 1"), F.lit(False)))
        .drop("__bucket", "__bits", "__pos", "__byte")
    )


def without(base: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of located ``base`` except those at staged addresses (file, row) of ``gone``, with
    the columns they had before they were located.

    Rows that a bitmap shows not to be among them pass where they are; only the others move.
    """
    flagged = with_maybe(base.select("all", "file", "row"), members_bitmap(gone, "file", "row"), "file", "row")
    unsure = flagged.where("__maybe").join(gone, ["file", "row"], "left_anti")
    return flagged.where("not __maybe").select("all").unionByName(unsure.select("all")).select("all.*")


def spread_join(rows: DataFrame, groups: DataFrame, key: str, size_col: str, how: str = "left") -> DataFrame:
    """Join many rows with one row per group, skew-safe.

    ``groups`` (staged; ``key`` is unique there) knows each group's number of rows.  Groups with
    more than a 1/HOT_KEYS share of all rows - at most HOT_KEYS, so their keys can be
    broadcast - are replicated over SPREAD salts, and their rows are dealt over these.
    """
    total = groups.agg(F.sum(size_col)).first()[0] or 0
    limit = max(total // HOT_KEYS, 256)
    hot = groups.where(F.col(size_col) > limit).select(key).withColumn("__hot", F.lit(True))
    salts = F.when(F.col(size_col) > limit, F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0)))
    right = groups.withColumn("__salt", F.explode(salts))
    rest = [c for c in rows.columns if c != key]
    left = rows.join(F.broadcast(hot), key, "left").withColumn(
        "__salt",
        F.when(F.col("__hot"), F.pmod(F.xxhash64(*rest), F.lit(SPREAD)).cast("int")).otherwise(F.lit(0)),
    )
    return left.drop("__hot").join(right, [key, "__salt"], how).drop("__salt")


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Number the rows from 0 in a total order without pulling them into one task.

    A range-partitioned sort gives each row its partition and its place there; only the
    number of rows of each partition is summed up across partitions.
    """
    placed = staged(
        df.orderBy(*order).withColumn("__id", F.monotonically_increasing_id()), "ranked"
    ).withColumns({"__part": F.shiftright("__id", 33), "__place": F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect()  # one row per partition
    before, total = {}, 0
    for part, n in sorted((r["__part"], r["n"]) for r in sizes):
        before[part] = total
        total += n
    start = F.lit(0).cast("long")
    if before:
        start = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])[F.col("__part")].cast("long")
    return placed.withColumn(name, start + F.col("__place")).drop("__id", "__part", "__place")
