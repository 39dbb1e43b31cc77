"""The engine's tables as views of a folder of Parquet tables: documents as chunks, benchmark items as queries, orders as a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import textindex
from quarry.sources.shared import new_folder


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table that comes in fewer partitions than there are cores (one small file, say), dealt over them; any other as it is."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def chunks(spark: SparkSession, folder: str, dealt: bool = True) -> DataFrame:
    """dealt: over all cores, where the files have fewer partitions; needless where texts are only looked up."""
    d = read(spark, folder, "documents")
    d = spread(d) if dealt else d
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return d.select(F.col("doc_id").alias("chunk_id"), path.alias("file_path"), F.col("text").alias("content"), F.lit(1).alias("start_line"), F.size(F.split("text", "\n")).alias("end_line"), "source", "lang")


_indexes: dict = {}


def text_index(spark: SparkSession, folder: str) -> textindex.TextIndex:
    """The stored text index of the documents, over their texts and paths. It is built where the application has none for just these
    files (by names, sizes and times) and then serves all its searches."""
    files = spark.read.format("binaryFile").load(f"{folder}/documents.parquet").select(F.xxhash64("path", "length", "modificationTime").alias("h"))
    stamp = files.agg(F.count("*").alias("n"), F.bit_xor("h").alias("h")).first()
    key = (spark.sparkContext.applicationId, folder, stamp.n, stamp.h)
    if key not in _indexes:
        _indexes[key] = textindex.store(chunks(spark, folder), ["content", "file_path"], new_folder(spark, "text-index"))
    return _indexes[key]


def queries(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), "label")


def edges(spark: SparkSession, folder: str) -> DataFrame:
    """(src, dst, kind): parts call suppliers, once for each order line; customers refer to nations, suppliers descend from them."""
    li, c, s = (read(spark, folder, t) for t in ("lineitem", "customer", "supplier"))
    a = li.select((F.col("l_partkey") * 4).alias("src"), (F.col("l_suppkey") * 4 + 1).alias("dst"), F.lit("call").alias("kind"))
    b = c.select((F.col("c_custkey") * 4 + 3).alias("src"), (F.col("c_nationkey").cast("long") * 4 + 2).alias("dst"), F.lit("type_ref").alias("kind"))
    h = s.select((F.col("s_suppkey") * 4 + 1).alias("src"), (F.col("s_nationkey").cast("long") * 4 + 2).alias("dst"), F.lit("hierarchy").alias("kind"))
    return a.unionByName(b).unionByName(h)


def nodes(spark: SparkSession, folder: str) -> DataFrame:
    one = lambda t, k, o: read(spark, folder, t).select((F.col(k).cast("long") * 4 + o).alias("chunk_id"))
    return one("part", "p_partkey", 0).unionByName(one("supplier", "s_suppkey", 1)).unionByName(one("nation", "n_nationkey", 2)).unionByName(one("customer", "c_custkey", 3))


def imports(spark: SparkSession, folder: str) -> DataFrame:
    """(importer, imported): a customer's file imports its nation's, a supplier's too."""
    n = read(spark, folder, "nation").select("n_nationkey", F.concat(F.lit("nations/"), "n_name", F.lit("/mod.py")).alias("imported"))
    c = read(spark, folder, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat("c_mktsegment", F.lit("/c"), "c_custkey", F.lit(".py")).alias("importer"), "imported")
    s = read(spark, folder, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("suppliers/s"), "s_suppkey", F.lit(".py")).alias("importer"), "imported")
    return c.unionByName(s)


def commits(spark: SparkSession, folder: str) -> DataFrame:
    e = read(spark, folder, "events")
    path = F.concat(F.lit("src/"), "event_type", F.lit("/f"), F.pmod("user_id", F.lit(97)).cast("string"), F.lit(".py"))
    return e.select(F.col("event_id").alias("hash"), F.concat(F.lit("user"), "user_id").alias("author"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"), F.concat("event_type", F.lit(" "), "props").alias("message"), path.alias("path"))


def notes(spark: SparkSession, folder: str) -> DataFrame:
    c = spread(read(spark, folder, "conversations"))
    return c.select((F.col("conv_id") * 100 + F.col("turn")).alias("note_id"), F.col("conv_id").alias("created_ts"), F.col("role").alias("scope"), F.col("text").alias("content"))
