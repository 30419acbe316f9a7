"""Content-addressed and sealed objects, and the sinks of the journal and of published files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def objects(rows: DataFrame, content: Column) -> DataFrame:
    """address, content: each content once, by the SHA-256 of its bytes (null contents have none)."""
    body = content.cast("binary")
    # contents are pruned to addresses first, so that the shuffle's map side keeps one of each
    return rows.where(content.isNotNull()).select(F.sha2(body, 256).alias("address"), body.alias("content")).dropDuplicates(["address"])


def put(rows: DataFrame, content: Column, folder: str) -> int:
    """Adds contents that the store lacks; gives how many. What is there is never written again."""
    spark = rows.sparkSession
    fresh = objects(rows, content)
    if exists(spark, folder):
        fresh = fresh.join(spark.read.parquet(folder).select("address"), "address", "left_anti")
    before = spark.read.parquet(folder).count() if exists(spark, folder) else 0
    fresh.write.mode("append").parquet(folder)
    return spark.read.parquet(folder).count() - before


def exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path)


def audit(store: DataFrame, references: DataFrame) -> DataFrame:
    """address, finding: ``corrupt`` (bytes of another digest), ``dangling`` (named, not stored), ``unused`` (a note)."""
    s = store.select("address", (F.sha2("content", 256) == F.col("address")).alias("whole"))
    j = s.join(references.select("address").distinct().withColumn("named", F.lit(True)), "address", "full_outer")
    finding = F.when(F.col("whole").isNull(), "dangling").when(~F.col("whole"), "corrupt").when(F.col("named").isNull(), "unused")
    return j.select("address", finding.alias("finding")).where("finding is not null")


def seal(content: Column, key: Column, context: Column) -> Column:
    """AES-256-GCM of a content, bound to a context that is needed to open it."""
    return F.aes_encrypt(content.cast("binary"), key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(b"").cast("binary"), context)


def unseal(sealed: Column, key: Column, context: Column) -> Column:
    """The content, null if key, context or bytes are others."""
    return F.try_aes_decrypt(sealed, key, F.lit("GCM"), F.lit("DEFAULT"), context)


def append_journal(events: DataFrame, folder: str, keys: list[str]) -> int:
    """Appends events (with ``order``, without seq) that the journal has none of with the same keys; gives how many.

    Of new events with equal keys only the first goes in. seq goes on from the journal's last one without a gap:
    batches are one writer's, so they are small against the journal and numbered by one sort.
    """
    from pyspark.sql import Window as W

    spark = events.sparkSession
    last = 0
    fresh = events.withColumn("turn", F.row_number().over(W.partitionBy(*keys).orderBy("order"))).where("turn = 1").drop("turn")
    if exists(spark, folder):
        old = spark.read.parquet(folder)
        fresh = fresh.join(old.select(*keys), keys, "left_anti")
        last = old.agg(F.max("seq")).first()[0] or 0
    numbered = fresh.withColumn("seq", (F.row_number().over(W.orderBy("order")) + last).cast("long")).drop("order").persist()
    n = numbered.count()
    if n:
        numbered.write.mode("append").parquet(folder)
    numbered.unpersist()
    return n


def publish(rows: DataFrame, folder: str) -> str:
    """Writes JSON to a folder that mustn't exist, reads it back and gives the digest of its rows.

    The digest is that of the sorted row digests' sum, so it needs no order; another result on reading back is an error.
    """
    def digest(d: DataFrame) -> tuple[int, str]:
        row = F.sha2(F.to_json(F.struct(*sorted(d.columns)), {"ignoreNullFields": "false"}), 256)
        r = d.agg(F.count("*").alias("n"), F.sum(F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)")).alias("s")).first()
        return r.n, str(r.s)

    rows.write.mode("errorifexists").option("ignoreNullFields", "false").json(folder)
    want, got = digest(rows), digest(rows.sparkSession.read.schema(rows.schema).json(folder))
    if want != got:
        raise OSError(f"{folder} reads back as {got}, written were {want}")
    return f"{want[0]}:{want[1]}"
