"""Exact dedup by stateful streaming (DataFrame functions only).

Texts are equal when identical after deleting ``[\\x20\\x09-\\x0D]``.  Batches of rows are staged in
a folder and pass as a stream through keyed state on disk (RocksDB, no expiry).  The state of a
digest holds the identifier of the row that stays, how many rows hit it, and the staged file in
which its content lies; not the content.  Texts whose digest was hit twice are compared byte by
byte with the content at that locator; should two texts share a digest, their bytes tell them
apart.  A later batch goes on from the state that is there.

Scale: rows are pre-aggregated before the exchange on the digest, so a text that holds a third
of all rows reaches its state as one row per task, and the check as one distinct text per task.
Only digests with two or more rows are checked; of the files only those that locators name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import scratch

#: At most so many bytes of digests or identifiers are broadcast; beyond that a shuffled join is used.
BROADCAST_BYTES = 8 << 20
#: Bytes of staged files that one micro-batch reads.
BATCH_BYTES = 64 << 30
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    # Else each partition's store takes 4 MB for its manifest, however small it is.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text: Column) -> Column:
    """Text without the six white-space characters; null counts as empty."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), " \t\n\x0b\x0c\r", "")


def sha256_digest(norm: Column) -> Column:
    return F.unhex(F.sha2(norm, 256))


def _few(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if scratch.size(keys) <= BROADCAST_BYTES else keys


class SeenTexts:
    """All rows given to `add`, grouped by equal texts; kept in a folder, so that another process can go on.

    Rows of all batches need the same columns, doc_id and text among them.
    """

    def __init__(self, spark: SparkSession, path: str, digest=sha256_digest):
        self.spark, self.path, self.digest = spark, path.rstrip("/"), digest
        fs = spark._jvm.org.apache.hadoop.fs
        self._rows = fs.Path(f"{self.path}/rows")
        self._fs = self._rows.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _batches(self) -> int:
        return sum(f.getPath().getName().startswith("batch=") for f in self._fs.listStatus(self._rows)) if self._fs.exists(self._rows) else 0

    def rows(self) -> DataFrame:
        """Staged rows: doc (the row as it was given), digest, n_orig, mark, neg_id, uid, batch."""
        return self.spark.read.parquet(f"{self.path}/rows")

    def add(self, docs: DataFrame) -> SeenTexts:
        """Stage a batch and take it into the state."""
        rows = docs.select(
            F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
            self.digest(normalised(F.col("text"))).alias("digest"),
            F.char_length(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("n_orig"),
            F.xxhash64("text").alias("mark"),
            (-F.col("doc_id").cast("long")).alias("neg_id"),
            F.monotonically_increasing_id().alias("uid"),
        )
        with scratch.settings(self.spark, scratch.RAW):
            rows.write.parquet(f"{self.path}/rows/batch={self._batches()}")
        staged = self.rows()
        one = {"spark.sql.streaming.stateStore.unloadOnCommit": "true"} if scratch.size(staged) <= BATCH_BYTES else {}
        with scratch.settings(self.spark, SETTINGS | one):
            stream = self.spark.readStream.schema(staged.schema).option("maxBytesPerTrigger", str(BATCH_BYTES)).parquet(f"{self.path}/rows")
            row = F.struct("n_orig", "neg_id", "mark", (-F.col("batch")).alias("neg_batch"), (-F.col("uid")).alias("neg_uid"), F.col("_metadata.file_path").alias("locator"))
            keyed = stream.groupBy("digest").agg(F.max(row).alias("best"), F.count(F.lit(1)).alias("n"))
            run = keyed.writeStream.format("noop").outputMode("update").option("checkpointLocation", f"{self.path}/state").trigger(availableNow=True).start()
            run.awaitTermination()
        return self

    def state(self) -> DataFrame:
        """The keyed state: digest, best (the row that stays, and its locator), n."""
        with scratch.settings(self.spark, SETTINGS):
            raw = self.spark.read.format("statestore").load(f"{self.path}/state")
            best, n = (f.name for f in raw.schema["value"].dataType.fields)
            return scratch.written(raw.select(F.col("key.digest").alias("digest"), F.col(f"value.`{best}`").alias("best"), F.col(f"value.`{n}`").alias("n")), "dedup-state", raw=False)

    def groups(self) -> DataFrame:
        """Return uid, batch, doc_id, digest, keep_id, group_size, kept of each row; see `exact_groups`."""
        rows = self.rows()
        if rows.isEmpty():
            return rows.select("uid", "batch", F.col("doc.doc_id").cast("long").alias("doc_id"), "digest", (-F.col("neg_id")).alias("keep_id"), F.lit(0).cast("long").alias("group_size"), F.lit(True).alias("kept"))
        state = self.state()
        norm = normalised(F.col("doc.text")).alias("norm")
        hit = scratch.written(state.where("n > 1").select("digest", (-F.col("best.neg_batch")).alias("batch"), (-F.col("best.neg_uid")).alias("uid"), F.col("best.locator").alias("locator")), "dedup-hit")
        files = [r[0] for r in hit.select("locator").distinct().collect()]  # at most the staged files' names
        held = self.spark.read.option("basePath", f"{self.path}/rows").schema(rows.schema).parquet(*files) if files else rows.limit(0)
        held = held.select("uid", "batch", norm).join(_few(hit.select("digest", "uid", "batch")), ["uid", "batch"]).select("digest", F.col("norm").alias("held"))
        texts = rows.select("digest", norm).join(_few(hit.select("digest")), "digest", "left_semi").groupBy("digest", "norm").count().drop("count")
        clash = scratch.written(texts.join(held, "digest").where("norm != held").select("digest").distinct(), "dedup-clash")
        out = rows.join(state, "digest").select(
            "uid",
            "batch",
            F.col("doc.doc_id").cast("long").alias("doc_id"),
            "digest",
            (-F.col("best.neg_id")).alias("keep_id"),
            F.col("n").alias("group_size"),
            ((F.col("uid") == -F.col("best.neg_uid")) & (F.col("batch") == -F.col("best.neg_batch"))).alias("kept"),
        )
        if clash.isEmpty():
            return out
        # Digests shared by different texts: group those rows by their bytes.
        told = rows.join(_few(clash), "digest", "left_semi").select("uid", "batch", F.col("doc.doc_id").cast("long").alias("doc_id"), "digest", norm, "n_orig", "mark", "neg_id")
        best = F.max(F.struct("n_orig", "neg_id", "mark", (-F.col("batch")).alias("neg_batch"), (-F.col("uid")).alias("neg_uid"))).alias("best")
        fixed = told.join(told.groupBy("digest", "norm").agg(best, F.count(F.lit(1)).alias("n")), ["digest", "norm"]).select(
            "uid",
            "batch",
            "doc_id",
            "digest",
            (-F.col("best.neg_id")).alias("keep_id"),
            F.col("n").alias("group_size"),
            ((F.col("uid") == -F.col("best.neg_uid")) & (F.col("batch") == -F.col("best.neg_batch"))).alias("kept"),
        )
        return out.join(_few(clash), "digest", "left_anti").select(*fixed.columns).unionByName(fixed)

    def kept(self) -> DataFrame:
        """The rows that stay, with all their columns."""
        gone = scratch.written(self.groups().where("not kept").select("uid", "batch"), "dedup-gone")
        return self.rows().join(_few(gone), ["uid", "batch"], "left_anti").select("doc.*")


def exact_groups(docs: DataFrame, digest=sha256_digest) -> DataFrame:
    """Return a row for each row of `docs`: doc_id, digest, keep_id, group_size, kept.

    Of equal texts the row with most code points in its original text stays, then the
    smallest doc_id (a null doc_id comes last); of rows with both equal one stays.  Null
    and empty texts form a group of their own.  No rows: an empty result.  Other
    columns of `docs` are ignored.
    """
    seen = SeenTexts(docs.sparkSession, scratch.new_path(docs.sparkSession, "dedup"), digest)
    return seen.add(docs.select("doc_id", "text")).groups().drop("uid", "batch")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """Return the rows of `docs` that stay (see `exact_groups`), with all their columns."""
    return SeenTexts(docs.sparkSession, scratch.new_path(docs.sparkSession, "dedup")).add(docs).kept()
