"""Structured Streaming jobs for arriving classifications, events and posts.

* ``classification_stream``: submission files -> ``foreachBatch`` into a log of runs.  A
  micro-batch writes one run, the latest body of each (user, post, question) in it, so
  what is written follows the batch and not the state.  Readers merge the runs: winners
  are picked by (createdAt, submissionId), never by arrival.  ``FAN_IN`` runs of one tier
  are merged to one run of the next, so a row is rewritten a logarithmic number of times
  and there are never more than ``FAN_IN - 1`` runs a tier.  A batch ends with a commit, a
  small table that names the runs in force.  All of it is computed from the previous
  commit and the batch only, and folders are named by the epoch, so re-running a batch
  after a failure gives the same state; runs that neither of the last two commits names
  are deleted with their folders.
* ``timeline_stream``: per-user daily counts on event time with a watermark, in update
  mode; rows later than the watermark are dropped.  Open days, the ones that can still
  change, are folded into one folder per batch.  Days that the watermark has passed
  move once into a table partitioned by date.
* ``post_stream``: tweet JSON files -> post rows, image manifest and rejects;
  stateless, as ids are hashes.

All sinks and checkpoints go to folders the caller names (shared storage on
a cluster).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from .. import schemas
from ..operators import ingest as IN
from ..operators import state as ST
from ..session import remove

STATE_COLUMNS = ["userId", "postId", "questionId", "categoryId", "createdAt", "submissionId"]


# ---- committed-version bookkeeping through the Hadoop FileSystem API --------
def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def committed_epochs(spark: SparkSession, root: str) -> list[int]:
    """Epoch numbers of folders ``<root>/epoch=<n>`` holding a ``_SUCCESS`` marker."""
    fs, p, jvm = _fs(spark, root)
    if not fs.exists(p):
        return []
    out = []
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if st.isDirectory() and name.startswith("epoch="):
            if fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
                out.append(int(name.split("=", 1)[1]))
    return sorted(out)


def _epoch_path(root: str, epoch: int) -> str:
    return os.path.join(root, f"epoch={epoch}")


# ---- classifications -------------------------------------------------------------
UPQ = ["userId", "postId", "questionId"]
FAN_IN = 4


def _latest(bodies: DataFrame) -> DataFrame:
    """One row per key: its latest body."""
    body = F.struct("createdAt", "submissionId", "cats")
    win = bodies.groupBy(*UPQ).agg(F.max_by(body, F.struct("createdAt", "submissionId")).alias("w"))
    return win.select(*UPQ, "w.createdAt", "w.submissionId", "w.cats")


def _commits(spark: SparkSession, state_root: str) -> list[int]:
    return committed_epochs(spark, os.path.join(state_root, "commits"))


def committed_runs(spark: SparkSession, state_root: str, epoch: int | None = None) -> list[tuple[str, int]]:
    """(run, tier) of a commit, the last one unless given, oldest run first."""
    commits = _commits(spark, state_root)
    if epoch is None and not commits:
        return []
    at = _epoch_path(os.path.join(state_root, "commits"), commits[-1] if epoch is None else epoch)
    return [(r["run"], r["tier"]) for r in spark.read.parquet(at).orderBy("place").collect()]


def _run_path(state_root: str, run: str) -> str:
    return os.path.join(state_root, "data", run)


def _read_runs(spark: SparkSession, state_root: str, runs: list[str]) -> DataFrame:
    return spark.read.schema(STATE_SCHEMA).parquet(*[_run_path(state_root, r) for r in runs])


def classification_batch_writer(state_root: str, fan_in: int = FAN_IN):
    def write(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        done = [e for e in _commits(spark, state_root) if e < epoch_id]
        before = committed_runs(spark, state_root, done[-1]) if done else []
        new = _latest(ST.valid_submissions(batch).select(
            *UPQ, "createdAt", "submissionId", ST._all_categories().alias("cats")))
        runs = before + [(f"run={epoch_id}-0", 0)]
        new.write.mode("overwrite").parquet(_run_path(state_root, runs[-1][0]))
        while len(runs) >= fan_in and len({tier for _, tier in runs[-fan_in:]}) == 1:
            tier = runs[-1][1] + 1
            merged = f"run={epoch_id}-{tier}"
            (_latest(_read_runs(spark, state_root, [r for r, _ in runs[-fan_in:]]))
             .write.mode("overwrite").parquet(_run_path(state_root, merged)))
            runs = runs[:-fan_in] + [(merged, tier)]
        rows = [(n, run, tier) for n, (run, tier) in enumerate(runs)]
        (spark.createDataFrame(rows, "place int, run string, tier int").coalesce(1)
         .write.mode("overwrite").parquet(_epoch_path(os.path.join(state_root, "commits"), epoch_id)))
        _drop_unnamed(spark, state_root, {r for r, _ in before + runs}, done[:-1])

    return write


def _drop_unnamed(spark: SparkSession, state_root: str, named: set[str], old_commits: list[int]) -> None:
    """Delete older commits, and runs that are not ``named``."""
    fs, data, jvm = _fs(spark, os.path.join(state_root, "data"))
    for st in fs.listStatus(data):
        if st.getPath().getName() not in named:
            fs.delete(st.getPath(), True)
    for e in old_commits:
        remove(spark, _epoch_path(os.path.join(state_root, "commits"), e))


def classification_stream(spark: SparkSession, source: str, state_root: str, checkpoint: str,
                          fmt: str = "parquet", available_now: bool = True, max_files: int | None = None,
                          fan_in: int = FAN_IN):
    """Start the submission stream; returns the StreamingQuery."""
    r = spark.readStream.schema(schemas.SUBMISSION).format(fmt)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    w = (r.load(source).writeStream.foreachBatch(classification_batch_writer(state_root, fan_in))
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def current_state(spark: SparkSession, state_root: str) -> DataFrame:
    """The rows of the latest commit, one per category: its runs merged by key."""
    runs = [r for r, _ in committed_runs(spark, state_root)]
    if not runs:
        return spark.createDataFrame([], ST_SCHEMA)
    return _latest(_read_runs(spark, state_root, runs)).select(
        *UPQ, F.explode("cats").alias("categoryId"), "createdAt", "submissionId")


ST_SCHEMA = "userId bigint, postId bigint, questionId bigint, categoryId bigint, createdAt timestamp_ntz, " \
            "submissionId bigint"
STATE_SCHEMA = "userId bigint, postId bigint, questionId bigint, " \
               "createdAt timestamp_ntz, submissionId bigint, cats array<bigint>"


# ---- timeline ------------------------------------------------------------------
def utc_instant(ntz):
    """TIMESTAMP (instant) whose UTC wall clock is the TIMESTAMP_NTZ value, whatever
    the session time zone: watermarks need instants, and day windows then align
    with the wall-clock days of the data."""
    secs = (F.second(ntz).cast("decimal(8,6)")
            + (F.date_format(ntz, "SSSSSS").cast("int") / 1000000).cast("decimal(8,6)"))
    return F.make_timestamp(F.year(ntz), F.month(ntz), F.dayofmonth(ntz), F.hour(ntz), F.minute(ntz), secs,
                            F.lit("UTC"))


DAYS = "userId bigint, date string, count bigint"


def timeline_batch_writer(sink: str, delay: str):
    """Open days go to ``open/epoch=n``, passed days to ``sealed/date=...``; ``limits`` has
    for each batch the first day that can still change and the latest event seen."""
    def write(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        done = [e for e in committed_epochs(spark, os.path.join(sink, "limits")) if e < epoch_id]
        seen, limit = None, ""
        rows = batch.persist()
        newest = rows.agg(F.max("latest")).first()[0]
        days = rows.select("userId", "date", "count")
        if done:
            # Spark's watermark for this batch: the latest event of earlier batches less the delay.
            last = spark.read.parquet(_epoch_path(os.path.join(sink, "limits"), done[-1]))
            mark = F.unix_seconds(F.timestamp_seconds("seen") - F.expr(f"INTERVAL {delay}"))
            passed = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(mark / 86400).cast("int"))
            seen, limit = last.select("seen", F.date_format(passed, "yyyy-MM-dd")).first()
            limit = limit or ""
            before = spark.read.schema(DAYS).parquet(_epoch_path(os.path.join(sink, "open"), done[-1]))
            days = (before.withColumn("at", F.lit(0)).unionByName(days.withColumn("at", F.lit(1)))
                    .groupBy("userId", "date").agg(F.max_by("count", "at").alias("count")))
            # A batch that is run again finds the same days passed and replaces them by the same rows.
            (days.where(F.col("date") < limit).repartition("date")
             .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date")
             .parquet(os.path.join(sink, "sealed")))
        days.where(F.col("date") >= limit).write.mode("overwrite").parquet(
            _epoch_path(os.path.join(sink, "open"), epoch_id))
        rows.unpersist()
        seen = max((x for x in (seen, newest) if x is not None), default=None)
        (spark.createDataFrame([(limit, seen)], "firstOpen string, seen bigint").coalesce(1)
         .write.mode("overwrite").parquet(_epoch_path(os.path.join(sink, "limits"), epoch_id)))
        for e in done[:-1]:
            for kind in ("open", "limits"):
                remove(spark, _epoch_path(os.path.join(sink, kind), e))

    return write


def timeline_stream(spark: SparkSession, source: str, sink: str, checkpoint: str, schema,
                    user_col: str = "user_id", ts_col: str = "ts", watermark: str = "1 hour",
                    fmt: str = "parquet", max_files: int | None = None):
    """Daily per-user counts on event time; each batch updates the open days."""
    r = spark.readStream.schema(schema).format(fmt)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    ev = r.load(source).select(F.col(user_col).alias("userId"), utc_instant(F.col(ts_col)).alias("ts"))
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_seconds(F.col("w.start")) / 86400).cast("int"))
    agg = (ev.withWatermark("ts", watermark)
           .groupBy("userId", F.window("ts", "1 day").alias("w"))
           .agg(F.count(F.lit(1)).alias("count"), F.max(F.unix_seconds("ts")).alias("latest"))
           .select("userId", F.date_format(day, "yyyy-MM-dd").alias("date"), "count", "latest"))
    return (agg.writeStream.outputMode("update").foreachBatch(timeline_batch_writer(sink, watermark))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def current_timeline(spark: SparkSession, sink: str) -> DataFrame:
    """The latest count of every (user, day): sealed days as they are, open days of the
    last batch."""
    done = committed_epochs(spark, os.path.join(sink, "limits"))
    if not done:
        return spark.createDataFrame([], DAYS)
    first_open = spark.read.parquet(_epoch_path(os.path.join(sink, "limits"), done[-1])).first()["firstOpen"]
    out = spark.read.schema(DAYS).parquet(_epoch_path(os.path.join(sink, "open"), done[-1]))
    sealed = os.path.join(sink, "sealed")
    fs, p, _ = _fs(spark, sealed)
    if first_open and fs.exists(p):
        old = spark.read.schema(DAYS).parquet(sealed).where(F.col("date") < first_open)
        out = out.unionByName(old.select("userId", "date", "count"))
    return out


# ---- posts ---------------------------------------------------------------------------
def post_batch_writer(out_root: str, keep_retweet_flag: bool = False):
    def write(batch: DataFrame, epoch_id: int) -> None:
        def put(df: DataFrame, name: str) -> None:
            df.write.mode("overwrite").parquet(_epoch_path(os.path.join(out_root, name), epoch_id))

        raw = batch.persist()  # one parse for the three outputs
        posts = IN.import_posts(raw, keep_retweet_flag=keep_retweet_flag)
        put(IN.post_images(posts), "images")
        put(IN.import_rejects(raw), "rejects")
        put(posts.drop("images"), "posts")
        raw.unpersist()

    return write


def post_stream(spark: SparkSession, source: str, out_root: str, checkpoint: str, study_col: str = "studyId",
                max_files: int | None = None, keep_retweet_flag: bool = False):
    """Tweet JSON-lines files (one ``studyId`` per tweet) -> post, image and reject folders."""
    schema = StructType(list(schemas.TWEET.fields))  # copy: add() mutates
    if study_col not in schema.fieldNames():
        schema = schema.add(study_col, LongType(), True)
    r = (spark.readStream.schema(schema).option("mode", "PERMISSIVE")
         .option("columnNameOfCorruptRecord", "_corrupt_record"))
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return (r.json(source).writeStream.foreachBatch(post_batch_writer(out_root, keep_retweet_flag))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def read_epochs(spark: SparkSession, root: str, schema: StructType | str | None = None) -> DataFrame:
    """All committed epochs' rows, with the column ``epoch``; without any epoch no rows, and
    the columns of ``schema`` if it is given."""
    eps = committed_epochs(spark, root)
    if not eps:
        return spark.createDataFrame([], schema or StructType()).withColumn("epoch", F.lit(0))
    return spark.read.option("basePath", root).parquet(*[_epoch_path(root, e) for e in eps])
