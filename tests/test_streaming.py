"""Structured Streaming jobs: watermark drops, multi-batch equality with batch forms."""

import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from crowdtally.operators import ingest as IN
from crowdtally.sources.tables import read_table
from crowdtally.sources.tweets import ID_BASE, tweets_from_documents
from crowdtally.streaming import jobs as J

EV = "user_id bigint, ts timestamp_ntz"


def _tmp():
    return tempfile.mkdtemp(prefix="ct-stream-", dir="/tmp")


def test_timeline_drops_rows_behind_the_watermark(spark):
    root = _tmp()
    src = os.path.join(root, "src")
    d = dt.datetime
    schema = spark.createDataFrame([], EV).schema

    def run():
        J.timeline_stream(spark, src, os.path.join(root, "sink"), os.path.join(root, "ck"), schema,
                          watermark="1 hour").awaitTermination()

    # The first file moves event time to Jan 11; the one arriving later holds a
    # Jan 1 row (behind the watermark) and a Jan 10 row.
    spark.createDataFrame([(1, d(2024, 1, 10, 12)), (1, d(2024, 1, 11, 12))], EV).coalesce(1) \
        .write.mode("append").parquet(src)
    run()
    spark.createDataFrame([(1, d(2024, 1, 1, 5)), (2, d(2024, 1, 10, 13))], EV).coalesce(1) \
        .write.mode("append").parquet(src)
    run()
    got = sorted(tuple(r) for r in J.current_timeline(spark, os.path.join(root, "sink")).collect())
    # Jan 1 is late and dropped.  Jan 10 closed before the second file arrived, so
    # user 2's Jan 10 row is late as well; Jan 11 is still open and delivered.
    assert got == [(1, "2024-01-10", 1), (1, "2024-01-11", 1)]


def test_open_day_is_updated(spark):
    root = _tmp()
    src = os.path.join(root, "src")
    d = dt.datetime
    for n in range(3):
        spark.createDataFrame([(1, d(2024, 1, 11, 12 + n))], EV).coalesce(1).write.mode("append").parquet(src)
        J.timeline_stream(spark, src, os.path.join(root, "sink"), os.path.join(root, "ck"),
                          spark.createDataFrame([], EV).schema).awaitTermination()
        assert [tuple(r) for r in J.current_timeline(spark, os.path.join(root, "sink")).collect()] == [
            (1, "2024-01-11", n + 1)]


BODY = "submissionId bigint, userId bigint, postId bigint, questionId bigint, categoryIds array<bigint>, " \
       "sentimentoCategoryIds array<bigint>, createdAt timestamp_ntz"


def _send(spark, root, *rows, fan_in=4):
    src, state = os.path.join(root, "src"), os.path.join(root, "state")
    spark.createDataFrame(list(rows), BODY).coalesce(1).write.mode("append").parquet(src)
    J.classification_stream(spark, src, state, os.path.join(root, "ck"), fan_in=fan_in).awaitTermination()
    return sorted((r.userId, r.categoryId, r.submissionId) for r in J.current_state(spark, state).collect())


def _run_rows(spark, state):
    return {run: spark.read.parquet(os.path.join(state, "data", run)).count() for run, _ in J.committed_runs(spark, state)}


def test_a_batch_writes_what_it_brings(spark):
    root, t = _tmp(), dt.datetime
    state = os.path.join(root, "state")
    assert len(_send(spark, root, *[(u, u, 5, 6, [1, 2], None, t(2024, 1, 1)) for u in range(40)])) == 80
    now = _send(spark, root, (100, 7, 5, 6, [3], [4], t(2024, 1, 2)))
    assert [x for x in now if x[0] == 7] == [(7, 3, 100), (7, 4, 100)] and len(now) == 80
    assert _run_rows(spark, state) == {"run=0-0": 40, "run=1-0": 1}
    # An older body and a copy of the newest change nothing.
    assert _send(spark, root, (99, 7, 5, 6, [9], None, t(2023, 1, 2)), (100, 7, 5, 6, [3], [4], t(2024, 1, 2))) == now
    # A batch that is run again gives the same state.
    batch = spark.createDataFrame([(99, 7, 5, 6, [9], None, t(2023, 1, 2))], BODY)
    for _ in range(2):
        J.classification_batch_writer(state)(batch, 2)
        assert sorted((r.userId, r.categoryId, r.submissionId) for r in J.current_state(spark, state).collect()) == now


def test_runs_are_merged_by_tiers(spark):
    root, t = _tmp(), dt.datetime
    state = os.path.join(root, "state")
    write, want = J.classification_batch_writer(state, 3), {}
    for n in range(11):
        rows = [(100 * n + u, (n * 7 + u) % 20, 5, 6, [n], None, t(2024, 1, 1 + n)) for u in range(4)]
        want |= {r[1]: n for r in rows}
        for _ in range(1 + n % 2):      # every other batch is run twice
            write(spark.createDataFrame(rows, BODY), n)
        runs = J.committed_runs(spark, state)
        tiers = [tier for _, tier in runs]
        assert tiers == sorted(tiers, reverse=True) and all(tiers.count(x) < 3 for x in tiers)
        assert {r.userId: r.categoryId for r in J.current_state(spark, state).collect()} == want
    assert [r for r, _ in J.committed_runs(spark, state)] == ["run=8-2", "run=9-0", "run=10-0"]
    # Only what the last two commits name is left.
    assert len(os.listdir(os.path.join(state, "commits"))) <= 2
    assert set(os.listdir(os.path.join(state, "data"))) == {"run=8-2", "run=9-0", "run=10-0"}


def test_a_batch_without_a_valid_body(spark):
    root = _tmp()
    assert J.current_state(spark, os.path.join(root, "state")).collect() == []
    assert _send(spark, root, (1, 1, None, 6, [1], None, dt.datetime(2024, 1, 1))) == []


def test_passed_days_are_sealed_once(spark):
    root, d = _tmp(), dt.datetime
    src, sink = os.path.join(root, "src"), os.path.join(root, "sink")
    empty = spark.createDataFrame([], EV)
    assert J.current_timeline(spark, sink).collect() == []

    def send(*rows):
        spark.createDataFrame(list(rows), EV).coalesce(1).write.mode("append").parquet(src)
        J.timeline_stream(spark, src, sink, os.path.join(root, "ck"), empty.schema).awaitTermination()
        return sorted(tuple(r) for r in J.current_timeline(spark, sink).select("userId", "date", "count").collect())

    def sealed():
        at = os.path.join(sink, "sealed")
        return {os.path.join(x, f): os.path.getmtime(os.path.join(x, f)) for x, _, fs in os.walk(at)
                for f in fs if f.endswith(".parquet")}

    want = {}
    for day in range(1, 8):
        rows = [(u, d(2024, 1, day, 10 + u)) for u in range(3)] + [(0, d(2024, 1, day, 23))]
        for u, ts in rows:
            want[u, f"{ts:%Y-%m-%d}"] = want.get((u, f"{ts:%Y-%m-%d}"), 0) + 1
        before = sealed()
        assert send(*rows) == sorted((u, x, n) for (u, x), n in want.items())
        assert all(sealed().get(p) == at for p, at in before.items())      # not written again
    opened = committed = J.committed_epochs(spark, os.path.join(sink, "open"))
    assert len(committed) <= 2
    left = spark.read.parquet(os.path.join(sink, "open", f"epoch={opened[-1]}"))
    assert left.select("date").distinct().count() <= 2 and len(sealed()) >= 5


def test_reading_a_sink_without_epochs(spark):
    assert J.read_epochs(spark, os.path.join(_tmp(), "none"), "id bigint").columns == ["id", "epoch"]
    assert J.read_epochs(spark, os.path.join(_tmp(), "none")).collect() == []


def test_post_stream_over_several_batches_matches_batch_import(spark):
    root = _tmp()
    docs = read_table(spark, "/root/testdata/sf0.001", "documents")
    tw = tweets_from_documents(docs).withColumn("studyId", (F.col("id").cast("bigint") - F.lit(ID_BASE)) % 5)
    tw.repartition(3).write.json(os.path.join(root, "src"))
    q = J.post_stream(spark, os.path.join(root, "src"), os.path.join(root, "out"), os.path.join(root, "ck"),
                      max_files=1)
    q.awaitTermination()
    streamed = J.read_epochs(spark, os.path.join(root, "out", "posts"))
    cols = ["id", "postLink", "pageName", "details", "studyId"]      # ids do not depend on batches
    whole = tw.withColumn("_corrupt_record", F.lit(None).cast("string"))
    batch = IN.import_posts(whole)
    assert batch.select("id").distinct().count() == batch.count()
    rejects = J.read_epochs(spark, os.path.join(root, "out", "rejects"))
    assert rejects.count() == IN.import_rejects(whole).count() > 0
    assert sorted(tuple(r) for r in streamed.select(*cols).collect()) == sorted(
        tuple(r) for r in batch.select(*cols).collect())
