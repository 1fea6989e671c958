"""Elements of an array file are checked and parsed once, whatever is asked of them."""

import os
import tempfile

from pyspark.sql import functions as F

from crowdtally.operators import ingest as IN
from crowdtally.sources.tweet_arrays import _one_value, read_posts_array


def test_a_filter_does_not_parse_again(spark):
    path = tempfile.mkdtemp(prefix="ct-array-", dir="/tmp")
    with open(os.path.join(path, "a.json"), "w", encoding="utf-8") as f:
        f.write('[\n{"id": "1", "url": "u", "username": "p"},\n{"id": "2"},\n{"id": "3"} x\n]')
    rejects = IN.import_rejects(read_posts_array(spark, path).withColumn("studyId", F.lit(1)))
    plan = rejects._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1
    assert sorted((r.postId, r.reason, r.record) for r in rejects.collect() if r.postId) == [("2", "missing_url", None)]
    assert [(r.reason, r.record) for r in rejects.collect() if not r.postId] == [("malformed", '{"id": "3"} x')]


def test_one_value(spark):
    cases = {'{"a": 1}': True, '{"a": [1, {}]}\n ': True, '{"a": "}]"}': True, '[1] ': True, "12": True, '"x': True,
             '{"a": 1} x': False, "{}{}": False, '{"a": 1}}': False, '{"a": {}': False, '{} "}"': False, "{} \\": False,
             "[],": False, '{"a": "\\"}"}': True}
    df = spark.createDataFrame([(k,) for k in cases], "text string").select("text", _one_value(F.col("text")).alias("one"))
    assert {r.text: r.one for r in df.collect()} == cases
