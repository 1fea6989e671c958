"""The array reader against Spark's multi-line reader, over splits of 1,500 bytes."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from crowdtally.sources.tweet_arrays import array_elements, read_posts_array, write_arrays
from crowdtally.sources.tweets import read_posts_json

TEXTS = ["plain", 'a "quoted" word', "braces }{ ]["" in } text", "back\\slash \\", 'ends \\"', "line\nbreak\ttab", "", "á, é, 日本",
         "}, {", '"},\n  {"', "\\\\\"[", "x" * 900]


def tweets(n):
    return [{"id": str(i), "url": f"u{i}", "username": "p", "text": TEXTS[i % len(TEXTS)], "likes": i,
             "images": [f"{i}/{k}" for k in range(i % 3)], "user": {"url": "v", "username": "{"}} for i in range(n)]


@pytest.fixture()
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = {k: spark.conf.get(k) for k in names}
    for k in names:
        spark.conf.set(k, "1500")
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def folder(**files):
    path = tempfile.mkdtemp(prefix="ct-array-", dir="/tmp")
    for name, text in files.items():
        with open(os.path.join(path, name + ".json"), "w", encoding="utf-8", newline="") as f:
            f.write(text)
    return path


def rows(df):
    return sorted(map(str, (r.asDict(recursive=True) for r in df.drop("file").collect())))


@pytest.mark.parametrize("form", [
    dict(indent=2), dict(indent=None), dict(indent=4, separators=(" ,", ":")), dict(indent="\t", ensure_ascii=False)])
def test_equals_the_multi_line_reader(small_splits, form):
    text = json.dumps(tweets(60), **form)
    path = folder(a=text, b=text.replace("\n", "\r\n"), c="[]", d=" \n[\n\n]\n", e="",
                  f=json.dumps(tweets(5)[3], indent=1))
    assert rows(read_posts_array(small_splits, path)) == rows(read_posts_json(small_splits, path))
    assert small_splits.read.text(path).rdd.getNumPartitions() > 5


def test_objects_that_share_a_line(small_splits):
    own = [json.dumps(t, indent=1) for t in tweets(40)]
    path = folder(a="[" + ", ".join(own) + "]", b="[" + " ,\n".join(json.dumps(t) for t in tweets(40)) + "\n]")
    assert rows(read_posts_array(small_splits, path)) == rows(read_posts_json(small_splits, path))


def test_a_broken_element_is_one_row(small_splits):
    own = [json.dumps(t, indent=2) for t in tweets(30)]
    own[4] = '{\n "id": "4", "likes": oops\n}'
    own[9] = "12"
    got = read_posts_array(small_splits, folder(a="[\n" + ",\n".join(own) + "\n]")).collect()
    assert sorted(r._corrupt_record for r in got if r._corrupt_record) == sorted([own[4], own[9]])
    assert sorted(int(r.id) for r in got if not r._corrupt_record) == [i for i in range(30) if i not in (4, 9)]


@pytest.mark.parametrize("fault", [
    '{\n    "id": "4",\n    "user": {\n', '{\n    "id": "4"\n  }}}', '{\n    "id": "4",\n    "text": "open\n  }', '{\n ]\n'])
def test_a_fault_of_brackets_costs_its_own_element(small_splits, fault):
    text = json.dumps(tweets(30), indent=2)
    at = text.index('{\n    "id": "4"')
    end = text.index('{\n    "id": "5"')
    path = folder(a=text[:at] + fault + ",\n  " + text[end:], b=json.dumps(tweets(3), indent=2))
    got = read_posts_array(small_splits, path).collect()
    good = sorted(int(r.id) for r in got if not r._corrupt_record)
    assert good == sorted([*range(3), *(i for i in range(30) if i != 4)])
    assert len([r for r in got if r._corrupt_record]) == 1


def test_a_file_cut_short(small_splits):
    text = json.dumps(tweets(30), indent=2)
    got = read_posts_array(small_splits, folder(a=text[:-9])).collect()
    assert sorted(int(r.id) for r in got if not r._corrupt_record) == list(range(29))
    assert sum(r._corrupt_record is not None for r in got) == 1


def test_written_arrays(small_splits):
    spark = small_splits
    df = spark.range(500).select((F.col("id") % 3).alias("studyId"), F.col("id").alias("at"), F.to_json(
        F.struct(F.col("id").cast("string").alias("id"), F.lit("{").alias("text")), {"pretty": "true"}).alias("object"))
    path = folder() + "/out"
    write_arrays(df, path, 4)
    assert rows(read_posts_array(spark, path)) == rows(read_posts_json(spark, path).drop("studyId", "part"))
    assert array_elements(spark, path).count() == 500
