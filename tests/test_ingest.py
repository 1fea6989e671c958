"""Tweet JSON ingest on a hand-written array file (invented posts, reference shape)."""

import hashlib
import json
import os
import tempfile

from pyspark.sql import functions as F

from crowdtally.operators import ingest as IN
from crowdtally.sources.tweets import read_posts_json

POSTS = [
    {"id": "1880000000000000001", "url": "https://x.com/a/status/1", "username": "pagea", "text": "Olá, ação!\nlinha 2",
     "likes": 5, "replies": 1, "retweets": 2, "isRetweet": True, "images": ["https://img/1.jpg", "https://img/2.jpg"],
     "user": {"url": "https://x.com/a", "username": "pagea", "website": None}},
    {"id": "1880000000000000002", "url": "https://x.com/b/status/2", "username": "pageb", "text": "sem imagens",
     "likes": 0, "replies": 0, "retweets": 0, "user": {"username": "pageb"}},
    {"id": "1880000000000000003", "url": None, "username": "pagec", "text": "sem link", "likes": 1},
]


def _write(tmp, posts, broken=False):
    path = os.path.join(tmp, "dataset.json")
    text = json.dumps(posts, ensure_ascii=False, indent=2)
    if broken:
        text = text[:-3]
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def test_read_array_file_and_import(spark):
    tmp = tempfile.mkdtemp(prefix="ct-json-", dir="/tmp")
    raw = read_posts_json(spark, _write(tmp, POSTS))
    rows = {r.id: r for r in raw.collect()}
    assert len(rows) == 3 and rows["1880000000000000001"].text == "Olá, ação!\nlinha 2"
    assert rows["1880000000000000002"].images is None and rows["1880000000000000002"].user.url is None
    posts = {r.postId: r for r in IN.import_posts(raw, study_id=17).collect()}
    assert set(posts) == {"1880000000000000001", "1880000000000000002"}
    a = posts["1880000000000000001"]
    assert (a.pageName, a.pageLink, a.isRetweet, a.socialName, a.studyId) == ("pagea", "https://x.com/a", 0,
                                                                              "Twitter", 17)
    own = hashlib.md5(b"17:1880000000000000001:https://x.com/a/status/1").hexdigest()
    assert a.id == int(own[:15], 16)
    rejects = IN.import_rejects(raw.withColumn("studyId", F.lit(17))).collect()
    assert [(r.postId, r.reason) for r in rejects] == [("1880000000000000003", "missing_url")]
    assert posts["1880000000000000002"].pageLink is None
    script = {r.postId: r.isRetweet for r in IN.import_posts(raw, study_id=17, keep_retweet_flag=True).collect()}
    assert script["1880000000000000001"] == 1
    imgs = sorted((r.pos, r.isFrontPage) for r in IN.post_images(IN.import_posts(raw, study_id=17)).collect())
    assert imgs == [(0, 1), (1, 0)]
    s = [tuple(r) for r in IN.import_summary(raw.withColumn("studyId", raw["likes"] * 0 + 17)).collect()]
    assert s[0][1:4] == (2, 1, "created")


def test_malformed_file_is_kept_as_corrupt_record(spark):
    tmp = tempfile.mkdtemp(prefix="ct-json-", dir="/tmp")
    raw = read_posts_json(spark, _write(tmp, POSTS, broken=True)).cache()
    rows = raw.collect()
    assert len(rows) == 1 and rows[0]._corrupt_record is not None
    summary = IN.import_summary(raw.withColumn("studyId", raw["likes"] * 0 + 1).fillna({"studyId": 1})).collect()
    assert [(r.inserted, r.failed, r.outcome) for r in summary] == [(0, 1, "error")]
