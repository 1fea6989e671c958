"""Registered queries of the source / ingest / sink family."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..operators import ingest as IN
from ..session import ensure_checkpoint_dir
from ..sources.tables import load_tables, read_table, write_tables
from ..sources.tweet_arrays import read_posts_array, write_arrays
from ..sources.tweets import ID_BASE, tweet_feed, tweets_from_documents
from .registry import register

TWEETS_CTE = """
Tw AS (
  SELECT doc_id, CAST(doc_id + 1880000000000000000 AS VARCHAR) AS id,
         concat('https://x.com/', source, '/status/', CAST(doc_id + 1880000000000000000 AS VARCHAR)) AS url,
         CASE WHEN doc_id % 50 = 7 THEN NULL ELSE source END AS username,
         text, n_chars % 1000 AS likes, n_chars % 97 AS replies, n_chars % 13 AS retweets,
         (doc_id % 7 = 0) AS isRetweet,
         CASE WHEN doc_id % 5 = 0 THEN NULL ELSE concat('https://x.com/', source) END AS userUrl,
         strftime(TIMESTAMP '2025-01-01 00:00:00' + to_days(CAST(doc_id % 90 AS INTEGER))
                  + to_hours(CAST(doc_id % 24 AS INTEGER)), '%Y-%m-%dT%H:%M:%S.000Z') AS timestamp,
         CAST(doc_id % 4 AS INTEGER) AS nImages,
         doc_id % 5 AS studyId
  FROM documents),
Imported AS (
  SELECT CAST('0x' || left(md5(studyId || ':' || id || ':' || url), 15) AS BIGINT) AS localId, *
  FROM Tw WHERE id IS NOT NULL AND url IS NOT NULL AND username IS NOT NULL)"""


def _raw(spark, sf):
    """Tweets as the JSON reader delivers them, without the files in between."""
    t = tweets_from_documents(read_table(spark, sf, "documents"))
    return t.withColumns({"_corrupt_record": F.lit(None).cast("string"),
                          "studyId": (F.col("id").cast("bigint") - F.lit(ID_BASE)) % 5})


@register("read_posts_json", "WITH " + TWEETS_CTE.strip() + """
SELECT id, url, username, text, likes, replies, retweets, isRetweet, userUrl, timestamp, nImages FROM Tw""")
def _q_read_posts_json(t, spark, sf):
    r = tweet_feed(spark, read_table(spark, sf, "documents"))
    n = F.coalesce(F.size("images"), F.lit(0))
    return r.select("id", "url", "username", "text", "likes", "replies", "retweets", "isRetweet",
                    F.col("user.url").alias("userUrl"), "timestamp",
                    F.when(n < 0, 0).otherwise(n).cast("int").alias("nImages"))


@register("import_posts", "WITH " + TWEETS_CTE.strip() + """
SELECT localId AS id, username AS pageName, userUrl AS pageLink, url AS postLink, id AS postId,
       text AS details, likes AS likesCount, replies AS commentsCount, retweets AS sharesCount,
       0 AS isRetweet, 'Twitter' AS socialName, studyId
FROM Imported""")
def _q_import_posts(t, spark, sf):
    return IN.import_posts(_raw(spark, sf)).drop("images")


@register("import_posts_script", "WITH " + TWEETS_CTE.strip() + """
SELECT localId AS id, username AS pageName, userUrl AS pageLink, url AS postLink, id AS postId,
       text AS details, likes AS likesCount, replies AS commentsCount, retweets AS sharesCount,
       CAST(isRetweet AS INTEGER) AS isRetweet, 'Twitter' AS socialName, studyId
FROM Imported""")
def _q_import_posts_script(t, spark, sf):
    return IN.import_posts(_raw(spark, sf), keep_retweet_flag=True).drop("images")


@register("post_images", "WITH " + TWEETS_CTE.strip() + """
SELECT localId AS postId, CAST(i AS INTEGER) AS pos,
       concat('https://img.test/', CAST(doc_id AS VARCHAR), '/', CAST(i AS VARCHAR), '.jpg') AS url,
       CAST(i = 0 AS INTEGER) AS isFrontPage
FROM (SELECT localId, doc_id, unnest(range(nImages)) AS i FROM Imported)""")
def _q_post_images(t, spark, sf):
    return IN.post_images(IN.import_posts(_raw(spark, sf)))


@register("import_rejects", "WITH " + TWEETS_CTE.strip() + """
SELECT id AS postId, url AS postLink, username AS pageName, studyId, 'missing_username' AS reason,
       CAST(NULL AS VARCHAR) AS record
FROM Tw WHERE username IS NULL""")
def _q_import_rejects(t, spark, sf):
    return IN.import_rejects(_raw(spark, sf))


@register("import_summary", "WITH " + TWEETS_CTE.strip() + """,
S AS (SELECT studyId,
             COUNT(*) FILTER (WHERE id IS NOT NULL AND url IS NOT NULL AND username IS NOT NULL) AS inserted,
             COUNT(*) FILTER (WHERE NOT (id IS NOT NULL AND url IS NOT NULL AND username IS NOT NULL)) AS failed
      FROM Tw GROUP BY studyId)
SELECT studyId, inserted, failed,
       CASE WHEN failed > 0 AND inserted = 0 THEN 'error' ELSE 'created' END AS outcome,
       CASE WHEN failed > 0 AND inserted = 0 THEN NULL
            ELSE concat('Importação concluída. ', CAST(inserted AS VARCHAR), ' publicações inseridas.') END AS message
FROM S""")
def _q_import_summary(t, spark, sf):
    return IN.import_summary(_raw(spark, sf))


# The feed as array files, six batches with faults: elements that don't parse (some with brackets
# that don't add up), without id or link, and one batch without any user name.
ARRAYS_CTE = TWEETS_CTE.strip() + """,
Element AS (
  SELECT doc_id % 6 AS studyId, text, likes, nImages,
         CASE WHEN doc_id % 211 = 17 THEN '{"id": "' || id || '", "user": {'
              WHEN doc_id % 41 = 3 THEN '{"id": "' || id || '", "likes": many}' END AS record,
         CASE WHEN doc_id % 43 <> 5 THEN id END AS id,
         CASE WHEN doc_id % 47 <> 9 THEN url END AS url,
         CASE WHEN doc_id % 6 <> 5 THEN username END AS username
  FROM Tw),
Arrived AS (
  SELECT studyId, record, CASE WHEN record IS NULL THEN id END AS id, CASE WHEN record IS NULL THEN url END AS url,
         CASE WHEN record IS NULL THEN username END AS username, CASE WHEN record IS NULL THEN text END AS text,
         CASE WHEN record IS NULL THEN likes END AS likes, CASE WHEN record IS NULL THEN nImages ELSE 0 END AS nImages
  FROM Element)"""


def _arrays(spark, sf):
    d = read_table(spark, sf, "documents")
    at = F.col("id").cast("bigint") - F.lit(ID_BASE)
    t = tweets_from_documents(d).withColumn("at", at)
    head = F.concat(F.lit('{"id": "'), F.col("id"))
    sound = F.struct(F.when(F.col("at") % 43 != 5, F.col("id")).alias("id"),
                     F.when(F.col("at") % 47 != 9, F.col("url")).alias("url"),
                     F.when(F.col("at") % 6 != 5, F.col("username")).alias("username"),
                     *[c for c in t.columns if c not in ("id", "url", "username", "at")])
    element = (F.when(F.col("at") % 211 == 17, F.concat(head, F.lit('", "user": {')))
               .when(F.col("at") % 41 == 3, F.concat(head, F.lit('", "likes": many}')))
               .otherwise(F.to_json(sound, {"pretty": "true"})))
    path = os.path.join(ensure_checkpoint_dir(spark), f"arrays-{uuid.uuid4().hex}")
    write_arrays(t.select((F.col("at") % 6).alias("studyId"), "at", element.alias("object")), path,
                 int(spark.conf.get("spark.sql.shuffle.partitions")))
    study = F.regexp_extract("file", r"studyId=(\d+)", 1).cast("bigint")
    return read_posts_array(spark, path).withColumn("studyId", study)


@register("read_posts_array", "WITH " + ARRAYS_CTE + """
SELECT studyId, record, id, url, username, text, likes, nImages FROM Arrived""")
def _q_read_posts_array(t, spark, sf):
    """Array files that many tasks read, faulty elements included."""
    n = F.coalesce(F.size("images"), F.lit(0))
    return _arrays(spark, sf).select("studyId", F.col("_corrupt_record").alias("record"), "id", "url", "username",
                                     "text", "likes", F.greatest(n, F.lit(0)).alias("nImages"))


@register("import_rejects_array", "WITH " + ARRAYS_CTE + """
SELECT id AS postId, url AS postLink, username AS pageName, studyId, record,
       CASE WHEN record IS NOT NULL THEN 'malformed' WHEN id IS NULL THEN 'missing_id'
            WHEN url IS NULL THEN 'missing_url' ELSE 'missing_username' END AS reason
FROM Arrived WHERE record IS NOT NULL OR id IS NULL OR url IS NULL OR username IS NULL""")
def _q_import_rejects_array(t, spark, sf):
    return IN.import_rejects(_arrays(spark, sf))


@register("import_summary_array", "WITH " + ARRAYS_CTE + """,
Told AS (SELECT studyId, count(*) AS n, count(CASE WHEN id || url || username <> '' THEN 1 END) AS inserted
         FROM Arrived GROUP BY studyId)
SELECT studyId, inserted, n - inserted AS failed, if(inserted = 0, 'error', 'created') AS outcome,
       if(inserted = 0, NULL, format('Importação concluída. {} publicações inseridas.', inserted)) AS message
FROM Told""")
def _q_import_summary_array(t, spark, sf):
    """One batch of the six holds no post that can be imported."""
    return IN.import_summary(_arrays(spark, sf))


@register("match_images_by_link", "WITH " + TWEETS_CTE.strip() + """,
FirstPost AS (SELECT url AS postLink, MIN(localId) AS postId FROM Imported GROUP BY url)
SELECT Tw.url AS postLink, f.postId,
       CASE WHEN f.postId IS NULL THEN 'not_found' WHEN Tw.nImages = 0 THEN 'no_images' ELSE 'matched' END AS status,
       CAST(Tw.nImages AS BIGINT) AS nImages
FROM Tw LEFT JOIN FirstPost f ON f.postLink = Tw.url""")
def _q_match_images_by_link(t, spark, sf):
    raw = _raw(spark, sf)
    return IN.match_images_by_link(raw, IN.import_posts(raw))


@register("matched_image_rows", "WITH " + TWEETS_CTE.strip() + """,
FirstPost AS (SELECT url AS postLink, MIN(localId) AS postId FROM Imported GROUP BY url)
SELECT postId, pos::INTEGER AS pos, 'https://img.test/' || doc_id || '/' || pos || '.jpg' AS url,
       (pos = 0)::INTEGER AS isFrontPage
FROM (SELECT doc_id, url, unnest(range(nImages)) AS pos FROM Tw) JOIN FirstPost ON postLink = url""")
def _q_matched_image_rows(t, spark, sf):
    raw = _raw(spark, sf)
    return IN.matched_image_rows(raw, IN.import_posts(raw))


@register("page_post_counts", "WITH " + TWEETS_CTE.strip() + """
SELECT username AS page, COUNT(*) AS posts FROM Tw
WHERE CAST(substr(timestamp, 1, 10) AS DATE) BETWEEN DATE '2025-01-15' AND DATE '2025-03-10'
GROUP BY username""")
def _q_page_post_counts(t, spark, sf):
    return IN.page_post_counts(_raw(spark, sf))


@register("load_tables", """
SELECT c.userId, c.postId, c.questionId, c.categoryId, c.createdAt, q.studyId
FROM ann_classification c JOIN ann_question q ON q.id = c.questionId""")
def _q_load_tables(t, spark, sf):
    """Sink then source: the study tables are written (post and classification
    partitioned by study) and the classification table is read back."""
    base = os.path.join(ensure_checkpoint_dir(spark), f"tables-{uuid.uuid4().hex}")
    write_tables({"post": t["post"], "classification": t["classification"]}, base, question=t["question"])
    back = load_tables(spark, base, names=["classification"])["classification"]
    return back.select("userId", "postId", "questionId", "categoryId", "createdAt", "studyId")


@register("write_tables", """
SELECT id, pageName, pageLink, postLink, postId, details, likesCount, commentsCount, sharesCount, isRetweet,
       socialName, studyId
FROM ann_post""")
def _q_write_tables(t, spark, sf):
    """Sink for every study table; the post table is read back from its
    studyId-partitioned folder."""
    base = os.path.join(ensure_checkpoint_dir(spark), f"tables-{uuid.uuid4().hex}")
    tables = {k: t[k] for k in ("study", "user", "user_study", "post", "image", "question", "categories",
                                "classification")}
    write_tables(tables, base, question=t["question"])
    back = load_tables(spark, base, names=["post"])["post"]
    return back.select("id", "pageName", "pageLink", "postLink", "postId", "details", "likesCount", "commentsCount",
                       "sharesCount", "isRetweet", "socialName", "studyId")
