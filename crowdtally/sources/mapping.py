"""Annotation tables derived from the driver's TPC-H-like parquet tables.

The driver data holds no annotation study, so every study table is derived
from a generic table by a fixed rule.  Each rule exists twice: as Spark
DataFrame code (``annotation_tables``) and as DuckDB/ANSI SQL text
(``MAPPING_SQL``) that the oracle queries put in front of their own SQL.
Every rule reads its whole source table; no row of the source is dropped.

Fixed values of the mapping (ours, chosen so that ties, thresholds, quotas,
null limits and empty feeds all occur at sf0.01):

* studies = regions; owner of even regions 'Supplier#000000000', of odd ones
  'Supplier#000000001'
* minClassificationsPerPost by region 0..4: 8, 10, 20, 26, 30
* maxClassificationsPerUser by region 0..4: NULL, 10, 80, 200, 200
* validationAgreementPercent = 40 + 5 * region
* users = suppliers; type 'investigator' when id % 10 < 2, else 'user'
* membership: user and study ids of equal parity
* posts = parts, study = id % 5; images per post = p_size % 4, third one null
* three questions per study (j = 0 radio, 1 and 2 checkbox), created 2 - j days
  after the study; three categories per question named 'A', 'N', 'R'; of type
  'sentimento' are A and R of j = 0 and N of j = 1, the others 'tematicas'
* submissions = lineitems; category from l_returnflag A/N/R; orders divisible by
  11 tick the next category as well (a second row), those by 97 none (null)
* feed requests: one per user; study id % 5 asked for unless id % 3 = 0 (then
  none, i.e. the default study); history mode when id % 4 = 1
"""

from __future__ import annotations

import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table

# ---------------------------------------------------------------- SQL text --
MAPPING_SQL: dict[str, str] = {
    "ann_study": """
SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS name,
  concat('study ', r_name) AS obs,
  CASE WHEN r_regionkey % 2 = 0 THEN 'Supplier#000000000' ELSE 'Supplier#000000001' END AS addedBy,
  CAST(concat('2024-01-0', CAST(r_regionkey + 1 AS VARCHAR), ' 00:00:00') AS TIMESTAMP) AS createdAt,
  CAST(CASE r_regionkey WHEN 0 THEN 8 WHEN 1 THEN 10 WHEN 2 THEN 20 WHEN 3 THEN 26 ELSE 30 END AS INTEGER)
    AS minClassificationsPerPost,
  CAST(CASE r_regionkey WHEN 0 THEN NULL WHEN 1 THEN 10 WHEN 2 THEN 80 ELSE 200 END AS INTEGER)
    AS maxClassificationsPerUser,
  CAST(40 + 5 * r_regionkey AS INTEGER) AS validationAgreementPercent
FROM region""",
    "ann_user": """
SELECT s_suppkey AS id, s_name AS username,
  concat('user', CAST(s_suppkey AS VARCHAR), '@mail.test') AS email,
  CASE WHEN s_suppkey % 10 < 2 THEN 'investigator' ELSE 'user' END AS type
FROM supplier""",
    "ann_user_study": """
SELECT u.id AS userId, s.id AS studyId
FROM ann_user u JOIN ann_study s ON u.id % 2 = s.id % 2""",
    "ann_post": """
SELECT p_partkey AS id, p_partkey % 5 AS studyId, p_brand AS pageName,
  CASE WHEN p_size % 3 = 0 THEN NULL ELSE concat('https://x.com/', replace(p_brand, '#', '')) END AS pageLink,
  concat('https://x.com/status/', CAST(p_partkey AS VARCHAR)) AS postLink,
  CAST(p_partkey AS VARCHAR) AS postId,
  CASE WHEN p_size % 11 = 0 THEN NULL ELSE p_name END AS details,
  CAST(p_size AS BIGINT) AS likesCount,
  CAST(p_size % 7 AS BIGINT) AS commentsCount,
  CAST(floor(p_retailprice) AS BIGINT) AS sharesCount,
  0 AS isRetweet, 'Twitter' AS socialName
FROM part""",
    "ann_image": """
SELECT postId, postId * 4 + pos AS imageId,
  CASE WHEN pos = 2 THEN NULL ELSE CAST(concat(p_name, ' #', CAST(pos AS VARCHAR)) AS BLOB) END AS image_data,
  CAST(pos = 0 AS INTEGER) AS isFrontPage
FROM (SELECT p_partkey AS postId, p_name, unnest(range(CAST(p_size % 4 AS BIGINT))) AS pos FROM part)""",
    "ann_question": """
SELECT s.id * 3 + q.j + 1 AS id, s.id AS studyId, q.j AS j,
  concat('Q', CAST(q.j AS VARCHAR)) AS question,
  CASE WHEN q.j = 0 THEN 'radio' ELSE 'checkbox' END AS inputType,
  s.createdAt + to_days(CAST(2 - q.j AS INTEGER)) AS createdAt
FROM ann_study s CROSS JOIN (SELECT 0 AS j UNION ALL SELECT 1 UNION ALL SELECT 2) q""",
    "ann_categories": """
SELECT q.id * 3 + k.k AS id, k.name AS name,
  CASE WHEN (q.j = 0 AND k.k <> 1) OR (q.j = 1 AND k.k = 1) THEN 'sentimento' ELSE 'tematicas' END AS categoryType,
  q.id AS questionId
FROM ann_question q CROSS JOIN (SELECT 0 AS k, 'A' AS name UNION ALL SELECT 1, 'N' UNION ALL SELECT 2, 'R') k""",
    "ann_submission": """
SELECT l_orderkey AS submissionId, l_suppkey AS userId, l_partkey AS postId, q AS questionId,
  CASE WHEN l_orderkey % 97 <> 0 THEN q * 3 + (strpos('ANR', l_returnflag) - 1 + again) % 3 END AS categoryId,
  l_shipdate AS createdAt
FROM (SELECT *, (l_partkey % 5) * 3 + (l_linenumber % 3) + 1 AS q FROM lineitem)
JOIN (SELECT 0 AS again UNION ALL SELECT 1) ON again = 0 OR l_orderkey % 11 = 0""",
    "ann_feed_request": """
SELECT id AS userId, CASE WHEN id % 3 = 0 THEN NULL ELSE id % 5 END AS requestedStudyId,
  (id % 4 = 1) AS includeClassified
FROM ann_user""",
    "ann_classification": """
SELECT userId, postId, questionId, categoryId, max(createdAt) AS createdAt
FROM ann_submission WHERE categoryId IS NOT NULL GROUP BY userId, postId, questionId, categoryId""",
}

VIEW_ORDER = ["ann_study", "ann_user", "ann_user_study", "ann_post", "ann_image",
              "ann_question", "ann_categories", "ann_submission", "ann_feed_request", "ann_classification"]


def with_views(sql: str, views: list[str] | None = None) -> str:
    """Prefix ``sql`` (which may itself start with ``WITH``) with the mapping views."""
    names = VIEW_ORDER if views is None else [v for v in VIEW_ORDER if v in views]
    head = ",\n".join(f"{n} AS ({MAPPING_SQL[n].strip()})" for n in names)
    body = sql.strip()
    if body[:14].upper() == "WITH RECURSIVE":
        return f"WITH RECURSIVE {head},\n{body[14:].lstrip()}"
    if body[:4].upper() == "WITH":
        return f"WITH {head},\n{body[4:].lstrip()}"
    return f"WITH {head}\n{body}"


# ------------------------------------------------------------ DataFrames --
def _study(region: DataFrame) -> DataFrame:
    k = F.col("r_regionkey")
    return region.select(
        k.cast("bigint").alias("id"),
        F.col("r_name").alias("name"),
        F.concat(F.lit("study "), F.col("r_name")).alias("obs"),
        F.when(k % 2 == 0, F.lit("Supplier#000000000")).otherwise(F.lit("Supplier#000000001")).alias("addedBy"),
        F.concat(F.lit("2024-01-0"), (k + 1).cast("string"), F.lit(" 00:00:00"))
        .cast("timestamp_ntz").alias("createdAt"),
        F.when(k == 0, 8).when(k == 1, 10).when(k == 2, 20).when(k == 3, 26).otherwise(30)
        .cast("int").alias("minClassificationsPerPost"),
        F.when(k == 0, F.lit(None)).when(k == 1, 10).when(k == 2, 80).otherwise(200)
        .cast("int").alias("maxClassificationsPerUser"),
        (F.lit(40) + 5 * k).cast("int").alias("validationAgreementPercent"),
    )


def _user(supplier: DataFrame) -> DataFrame:
    i = F.col("s_suppkey")
    return supplier.select(
        i.alias("id"), F.col("s_name").alias("username"),
        F.concat(F.lit("user"), i.cast("string"), F.lit("@mail.test")).alias("email"),
        F.when(i % 10 < 2, F.lit("investigator")).otherwise(F.lit("user")).alias("type"),
    )


def _user_study(user: DataFrame, study: DataFrame) -> DataFrame:
    # (u + s) % 2 = 0  <=>  equal parity: an equi-join, not a product.
    u = user.select(F.col("id").alias("userId"), (F.col("id") % 2).alias("_par"))
    s = study.select(F.col("id").alias("studyId"), (F.col("id") % 2).alias("_par"))
    return u.join(s, "_par").select("userId", "studyId")


def _post(part: DataFrame) -> DataFrame:
    pk, size = F.col("p_partkey"), F.col("p_size")
    return part.select(
        pk.alias("id"), (pk % 5).alias("studyId"), F.col("p_brand").alias("pageName"),
        F.when(size % 3 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("https://x.com/"), F.replace(F.col("p_brand"), F.lit("#"), F.lit(""))))
        .alias("pageLink"),
        F.concat(F.lit("https://x.com/status/"), pk.cast("string")).alias("postLink"),
        pk.cast("string").alias("postId"),
        F.when(size % 11 == 0, F.lit(None).cast("string")).otherwise(F.col("p_name")).alias("details"),
        size.cast("bigint").alias("likesCount"),
        (size % 7).cast("bigint").alias("commentsCount"),
        F.floor("p_retailprice").cast("bigint").alias("sharesCount"),
        F.lit(0).alias("isRetweet"), F.lit("Twitter").alias("socialName"),
    )


def _image(part: DataFrame) -> DataFrame:
    x = part.select(
        F.col("p_partkey").alias("postId"), "p_name",
        F.posexplode(F.array_repeat(F.lit(1), (F.col("p_size") % 4).cast("int"))).alias("pos", "_one"))
    return x.select(
        "postId", (F.col("postId") * 4 + F.col("pos")).alias("imageId"),
        F.when(F.col("pos") == 2, F.lit(None).cast("binary"))
        .otherwise(F.concat(F.col("p_name"), F.lit(" #"), F.col("pos").cast("string")).cast("binary"))
        .alias("image_data"),
        (F.col("pos") == 0).cast("int").alias("isFrontPage"),
    )


def _question(study: DataFrame) -> DataFrame:
    q = study.select(F.col("id").alias("studyId"), F.col("createdAt").alias("_made"),
                     F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("j"))
    return q.select(
        (F.col("studyId") * 3 + F.col("j") + 1).alias("id"), "studyId", "j",
        F.concat(F.lit("Q"), F.col("j").cast("string")).alias("question"),
        F.when(F.col("j") == 0, F.lit("radio")).otherwise(F.lit("checkbox")).alias("inputType"),
        (F.col("_made") + F.make_dt_interval(days=2 - F.col("j"))).alias("createdAt"),
    )


def _categories(question: DataFrame) -> DataFrame:
    names = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(n).alias("name")) for k, n in enumerate("ANR")])
    c = question.select(F.col("id").alias("questionId"), "j", F.explode(names).alias("kn"))
    j, k = F.col("j"), F.col("kn.k")
    return c.select(
        (F.col("questionId") * 3 + k).alias("id"), F.col("kn.name").alias("name"),
        F.when(((j == 0) & (k != 1)) | ((j == 1) & (k == 1)), F.lit("sentimento")).otherwise(F.lit("tematicas"))
        .alias("categoryType"),
        "questionId",
    )


def _submission(lineitem: DataFrame) -> DataFrame:
    q = (F.col("l_partkey") % 5) * 3 + (F.col("l_linenumber") % 3) + 1
    flag = (F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2))
    ticks = F.when(F.col("l_orderkey") % 11 == 0, F.array(flag, (flag + 1) % 3)).otherwise(F.array(flag))
    return lineitem.select(
        F.col("l_orderkey").alias("submissionId"), F.col("l_suppkey").alias("userId"),
        F.col("l_partkey").alias("postId"), q.alias("questionId"), F.explode(ticks).alias("_tick"),
        F.col("l_shipdate").alias("createdAt"),
    ).select("submissionId", "userId", "postId", "questionId",
             F.when(F.col("submissionId") % 97 != 0, F.col("questionId") * 3 + F.col("_tick")).alias("categoryId"),
             "createdAt")


def _feed_request(user: DataFrame) -> DataFrame:
    i = F.col("id")
    return user.select(i.alias("userId"),
                       F.when(i % 3 == 0, F.lit(None).cast("bigint")).otherwise(i % 5).alias("requestedStudyId"),
                       (i % 4 == 1).alias("includeClassified"))


def classification_from_submissions(submission: DataFrame) -> DataFrame:
    """Distinct answer rows; partial aggregation keeps the shuffle small."""
    return (submission.where(F.col("categoryId").isNotNull())
            .groupBy("userId", "postId", "questionId", "categoryId")
            .agg(F.max("createdAt").alias("createdAt")))


def submission_bodies(submission: DataFrame, categories: DataFrame,
                      dealt: tuple = ("userId", "postId", "questionId")) -> DataFrame:
    """Request bodies: the rows of one (submissionId, user, post, question), thematic
    ids in ``categoryIds`` and sentiment ids in ``sentimentoCategoryIds``.

    The rows are dealt by (user, post, question), which is enough for this grouping
    and for the latest state, so both need this one exchange only.  ``dealt`` names other
    arguments of ``repartition``, with columns among these three."""
    c = categories.select(F.col("id").alias("categoryId"), "categoryType")
    j = submission.join(c, "categoryId", "left")
    pick = lambda t: F.sort_array(F.collect_list(F.when(F.col("categoryType") == t, F.col("categoryId"))))
    return (j.repartition(*dealt).groupBy("submissionId", "userId", "postId", "questionId")
            .agg(pick("tematicas").alias("categoryIds"), pick("sentimento").alias("sentimentoCategoryIds"),
                 F.max("createdAt").alias("createdAt")))


def legacy_bodies(bodies: DataFrame, question: DataFrame, user: DataFrame) -> DataFrame:
    """Legacy request bodies: study instead of question, username as userId."""
    q = question.select(F.col("id").alias("questionId"), "studyId")
    u = user.select(F.col("id").alias("_uid"), "username")
    return (bodies.join(q, "questionId", "left").join(u, bodies["userId"] == u["_uid"], "left")
            .select("submissionId", "postId", "studyId", "categoryIds", "sentimentoCategoryIds",
                    F.col("username").alias("userId"), "createdAt"))


_BUILT: "weakref.WeakKeyDictionary[SparkSession, dict]" = weakref.WeakKeyDictionary()


def annotation_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """All annotation tables for one scale-factor folder, as lazy DataFrames.

    Built once per session object and folder, like registering views: the frames
    are plans, not data, so every query still reads the files."""
    built = _BUILT.setdefault(spark, {})
    if sf_dir not in built:
        built[sf_dir] = _build_tables(spark, sf_dir)
    return dict(built[sf_dir])


def _build_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    study = _study(read_table(spark, sf_dir, "region"))
    user = _user(read_table(spark, sf_dir, "supplier"))
    part = read_table(spark, sf_dir, "part")
    question = _question(study)
    submission = _submission(read_table(spark, sf_dir, "lineitem"))
    return {
        "study": study,
        "user": user,
        "user_study": _user_study(user, study),
        "post": _post(part),
        "image": _image(part),
        "question": question,
        "categories": _categories(question),
        "submission": submission,
        "classification": classification_from_submissions(submission),
        "feed_request": _feed_request(user),
    }
