"""Registered queries of the batch-validation / maintenance family.

Candidate batches are derived from the driver tables by fixed rules (ours):
categories and questions from ``documents`` (whole texts as the raw type and
content), studies, study updates and users from ``customer``, memberships and
post changes from ``orders``.  ``batchOrder`` is the source key.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import slug
from ..operators import validate as V
from ..sources.tables import read_table
from .registry import register

# ---- candidate batches (Spark) ------------------------------------------------


def category_candidates(spark, sf):
    d = read_table(spark, sf, "documents")
    i = F.col("doc_id")
    return d.select(
        i.alias("batchOrder"),
        F.when(i % 13 == 0, F.lit(None).cast("string")).when(i % 7 == 0, F.lit("A"))
        .otherwise(F.concat(F.lit("c"), (i % 40).cast("string"))).alias("name"),
        F.when(i % 9 == 0, F.lit("123")).otherwise(F.col("text")).alias("categoryType"),
        (i % 17).alias("questionId"))


def question_candidates(spark, sf):
    d = read_table(spark, sf, "documents")
    i = F.col("doc_id")
    return d.select(
        i.alias("batchOrder"),
        F.when(i % 6 == 0, F.concat(F.lit(" q"), (i % 3).cast("string"), F.lit(" ")))
        .otherwise(F.concat(F.lit("Question "), (i % 50).cast("string"))).alias("question"),
        F.col("text").alias("content"), F.lit("radio").alias("inputType"), (i % 5).alias("studyId"))


def study_candidates(spark, sf):
    c = read_table(spark, sf, "customer")
    k = F.col("c_custkey")
    return c.select(
        k.alias("batchOrder"),
        F.when(k % 6 == 0, F.lit("ASIA")).when(k % 6 == 1, F.concat(F.lit("Study "), F.col("c_mktsegment")))
        .otherwise(F.col("c_name")).alias("name"),
        F.when(k % 7 == 3, F.lit(None).cast("string")).otherwise(F.lit("Supplier#000000000")).alias("addedBy"))


def study_updates(spark, sf):
    c = read_table(spark, sf, "customer")
    k = F.col("c_custkey")
    return c.select(
        k.alias("id"),
        F.when(k % 4 == 0, F.lit("")).otherwise(F.col("c_nationkey").cast("string")).alias("minClassificationsPerPost"),
        F.when(k % 3 == 0, F.lit("")).otherwise((k % 90).cast("string")).alias("maxClassificationsPerUser"),
        F.when(k % 5 == 0, F.lit("")).otherwise((k % 100).cast("string")).alias("validationAgreementPercent"),
        F.when(k % 2 == 0, F.lit("  ")).otherwise(F.lit("2025-03-10")).alias("finishedAt"))


def user_candidates(spark, sf):
    c = read_table(spark, sf, "customer")
    k = F.col("c_custkey")
    return c.select(
        k.alias("batchOrder"),
        F.when(k % 50 == 0, F.lit("Supplier#000000003"))
        .otherwise(F.concat(F.lit("cust"), (k % 700).cast("string"))).alias("username"),
        F.when(k % 31 == 0, F.lit("")).otherwise(F.lit("pw")).alias("password"),
        F.when(k % 77 == 0, F.lit("user5@mail.test"))
        .otherwise(F.concat(F.lit("c"), (k % 900).cast("string"), F.lit("@mail.test"))).alias("email"),
        F.lit("user").alias("type"),
        F.when(k % 2 == 0, F.lit(None).cast("string")).otherwise(F.lit("admin2")).alias("createdBy"))


def membership_candidates(spark, sf):
    o = read_table(spark, sf, "orders")
    k = F.col("o_orderkey")
    return o.select(k.alias("batchOrder"), (F.col("o_custkey") % 120).alias("userId"), (k % 6).alias("studyId"))


def post_changes(spark, sf):
    o = read_table(spark, sf, "orders")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("batchOrder"),
        F.when(F.col("o_orderstatus") == "F", F.lit("update")).when(F.col("o_orderstatus") == "O", F.lit("delete"))
        .otherwise(F.lit("insert")).alias("op"),
        (k % 2600).alias("id"),
        F.when(k % 3 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("edit "), k.cast("string")))
        .alias("details"),
        F.when(k % 4 == 0, F.lit(None).cast("bigint")).otherwise(F.floor("o_totalprice").cast("bigint") % 100)
        .alias("likesCount"),
        F.when(k % 8 == 4, F.array(F.lit("likesCount"))).when(k % 9 == 0, F.array(F.lit("details")))
        .alias("clear"))


# ---- candidate batches (SQL) -------------------------------------------------
#: Fixed value: the characters that JavaScript's \\s stands for, as ranges.
WS = ("[\\x{9}-\\x{d}\\x{20}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}"
      "\\x{3000}\\x{feff}]")
SLUG_SQL = ("substr(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace("
            "lower(strip_accents(COALESCE({x}, ''))), '^{ws}+|{ws}+$', '', 'g'), '{ws}+', '-', 'g'), "
            "'[^a-z0-9_-]', '', 'g'), '[0-9]+', '', 'g'), '-+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 30)")

CAT_CANDS = """
Cands AS (
  SELECT doc_id AS batchOrder,
         CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN 'A'
              ELSE concat('c', CAST(doc_id % 40 AS VARCHAR)) END AS name,
         CASE WHEN doc_id % 9 = 0 THEN '123' ELSE text END AS categoryType,
         doc_id % 17 AS questionId
  FROM documents)"""

FIRST_WINS = """
  CASE WHEN reason0 IS NULL AND batchOrder <> MIN(CASE WHEN reason0 IS NULL THEN batchOrder END)
                                                OVER (PARTITION BY {keys})
       THEN 'duplicate_in_batch' ELSE reason0 END AS reason"""


#: Replays updates one by one.  ``Rows`` (id, k1, k2) are the stored rows, ``Asked`` the
#: candidates with their keys, ``reason0`` and ``writes``; a step carries who holds what, and
#: whether the table knew it (s1, s2).
REPLAY = """,
Numbered AS (SELECT *, row_number() OVER (ORDER BY batchOrder) AS n FROM Asked WHERE reason0 IS NULL),
Replay AS (
  SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS batchOrder, CAST(NULL AS VARCHAR) AS outcome,
         (SELECT list({'id': id, 'k1': k1, 'k2': k2, 's1': true, 's2': true}) FROM Rows) AS held
  UNION ALL
  SELECT n, batchOrder, CASE WHEN len(others) = 0 THEN NULL
           WHEN len(list_filter(others, lambda o: (o.k1 = k1 AND o.s1) OR (o.k2 = k2 AND o.s2))) > 0 THEN 'held'
           ELSE 'won' END,
         CASE WHEN len(others) > 0 OR NOT writes THEN held
              ELSE list_transform(held, lambda h: CASE WHEN h.id <> id THEN h
                   ELSE {'id': h.id, 'k1': k1, 'k2': k2, 's1': h.s1 AND h.k1 = k1, 's2': h.s2 AND h.k2 = k2} END) END
  FROM (SELECT c.n, c.batchOrder, c.id, c.k1, c.k2, c.writes, held,
               list_filter(held, lambda h: h.id <> c.id AND (h.k1 = c.k1 OR COALESCE(h.k2 = c.k2, false))) AS others
        FROM Replay r JOIN Numbered c ON c.n = r.n + 1))"""


@register("category_slug", "WITH " + CAT_CANDS.strip() + f"""
SELECT batchOrder, {SLUG_SQL.format(x="categoryType", ws=WS)} AS normalizedType FROM Cands""")
def _q_category_slug(t, spark, sf):
    c = category_candidates(spark, sf)
    return c.select("batchOrder", slug("categoryType").alias("normalizedType"))


@register("category_type_valid", "WITH " + CAT_CANDS.strip() + f""",
S AS (SELECT batchOrder, {SLUG_SQL.format(x="categoryType", ws=WS)} AS normalizedType FROM Cands)
SELECT batchOrder, normalizedType, COALESCE(regexp_matches(normalizedType, '^[a-z][a-z_-]{{1,29}}$'), false) AS valid
FROM S""")
def _q_category_type_valid(t, spark, sf):
    from ..functions.text import type_valid
    c = category_candidates(spark, sf).select("batchOrder", slug("categoryType").alias("normalizedType"))
    return c.withColumn("valid", type_valid("normalizedType"))


def _category_import_sql(legacy: bool) -> str:
    taken = ("EXISTS (SELECT 1 FROM ann_categories c2 JOIN ann_question q2 ON q2.id = c2.questionId "
             "WHERE c2.name = x.name" + ("" if legacy else " AND q2.studyId = x.studyId") + ")")
    keys = "name" if legacy else "name, studyId"
    return "WITH " + CAT_CANDS.strip() + f""",
X AS (
  SELECT c.batchOrder, c.name, c.categoryType, c.questionId, q.studyId, q.id AS qid,
         {SLUG_SQL.format(x="c.categoryType", ws=WS)} AS normalizedType
  FROM Cands c LEFT JOIN ann_question q ON q.id = c.questionId),
R AS (
  SELECT x.*,
         CASE WHEN x.name IS NULL OR x.name = '' OR x.categoryType IS NULL OR x.categoryType = ''
                   OR x.questionId IS NULL OR x.questionId = 0 THEN 'missing_fields'
              WHEN x.normalizedType = '' OR NOT regexp_matches(x.normalizedType, '^[a-z][a-z_-]{{1,29}}$')
                   THEN 'invalid_type'
              WHEN x.qid IS NULL THEN 'unknown_question'
              WHEN {taken} THEN 'name_taken' END AS reason0
  FROM X x)
SELECT batchOrder, name, categoryType, questionId, normalizedType, studyId,
{FIRST_WINS.format(keys=keys)}
FROM R"""


@register("category_import", _category_import_sql(False))
def _q_category_import(t, spark, sf):
    return V.category_import(category_candidates(spark, sf), t["categories"], t["question"])


@register("category_import_legacy", _category_import_sql(True))
def _q_category_import_legacy(t, spark, sf):
    return V.category_import(category_candidates(spark, sf), t["categories"], t["question"], legacy_global_names=True)


@register("question_import", """
WITH Cands AS (
  SELECT doc_id AS batchOrder,
         CASE WHEN doc_id % 6 = 0 THEN concat(' q', CAST(doc_id % 3 AS VARCHAR), ' ')
              ELSE concat('Question ', CAST(doc_id % 50 AS VARCHAR)) END AS question,
         text AS content, 'radio' AS inputType, doc_id % 5 AS studyId
  FROM documents),
R AS (
  SELECT c.*, lower(trim(c.question)) AS k,
         CASE WHEN c.question IS NULL OR c.question = '' OR c.content IS NULL OR c.content = ''
                   OR c.inputType IS NULL OR c.inputType = '' OR c.studyId IS NULL OR c.studyId = 0
                   THEN 'missing_fields'
              WHEN EXISTS (SELECT 1 FROM ann_question q WHERE q.studyId = c.studyId
                           AND lower(trim(q.question)) = lower(trim(c.question))) THEN 'name_taken' END AS reason0
  FROM Cands c)
SELECT batchOrder, question, content, inputType, studyId,""" + FIRST_WINS.format(keys="studyId, k") + """
FROM R""")
def _q_question_import(t, spark, sf):
    return V.question_import(question_candidates(spark, sf), t["question"])


@register("study_import", """
WITH Cands AS (
  SELECT c_custkey AS batchOrder,
         CASE WHEN c_custkey % 6 = 0 THEN 'ASIA' WHEN c_custkey % 6 = 1 THEN concat('Study ', c_mktsegment)
              ELSE c_name END AS name,
         CASE WHEN c_custkey % 7 = 3 THEN NULL ELSE 'Supplier#000000000' END AS addedBy
  FROM customer),
R AS (
  SELECT c.*,
         CASE WHEN c.name IS NULL OR c.name = '' OR c.addedBy IS NULL OR c.addedBy = '' THEN 'missing_fields'
              WHEN EXISTS (SELECT 1 FROM ann_study s WHERE s.name = c.name) THEN 'name_taken' END AS reason0
  FROM Cands c)
SELECT batchOrder, name, addedBy,""" + FIRST_WINS.format(keys="name") + """
FROM R""")
def _q_study_import(t, spark, sf):
    return V.study_import(study_candidates(spark, sf), t["study"])


@register("study_clean", """
SELECT c_custkey AS id,
       TRY_CAST(CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CAST(c_nationkey AS VARCHAR) END AS INTEGER)
         AS minClassificationsPerPost,
       TRY_CAST(CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE CAST(c_custkey % 90 AS VARCHAR) END AS INTEGER)
         AS maxClassificationsPerUser,
       TRY_CAST(CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(c_custkey % 100 AS VARCHAR) END AS INTEGER)
         AS validationAgreementPercent,
       CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE '2025-03-10' END AS finishedAt
FROM customer""")
def _q_study_clean(t, spark, sf):
    return V.study_clean(study_updates(spark, sf))


#: Replays the valid candidates one by one; a step carries the names taken so far.
USER_REPLAY = """,
R AS (
  SELECT c.*,
         CASE WHEN c.username IS NULL OR c.username = '' OR c.password IS NULL OR c.password = ''
                   OR c.email IS NULL OR c.email = '' OR c.type IS NULL OR c.type = '' THEN 'missing_fields'
              WHEN EXISTS (SELECT 1 FROM ann_user u WHERE u.username = c.username OR u.email = c.email)
                   THEN 'username_or_email_taken' END AS reason0
  FROM Cands c),
Valid AS (SELECT *, row_number() OVER (ORDER BY batchOrder) AS n FROM R WHERE reason0 IS NULL),
Replay AS (
  SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS batchOrder, false AS ok,
         CAST([] AS VARCHAR[]) AS names, CAST([] AS VARCHAR[]) AS mails
  UNION ALL
  SELECT n, batchOrder, free, CASE WHEN free THEN list_append(names, username) ELSE names END,
         CASE WHEN free THEN list_append(mails, email) ELSE mails END
  FROM (SELECT v.n, v.batchOrder, v.username, v.email, names, mails,
               NOT list_contains(names, v.username) AND NOT list_contains(mails, v.email) AS free
        FROM Replay r JOIN Valid v ON v.n = r.n + 1))
SELECT R.batchOrder, username, email, type, COALESCE(createdBy, 'admin') AS createdBy,
       CASE WHEN reason0 IS NULL AND NOT ok THEN 'duplicate_in_batch' ELSE reason0 END AS reason
FROM R LEFT JOIN Replay ON Replay.batchOrder = R.batchOrder"""


@register("user_import", """
WITH RECURSIVE Cands AS (
  SELECT c_custkey AS batchOrder,
         CASE WHEN c_custkey % 50 = 0 THEN 'Supplier#000000003'
              ELSE concat('cust', CAST(c_custkey % 700 AS VARCHAR)) END AS username,
         CASE WHEN c_custkey % 31 = 0 THEN '' ELSE 'pw' END AS password,
         CASE WHEN c_custkey % 77 = 0 THEN 'user5@mail.test'
              ELSE concat('c', CAST(c_custkey % 900 AS VARCHAR), '@mail.test') END AS email,
         'user' AS type,
         CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE 'admin2' END AS createdBy
  FROM customer)""" + USER_REPLAY)
def _q_user_import(t, spark, sf):
    return V.user_import(user_candidates(spark, sf), t["user"])


@register("user_import_conflicts", """
WITH RECURSIVE Cands AS (
  SELECT c_custkey AS batchOrder, concat('n', c_custkey * 7 % 41 + c_custkey % 30) AS username, 'pw' AS password,
         concat('m', c_custkey * c_custkey % 53 + c_custkey % 20) AS email, 'user' AS type, c_mktsegment AS createdBy
  FROM customer)""" + USER_REPLAY)
def _q_user_import_conflicts(t, spark, sf):
    """A batch in which refused candidates often share a key with acceptable ones."""
    c = read_table(spark, sf, "customer")
    k = F.col("c_custkey")
    cands = c.select(
        k.alias("batchOrder"), F.concat(F.lit("n"), (k * 7 % 41 + k % 30).cast("string")).alias("username"),
        F.lit("pw").alias("password"),
        F.concat(F.lit("m"), (k * k % 53 + k % 20).cast("string")).alias("email"),
        F.lit("user").alias("type"), F.col("c_mktsegment").alias("createdBy"))
    return V.user_import(cands, t["user"])


@register("membership_import", """
WITH Cands AS (SELECT o_orderkey AS batchOrder, o_custkey % 120 AS userId, o_orderkey % 6 AS studyId FROM orders),
R AS (
  SELECT c.*,
         CASE WHEN c.studyId IS NULL OR c.studyId = 0 THEN 'missing_fields'
              WHEN EXISTS (SELECT 1 FROM ann_user_study us WHERE us.userId = c.userId AND us.studyId = c.studyId)
                   THEN 'link_exists' END AS reason0
  FROM Cands c)
SELECT batchOrder, userId, studyId,""" + FIRST_WINS.format(keys="userId, studyId") + """
FROM R""")
def _q_membership_import(t, spark, sf):
    return V.membership_import(membership_candidates(spark, sf), t["user_study"])


#: Replays the batch change by change: step n holds the row after its n-th change.
CHANGES_SQL = """
WITH RECURSIVE Numbered AS (
  SELECT o_orderkey AS batchOrder, o_orderkey % 2600 AS id,
         CASE o_orderstatus WHEN 'F' THEN 'update' WHEN 'O' THEN 'delete' ELSE 'insert' END AS op,
         CASE WHEN o_orderkey % 3 <> 0 THEN concat('edit ', CAST(o_orderkey AS VARCHAR)) END AS newDetails,
         CASE WHEN o_orderkey % 4 <> 0 THEN CAST(floor(o_totalprice) AS BIGINT) % 100 END AS newLikes,
         o_orderkey % 8 = 4 AS clearLikes, o_orderkey % 8 <> 4 AND o_orderkey % 9 = 0 AS clearDetails,
         row_number() OVER (PARTITION BY o_orderkey % 2600 ORDER BY o_orderkey) AS n
  FROM orders),
Steps AS (
  SELECT k.id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS batchOrder, CAST(NULL AS VARCHAR) AS op,
         CAST(NULL AS VARCHAR) AS status, p.id IS NOT NULL AS there, p.pageName, p.details, p.likesCount
  FROM (SELECT id FROM ann_post UNION SELECT id FROM Numbered) k LEFT JOIN ann_post p ON p.id = k.id
  UNION ALL
  SELECT s.id, c.n, c.batchOrder, c.op,
         CASE WHEN c.op = 'insert' THEN CASE WHEN s.there THEN 'id_exists' ELSE 'inserted' END
              WHEN NOT s.there THEN 'not_found' WHEN c.op = 'update' THEN 'updated' ELSE 'deleted' END,
         c.op = 'insert' OR (s.there AND c.op = 'update'),
         CASE WHEN s.there AND c.op <> 'delete' THEN s.pageName END,
         CASE WHEN c.op = 'insert' AND NOT s.there THEN c.newDetails
              WHEN c.op = 'update' AND s.there THEN
                   CASE WHEN c.newDetails IS NOT NULL OR c.clearDetails THEN c.newDetails ELSE s.details END
              WHEN c.op = 'insert' THEN s.details END,
         CASE WHEN c.op = 'insert' AND NOT s.there THEN c.newLikes
              WHEN c.op = 'update' AND s.there THEN
                   CASE WHEN c.newLikes IS NOT NULL OR c.clearLikes THEN c.newLikes ELSE s.likesCount END
              WHEN c.op = 'insert' THEN s.likesCount END
  FROM Steps s JOIN Numbered c ON c.id = s.id AND c.n = s.n + 1)"""


def _post_snapshot(t):
    return t["post"].select("id", "pageName", "details", "likesCount")


@register("apply_changes", CHANGES_SQL.strip() + """
SELECT id, pageName, details, likesCount FROM Steps
WHERE there AND (id, n) IN (SELECT id, max(n) FROM Steps GROUP BY id)""")
def _q_apply_changes(t, spark, sf):
    snap, _ = V.apply_changes(_post_snapshot(t), post_changes(spark, sf))
    return snap


@register("apply_changes_status", CHANGES_SQL.strip() + """
SELECT batchOrder, op, id, status FROM Steps WHERE n > 0""")
def _q_apply_changes_status(t, spark, sf):
    _, stat = V.apply_changes(_post_snapshot(t), post_changes(spark, sf))
    return stat


# ---- update forms (the row's own id does not count as taken) -----------------
def category_updates(spark, sf):
    d = read_table(spark, sf, "documents")
    i = F.col("doc_id")
    return d.select(
        i.alias("batchOrder"), (i % 50).alias("id"),
        F.when(i % 4 == 0, F.lit("A")).when(i % 4 == 1, F.lit("N"))
        .otherwise(F.concat(F.lit("u"), (i % 30).cast("string"))).alias("name"),
        F.lit("tematicas").alias("categoryType"), (i % 15 + 1).alias("questionId"))


@register("category_update", """
WITH RECURSIVE Cands AS (
  SELECT doc_id AS batchOrder, doc_id % 50 AS id,
         CASE WHEN doc_id % 4 = 0 THEN 'A' WHEN doc_id % 4 = 1 THEN 'N'
              ELSE concat('u', CAST(doc_id % 30 AS VARCHAR)) END AS name,
         'tematicas' AS categoryType, doc_id % 15 + 1 AS questionId
  FROM documents),
Rows AS (SELECT c.id, to_json([name, studyId::VARCHAR]) AS k1, NULL::VARCHAR AS k2
         FROM ann_categories c JOIN ann_question q ON q.id = c.questionId),
Asked AS (
  SELECT c.*, q.studyId, 'tematicas' AS normalizedType, to_json([c.name, q.studyId::VARCHAR]) AS k1, NULL::VARCHAR AS k2,
         c.id IN (SELECT id FROM ann_categories) AS writes,
         CASE WHEN q.id IS NULL THEN 'unknown_question' END AS reason0
  FROM Cands c LEFT JOIN ann_question q ON q.id = c.questionId)""" + REPLAY + """
SELECT a.batchOrder, id, name, categoryType, questionId, normalizedType, studyId,
       CASE WHEN reason0 IS NOT NULL THEN reason0 WHEN outcome = 'held' THEN 'name_taken'
            WHEN outcome = 'won' THEN 'duplicate_in_batch' WHEN NOT writes THEN 'not_found' END AS reason
FROM Asked a LEFT JOIN Replay r ON r.batchOrder = a.batchOrder""")
def _q_category_update(t, spark, sf):
    return V.category_import(category_updates(spark, sf), t["categories"], t["question"])


@register("question_update", """
WITH RECURSIVE Cands AS (
  SELECT doc_id AS batchOrder, doc_id % 16 AS id,
         CASE WHEN doc_id % 3 = 0 THEN 'Q1' ELSE concat('New ', CAST(doc_id % 20 AS VARCHAR)) END AS question,
         text AS content, 'radio' AS inputType, doc_id % 5 AS studyId
  FROM documents),
Rows AS (SELECT id, to_json([studyId::VARCHAR, lower(trim(question))]) AS k1, NULL::VARCHAR AS k2 FROM ann_question),
Asked AS (
  SELECT c.*, to_json([studyId::VARCHAR, lower(trim(question))]) AS k1, NULL::VARCHAR AS k2,
         c.id IN (SELECT id FROM ann_question) AS writes,
         CASE WHEN c.question IS NULL OR c.question = '' OR c.content IS NULL OR c.content = ''
                   OR c.studyId IS NULL OR c.studyId = 0 THEN 'missing_fields' END AS reason0
  FROM Cands c)""" + REPLAY + """
SELECT a.batchOrder, id, question, content, inputType, studyId,
       CASE WHEN reason0 IS NOT NULL THEN reason0 WHEN outcome = 'held' THEN 'name_taken'
            WHEN outcome = 'won' THEN 'duplicate_in_batch' WHEN NOT writes THEN 'not_found' END AS reason
FROM Asked a LEFT JOIN Replay r ON r.batchOrder = a.batchOrder""")
def _q_question_update(t, spark, sf):
    d = read_table(spark, sf, "documents")
    i = F.col("doc_id")
    cands = d.select(
        i.alias("batchOrder"), (i % 16).alias("id"),
        F.when(i % 3 == 0, F.lit("Q1")).otherwise(F.concat(F.lit("New "), (i % 20).cast("string"))).alias("question"),
        F.col("text").alias("content"), F.lit("radio").alias("inputType"), (i % 5).alias("studyId"))
    return V.question_import(cands, t["question"])


@register("study_update", """
WITH RECURSIVE Cands AS (
  SELECT c_custkey AS batchOrder, c_custkey % 6 AS id,
         CASE WHEN c_custkey % 4 = 0 THEN 'ASIA' ELSE concat('S', CAST(c_custkey % 50 AS VARCHAR)) END AS name
  FROM customer),
Rows AS (SELECT id, name AS k1, NULL::VARCHAR AS k2 FROM ann_study),
Asked AS (SELECT c.*, name AS k1, NULL::VARCHAR AS k2, id IN (SELECT id FROM ann_study) AS writes,
                 NULL::VARCHAR AS reason0 FROM Cands c)""" + REPLAY + """
SELECT a.batchOrder, id, name, CASE outcome WHEN 'held' THEN 'name_taken' WHEN 'won' THEN 'duplicate_in_batch' END AS reason
FROM Asked a LEFT JOIN Replay r ON r.batchOrder = a.batchOrder""")
def _q_study_update(t, spark, sf):
    c = read_table(spark, sf, "customer")
    k = F.col("c_custkey")
    cands = c.select(k.alias("batchOrder"), (k % 6).alias("id"),
                     F.when(k % 4 == 0, F.lit("ASIA")).otherwise(F.concat(F.lit("S"), (k % 50).cast("string")))
                     .alias("name"))
    return V.study_update(cands, t["study"])


@register("user_rename", """
WITH RECURSIVE Cands AS (
  SELECT c_custkey AS batchOrder, c_custkey % 120 AS id,
         CASE WHEN c_custkey % 5 = 0 THEN concat('Supplier#', lpad(CAST(c_custkey % 100 AS VARCHAR), 9, '0'))
              ELSE concat('nu', CAST(c_custkey % 400 AS VARCHAR)) END AS username,
         concat('user', CAST(c_custkey % 150 AS VARCHAR), '@mail.test') AS email
  FROM customer),
Rows AS (SELECT id, username AS k1, email AS k2 FROM ann_user),
Asked AS (
  SELECT c.*, username AS k1, email AS k2, id IN (SELECT id FROM ann_user) AS writes,
         NULL::VARCHAR AS reason0
  FROM Cands c)""" + REPLAY + """
SELECT a.batchOrder, id, username, email,
       CASE WHEN reason0 IS NOT NULL THEN reason0 WHEN outcome = 'held' THEN 'username_or_email_taken'
            WHEN outcome = 'won' THEN 'duplicate_in_batch' END AS reason
FROM Asked a LEFT JOIN Replay r ON r.batchOrder = a.batchOrder""")
def _q_user_rename(t, spark, sf):
    c = read_table(spark, sf, "customer")
    k = F.col("c_custkey")
    cands = c.select(
        k.alias("batchOrder"), (k % 120).alias("id"),
        F.when(k % 5 == 0, F.concat(F.lit("Supplier#"), F.lpad((k % 100).cast("string"), 9, "0")))
        .otherwise(F.concat(F.lit("nu"), (k % 400).cast("string"))).alias("username"),
        F.concat(F.lit("user"), (k % 150).cast("string"), F.lit("@mail.test")).alias("email"))
    return V.user_rename(cands, t["user"])


@register("category_link_import", """
WITH Links AS (SELECT q.studyId, c.id AS categoryId FROM ann_categories c JOIN ann_question q ON q.id = c.questionId),
Cands AS (SELECT o_orderkey AS batchOrder, o_orderkey % 6 AS studyId, o_custkey % 50 AS categoryId FROM orders),
R AS (
  SELECT c.*,
         CASE WHEN c.studyId = 0 OR c.studyId IS NULL OR c.categoryId = 0 OR c.categoryId IS NULL
              THEN 'missing_fields'
              WHEN EXISTS (SELECT 1 FROM Links l WHERE l.studyId = c.studyId AND l.categoryId = c.categoryId)
              THEN 'link_exists' END AS reason0
  FROM Cands c)
SELECT batchOrder, studyId, categoryId,""" + FIRST_WINS.format(keys="studyId, categoryId") + """
FROM R""")
def _q_category_link_import(t, spark, sf):
    from ..operators.lookups import study_category_links
    o = read_table(spark, sf, "orders")
    cands = o.select(F.col("o_orderkey").alias("batchOrder"), (F.col("o_orderkey") % 6).alias("studyId"),
                     (F.col("o_custkey") % 50).alias("categoryId"))
    links = study_category_links(t["categories"], t["question"])
    return V.membership_import(cands, links, keys=("studyId", "categoryId"), required=("studyId", "categoryId"))


@register("user_update", """
WITH RECURSIVE Cands AS (
  SELECT c_custkey AS batchOrder, c_custkey % 130 AS id,
         CASE WHEN c_custkey % 5 = 0 THEN concat('Supplier#', lpad(CAST(c_custkey % 100 AS VARCHAR), 9, '0'))
              ELSE concat('nu', CAST(c_custkey % 400 AS VARCHAR)) END AS username,
         concat('user', CAST(c_custkey % 150 AS VARCHAR), '@mail.test') AS email,
         CASE WHEN c_custkey % 17 = 0 THEN '' ELSE 'user' END AS type
  FROM customer),
Rows AS (SELECT id, username AS k1, email AS k2 FROM ann_user),
Asked AS (
  SELECT c.*, username AS k1, email AS k2, id IN (SELECT id FROM ann_user) AS writes,
         CASE WHEN c.username IS NULL OR c.username = '' OR c.email IS NULL OR c.email = ''
                   OR c.type IS NULL OR c.type = '' THEN 'missing_fields'
              WHEN c.id NOT IN (SELECT id FROM ann_user) THEN 'not_found' END AS reason0
  FROM Cands c)""" + REPLAY + """
SELECT a.batchOrder, id, username, email, type,
       CASE WHEN reason0 IS NOT NULL THEN reason0 WHEN outcome = 'held' THEN 'username_or_email_taken'
            WHEN outcome = 'won' THEN 'duplicate_in_batch' END AS reason
FROM Asked a LEFT JOIN Replay r ON r.batchOrder = a.batchOrder""")
def _q_user_update(t, spark, sf):
    c = read_table(spark, sf, "customer")
    k = F.col("c_custkey")
    cands = c.select(
        k.alias("batchOrder"), (k % 130).alias("id"),
        F.when(k % 5 == 0, F.concat(F.lit("Supplier#"), F.lpad((k % 100).cast("string"), 9, "0")))
        .otherwise(F.concat(F.lit("nu"), (k % 400).cast("string"))).alias("username"),
        F.concat(F.lit("user"), (k % 150).cast("string"), F.lit("@mail.test")).alias("email"),
        F.when(k % 17 == 0, F.lit("")).otherwise(F.lit("user")).alias("type"))
    return V.user_update(cands, t["user"])


@register("profile_rename", """
WITH RECURSIVE Cands AS (
  SELECT c_custkey AS batchOrder,
         concat('Supplier#', lpad(CAST(c_custkey % 110 AS VARCHAR), 9, '0')) AS currentUsername,
         CASE WHEN c_custkey % 7 = 0 THEN concat('Supplier#', lpad(CAST(c_custkey % 110 AS VARCHAR), 9, '0'))
              WHEN c_custkey % 7 = 1 THEN concat('Supplier#', lpad(CAST(c_custkey % 90 AS VARCHAR), 9, '0'))
              ELSE concat('renamed', CAST(c_custkey % 300 AS VARCHAR)) END AS newUsername
  FROM customer),
Numbered AS (
  SELECT *, newUsername IS NOT NULL AND newUsername <> '' AND newUsername <> currentUsername AS changes,
         row_number() OVER (ORDER BY batchOrder) AS n FROM Cands),
Replay AS (
  SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS batchOrder, CAST(NULL AS VARCHAR) AS currentUsername,
         CAST(NULL AS VARCHAR) AS newUsername, CAST(NULL AS VARCHAR) AS reason,
         (SELECT list(DISTINCT username) FROM ann_user) AS stored, CAST([] AS VARCHAR[]) AS won
  UNION ALL
  SELECT n, batchOrder, currentUsername, newUsername, why,
         CASE WHEN why IS NULL AND changes THEN list_filter(stored, lambda x: x <> currentUsername) ELSE stored END,
         CASE WHEN why IS NULL AND changes
              THEN list_append(list_filter(won, lambda x: x <> currentUsername), newUsername) ELSE won END
  FROM (SELECT c.n, c.batchOrder, c.currentUsername, c.newUsername, c.changes, stored, won,
               CASE WHEN NOT list_contains(stored, c.currentUsername) AND NOT list_contains(won, c.currentUsername)
                    THEN 'not_found'
                    WHEN c.changes AND list_contains(stored, c.newUsername) THEN 'username_or_email_taken'
                    WHEN c.changes AND list_contains(won, c.newUsername) THEN 'duplicate_in_batch' END AS why
        FROM Replay r JOIN Numbered c ON c.n = r.n + 1))
SELECT batchOrder, currentUsername, newUsername, reason FROM Replay WHERE n > 0""")
def _q_profile_rename(t, spark, sf):
    c = read_table(spark, sf, "customer")
    k = F.col("c_custkey")
    sup = lambda m: F.concat(F.lit("Supplier#"), F.lpad((k % m).cast("string"), 9, "0"))
    cands = c.select(
        k.alias("batchOrder"), sup(110).alias("currentUsername"),
        F.when(k % 7 == 0, sup(110)).when(k % 7 == 1, sup(90))
        .otherwise(F.concat(F.lit("renamed"), (k % 300).cast("string"))).alias("newUsername"))
    return V.profile_rename(cands, t["user"])


#: By the last earlier insert or delete of the same link.
MEMBERSHIP_CHANGES_SQL = """
WITH Changes AS (
  SELECT o_orderkey AS batchOrder, CASE WHEN o_orderstatus = 'P' THEN 'insert' ELSE 'delete' END AS op,
         o_custkey % 110 AS userId, o_orderkey % 6 AS studyId
  FROM orders),
Placed AS (
  SELECT c.*, COALESCE(lag(op) OVER (PARTITION BY userId, studyId ORDER BY batchOrder) = 'insert',
                       EXISTS (SELECT 1 FROM ann_user_study o
                               WHERE o.userId = c.userId AND o.studyId = c.studyId)) AS linked,
         batchOrder = max(batchOrder) OVER (PARTITION BY userId, studyId) AS newest
  FROM Changes c)"""


def _membership_changes(spark, sf):
    o = read_table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("batchOrder"),
                    F.when(F.col("o_orderstatus") == "P", F.lit("insert")).otherwise(F.lit("delete")).alias("op"),
                    (F.col("o_custkey") % 110).alias("userId"), (F.col("o_orderkey") % 6).alias("studyId"))


@register("membership_changes", MEMBERSHIP_CHANGES_SQL.strip() + """
SELECT userId, studyId FROM Placed WHERE newest AND op = 'insert'
UNION ALL
SELECT userId, studyId FROM ann_user_study
WHERE (userId, studyId) NOT IN (SELECT userId, studyId FROM Changes)""")
def _q_membership_changes(t, spark, sf):
    """Membership links added and removed by a batch (composite key)."""
    snap, _ = V.apply_changes(t["user_study"], _membership_changes(spark, sf), key=["userId", "studyId"])
    return snap


@register("membership_changes_status", MEMBERSHIP_CHANGES_SQL.strip() + """
SELECT batchOrder, op, userId, studyId,
       CASE WHEN op = 'insert' AND linked THEN 'id_exists' WHEN op = 'insert' THEN 'inserted'
            WHEN linked THEN 'deleted' ELSE 'not_found' END AS status
FROM Placed""")
def _q_membership_changes_status(t, spark, sf):
    _, stat = V.apply_changes(t["user_study"], _membership_changes(spark, sf), key=["userId", "studyId"])
    return stat


# ---- names compared without case and accents -------------------------------------
def _spelled(k, segment, name):
    """Names in several spellings that a collation takes for equal."""
    return (F.when(k % 6 == 0, F.lit("Ásia")).when(k % 6 == 1, F.concat(F.lit("Stúdy "), F.lower(segment)))
            .when(k % 6 == 2, F.concat(F.lit("STUDY "), segment)).when(k % 6 == 3, F.upper(name)).otherwise(name))


SPELLED = """CASE c_custkey % 6 WHEN 0 THEN 'Ásia' WHEN 1 THEN concat('Stúdy ', lower(c_mktsegment))
         WHEN 2 THEN concat('STUDY ', c_mktsegment) WHEN 3 THEN upper(c_name) ELSE c_name END"""


@register("study_import_collated", f"""
WITH Cands AS (SELECT c_custkey AS batchOrder, {SPELLED} AS name, 'Supplier#000000000' AS addedBy FROM customer),
R AS (
  SELECT c.*, lower(strip_accents(c.name)) AS k,
         CASE WHEN EXISTS (SELECT 1 FROM ann_study s WHERE lower(strip_accents(s.name)) = lower(strip_accents(c.name)))
              THEN 'name_taken' END AS reason0
  FROM Cands c)
SELECT batchOrder, name, addedBy,""" + FIRST_WINS.format(keys="k") + """
FROM R""")
def _q_study_import_collated(t, spark, sf):
    from ..operators.collation import with_collation
    c = read_table(spark, sf, "customer")
    cands = c.select(F.col("c_custkey").alias("batchOrder"),
                     _spelled(F.col("c_custkey"), F.col("c_mktsegment"), F.col("c_name")).alias("name"),
                     F.lit("Supplier#000000000").alias("addedBy"))
    return with_collation(V.study_import, cands, ["name"], [(t["study"], ["name"])])


@register("study_update_collated", f"""
WITH RECURSIVE Cands AS (
  SELECT c_custkey AS batchOrder, c_custkey % 7 AS id,
         CASE c_custkey % 4 WHEN 0 THEN 'Ásia' WHEN 1 THEN 'ásia' WHEN 2 THEN concat('ÉS', c_custkey % 20)
              ELSE concat('es', c_custkey % 20) END AS name
  FROM customer),
Rows AS (SELECT id, lower(strip_accents(name)) AS k1, NULL::VARCHAR AS k2 FROM ann_study),
Asked AS (SELECT c.*, lower(strip_accents(name)) AS k1, NULL::VARCHAR AS k2, id IN (SELECT id FROM ann_study) AS writes,
                 NULL::VARCHAR AS reason0 FROM Cands c)""" + REPLAY + """
SELECT a.batchOrder, id, name, CASE outcome WHEN 'held' THEN 'name_taken' WHEN 'won' THEN 'duplicate_in_batch' END AS reason
FROM Asked a LEFT JOIN Replay r ON r.batchOrder = a.batchOrder""")
def _q_study_update_collated(t, spark, sf):
    from ..operators.collation import with_collation
    c = read_table(spark, sf, "customer")
    k = F.col("c_custkey")
    cands = c.select(k.alias("batchOrder"), (k % 7).alias("id"),
                     F.when(k % 4 == 0, F.lit("Ásia")).when(k % 4 == 1, F.lit("ásia"))
                     .when(k % 4 == 2, F.concat(F.lit("ÉS"), (k % 20).cast("string")))
                     .otherwise(F.concat(F.lit("es"), (k % 20).cast("string"))).alias("name"))
    return with_collation(V.study_update, cands, ["name"], [(t["study"].select("id", "name"), ["name"])])
