"""Registered queries of the boards for all viewers.

The oracles go viewer by viewer: each viewer's circle of raters, numbered by its own rank,
and only then one line per class.  The ``_changed`` keys use the memberships after the batch
of membership changes, whose users belong to many different sets of studies.
"""

from __future__ import annotations

from ..operators import boards as B
from ..operators import validate as V
from .consensus_queries import SHARE
from .registry import register
from .validate_queries import MEMBERSHIP_CHANGES_SQL, _membership_changes

CHANGED = MEMBERSHIP_CHANGES_SQL.strip()[len("WITH "):] + """,
member AS (
  SELECT userId, studyId FROM Placed WHERE newest AND op = 'insert'
  UNION
  SELECT userId, studyId FROM ann_user_study WHERE (userId, studyId) NOT IN (SELECT userId, studyId FROM Changes))"""
PLAIN = "member AS (SELECT DISTINCT userId, studyId FROM ann_user_study)"

#: Viewer by viewer: who is seen, and the viewer's class.
CIRCLES = """,
viewer AS (
  SELECT id AS viewerId, CASE type WHEN 'investigator' THEN type
         ELSE (SELECT string_agg(studyId, ',' ORDER BY studyId) FROM member WHERE userId = u.id) END AS viewerClass
  FROM ann_user u),
rater AS (SELECT id, username FROM ann_user WHERE id IN (SELECT userId FROM ann_classification)),
circle AS (
  SELECT v.viewerId, v.viewerClass, r.id, r.username FROM viewer v JOIN rater r
    ON v.viewerClass = 'investigator'
    OR EXISTS (SELECT 1 FROM member a, member b WHERE a.studyId = b.studyId AND a.userId = v.viewerId AND b.userId = r.id)),
named AS (
  SELECT *, dense_rank() OVER (PARTITION BY viewerId ORDER BY id) AS number FROM circle),
line AS (
  SELECT DISTINCT viewerClass, id, username, number,
         CASE viewerClass WHEN 'investigator' THEN username ELSE 'Utilizador ' || number END AS shown
  FROM named)"""

SCORED = """
SELECT viewerClass, line.id AS userId, number, shown AS anonymizedUser,
       round(gained::DECIMAL(18, 6), 2)::DOUBLE AS validated,
       round((answered - gained)::DECIMAL(18, 6), 2)::DOUBLE AS not_validated
FROM line JOIN board ON board.userId = line.id"""


def _changed(t, spark, sf):
    """The tables with the memberships after the batch of changes."""
    member, _ = V.apply_changes(t["user_study"], _membership_changes(spark, sf), key=["userId", "studyId"])
    return t | {"user_study": member}


@register("viewer_classes", "WITH " + CHANGED + CIRCLES + """
SELECT viewerId, viewerClass FROM viewer WHERE viewerClass IS NOT NULL""")
def _q_viewer_classes(t, spark, sf):
    t = _changed(t, spark, sf)
    return B.viewer_classes(t["user"], t["user_study"])


@register("visible_users_all", "WITH " + CHANGED + CIRCLES + """
SELECT viewerClass, id, username FROM line""")
def _q_visible_users_all(t, spark, sf):
    return B.visible_users_all(_changed(t, spark, sf))


@register("anonymized_users_all", "WITH " + CHANGED + CIRCLES + """
SELECT viewerClass, id AS userId, number, shown AS anonymizedUser FROM line""")
def _q_anonymized_users_all(t, spark, sf):
    return B.anonymized_users_all(_changed(t, spark, sf))


@register("stats_general_all", "WITH " + SHARE.strip() + "," + PLAIN + CIRCLES + SCORED)
def _q_stats_general_all(t, spark, sf):
    return B.stats_general_all(t)


@register("stats_general_all_changed", "WITH " + CHANGED + "," + SHARE.strip() + CIRCLES + SCORED)
def _q_stats_general_all_changed(t, spark, sf):
    return B.stats_general_all(_changed(t, spark, sf))
