"""Batch validation and snapshot maintenance (the reference's write routes, set-based).

Each import takes a DataFrame of candidates with a ``batchOrder`` column and
returns every candidate with ``reason`` (null = accepted) and, where the
handler normalises values, the normalised columns.  Rules are checked in the
handler's order; duplicates *inside* a batch of new rows are resolved after all
other checks, the first candidate (by batchOrder) of a key winning.  In a batch of
updates a candidate conflicts when the first valid candidate of its key is for
another row; a row may be updated again under the same key.  New users have two keys
(username, email), of which an accepted one claims both and a refused one none
(``claims.first_independent``); in a batch of changed users the rule holds for each
key on its own.
First-wins is computed with an aggregate per key and a join back, so a hot key is
combined map-side instead of sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import normalized_key, slug, type_valid
from ..session import cut_lineage
from .claims import GONE, HELD, WON, first_independent, replay_claims, replay_renames

# Rejection reasons.
MISSING = "missing_fields"
BAD_TYPE = "invalid_type"
UNKNOWN_QUESTION = "unknown_question"
NAME_TAKEN = "name_taken"
DUPLICATE = "duplicate_in_batch"
USER_TAKEN = "username_or_email_taken"
LINK_EXISTS = "link_exists"
NOT_FOUND = "not_found"
CONFLICT = "id_exists"

ORDER = "batchOrder"


def js_missing(df: DataFrame, name: str) -> Column:
    """JavaScript falsy for a request field: null, '' for text, 0 for numbers."""
    c = F.col(name)
    dtype = dict(df.dtypes)[name]
    if dtype == "string":
        return c.isNull() | (c == "")
    if dtype == "boolean":
        return c.isNull() | ~c
    return c.isNull() | (c == 0)


def taken_by_other(cands: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """``cands`` + boolean ``_taken``: some existing row has the same ``keys``."""
    ex = existing.select(*keys).distinct().withColumn("_taken", F.lit(True))
    return cands.join(ex, keys, "left").withColumn("_taken", F.coalesce("_taken", F.lit(False)))


def first_wins(df: DataFrame, keys: list[str], existing: DataFrame, taken: str) -> DataFrame:
    """Decide the rows whose reason is null: ``taken`` if an existing row has the same
    ``keys``, else a duplicate if it is not the first of its key (rows without a key are
    neither, rows without an order no duplicates).

    Key and order alone are compared with the key's first row and the existing ones; whole
    rows meet the outcome by key and order, so a key of many candidates is spread over the
    tasks."""
    open_rows = df.filter(F.col("reason").isNull()).select(*keys, ORDER).dropna(subset=keys)
    first = taken_by_other(open_rows.groupBy(*keys).agg(F.min(ORDER).alias("_first")), existing, keys)
    why = F.when(F.col("_taken"), F.lit(taken)).when(F.col(ORDER) != F.col("_first"), F.lit(DUPLICATE))
    why = (open_rows.join(first, keys).select(*[F.col(k).alias(f"_k_{k}") for k in keys],
                                              F.col(ORDER).alias("_order"), why.alias("_why"))
           .where("_why IS NOT NULL").distinct())
    on = F.col(ORDER).eqNullSafe(F.col("_order"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"_k_{k}"))
    return (df.join(why, on, "left").withColumn("reason", F.coalesce("reason", "_why"))
            .select(*keys, *[c for c in df.columns if c not in keys]))


def known_ids(cands: DataFrame, existing: DataFrame) -> DataFrame:
    """``cands`` + boolean ``_known``: the id is one of the existing rows'."""
    ids = existing.select("id").distinct().withColumn("_known", F.lit(True))
    return cands.join(ids, "id", "left").withColumn("_known", F.coalesce("_known", F.lit(False)))


def replayed(c: DataFrame, stored: DataFrame, names: dict[str, Column], taken: str,
             writes: Column | None = None, stored_names: dict[str, Column] | None = None,
             log: list | None = None) -> DataFrame:
    """Updates ``c`` with a ``reason`` so far (null: to be decided) -> + the outcome of
    claiming ``names`` in order.  Candidates with a reason change nothing."""
    c = cut_lineage(c)
    refused = replay_claims(c.where(F.col("reason").isNull()), stored, names, writes, stored_names, log)
    outcome = F.when(F.col("outcome") == HELD, F.lit(taken)).when(F.col("outcome") == WON, F.lit(DUPLICATE))
    return (c.join(refused, ORDER, "left").withColumn("reason", F.coalesce("reason", outcome)).drop("outcome"))


def category_import(cands: DataFrame, categories: DataFrame, question: DataFrame,
                    legacy_global_names: bool = False) -> DataFrame:
    """cands(batchOrder, name, categoryType, questionId[, id]) -> + normalizedType,
    studyId, reason.

    Name uniqueness is per study (via the question), or over all studies in
    the legacy rule.  With an ``id`` column the batch is an update: the row's
    own current name does not count as taken, and the id must exist (checked
    last, as the handler learns it from the write)."""
    update = "id" in cands.columns
    q = question.select(F.col("id").alias("questionId"), "studyId", F.lit(True).alias("_q"))
    existing = categories.join(question.select(F.col("id").alias("questionId"), "studyId"), "questionId") \
        .select("id", "name", "studyId")
    c = cands.withColumn("normalizedType", slug("categoryType")).join(q, "questionId", "left")
    keys = ["name"] if legacy_global_names else ["name", "studyId"]
    reason = (F.when(js_missing(c, "name") | js_missing(c, "categoryType") | js_missing(c, "questionId"),
                     F.lit(MISSING))
              .when((F.col("normalizedType") == "") | ~type_valid("normalizedType"), F.lit(BAD_TYPE))
              .when(F.col("_q").isNull(), F.lit(UNKNOWN_QUESTION)))
    if update:
        c = known_ids(c.withColumn("reason", reason).drop("_q"), categories)
        name = F.to_json(F.array(*[F.col(k).cast("string") for k in keys]))
        done = replayed(c, existing, {"name": name}, NAME_TAKEN, F.col("_known"))
        return _unknown_last(done)
    return first_wins(c.withColumn("reason", reason).drop("_q"), keys, existing, NAME_TAKEN)


def _unknown_last(done: DataFrame) -> DataFrame:
    """An unknown id is the last thing that is noticed, as the handler learns it from the write."""
    late = F.when(F.col("reason").isNull() & ~F.col("_known"), F.lit(NOT_FOUND)).otherwise(F.col("reason"))
    return done.withColumn("reason", late).drop("_known")


def question_import(cands: DataFrame, question: DataFrame) -> DataFrame:
    """cands(batchOrder, question, content, inputType, studyId[, id]) -> + reason;
    duplicates by LOWER(TRIM(question)) inside the study; an ``id`` column makes
    it an update that ignores the row itself and needs a known id."""
    update = "id" in cands.columns
    existing = question.select("id", "studyId", normalized_key("question").alias("_k"))
    c = cands.withColumn("_k", normalized_key("question"))
    miss = js_missing(c, "question") | js_missing(c, "content") | js_missing(c, "inputType") \
        | js_missing(c, "studyId")
    if update:
        c = known_ids(c.withColumn("reason", F.when(miss, F.lit(MISSING))), question)
        name = F.to_json(F.array(F.col("studyId").cast("string"), F.col("_k")))
        return _unknown_last(replayed(c, existing, {"name": name}, NAME_TAKEN, F.col("_known"))).drop("_k")
    c = c.withColumn("reason", F.when(miss, F.lit(MISSING)))
    return first_wins(c, ["studyId", "_k"], existing, NAME_TAKEN).drop("_k")


def study_import(cands: DataFrame, study: DataFrame) -> DataFrame:
    """New studies: cands(batchOrder, name, addedBy, ...) -> + reason; names are global."""
    miss = js_missing(cands, "name") | js_missing(cands, "addedBy")
    return first_wins(cands.withColumn("reason", F.when(miss, F.lit(MISSING))), ["name"], study, NAME_TAKEN)


def study_update(cands: DataFrame, study: DataFrame) -> DataFrame:
    """Changed studies: cands(batchOrder, id, name, ...) -> + reason.  Only the name is
    checked, against other studies; an unknown id is no error (nothing is written)."""
    c = known_ids(cands.withColumn("reason", F.lit(None).cast("string")), study)
    return replayed(c, study.select("id", "name"), {"name": F.col("name")}, NAME_TAKEN, F.col("_known")).drop("_known")


def study_clean(updates: DataFrame) -> DataFrame:
    """'' -> null for the three limits; blank finishedAt -> null."""
    out = updates
    for c in ("minClassificationsPerPost", "maxClassificationsPerUser", "validationAgreementPercent"):
        if c in out.columns:
            out = out.withColumn(c, F.when(F.col(c).cast("string") == "", F.lit(None)).otherwise(F.col(c))
                                 .try_cast("int"))
    if "finishedAt" in out.columns:
        out = out.withColumn("finishedAt", F.when(F.trim(F.col("finishedAt").cast("string")) == "", F.lit(None))
                             .otherwise(F.col("finishedAt")))
    return out


def user_import(cands: DataFrame, user: DataFrame, default_created_by: str = "admin",
                log: list | None = None) -> DataFrame:
    """cands(batchOrder, username, password, email, type, createdBy) -> + reason.

    Taken when the username *or* the email exists (two semi-joins, not an OR
    join).  Inside the batch a candidate is rejected when an earlier accepted
    candidate has its username or its email, as if the requests came one by one.
    The password is only checked for presence and never returned.  The checked
    candidates and the rounds are materialised."""
    names = user.select("username").distinct().withColumn("_un", F.lit(True))
    mails = user.select("email").distinct().withColumn("_em", F.lit(True))
    c = cands.join(names, "username", "left").join(mails, "email", "left")
    miss = js_missing(c, "username") | js_missing(c, "password") | js_missing(c, "email") \
        | js_missing(c, "type")
    reason = F.when(miss, F.lit(MISSING)).when(F.col("_un").isNotNull() | F.col("_em").isNotNull(), F.lit(USER_TAKEN))
    c = c.withColumn("reason", reason).drop("_un", "_em")
    created_by = F.coalesce(F.when(~js_missing(c, "createdBy"), F.col("createdBy")), F.lit(default_created_by))
    c = cut_lineage(c.withColumn("createdBy", created_by).drop("password"))
    valid = c.where(F.col("reason").isNull()).select(ORDER, "username", "email")
    accepted = first_independent(valid, ["username", "email"], log).withColumn("_ok", F.lit(True))
    refused = F.col("reason").isNull() & F.col("_ok").isNull()
    return (c.join(accepted, ORDER, "left")
            .withColumn("reason", F.when(refused, F.lit(DUPLICATE)).otherwise(F.col("reason"))).drop("_ok"))


def membership_import(cands: DataFrame, user_study: DataFrame, keys: tuple[str, str] = ("userId", "studyId"),
                      required: tuple[str, ...] = ("studyId",)) -> DataFrame:
    """cands(batchOrder, <keys>) -> + reason (missing field, link exists).  The
    same rule links users to studies and, in the legacy form, categories to
    studies (keys ("studyId", "categoryId"), both required)."""
    k = list(keys)
    miss = F.lit(False)
    for r in required:
        miss = miss | js_missing(cands, r)
    return first_wins(cands.withColumn("reason", F.when(miss, F.lit(MISSING))), k, user_study, LINK_EXISTS)


def user_rename(cands: DataFrame, user: DataFrame) -> DataFrame:
    """Profile update: cands(batchOrder, id, username, email) -> + reason; the new
    username or email must not belong to another user."""
    c = known_ids(cands.withColumn("reason", F.lit(None).cast("string")), user)
    return replayed(c, user, {"username": F.col("username"), "email": F.col("email")}, USER_TAKEN,
                    F.col("_known")).drop("_known")


#: Changes are ordered within blocks of this many batchOrder values, then over blocks,
#: so that one key's changes never have to be sorted by one task.
CHANGE_BLOCK = 1_000_000


def set_always(updates: DataFrame, columns: list[str], clear: str = "clear") -> DataFrame:
    """Mark the null ones of ``columns`` as explicit nulls (an unconditional SET)."""
    names = F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in columns])
    return updates.withColumn(clear, F.array_compact(names))


def apply_changes(old: DataFrame, changes: DataFrame, key: str | list[str] = "id",
                  clear: str = "clear") -> tuple[DataFrame, DataFrame]:
    """Apply a batch of changes to a snapshot table, each key's in batchOrder.

    changes(batchOrder, op in 'insert'/'update'/'delete', key column(s), any
    subset of the table's other columns[, ``clear``: array of column names]).
    A null or absent column of an update keeps the value the row has by then,
    unless the update names it in ``clear``: then it becomes null.  Every change
    is applied: a row may be updated twice, or deleted and inserted again (a new
    life, in which columns the insert doesn't give are null).  The key may be
    composite.  Returns (new snapshot, per-change status: updated, deleted,
    inserted, id_exists or not_found).

    No change has to see the others' values: whether a row exists before a change
    follows from the last insert or delete before it, and a column's final value
    is that of the last change that sets it in the row's last life.  Both are
    aggregates with map-side combination.
    """
    keys = [key] if isinstance(key, str) else list(key)
    cols = [c for c in old.columns if c not in keys]
    given = [c for c in cols if c in changes.columns]
    ch = changes if clear in changes.columns else changes.withColumn(
        clear, F.lit(None).cast("array<string>"))
    ch = ch.withColumn("_block", F.floor(F.col(ORDER) / CHANGE_BLOCK))
    switch = F.when(F.col("op").isin("insert", "delete"), F.col("op"))
    same = W.partitionBy(*keys, "_block").orderBy(ORDER).rowsBetween(W.unboundedPreceding, -1)
    inside = ch.withColumn("_in", F.last(switch, ignorenulls=True).over(same))
    over = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    blocks = (ch.groupBy(*keys, "_block").agg(F.max_by(switch, F.when(switch.isNotNull(), F.col(ORDER)))
                                              .alias("_last"))
              .withColumn("_over", F.last("_last", ignorenulls=True).over(over))
              .select(*[F.col(k).alias(f"_b_{k}") for k in keys], F.col("_block").alias("_b"), "_over"))
    on = F.col("_block") == F.col("_b")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_b_{k}"))
    known = old.select(*keys).distinct().withColumn("_old", F.lit(True))
    seen = inside.join(blocks, on).join(known, keys, "left")
    before = F.coalesce("_in", "_over")
    exists = F.when(before.isNotNull(), before == "insert").otherwise(F.col("_old").isNotNull())
    op = F.col("op")
    seen = seen.withColumn("status", (
        F.when(op == "insert", F.when(exists, F.lit(CONFLICT)).otherwise(F.lit("inserted")))
        .when(~exists, F.lit(NOT_FOUND))
        .when(op == "update", F.lit("updated")).when(op == "delete", F.lit("deleted"))))
    stat = seen.select(ORDER, "op", *keys, "status")

    turn = F.when(F.col("status").isin("inserted", "deleted"), F.col(ORDER))
    lives = seen.groupBy(*keys).agg(F.max(turn).alias("_turn"),
                                    F.max_by("status", turn).alias("_kind"))
    last = (seen.join(lives.select(*[F.col(k).alias(f"_l_{k}") for k in keys],
                                   F.col("_turn").alias("_from")),
                      [F.col(k).eqNullSafe(F.col(f"_l_{k}")) for k in keys])
            .where(F.col("status").isin("inserted", "updated"))
            .where(F.col("_from").isNull() | (F.col(ORDER) >= F.col("_from"))))
    sets = {c: F.when((F.col("status") == "inserted") | F.col(c).isNotNull()
                      | F.coalesce(F.array_contains(clear, c), F.lit(False)), F.col(ORDER))
            for c in given}
    aggs = [a for c in given for a in (F.max(sets[c]).alias(f"_at_{c}"),
                                       F.max_by(F.struct(c), sets[c]).alias(f"_new_{c}"))]
    values = last.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *aggs)
    done = lives.join(values, [lives[k].eqNullSafe(values[k]) for k in keys], "left").select(
        *[lives[k] for k in keys], "_kind", *[n for c in given for n in (f"_at_{c}", f"_new_{c}")])
    j = old.withColumn("_old", F.lit(True)).join(done, keys, "full_outer")
    there = F.when(F.col("_kind").isNotNull(), F.col("_kind") == "inserted").otherwise(
        F.col("_old").isNotNull())

    def value(c):
        kept = F.when(F.col("_kind").isNull(), F.col(c))
        return F.when(F.col(f"_at_{c}").isNotNull(), F.col(f"_new_{c}")[c]).otherwise(kept) \
            if c in given else kept

    return j.filter(there).select(*keys, *[value(c).alias(c) for c in cols]), stat


def user_update(cands: DataFrame, user: DataFrame) -> DataFrame:
    """Admin update: cands(batchOrder, id, username, email, type) -> + reason.
    Required fields first, then the id must exist, then username and email
    must not belong to another user."""
    c = known_ids(cands, user)
    miss = js_missing(c, "username") | js_missing(c, "email") | js_missing(c, "type")
    reason = F.when(miss, F.lit(MISSING)).when(~F.col("_known"), F.lit(NOT_FOUND))
    return replayed(c.withColumn("reason", reason).drop("_known"), user,
                    {"username": F.col("username"), "email": F.col("email")}, USER_TAKEN)


def profile_rename(cands: DataFrame, user: DataFrame) -> DataFrame:
    """Profile change of one's own username: cands(batchOrder, currentUsername,
    newUsername) -> + reason, in order.  Somebody must bear the current name just then; a
    new name that differs from it must be free just then."""
    c = cut_lineage(cands)
    new = F.when(~js_missing(c, "newUsername"), F.col("newUsername"))
    refused = replay_renames(c, user.select(F.col("username").alias("name")), F.col("currentUsername"), new)
    reason = (F.when(F.col("outcome") == GONE, F.lit(NOT_FOUND)).when(F.col("outcome") == HELD, F.lit(USER_TAKEN))
              .when(F.col("outcome") == WON, F.lit(DUPLICATE)))
    return c.join(refused, ORDER, "left").withColumn("reason", reason).drop("outcome")
