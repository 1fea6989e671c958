"""Who gets a name: batches that claim unique names, decided as if applied one by one.

New rows: ``first_independent`` takes new rows with several unique keys (username and e-mail).  A
candidate is accepted when no accepted earlier one shares any of its keys: the
lexicographically first independent set of the conflict graph.  In each round the candidates
that are first among the open ones on *all* their keys are accepted, and every open one that
shares a key with them is refused.  A round is aggregates by key and equi-joins; a hot name
combines map-side.  Candidates equal in all keys are reduced to their first before the
rounds, as the others can never be accepted.  The first open candidate is decided in every
round, a chain of n candidates that conflict one by one takes about n / 2 rounds.

Changed rows: ``replay_claims``.  Here an accepted claim also *releases* the names its row had,
so a claim's outcome can depend on the whole history of its names, and a name that changes
hands n times needs n steps whatever the plan.  What can be done at once is everything that
doesn't touch: events (stored rows and candidates) that share a row or a name, directly or
through others, form a group.  Groups are found by rounds of joins - the least label over a
shared token, then twice the label's own label, so the rounds grow with the logarithm of a
chain's length.
Then each group is replayed in its order by one pass over sorted rows, which keeps only who
holds what.  Groups are spread over all tasks; a group as large as the batch (one name
wanted by everybody) streams through one task, as such requests do.

Rounds are tables in the shared checkpoint folder; what they decided is appended to ``log``
(a list) if there is one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Scratch, cut_lineage

ORDER = "batchOrder"
#: Outcomes of a replayed claim: a holder that the table knew, or one of the batch;
#: nobody bears the name to be changed.
HELD, WON, GONE = "held", "won", "gone"


def first_independent(cands: DataFrame, keys: list[str], log: list | None = None) -> DataFrame:
    """The accepted ``batchOrder`` values of ``cands`` (batchOrder, keys): no two share a key,
    and each refused one shares a key with an accepted earlier one.  Null keys conflict with
    nothing."""
    none = reduce(Column.__and__, [F.col(k).isNull() for k in keys])
    accepted = [cands.where(none).select(ORDER)]
    scratch = Scratch(cands.sparkSession, "claims")
    open_ = scratch.table(cands.where(~none).groupBy(*keys).agg(F.min(ORDER).alias(ORDER)))
    while True:
        marked = open_
        for i, k in enumerate(keys):
            first = open_.where(F.col(k).isNotNull()).groupBy(k).agg(F.min(ORDER).alias(f"_first{i}"))
            marked = marked.join(first, k, "left")
        wins = reduce(Column.__and__, [F.coalesce(F.col(f"_first{i}") == F.col(ORDER), F.lit(True))
                                       for i in range(len(keys))])
        marked = scratch.table(marked.select(ORDER, *keys, wins.alias("_wins")))
        won = marked.where("_wins")
        n = won.count()
        if log is not None:
            log.append(n)
        if not n:
            break
        accepted.append(won.select(ORDER))
        rest = marked.where("NOT _wins").drop("_wins")
        for k in keys:
            rest = rest.join(won.select(k).where(F.col(k).isNotNull()), k, "left_anti")
        open_ = rest.select(ORDER, *keys)
    return reduce(DataFrame.unionAll, accepted)


def groups_of(edges: DataFrame, log: list | None = None) -> DataFrame:
    """(node, label): nodes linked by shared tokens get the same label, the least node's.
    ``edges``: (node, token)."""
    scratch = Scratch(edges.sparkSession, "groups")
    edges = scratch.table(edges.distinct())
    labels = scratch.table(edges.select("node").distinct().withColumn("label", F.col("node")))
    while True:
        least = edges.join(labels, "node").groupBy("token").agg(F.min("label").alias("label"))
        near = scratch.table(edges.join(least, "token").groupBy("node").agg(F.min("label").alias("near")))
        own = near.select(F.col("node").alias("at"), F.col("near").alias("label"))
        moved = near.join(own, F.col("near") == F.col("at")).select("node", F.col("label").alias("near"))
        moved = moved.join(own, F.col("near") == F.col("at")).select("node", "label")
        after = scratch.table(moved.join(labels.withColumnRenamed("label", "was"), "node"))
        n = after.where("label <> was").count()
        if log is not None:
            log.append(n)
        labels = after.select("node", "label")
        scratch.only(edges, after)
        if not n:
            return labels


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by group, stored rows first, then candidates in order -> refused candidates.
    Columns: label, place (null for a stored row), row, names, writes."""
    now = None
    for b in batches:
        out = []
        for label, place, row, names, writes in zip(*[c.to_pylist() for c in b.columns]):
            if label != now:
                now, holders, held = label, {}, {}  # name -> {row: is it stored}; row -> names
            if place is None:
                held[row] = held.get(row, []) + names
                for n in names:
                    holders.setdefault(n, {})[row] = True
                continue
            others = [stored for n in names for r, stored in holders.get(n, {}).items() if r != row]
            if others:
                out.append((place, HELD if any(others) else WON))
            elif writes:
                for n in held.get(row, ()):
                    if n not in names:
                        del holders[n][row]
                for n in names:
                    holders.setdefault(n, {}).setdefault(row, False)
                held[row] = names
        yield pa.RecordBatch.from_arrays(
            [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.string())],
            names=[ORDER, "outcome"])


def replay_claims(cands: DataFrame, stored: DataFrame, names: dict[str, Column], writes: Column | None = None,
                  stored_names: dict[str, Column] | None = None, log: list | None = None) -> DataFrame:
    """(batchOrder, outcome) of the refused ones among ``cands`` (batchOrder, id, ...), which
    change the names of the rows ``stored`` (id, ...) in order.

    ``names`` gives a candidate's claims by kind (null claims nothing), ``stored_names`` what
    a stored row holds (the same expressions unless given).  A candidate is refused when
    another row holds one of its names just then; else its row's names are exactly its claims.
    Where ``writes`` is not true the candidate is checked but changes nothing."""
    def tokens(given: dict[str, Column]) -> Column:
        return F.array_compact(F.array(*[F.concat(F.lit(f"{k}:"), c.cast("string")) for k, c in given.items()]))

    held = stored.where(F.col("id").isNotNull()).select(
        F.concat(F.lit("s"), F.monotonically_increasing_id().cast("string")).alias("node"),
        F.lit(None).cast("long").alias("place"), F.col("id").cast("string").alias("row"),
        tokens(stored_names or names).alias("names"), F.lit(True).alias("writes"))
    asked = cands.select(
        F.concat(F.lit("c"), F.col(ORDER).cast("string")).alias("node"), F.col(ORDER).cast("long").alias("place"),
        F.coalesce(F.col("id").cast("string"), F.concat(F.lit("new "), F.col(ORDER).cast("string"))).alias("row"),
        tokens(names).alias("names"), F.coalesce(writes if writes is not None else F.lit(True), F.lit(False)).alias("writes"))
    return _in_groups(held.unionAll(asked), _replay, log)


def _in_groups(events: DataFrame, replay, log: list | None) -> DataFrame:
    """Run ``replay`` over the events (node, place, row, names, writes) of each group."""
    events = cut_lineage(events)
    shared = F.when(F.col("row").isNotNull(), F.array(F.concat(F.lit("row:"), F.col("row"))))
    edges = events.select("node", F.explode(F.concat(
        "names", F.coalesce(shared, F.array().cast("array<string>")))).alias("token"))
    # Stored rows that no candidate touches stay out; a candidate without a token is alone.
    touched = edges.where("node LIKE 'c%'").select("token").distinct()
    near = edges.join(edges.join(touched, "token", "left_semi").select("node").distinct(), "node", "left_semi")
    placed = events.join(groups_of(near, log), "node")
    return (placed.select("label", "place", "row", "names", "writes").repartition("label")
            .sortWithinPartitions("label", F.col("place").asc_nulls_first())
            .mapInArrow(replay, f"{ORDER} long, outcome string"))


def _replay_renames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As ``_replay``; a candidate's names are the one it has and, if it changes, the new one."""
    now = None
    for b in batches:
        out = []
        for label, place, _, names, _ in zip(*[c.to_pylist() for c in b.columns]):
            if label != now:
                now, there = label, {}  # name -> is it stored
            if place is None:
                there[names[0]] = True
            elif names[0] not in there:
                out.append((place, GONE))
            elif names[-1] != names[0]:
                if names[-1] in there:
                    out.append((place, HELD if there[names[-1]] else WON))
                else:
                    del there[names[0]]
                    there[names[-1]] = False
        yield pa.RecordBatch.from_arrays(
            [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.string())],
            names=[ORDER, "outcome"])


def replay_renames(cands: DataFrame, stored: DataFrame, current: Column, new: Column,
                   log: list | None = None) -> DataFrame:
    """(batchOrder, outcome) of the refused ones among ``cands``, each of which renames the
    bearer of a name at its moment.  ``stored``: (name).  A candidate whose current name
    nobody bears just then is refused as gone; a null ``new`` name changes nothing."""
    none = F.lit(None).cast("string")
    held = stored.where(F.col("name").isNotNull()).select(
        F.concat(F.lit("s"), F.col("name")).alias("node"), F.lit(None).cast("long").alias("place"),
        none.alias("row"), F.array("name").alias("names"), F.lit(True).alias("writes")).distinct()
    asked = cands.where(current.isNotNull()).select(
        F.concat(F.lit("c"), F.col(ORDER).cast("string")).alias("node"), F.col(ORDER).cast("long").alias("place"),
        none.alias("row"), F.array_compact(F.array(current, new)).alias("names"), F.lit(True).alias("writes"))
    nameless = cands.where(current.isNull()).select(F.col(ORDER).cast("long").alias(ORDER), F.lit(GONE).alias("outcome"))
    return _in_groups(held.unionAll(asked), _replay_renames, log).unionAll(nameless)
