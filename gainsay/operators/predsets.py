"""Set algebra on predicate sets: one row ``(set_id, members)`` per set, members sorted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def canonical(sets: DataFrame, members: str = "members") -> DataFrame:
    """Each set once, whatever the order of its members: ``(set_id, members)``."""
    key = F.array_sort(F.array_distinct(F.col(members)))
    return (sets.select(key.alias("members")).groupBy("members").agg(F.lit(1).alias("one"))
                .select(F.array_join("members", " & ").alias("set_id"), "members"))


def with_member(sets: DataFrame, additions: DataFrame) -> DataFrame:
    """One step up: every set joined by a further member.

    ``additions`` holds ``(set_id, member)``; result ``(set_id, member, to_id, to_members)``.
    """
    grown = F.array_sort(F.array_union("members", F.array("member")))
    return (sets.join(additions, "set_id").where(~F.array_contains(F.col("members"), F.col("member")))
                .select("set_id", "member", grown.alias("to_members"))
                .select("set_id", "member", F.array_join("to_members", " & ").alias("to_id"), "to_members"))


def without_member(sets: DataFrame) -> DataFrame:
    """One step down: every set with one member removed, ``(set_id, member, from_id, from_members)``."""
    return (sets.select("set_id", "members", F.explode("members").alias("member"))
                .select("set_id", "member", F.array_remove("members", F.col("member")).alias("from_members"))
                .select("set_id", "member", F.array_join("from_members", " & ").alias("from_id"), "from_members"))


def subsumption_pairs(sets: DataFrame) -> DataFrame:
    """``(sub_id, sup_id)`` for every set that is a proper subset of another one of the table.

    Each set is looked up by its rarest member only, so a pair meets once and a member found in
    most sets is hardly ever a join key.
    """
    rarest, sup = _by_rarest(sets)
    return rarest.join(sup, "member").where(_PROPER).select("sub_id", "sup_id")


_PROPER = "size(sub) < size(sup) AND size(array_except(sub, sup)) = 0"


def _by_rarest(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    members = sets.select("set_id", "members", F.explode("members").alias("member"))
    frequency = members.groupBy("member").agg(F.count(F.lit(1)).alias("freq"))
    rarest = (members.join(frequency, "member").groupBy("set_id", "members")
              .agg(F.min(F.struct("freq", "member")).alias("rare"))
              .select(F.col("set_id").alias("sub_id"), F.col("members").alias("sub"),
                      F.col("rare.member").alias("member")))
    return rarest, members.select(F.col("set_id").alias("sup_id"), F.col("members").alias("sup"), "member")


def supersets(sets: DataFrame, stop: str | None = None) -> DataFrame:
    """Known supersets of every set; ``stop`` (a condition on ``members``) ends a branch there.

    A superset is reached unless some proper subset of it above the start already met ``stop``.
    """
    pairs = subsumption_pairs(sets)
    if stop is None:
        return pairs.select(F.col("sub_id").alias("set_id"), F.col("sup_id").alias("superset_id"))
    ended = sets.where(stop).select(F.col("set_id").alias("mid_id"))
    above = pairs.select("sub_id", F.col("sup_id").alias("mid_id")).join(ended, "mid_id", "left_semi")
    beyond = (above.join(pairs.select(F.col("sub_id").alias("mid_id"), "sup_id"), "mid_id")
                   .select("sub_id", "sup_id").distinct())
    return (pairs.join(beyond, ["sub_id", "sup_id"], "left_anti")
                 .select(F.col("sub_id").alias("set_id"), F.col("sup_id").alias("superset_id")))


def subsets(sets: DataFrame) -> DataFrame:
    """Known subsets of every set."""
    return subsumption_pairs(sets).select(F.col("sup_id").alias("set_id"), F.col("sub_id").alias("subset_id"))


def grown_sets(sets: DataFrame, predicates: DataFrame, max_size: int) -> DataFrame:
    """All supersets up to ``max_size``, created as needed, with one predicate per column.

    ``sets`` holds members ``"col op"``; ``predicates`` holds ``(col, op)``.  Each round adds one
    predicate of an unused column and removes duplicates.
    """
    all_preds = predicates.agg(F.collect_set(F.struct("col", F.concat_ws(" ", "col", "op").alias("member"))).alias("preds"))
    preds = all_preds.first()["preds"]           # at most six per column of the table
    choices = F.array(*[F.struct(F.lit(p["col"]).alias("col"), F.lit(p["member"]).alias("member"))
                        for p in sorted(preds, key=lambda p: p["member"])])
    level = canonical(sets)
    out = level
    for _ in range(max_size - 1):
        used = F.transform("members", lambda m: F.regexp_replace(m, " [^ ]*$", ""))     # names may hold spaces, operators don't
        free = F.filter(choices, lambda c: ~F.array_contains(used, c["col"]))
        level = canonical(level.where(F.size("members") < max_size)
                          .select("members", F.explode(free).alias("add"))
                          .select(F.concat("members", F.array("add.member")).alias("members")))
        out = out.unionByName(level)
    return out.dropDuplicates(["set_id"])


def minimal_cover(sets: DataFrame) -> DataFrame:
    """The sets that contain no other set of the table; one contained set is enough, pairs are not listed."""
    rarest, sup = (side.alias(n) for side, n in zip(_by_rarest(sets), "rs"))
    implied = sup.join(rarest, (F.col("s.member") == F.col("r.member")) & F.expr(_PROPER), "left_semi").select(F.col("sup_id").alias("set_id")).distinct()
    return sets.join(implied, "set_id", "left_anti")
