"""The join workloads that feed discovery."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gainsay.operators.schema_model import quoted


@dataclass(frozen=True)
class Join:
    """Inner equi-join of two tables; ``drop`` names the repeated key columns."""

    left: str
    right: str
    on: tuple[tuple[str, str], ...]
    drop: tuple[str, ...] = ()


# The decision-support joins.
STAR_JOINS = {
    "join_lineitem_orders": Join("lineitem", "orders", (("l_orderkey", "o_orderkey"),), ("o_orderkey",)),
    "join_lineitem_partsupp": Join("lineitem", "partsupp", (("l_partkey", "ps_partkey"), ("l_suppkey", "ps_suppkey")),
                                   ("ps_partkey", "ps_suppkey")),
    "join_customer_orders": Join("customer", "orders", (("c_custkey", "o_custkey"),), ("o_custkey",)),
    "join_partsupp_part": Join("partsupp", "part", (("ps_partkey", "p_partkey"),), ("p_partkey",)),
    "join_partsupp_supplier": Join("partsupp", "supplier", (("ps_suppkey", "s_suppkey"),), ("s_suppkey",)),
    "join_customer_nation": Join("customer", "nation", (("c_nationkey", "n_nationkey"),), ("n_nationkey",)),
    "join_nation_supplier": Join("nation", "supplier", (("n_nationkey", "s_nationkey"),), ("s_nationkey",)),
    "join_nation_region": Join("nation", "region", (("n_regionkey", "r_regionkey"),), ("r_regionkey",)),
    "join_lineitem_part": Join("lineitem", "part", (("l_partkey", "p_partkey"),), ("p_partkey",)),
    "join_lineitem_supplier": Join("lineitem", "supplier", (("l_suppkey", "s_suppkey"),), ("s_suppkey",)),
}


def equi_join(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]],
              drop: Sequence[str] = ()) -> DataFrame:
    """Inner join on column pairs, without the dropped columns."""
    tests = [left[quoted_name(a)] == right[quoted_name(b)] for a, b in on]
    return left.join(right, functools.reduce(lambda x, y: x & y, tests), "inner").drop(*drop)


def quoted_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def star_join(tables: Mapping[str, DataFrame], name: str) -> DataFrame:
    j = STAR_JOINS[name]
    return equi_join(tables[j.left], tables[j.right], j.on, j.drop)


def lineitem_part_supplier(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Lineitem with both its dimensions."""
    with_part = star_join(tables, "join_lineitem_part")
    return equi_join(with_part, tables["supplier"], (("l_suppkey", "s_suppkey"),), ("s_suppkey",))


def prefixed(df: DataFrame, alias: str, drop: Sequence[str] = ()) -> DataFrame:
    """Every column renamed to ``alias_column``, so joins cannot clash."""
    return df.select(*[quoted(c).alias(f"{alias}_{c}") for c in df.columns if c not in drop])


@dataclass(frozen=True)
class PrefixedJoin:
    """Join of two prefixed tables ``(table, alias, key)``; ``drop`` lists result columns left out."""

    left: tuple[str, str, str]
    right: tuple[str, str, str]
    drop: tuple[str, ...] = ()


# The movie-database joins.
MOVIE_JOINS = {
    "join_char_name_cast_info": PrefixedJoin(("char_name", "chn", "id"), ("cast_info", "ci", "person_role_id")),
    "join_role_type_cast_info": PrefixedJoin(("role_type", "rt", "id"), ("cast_info", "ci", "role_id")),
    "join_cast_info_name": PrefixedJoin(("cast_info", "ci", "person_id"), ("name", "n", "id"), ("n_id",)),
    "join_cast_info_title": PrefixedJoin(("cast_info", "ci", "movie_id"), ("title", "t", "id"), ("t_id",)),
    "join_name_aka_name": PrefixedJoin(("name", "n", "id"), ("aka_name", "an", "person_id")),
    "join_name_person_info": PrefixedJoin(("name", "n", "id"), ("person_info", "pi", "person_id")),
    "join_person_info_info_type": PrefixedJoin(("person_info", "pi", "info_type_id"), ("info_type", "it", "id"), ("it_id",)),
    "join_info_type_movie_info": PrefixedJoin(("info_type", "it", "id"), ("movie_info", "mi", "info_type_id")),
    "join_movie_info_title": PrefixedJoin(("movie_info", "mi", "movie_id"), ("title", "t", "id"), ("t_id",)),
    "join_movie_info_idx_info_type": PrefixedJoin(("movie_info_idx", "mii", "info_type_id"), ("info_type", "it", "id"), ("it_id",)),
    "join_movie_info_idx_title": PrefixedJoin(("movie_info_idx", "mii", "movie_id"), ("title", "t", "id"), ("t_id",)),
    "join_kind_type_title": PrefixedJoin(("kind_type", "kt", "id"), ("title", "t", "kind_id"), ("t_kind_id",)),
    "join_title_movie_keyword": PrefixedJoin(("title", "t", "id"), ("movie_keyword", "mk", "movie_id")),
    "join_movie_keyword_keyword": PrefixedJoin(("movie_keyword", "mk", "keyword_id"), ("keyword", "k", "id"), ("k_id",)),
    "join_company_name_movie_companies": PrefixedJoin(("company_name", "cn", "id"), ("movie_companies", "mc", "company_id")),
    "join_movie_companies_company_type": PrefixedJoin(("movie_companies", "mc", "company_type_id"), ("company_type", "ct", "id"), ("ct_id",)),
    "join_movie_companies_title": PrefixedJoin(("movie_companies", "mc", "movie_id"), ("title", "t", "id"), ("t_id",)),
    "join_movie_link_link_type": PrefixedJoin(("movie_link", "ml", "link_type_id"), ("link_type", "lt", "id"), ("lt_id",)),
    "join_movie_link_title": PrefixedJoin(("movie_link", "ml", "movie_id"), ("title", "t", "id"), ("t_id",)),
    "join_aka_title_title": PrefixedJoin(("aka_title", "at", "movie_id"), ("title", "t", "id"), ("t_id",)),
}


def prefixed_join(left: tuple[DataFrame, str, str], right: tuple[DataFrame, str, str],
                  drop: Sequence[str] = ()) -> DataFrame:
    (ldf, la, lk), (rdf, ra, rk) = left, right
    return equi_join(prefixed(ldf, la), prefixed(rdf, ra), ((f"{la}_{lk}", f"{ra}_{rk}"),), drop)


def movie_join(tables: Mapping[str, DataFrame], name: str) -> DataFrame:
    j = MOVIE_JOINS[name]
    (lt, la, lk), (rt, ra, rk) = j.left, j.right
    return prefixed_join((tables[lt], la, lk), (tables[rt], ra, rk), j.drop)


def twice_joined(fact: DataFrame, dimension: DataFrame, first: tuple[str, str], second: tuple[str, str],
                 key: str, label: str) -> DataFrame:
    """One dimension joined twice; ``first`` and ``second`` are (fact column, name of the label)."""
    out = fact
    for col, name in (first, second):
        dim = dimension.select(quoted(key).alias("__key"), quoted(label).alias(name))
        out = out.join(dim, out[quoted_name(col)] == F.col("__key"), "inner").drop("__key")
    return out


def complete_cast_join(tables: Mapping[str, DataFrame]) -> DataFrame:
    """complete_cast with the kind of its subject and of its status."""
    return twice_joined(prefixed(tables["complete_cast"], "cc"), tables["comp_cast_type"],
                        ("cc_subject_id", "cc_subject_kind"), ("cc_status_id", "cc_status_kind"), "id", "kind")


def run_means(runs: DataFrame) -> DataFrame:
    """Mean time and memory of the successful runs per configuration."""
    return (runs.where("ok").groupBy("scenario", "engine", "attrs", "n_rows", "threshold")
                .agg(F.avg("seconds").alias("mean_seconds"), F.avg("gigabytes").alias("mean_gigabytes"),
                     F.count(F.lit(1)).alias("n_runs")))
