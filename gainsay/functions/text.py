"""Rendering, parsing and triage of denial-constraint text, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (must equal the published output and rules).
OPERATORS = ("==", "!=", ">", "<=", "<", ">=")
ORDER_OPERATORS = ("<", "<=", ">", ">=")
DC_PATTERN = r"!\(\s*(.*?)\s*\)"
PREDICATE_PATTERN = r"([a-zA-Z0-9_]+)\s*(==|!=|>=|<=|>|<)\s*([a-zA-Z0-9_]+)"
TYPE_SUFFIX_PATTERN = r"\((String|Integer|Double)\)"
KEY_PATTERN = r"^(id|.*_id)$"
LOOKUP_PAIRS = (
    ("rt_id", "rt_role"),
    ("it_id", "it_info"),
    ("kt_id", "kt_kind"),
    ("ct_id", "ct_kind"),
    ("lt_id", "lt_link"),
    ("cct_sub_id", "cc_subject_kind"),
    ("cct_stat_id", "cc_status_kind"),
)
EMPTY = "Empty/Invalid"
SINGLE_COLUMN = "Single-column Triviality"
LOOKUP = "Lookup Name Mapping"
SPURIOUS_ORDER = "Spurious Order Dependency (Sequential sorting artifact)"
USEFUL = "Potentially Useful"


def predicate_text(col: Column, op: Column) -> Column:
    return F.concat_ws(" ", col, op, col)


def dc_text(predicates: Column, style: str = "default") -> Column:
    """Text of ``array<struct<col, op>>``.

    ``default`` is ``!(a == a & b != b & )`` with the trailing separator; ``sql`` names the two
    rows: ``!(t1.a = t2.a & t1.b != t2.b)``.
    """
    if style == "default":
        parts = F.transform(predicates, lambda p: F.concat(predicate_text(p["col"], p["op"]), F.lit(" & ")))
        return F.concat(F.lit("!("), F.concat_ws("", parts), F.lit(")"))
    if style == "sql":
        parts = F.transform(predicates, lambda p: F.concat(
            F.lit("t1."), p["col"], F.lit(" "),
            F.when(p["op"] == "==", F.lit("=")).otherwise(p["op"]),
            F.lit(" t2."), p["col"]))
        return F.concat(F.lit("!("), F.concat_ws(" & ", parts), F.lit(")"))
    raise ValueError(f"unknown style {style!r}")


def dependency_text(column_id: Column, target_id: Column, score: Column) -> Column:
    """``f t score`` with six decimals."""
    return F.concat_ws(" ", column_id.cast("string"), target_id.cast("string"), F.format_string("%.6f", score))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once a row, however often it is used and wherever the optimizer moves the result."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def parse_dc(line: Column) -> Column:
    """Text line to ``array<struct<left, op, right>>``; NULL when the line holds no constraint."""
    def parsed(clean: Column) -> Column:
        pieces = F.split(F.regexp_extract(clean, DC_PATTERN, 1), "&")
        terms = F.transform(pieces, lambda p: F.struct(
            F.regexp_extract(p, PREDICATE_PATTERN, 1).alias("left"),
            F.regexp_extract(p, PREDICATE_PATTERN, 2).alias("op"),
            F.regexp_extract(p, PREDICATE_PATTERN, 3).alias("right")))
        return F.when(clean.rlike(DC_PATTERN), F.filter(terms, lambda p: p["op"] != ""))

    return once(F.regexp_replace(line, TYPE_SUFFIX_PATTERN, ""), parsed)


def classify(parsed: Column, key_pattern: str = KEY_PATTERN,
             lookup_pairs: Iterable[tuple[str, str]] = LOOKUP_PAIRS) -> Column:
    """Triage class of a parsed constraint; the first rule that applies wins."""
    pairs = F.array(*[F.lit("|".join(sorted(p))) for p in lookup_pairs])

    def category(terms: Column, attrs: Column) -> Column:
        is_lookup = (F.size(attrs) == 2) & F.array_contains(pairs, F.array_join(F.array_sort(attrs), "|"))
        only_order = F.forall(terms, lambda p: p["op"].isin(*ORDER_OPERATORS))
        has_key = F.exists(attrs, lambda c: c.rlike(key_pattern))
        return (F.when(terms.isNull() | (F.size(terms) == 0), F.lit(EMPTY))
                 .when(F.size(attrs) <= 1, F.lit(SINGLE_COLUMN))
                 .when(is_lookup, F.lit(LOOKUP))
                 .when(only_order & has_key, F.lit(SPURIOUS_ORDER))
                 .otherwise(F.lit(USEFUL)))

    # Both are bound as lambda variables: as plain columns a filter on the class would parse the line again for every use.
    return once(parsed, lambda terms: once(
        F.array_distinct(F.concat(F.transform(terms, lambda p: p["left"]), F.transform(terms, lambda p: p["right"]))),
        lambda attrs: category(terms, attrs)))


def is_useless(category: Column) -> Column:
    return category != F.lit(USEFUL)
