"""Comparing a reported value with its evidence, and rolling outcomes up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.numeric import crosses, implied_pct, is_missing, relative_error, self_consistent, with_cells
from auditlake.functions.units import units_differ

#: Bands of relative error for means, spreads and bounds of intervals, and of absolute error for thresholds (fixed values).
MEAN, SPREAD, INTERVAL, THRESHOLD = 0.01, 0.03, 0.05, 0.001


def with_tolerances(rows: DataFrame, bands: DataFrame, key: str = "field_type") -> DataFrame:
    """rows with the bands of their field type, else those of the entry `*`. bands is a contract's: a row for each field type that has its own."""
    names = [c for c in bands.columns if c != key]
    default = bands.where(F.col(key) == "*").first()
    own = bands.where(F.col(key) != "*")
    held = rows.join(F.broadcast(own), key, "left")
    return held.withColumns({n: F.coalesce(n, F.lit(default[n] if default else None)) for n in names})


def _filled(cell: Column, parts: Column) -> Column:
    """A parsed cell whose missing bounds are those that were read beside it; nothing that is printed is changed, and parts that were refused aren't used."""
    usable = F.coalesce(parts["status"], F.lit("ok")) != "protocol_error"
    fill = {f"ci_{n}": F.coalesce(cell[f"ci_{n}"], F.when(usable, parts[n])) for n in ("level", "lower", "upper")}
    return F.when(cell.isNull(), cell).otherwise(F.struct(*((fill.get(n, cell[n])).alias(n) for n in ("primary", "spread", "spread_kind", "lower", "upper", "operator", "ci_lower", "ci_upper", "ci_level", "events", "total", "pct", "form"))))


def compare_values(rows: DataFrame, review: str, source: str, review_unit: str | None, source_unit: str | None, null_value: float | Column = 1.0, omitted: Column | None = None, mean: float | Column = MEAN, spread: float | Column = SPREAD, threshold: float | Column = THRESHOLD, scope: str | None = None, components: str | None = None) -> DataFrame:
    """rows with label, mode, review_required. In this order: populations that don't go together (scope, a column of scope_verdict), a missing value, units that differ, an unparsed one, structure (bounds, proportions, intervals), means, spreads.

    Where an interval agrees on both sides the point estimates aren't compared. What one side states and the other doesn't is left unconsumed: it asks for a review, and makes the pair not comparable where the source is known to have left it out (`omitted`, or parts read from the source that are incomplete). components: a struct of status, level, lower, upper and missing that was read beside the source's value. Bands may be columns (see with_tolerances)."""
    held = with_cells(rows, _a=F.col(review), _b=F.col(source))
    if components is not None:
        parts = F.col(components)
        held = held.withColumn("_b", _filled(F.col("_b"), parts))
        left = (parts["status"] == "incomplete") & (F.size(parts["missing"]) > 0)
        omitted = left if omitted is None else omitted | left
    a, b = F.col("_a"), F.col("_b")
    within = lambda x, y, band: relative_error(x, y) <= band
    op_a, op_b = a["operator"], b["operator"]
    pct_a, pct_b = F.coalesce(a["pct"], implied_pct(a)), F.coalesce(b["pct"], implied_pct(b))
    both_ci = a["ci_lower"].isNotNull() & b["ci_lower"].isNotNull()
    one_ci = a["ci_lower"].isNotNull() != b["ci_lower"].isNotNull()
    both_pct, one_pct = pct_a.isNotNull() & pct_b.isNotNull(), pct_a.isNotNull() != pct_b.isNotNull()
    bounded = op_a.isNotNull() | op_b.isNotNull()
    structured = bounded | pct_a.isNotNull() | pct_b.isNotNull() | a["ci_lower"].isNotNull() | b["ci_lower"].isNotNull()
    holds = lambda exact, op, bound: F.when(op == "<", exact < bound).when(op == "<=", exact <= bound).when(op == ">", exact > bound).otherwise(exact >= bound)
    satisfied = F.when(op_a.isNotNull(), holds(b["primary"], op_a, a["primary"])).otherwise(holds(a["primary"], op_b, b["primary"]))
    null = null_value if isinstance(null_value, Column) else F.lit(null_value)
    level_differs = F.coalesce(a["ci_level"] != b["ci_level"], F.lit(False))
    refused = (
        F.when(~self_consistent(a, 0.01) | ~self_consistent(b, 0.01), "not_comparable")
        .when(op_a.isNotNull() & op_b.isNotNull() & ((op_a != op_b) | ~((F.abs(a["primary"] - b["primary"]) <= threshold) | within(a["primary"], b["primary"], mean))), "mismatch")
        .when((op_a.isNotNull() != op_b.isNotNull()) & satisfied, "not_comparable")
        .when((op_a.isNotNull() != op_b.isNotNull()), "mismatch")
        .when(both_pct & ~within(pct_a, pct_b, mean), "mismatch")
        .when(a["events"].isNotNull() & b["events"].isNotNull() & ((a["events"] != b["events"]) | (a["total"] != b["total"])), "mismatch")
        .when(both_ci & level_differs, "mismatch")
        .when(both_ci & (crosses(a["ci_lower"], a["ci_upper"], null) != crosses(b["ci_lower"], b["ci_upper"], null)), "mismatch")
        .when(both_ci & ~(within(a["ci_lower"], b["ci_lower"], INTERVAL) & within(a["ci_upper"], b["ci_upper"], INTERVAL)), "mismatch")
    )
    unconsumed, compared = one_ci | one_pct, both_ci | both_pct | (op_a.isNotNull() & op_b.isNotNull())
    near = within(a["primary"], b["primary"], mean)
    apart = (a["spread_kind"] == "sd") & (b["spread_kind"] == "sd") & ~within(a["spread"], b["spread"], spread)
    units = units_differ(F.col(review_unit), F.col(source_unit)) if review_unit and source_unit else F.lit(False)
    blocked = F.coalesce(F.col(scope).isin("mismatch", "unresolved"), F.lit(False)) if scope else F.lit(False)
    early = F.when(blocked, "not_comparable").when(is_missing(F.col(review)) | is_missing(F.col(source)), "not_comparable").when(units, "unit_mismatch").when(a["primary"].isNull() | b["primary"].isNull(), "not_comparable")
    left_out = F.coalesce(omitted, F.lit(False)) if omitted is not None else F.lit(False)
    held = held.withColumns({"_early": early, "_refused": refused, "_structured": structured & (compared | unconsumed | refused.isNotNull()), "_unconsumed": unconsumed, "_compared": compared})
    inside = F.col("_early").isNull() & F.col("_structured")
    label = (
        F.when(F.col("_early").isNotNull(), F.col("_early")).when(inside & F.col("_refused").isNotNull(), F.col("_refused"))
        .when(inside & F.col("_unconsumed") & left_out, "not_comparable").when(inside & F.col("_compared"), "match")
        .when(~near, "mismatch").when(~inside & F.coalesce(apart, F.lit(False)), "mismatch").otherwise("match")
    )
    ask = blocked | (inside & F.col("_refused").isNull() & F.col("_unconsumed"))
    return held.withColumns({"label": label, "mode": F.when(inside, "structured").otherwise("numeric"), "review_required": ask}).drop("_a", "_b", "_early", "_refused", "_structured", "_unconsumed", "_compared")


def verdict(n: Column, match: Column, mismatch: Column, unit: Column, partial: Column, not_comparable: Column) -> Column:
    """None compared: INCOMPLETE; a mismatch: FAIL; a unit or part in doubt: PARTIAL; no match: INCOMPLETE; anything not comparable: PARTIAL; else PASS."""
    return F.when(n == 0, "INCOMPLETE").when(mismatch > 0, "FAIL").when(unit + partial > 0, "PARTIAL").when(match == 0, "INCOMPLETE").when(not_comparable > 0, "PARTIAL").otherwise("PASS")


def scope_verdict(review: Column, source: Column, required: Column) -> Column:
    """A stated conflict is a mismatch; a required scope that either side leaves open is unresolved."""
    stated = review.isNotNull() & source.isNotNull()
    return F.when(stated & (review != source), "mismatch").when(required & ~stated, "unresolved").when(stated, "resolved").otherwise("not_required")
