"""Conditional sensitivity formula over a table of scenarios."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.functions.typed import finite
from parcelwise.operators.ingest import first_reason

PARAMETERS = (
    "eligible", "take_up", "incremental", "stock", "supply_elasticity", "demand_elasticity", "horizon_months",
)


def scenarios(params: DataFrame, sources: str = "sources") -> DataFrame:
    """Percent change = 100 * demand shift / (supply + demand elasticity); bad rows keep a reason instead.

    ``sources`` is an array with one text per parameter; every one must be given and not blank.
    """
    sourced = (F.size(sources) == len(PARAMETERS)) & F.forall(sources, lambda s: F.coalesce(F.btrim(s) != "", F.lit(False)))
    known = F.lit(True)
    for p in PARAMETERS:
        known = known & finite(F.col(p)).isNotNull()
    take, inc = F.col("take_up"), F.col("incremental")
    invalid = (
        (F.col("eligible") < 0) | (F.col("stock") <= 0) | (F.col("horizon_months") <= 0)
        | (F.col("supply_elasticity") < 0) | (F.col("demand_elasticity") <= 0)
    )
    reason = first_reason(
        ("source_missing", ~sourced), ("not_finite", ~known),
        ("fraction_out_of_range", ~take.between(0, 1) | ~inc.between(0, 1)),
        ("invalid_stock_horizon_or_elasticity", invalid),
    )
    shift = F.try_divide(F.col("eligible") * take * inc, F.col("stock"))
    change = F.lit(100.0) * shift / (F.col("supply_elasticity") + F.col("demand_elasticity"))
    return params.withColumn("reason", reason).withColumn("percent_change", F.when(F.col("reason").isNull(), change))
