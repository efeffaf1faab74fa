"""Business rules of the sample flows, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What the review tiers, operations and rules mean.
TIERS = {0: "SETTLED", 1: "REVIEW", 2: "HOLD"}
WRITING_OPS = ("I", "U")


def settlement(valid: Column, tier: Column) -> Column:
    """What happens with an order; a tier that no stage assigns is an error."""
    out = F.when(~valid, "REJECTED")
    for value, name in TIERS.items():
        out = out.when(tier == value, name)
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown review tier "), F.coalesce(tier.cast("string"), F.lit("null")))))


def fee(amount: Column, basis_points: float, fixed: float) -> Column:
    """A share and a fixed part, in cents rounded half away from zero."""
    cents = (amount * basis_points / 10000 + fixed) * 100
    return F.signum(cents) * F.floor(F.abs(cents) + 0.5) / 100


def fraud_score(amount: Column, customer: Column) -> Column:
    """Additive weights, 1.0 at most; a customer without a number counts as 0."""
    # The weights and limits of the score.
    number = F.coalesce(F.ltrim(customer, F.lit("C")).try_cast("int"), F.lit(0))
    weights = [(amount > 2000, 0.35), (number.between(800, 900), 0.40), (amount > 4000, 0.20)]
    total = F.lit(0.0)
    for when, weight in weights:
        total = total + F.when(when, weight).otherwise(0.0)
    return F.least(F.lit(1.0), total)


def approval(valid: Column, stock: Column, fraud: Column) -> Column:
    fine = valid & stock.isin("available", "low_stock") & (fraud < 0.7)
    return F.when(fine, "approved").otherwise("rejected")


def well_formed_change(op: Column, status: Column, revision: Column, statuses: tuple[str, ...]) -> Column:
    return op.isin(*WRITING_OPS) & status.isin(*statuses) & (revision >= 1)
