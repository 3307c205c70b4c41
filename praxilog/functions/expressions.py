"""Column expressions that several operators use."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

#: Probabilities are kept this far from 0 and 1 before any loss.
CLIP = 1e-9


def order_domain(question: str = "question_id", scope: str = "order_scope") -> Column:
    """The part of an order domain beyond source and learner: the question where order holds only within it."""
    return F.when(F.col(scope) == "question", F.col(question)).otherwise(F.lit(""))


DOMAIN = ("source_namespace", "learner_id", "domain")


def known_order() -> list[Column]:
    """Order within a domain: time, unknown last, then source sequence, then event."""
    return [F.col("timestamp").asc_nulls_last(), F.col("source_sequence").asc_nulls_last(), F.col("event_id").asc_nulls_last()]


def place_in_order() -> Column:
    """A value that sorts as :func:`known_order` does."""
    return F.struct(*[x for c in ("timestamp", "source_sequence", "event_id") for x in (F.col(c).isNull().alias(f"no_{c}"), F.col(c))])


def within(*keys: str | Column) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*known_order())


def running(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def z_value(confidence: float = 0.95) -> float:
    return NormalDist().inv_cdf(0.5 + confidence / 2)


def wilson(successes: Column, n: Column, confidence: float = 0.95) -> dict[str, Column]:
    """Estimate and Wilson bounds of a proportion; all null where nothing was observed."""
    z, p, m = z_value(confidence), successes / n, n.cast("double")
    middle = (p + F.lit(z * z / 2) / m) / (1 + F.lit(z * z) / m)
    half = F.lit(z) * F.sqrt(p * (1 - p) / m + F.lit(z * z / 4) / (m * m)) / (1 + F.lit(z * z) / m)
    seen = lambda c: F.when(n > 0, c)
    return {
        "estimate": seen(successes.cast("double") / m),
        "lower": seen(F.greatest(F.lit(0.0), middle - half)),
        "upper": seen(F.least(F.lit(1.0), middle + half)),
    }


def clipped(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(CLIP)), F.lit(1 - CLIP))


def log_loss(correct: Column, p: Column) -> Column:
    q = clipped(p)
    return -F.when(correct, F.ln(q)).otherwise(F.log1p(-q))


def logit(p: Column) -> Column:
    q = clipped(p)
    return F.ln(q / (1 - q))


def csv_guarded(value: Column) -> Column:
    """A text cell that spreadsheets don't take for a formula."""
    return F.when(value.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), value)).otherwise(value)


def csv_unguarded(value: Column) -> Column:
    return F.regexp_replace(value, r"^'(?=[=+\-@\t\r])", "")


def identity_hash(namespace: Column, event: Column) -> Column:
    return F.sha2(F.to_json(F.array(namespace, event)), 256)
