"""Closed-form attempts of any number, for scale tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Of every 1000 records the last three are a repeat, a contradiction and an invalid one.
BLOCK, GOOD = 1000, 997


def workload(spark: SparkSession, rows: int) -> DataFrame:
    """Records ``row``, ``value``, ``error`` as readers give them, from an expression of the row alone."""
    i = F.col("id")
    place = i % BLOCK
    target = F.when(place.isin(GOOD, GOOD + 1), i - (place - (GOOD - 1))).otherwise(i)
    right = F.when(place == GOOD + 1, target % 3 == 0).otherwise(target % 3 != 0)
    text = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    value = F.concat(
        F.lit('{"event_id":'), text(target), F.lit(',"learner_id":'), text(F.concat(F.lit("learner-"), target % 10000)), F.lit(',"question_id":'), text(F.concat(F.lit("question-"), target % 200)),
        F.lit(',"skills":['), text(F.concat(F.lit("skill-"), target % 10)), F.lit('],"correct":'), F.when(place == GOOD + 2, '"false"').when(right, "true").otherwise("false"),
        F.lit(',"source_sequence":'), target, F.lit(',"duration_ms":60000,"duration_scope":"event","attempt_kind":"practice"}'),
    )
    return spark.range(rows).select((i + 1).alias("row"), value.alias("value"), F.lit(None).cast("string").alias("error"))


def expected(rows: int) -> dict[str, int]:
    """What an import of :func:`workload` counts."""
    blocks, rest = divmod(rows, BLOCK)
    out = {k: blocks + (rest > GOOD + j) for j, k in enumerate(("duplicates", "conflicts", "rejected"))}
    return {"received": rows, "accepted": rows - sum(out.values()), **out}


def demo_attempts(spark: SparkSession, learners: int = 50, attempts: int = 60, seed: int = 0) -> DataFrame:
    """Seeded attempts of learners who come to know three skills: columns of the attempt table without digests."""
    import numpy as np
    import pandas as pd

    from ..models.bkt import DEFAULTS
    from ..schema import CONTENT, VERSION

    def run(batches):
        for batch in batches:
            out = []
            for learner in batch["id"]:
                rng = np.random.default_rng([seed, int(learner)])
                known = rng.random(3) < DEFAULTS[0]
                for k in range(attempts):
                    s = int(rng.integers(3))
                    right = bool(rng.random() < (1 - DEFAULTS[2] if known[s] else DEFAULTS[3]))
                    known[s] |= rng.random() < DEFAULTS[1]
                    out.append((VERSION, "demo", f"{learner}:{k}", f"learner-{learner}", f"item-{s}-{int(rng.integers(8))}", [f"skill-{s}"], right, "practice", k, f"session-{k // 3}", "learner", "unknown", "unknown"))
            yield pd.DataFrame(out, columns=["schema_version", "source_namespace", "event_id", "learner_id", "question_id", "skills", "correct", "attempt_kind", "source_sequence", "session_id", "order_scope", "time_semantics", "duration_scope"])

    rows = spark.range(learners).mapInPandas(run, "schema_version string, source_namespace string, event_id string, learner_id string, question_id string, skills array<string>, correct boolean, attempt_kind string, source_sequence long, session_id string, order_scope string, time_semantics string, duration_scope string")
    return rows.withColumns({"timestamp": F.lit(None).cast("timestamp"), "duration_ms": F.lit(None).cast("double"), "bundle_id": F.lit(None).cast("string")}).select(*CONTENT)
