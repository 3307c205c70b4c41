"""What knowledge tracing adds to a plan's scores, against a plain fold."""

import pytest

from praxilog.models import bkt
from praxilog.operators import planner

from .test_core import random_rows, table

GIVEN = {"s1": (0.4, 0.2, 0.1, 0.15, 0.05)}


@pytest.fixture(scope="module")
def model(spark):
    return spark.createDataFrame([(s, *p) for s, p in GIVEN.items()], "skill string, " + ", ".join(f"{n} double" for n in bkt.NAMES))


def order(r):
    return (r["timestamp"] is None, r["timestamp"] or 0, r["source_sequence"])


def domain(r, question=None):
    return (question or r["question_id"]) if r["order_scope"] == "question" else ""


def chance(rows, learner, question, tags, primary):
    own = sorted((r for r in rows if r["learner_id"] == learner), key=order)
    out = []
    for tag in tags[:1] if primary else tags:
        p = GIVEN.get(tag, bkt.DEFAULTS)
        known = p[0]
        for r in own:
            counted = r["skills"][:1] if primary else r["skills"]
            if tag in counted and domain(r) == domain(own[-1], question):
                known = bkt.step(known, r["correct"], *p)[2]
        out.append(known * (1 - p[2]) + (1 - known) * p[3])
    return sum(out) / len(out) if out else None


@pytest.mark.parametrize("primary", [True, False])
def test_scores_rise_with_what_the_model_expects_to_go_wrong(spark, model, primary):
    rows = [{"event_id": f"e{i:04d}", "source_sequence": i} | r for i, r in enumerate(random_rows(3, 160))]
    made = table(spark, rows)
    config = planner.PlanConfig(model_weight=0.5)
    plain = {(r["learner_id"], r["question_id"]): r for r in planner.candidates(made, config).collect()}
    for r in planner.candidates(made, config, model, primary).collect():
        p = chance(rows, r["learner_id"], r["question_id"], r["tags"], primary)
        assert r["score"] == pytest.approx(plain[r["learner_id"], r["question_id"]]["score"] + (0.5 * (1 - p) if p is not None else 0))


def test_questions_that_were_never_tried_have_no_tags_and_no_term(spark, model):
    made = table(spark, [{"skills": ["s1"]}, {"learner_id": "b", "skills": []}])
    config = planner.PlanConfig(available=("q", "new"))
    plain = {(r["learner_id"], r["question_id"]): r["score"] for r in planner.candidates(made, config).collect()}
    got = {(r["learner_id"], r["question_id"]): r["score"] for r in planner.candidates(made, config, model).collect()}
    assert {k for k in got if got[k] != plain[k]} == {("a", "q")}
    with pytest.raises(ValueError, match="finite"):
        planner.candidates(made, planner.PlanConfig(model_weight=-1.0))
