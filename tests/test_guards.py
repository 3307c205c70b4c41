"""Leakage guards, slices, intervals, item response and kept artifacts against plain Python."""

import math

import pytest
from pyspark.sql import functions as F

from praxilog.models import irt, logistic
from praxilog.operators import experiment, integrity, leakage, metrics, splits, units
from praxilog.plans import artifacts
from praxilog.sources import workload

from .test_core import random_rows, table


def predicted(spark, rows, salt=7):
    p = (F.pmod(F.xxhash64(F.lit(salt), "event_id"), F.lit(19)) + 1) / 20.0
    return table(spark, rows).withColumn("probability", p)


def area(pairs):
    """Area under the curve of (weight, hit, probability), ties counting half."""
    pos, neg = [(w, p) for w, y, p in pairs if y and w], [(w, p) for w, y, p in pairs if not y and w]
    if not pos or not neg:
        return None
    return sum(a * b * (1.0 if p > q else 0.5 if p == q else 0.0) for a, p in pos for b, q in neg) / (sum(w for w, _ in pos) * sum(w for w, _ in neg))


def test_slices_are_those_of_plain_masks(spark):
    made = predicted(spark, random_rows(5, 240))
    train, rest = made.where("source_sequence < 40 and learner_id <> 'u1' and question_id <> 'q3'"), made.where("source_sequence >= 40")
    domain = lambda r: (r.learner_id, r.question_id if r.order_scope == "question" else "")
    domains, items = {domain(r) for r in train.collect()}, {r.question_id for r in train.collect()}
    want = {}
    for r in rest.collect():
        labels = [("learner", "warm" if domain(r) in domains else "cold"), ("item", "warm" if r.question_id in items else "cold"), ("each_learner", r.learner_id)]
        for x in labels + ([("skill", s) for s in r.skills] or [("untagged", "")]):
            want.setdefault(x, []).append((1, r.correct, r.probability))
    got = {(r["slice"], r["value"]): r for r in metrics.slices(rest, train).collect()}
    assert got.keys() == want.keys() and ("learner", "cold") in got and ("item", "cold") in got
    for k, pairs in want.items():
        loss = sum(-math.log(p if y else 1 - p) for _, y, p in pairs) / len(pairs)
        assert (got[k].n, got[k].log_loss, got[k].auroc) == (len(pairs), pytest.approx(loss), pytest.approx(area(pairs)))


def test_intervals_weigh_whole_clusters(spark):
    made = predicted(spark, random_rows(6, 200))
    weights = {(r.learner_id, d): w for r in made.select("learner_id").distinct().withColumn("w", metrics.drawn("learner_id", 30, 3)).collect() for d, w in enumerate(r.w)}
    rows = made.collect()
    areas = [area([(weights[r.learner_id, d], r.correct, r.probability) for r in rows]) for d in range(30)]
    areas = sorted(a for a in areas if a is not None)
    got = metrics.auroc_interval(made, repetitions=30, seed=3).first()
    at = lambda q: areas[int(q * (len(areas) - 1))] + (q * (len(areas) - 1) % 1) * (areas[math.ceil(q * (len(areas) - 1))] - areas[int(q * (len(areas) - 1))])
    assert got.eligible_draws == len(areas) and got.auroc_lower == pytest.approx(at(0.025)) and got.auroc_upper == pytest.approx(at(0.975))
    own = metrics.residual_interval(made, repetitions=30).first()
    assert own.clusters == 4 and own.residual_lower <= own.residual_upper
    assert metrics.residual_interval(made.where("learner_id = 'u1'"), repetitions=30).first().residual_lower is None


def test_only_the_largest_component_is_fitted(spark):
    rows = [{"learner_id": f"{side}{i % 3}", "question_id": f"{side}q{i % 4}", "correct": (i * 7) % 3 > 0} for side, n in (("a", 60), ("b", 90)) for i in range(n)]
    rows += [{"learner_id": f"c{i}", "question_id": f"cq{i + k}", "correct": True} for i in range(12) for k in (0, 1)]
    own = irt.responses(table(spark, rows))
    found = {r.learner_id: r.component.learner_id for r in irt.components(own).collect()}
    assert all(c == k[0] + "0" for k, c in found.items()) and len(found) == 18
    kept = irt.eligible(own, 1, 1)
    assert {r.learner_id for r in kept.collect()} == {"b0", "b1", "b2"}
    assert irt.eligible(own, 1000, 1).count() == 0


def test_abilities_go_on_as_a_fold_does(spark):
    made = table(spark, random_rows(8, 260)).where("order_scope = 'learner'")
    train, later = made.where("source_sequence < 120"), made.where("source_sequence >= 120")
    own = irt.eligible(irt.responses(train.where("question_id <> 'q5'")), 1, 1)
    learners, items = irt.fit(own, rounds=3)
    precise, each = irt.support(own, learners, items)
    state = {r.learner_id: (r.ability, r.precision) for r in precise.collect()}
    known = {r.question_id: (r.difficulty, r.discrimination) for r in each.collect()}
    assert each.where("unstable is null or standard_error <= 0").count() == 0
    got = {r.event_id: r.probability for r in irt.predict_online(precise, items, later).collect()}
    placed = sorted(units.units(later).collect(), key=lambda r: (r.learner_id, r.pos))
    held, last = {}, None
    for r in placed:
        now = state.setdefault(r.learner_id, (0.0, 0.1))
        if (r.learner_id, r.unit) != last:
            last, held = (r.learner_id, r.unit), now
        if r.question_id in known:
            d, a = known[r.question_id]
            assert got[r.event_id] == pytest.approx(1 / (1 + math.exp(-a * (held[0] - d))))
            state[r.learner_id] = irt.moved(*now, r.correct, d, a)
        else:
            assert got[r.event_id] == 0.5
    assert len(got) == len(placed)


def test_features_and_what_they_depend_on(spark):
    made = table(spark, random_rows(2, 120))
    features = units.feature_map(made)
    assert leakage.unknown_features(features).count() == 0
    odd = features.limit(3).withColumn("features", F.create_map(F.lit("next_answer"), F.lit(1.0)))
    assert [(r.name, r.n) for r in leakage.unknown_features(odd).collect()] == [("next_answer", 3)]
    assert leakage.changed_prefixes(made, 2).count() == 0
    place = {r.event_id: ((r.learner_id, r.domain), r.unit) for r in units.units(made).collect()}
    asked = [("t", a, b) for a in [*list(place)[:12], "none"] for b in [*list(place)[::9], "lost"]]

    def fault(a, b):
        if a not in place:
            return "no target"
        if b not in place:
            return "unknown"
        (x, u), (y, v) = place[a], place[b]
        return "other domain" if x != y else "same unit" if u == v else "later unit" if v > u else None

    want = {(a, b): fault(a, b) for _, a, b in asked if fault(a, b)}
    got = leakage.late_dependencies(made, spark.createDataFrame(asked, "source_namespace string, event_id string, depends_on string"))
    assert {(r.event_id, r.depends_on): r.reason for r in got.collect()} == want


def test_fits_see_their_own_parts_alone(spark):
    split = splits.forward_split(table(spark, [{"learner_id": f"u{i % 4}"} for i in range(80)]))
    scopes = leakage.fit_scopes(split)
    sound = leakage.scope_faults(scopes, split).collect()
    assert {r.component for r in sound} == set(leakage.SCOPES) and all(r.repeated == r.outside == r.missing == r.unasked == 0 for r in sound)
    test = split.where("part = 'test'").limit(2).select(F.lit("item_priors").alias("component"), F.lit("train").alias("part"), "source_namespace", "event_id")
    bad = scopes.where("component <> 'feature_scaler'").union(test).union(scopes.where("component = 'model_parameters'").limit(1)).union(test.limit(1).withColumn("component", F.lit("other")))
    got = {r.component: (r.repeated, r.outside, r.missing, r.unasked) for r in leakage.scope_faults(bad, split).collect()}
    n = split.where("part = 'train'").count()
    assert got["item_priors"] == (0, 2, 0, 0) and got["feature_scaler"] == (0, 0, n, 0) and got["model_parameters"] == (1, 0, 0, 0) and got["other"] == (0, 1, 0, 1)
    digests = lambda s: {r.component: r.digest for r in leakage.scope_digests(s).collect()}
    assert digests(scopes) == digests(scopes.orderBy(F.desc("event_id"))) != digests(bad)


def test_drift_has_each_windows_calibration(spark):
    rows = [{"question_id": "a" if i < 100 else "b", "correct": i < 100, "duration_ms": 5.0 if i < 100 else None, "duration_scope": "event" if i < 100 else "unknown"} for i in range(200)]
    made = predicted(spark, rows)
    got = integrity.drift_report(made, "a", predictions=made)
    assert got["reference"]["estimate"] == 1 and got["missingness"]["no_duration"]["current"]["estimate"] == 1
    assert [sum(b["n"] for b in got["calibration"][p]) for p in ("reference", "current")] == [100, 100]
    assert integrity.drift_report(made, "a", predictions=made.where("source_sequence > 3"))["calibration"] is None


def test_artifacts_are_kept_once_and_checked(spark, tmp_path):
    root, rows = str(tmp_path), spark.range(50).withColumn("x", F.col("id") * 2)
    own = artifacts.publish(spark, root, "table", {"a": rows.coalesce(2), "b": rows.limit(0)}, {"k": 1})
    assert own == artifacts.publish(spark, root, "table", {"a": rows.coalesce(2), "b": rows.limit(0)}, {"k": 1}) != artifacts.publish(spark, root, "table", {"a": rows.coalesce(2), "b": rows.limit(0)}, {"k": 2})
    assert artifacts.verify(spark, root, own) == [] and artifacts.load(spark, root, own, "a").count() == 50 and not list((tmp_path / "staging").glob("*"))
    made = []
    ask = lambda: artifacts.cached(spark, root, "d", "1", {"learner": None}, lambda: made.append(1) or {"a": rows.coalesce(1)})
    assert ask() == (kept := ask()) and made == [1]
    file = next((tmp_path / "artifacts" / kept / "a").glob("*.parquet"))
    (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
    file.write_bytes(file.read_bytes()[::-1])
    assert artifacts.verify(spark, root, kept) == [f"a/{file.name}"]
    with pytest.raises(ValueError):
        ask()


def test_models_come_back_as_they_were(spark, tmp_path):
    demo = workload.demo_attempts(spark, 8, 20).cache()
    rows = demo.join(units.feature_map(demo), ["source_namespace", "event_id"])
    model = logistic.LogisticHistory(0.5).fit(rows)
    model.save(spark, str(tmp_path / "m"))
    back = logistic.LogisticHistory.load(spark, str(tmp_path / "m"))
    key = lambda m: sorted((r.event_id, round(r.probability, 12)) for r in m.predict(rows).collect())
    assert key(model) == key(back) and back.c == 0.5


def test_ablations_predict_what_the_models_do(spark):
    demo = workload.demo_attempts(spark, 16, 40).cache()
    names = ("irt2", "logistic_without_skills", "logistic_without_time", "hierarchical_without_shrinkage")
    made = experiment.run(demo, names).cache()
    assert {r["count"] for r in made.groupBy("model").count().collect()} == {made.where("model = 'irt2'").count()} and made.where("probability is null").count() == 0
