"""The core operators against small worked cases and plain Python folds."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from praxilog.functions.expressions import csv_guarded, csv_unguarded, wilson
from praxilog.functions.numeric import beta_quantile
from praxilog.models import baselines, bkt, hierarchical, irt
from praxilog.operators import experiment, ingest, integrity, metrics, overview, planner, splits, units
from praxilog.plans.store import Store, export
from praxilog.schema import ATTEMPTS, CONTENT
from praxilog.sources import readers, tutoring, workload
from praxilog.streaming import live

BASE = {"schema_version": "attempt/1", "source_namespace": "t", "learner_id": "a", "question_id": "q", "skills": ["s1"], "correct": True, "attempt_kind": "practice", "timestamp": None, "duration_ms": None, "session_id": None, "bundle_id": None, "order_scope": "learner", "time_semantics": "unknown", "duration_scope": "unknown"}


def table(spark, rows):
    """Attempts with what the rows give; events and places are numbered, times are minutes."""
    full = [BASE | {"event_id": f"e{i:04d}", "source_sequence": i} | r for i, r in enumerate(rows)]
    schema = ", ".join(f"{n} {'int' if n == 'timestamp' else ATTEMPTS[n].dataType.simpleString()}" for n in CONTENT)
    made = spark.createDataFrame([tuple(r[n] for n in CONTENT) for r in full], schema)
    return made.withColumn("timestamp", F.timestamp_seconds(F.col("timestamp") * 60))


def random_rows(seed, n=300):
    r = random.Random(seed)
    return [{"learner_id": f"u{r.randrange(4)}", "question_id": f"q{r.randrange(6)}", "correct": r.random() < 0.6, "skills": r.choice([[], ["s1"], ["s1", "s2"]]), "session_id": r.choice([None, *(f"d{k}" for k in range(30))]), "timestamp": r.choice([None, i // 3, r.randrange(60)]), "order_scope": r.choice(["learner"] * 5 + ["question"])} for i in range(n)]


def folded(rows):
    """Units and pre-unit counts by a plain fold over each domain."""
    full = [BASE | {"event_id": f"e{i:04d}", "source_sequence": i} | r for i, r in enumerate(rows)]
    domains = {}
    for r in full:
        domains.setdefault((r["learner_id"], r["question_id"] if r["order_scope"] == "question" else ""), []).append(r)
    out = {}
    for own in domains.values():
        own.sort(key=lambda r: (r["timestamp"] is None, r["timestamp"] or 0, r["source_sequence"]))
        last = {}
        for p, r in enumerate(own):
            for key in (("s", r["session_id"]), ("t", r["timestamp"])):
                if key[1] is not None:
                    last[key] = p
        start = 0
        while start < len(own):
            end, p = start, start
            while p <= end:
                end = max(end, *(last.get((k, own[p][n]), p) for k, n in (("s", "session_id"), ("t", "timestamp"))))
                p += 1
            before = own[:start]
            for r in own[start : end + 1]:
                item = [x for x in before if x["question_id"] == r["question_id"]]
                lately = before[-10:]
                out[r["event_id"]] = (len(before), sum(x["correct"] for x in before), (sum(x["correct"] for x in lately) + 1) / (len(lately) + 2), len(item), (sum(x["correct"] for x in item) + 1) / (len(item) + 2))
            start = end + 1
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_history_features_are_those_of_a_fold(spark, seed):
    rows = random_rows(seed)
    got = {r.event_id: (r.past_attempts, r.past_successes, pytest.approx(r.recent_accuracy), r.item_past_attempts, pytest.approx(r.item_past_accuracy)) for r in units.history_features(table(spark, rows)).collect()}
    assert got == folded(rows)


def test_units_close_over_sessions_and_ties(spark):
    rows = [{"session_id": s, "timestamp": t} for s, t in (("a", 0), ("b", 1), ("a", 2), ("c", 2), ("d", 4))]
    assert [r.past_attempts for r in units.history_features(table(spark, rows)).orderBy("event_id").collect()] == [0, 0, 0, 0, 4]
    assert [r.past_attempts for r in units.history_features(table(spark, [{}] * 6)).orderBy("event_id").collect()] == list(range(6))
    assert units.check_units(table(spark, [{"session_id": "x"}] * 5), 4).count() == 1


def test_later_outcomes_change_no_earlier_features(spark):
    rows = random_rows(3, 80)
    flipped = [r | ({"correct": not r["correct"]} if i >= 60 else {}) for i, r in enumerate(rows)]
    rows, flipped = ([r | {"session_id": None, "timestamp": None, "order_scope": "learner"} for r in x] for x in (rows, flipped))
    a, b = ({r.event_id: r for r in units.feature_map(table(spark, x)).collect()} for x in (rows, flipped))
    assert all(a[e].features == b[e].features for e in a if e < "e0060") and any(a[e].features != b[e].features for e in a)


def test_durations_count_a_bundle_once(spark):
    rows = [{"duration_ms": 1000.0, "duration_scope": "event", "session_id": "s"}, *[{"duration_ms": 5000.0, "duration_scope": "bundle", "session_id": "s", "bundle_id": "b"}] * 2, {"duration_ms": 9000.0, "duration_scope": "unknown"}, {"duration_ms": 0.0, "duration_scope": "event"}]
    r = overview.duration_stats(table(spark, rows)).first()
    assert (r.n, r.total_ms, r.median_ms) == (3, 6000.0, 1000.0)
    s = overview.sessions(table(spark, rows)).first()
    assert (s.known_duration_ms, s.duration_observations) == (6000.0, 2)


def test_empty_denominators_are_null(spark):
    none = table(spark, [{"correct": False}] * 4)
    assert overview.streaks(none).first().longest_correct_streak == 0
    r = overview.coverage(overview.of_learner(none, "nobody")).first()
    assert r.n == 0 and r.estimate is None and r.lower is None
    assert overview.first_attempts(none.limit(0)).first().estimate is None
    assert metrics.metric_summary(none.limit(0).withColumn("probability", F.lit(0.5))).first().log_loss is None


def test_wilson_and_beta(spark):
    r = spark.range(1).select(*[c.alias(k) for k, c in wilson(F.lit(8), F.lit(10)).items()]).first()
    assert (round(r.estimate, 6), round(r.lower, 4), round(r.upper, 4)) == (0.8, 0.4902, 0.9433)
    assert np.allclose(beta_quantile(0.5, np.array([1.0, 2.0, 30.0]), np.array([1.0, 1.0, 30.0])), [0.5, 0.5**0.5, 0.5], atol=1e-9)
    assert abs(integrity.fisher_two_sided(3, 1, 1, 3) - 0.4857142857) < 1e-9


def test_trend_refuses_several_domains(spark):
    rows = table(spark, [{"order_scope": "question", "question_id": f"q{i % 2}"} for i in range(6)])
    with pytest.raises(ValueError):
        overview.trend(rows, "a", 4)
    assert overview.trend(rows, "a", 2, question="q1").count() == 2


def test_drift(spark):
    good = [{"question_id": "a", "duration_ms": 10.0, "duration_scope": "event"}] * 100
    bad = [{"question_id": "b", "correct": False}] * 100
    r = integrity.drift_report(table(spark, good + bad), "a")
    assert r["available"] and r["response_alert"] and r["coverage_alert"] and r["missingness"]["no_duration"]["alert"] and r["p_value"] < 1e-10
    assert not integrity.drift_report(table(spark, good[:3]), "a")["available"]


def test_splits_are_sound(spark):
    t = table(spark, random_rows(5))
    for split in (splits.forward_split(t), *(splits.rolling_splits(t).where(F.col("fold") == k) for k in range(3))):
        assert set(splits.audit_split(t, split).first()) == {0}
    by = splits.learner_split(table(spark, [{"learner_id": f"u{i % 9}"} for i in range(90)]))
    assert by.groupBy("learner_id").agg(F.count_distinct("part").alias("n")).where("n > 1").count() == 0 and by.select("part").distinct().count() == 3


def test_metrics(spark):
    rng = np.random.default_rng(0)
    p, y = np.round(rng.random(400), 2), rng.random(400) < 0.5
    t = spark.createDataFrame([(f"u{i % 7}", bool(b), float(a)) for i, (a, b) in enumerate(zip(p, y))], "learner_id string, correct boolean, probability double")
    r = metrics.metric_summary(t).first()
    pairs = [(a > b) + 0.5 * (a == b) for a in p[y] for b in p[~y]]
    assert abs(r.auroc - np.mean(pairs)) < 1e-12 and abs(r.brier - np.mean((p - y) ** 2)) < 1e-6
    bins = metrics.calibration_bins(t.where("probability < 0.45"), 10).orderBy("bin").collect()
    assert len(bins) == 10 and bins[9].n == 0 and bins[9].estimate is None
    b = metrics.bootstrap(metrics.cluster_sums(t)).first()
    assert b.loss_lower < r.log_loss < b.loss_upper


def test_knowledge_tracing(spark):
    p = (0.21, 0.11, 0.13, 0.19, 0.02)
    outcomes = [True, False, True, True, False]
    t = table(spark, [{"correct": c} for c in outcomes])
    rows = spark.createDataFrame([("s1", True, *p)], "skill string, fitted boolean, " + ", ".join(f"{n} double" for n in bkt.NAMES))
    got = [r.probability for r in bkt.predict(t, rows, 0.5).orderBy("event_id").collect()]
    known, want = p[0], []
    for c in outcomes:
        guess, _, known = bkt.step(known, c, *p)
        want.append(guess)
    assert got == pytest.approx(want, rel=1e-12)
    demo = workload.demo_attempts(spark, 12, 20).cache()
    fitted = bkt.fit(spark, demo)
    assert fitted.count() == 3 and fitted.where("fitted").count() == 3
    assert bkt.fit(spark, t).first().initial == bkt.DEFAULTS[0]


def test_models_predict_everywhere(spark):
    demo = workload.demo_attempts(spark, 20, 30).cache()
    train, test = demo.where("source_sequence < 20"), demo.where("source_sequence >= 20")
    for made in (baselines.predict_global(train, test), baselines.predict_item(train, test), hierarchical.predict(train, test, "question_id")):
        assert made.count() == test.count() and made.where("probability is null or probability <= 0 or probability >= 1").count() == 0
    rows = irt.eligible(irt.responses(train), 5, 5)
    learners, items = irt.fit(rows, 2, 3)
    assert irt.predict(learners, items, test).where("probability is null").count() == 0 and items.where("discrimination < 0.25 or discrimination > 3").count() == 0


def test_planner(spark):
    rows = [{"question_id": f"q{i % 5}", "correct": i % 3 > 0, "duration_ms": 60000.0 * (1 + i % 5), "duration_scope": "event"} for i in range(60)]
    chosen = planner.plan(table(spark, rows), planner.PlanConfig(budget_seconds=300)).orderBy("place").collect()
    assert chosen and sum(r.planned_seconds for r in chosen) <= 300 and [r.score for r in chosen] == sorted((r.score for r in chosen), reverse=True)
    assert planner.plan(table(spark, rows), planner.PlanConfig(prerequisites={"s1": ["never"]})).count() == 0
    with pytest.raises(ValueError):
        planner.PlanConfig(prerequisites={"a": ["b"], "b": ["a"]}).check()


def test_plans_are_those_of_a_plain_choice(spark):
    rows = [{"question_id": f"q{i % 9}", "skills": [f"s{i % 3}"], "correct": i % 4 > 0, "duration_ms": 30000.0 * (1 + i % 9), "duration_scope": "event"} for i in range(120)] + [{"question_id": "untimed", "correct": True, "skills": []}]
    config = planner.PlanConfig(budget_seconds=500, prerequisites={"s1": ["s2"]}, priorities={"s0": 2.0}, available=(*(f"q{i}" for i in range(8)), "untimed", "new"))
    found = planner.candidates(table(spark, rows), config).collect()
    assert {r.question_id for r in found} == set(config.available)
    left, want = 500.0, []
    for r in sorted(found, key=lambda r: (-r.score, r.question_id)):
        if not r.blocks and r.timed and r.median_seconds <= left and len(want) < 12:
            left -= r.median_seconds
            want.append(r.question_id)
    assert want and [r.question_id for r in planner.plan(table(spark, rows), config).orderBy("place").collect()] == want
    out = {(r.question_id, r.reason) for r in planner.left_out(table(spark, rows), config).collect()}
    assert {("new", "unknown_time"), ("untimed", "unknown_time")} <= out and {q for q, reason in out if reason == "blocked"} == {r.question_id for r in found if r.blocks}
    new = next(r for r in found if r.question_id == "new")
    assert new.score == pytest.approx(0.4 * 0.5 + 0.4 * 0.95 + 0.2 * 0.5)
    with pytest.raises(ValueError):
        planner.PlanConfig(maximum_actions=0).check()


def test_units_without_sessions_or_times(spark):
    bare = table(spark, [{"correct": i % 3 > 0, "question_id": f"q{i % 4}"} for i in range(30)]).withColumns({"session_id": F.lit(None).cast("string"), "timestamp": F.lit(None).cast("timestamp")})
    key = lambda t: sorted(map(str, t.collect()))
    assert not units.coupled(bare) and key(units.history_features(bare, coupled=False)) == key(units.history_features(bare))


def test_records_are_judged_as_their_rules_say(spark, tmp_path):
    good = {"event_id": "e", "question_id": "q", "correct": True, "source_sequence": 1}
    cases = [
        (json.dumps(good | {"event_id": "\tq\n"}), "q"),
        (json.dumps(good | {"event_id": "a\ufffd"}, ensure_ascii=False), "a\ufffd"),
        (json.dumps(good | {"event_id": "e\u0301"}), "\u00e9"),
        (json.dumps(good)[:-1] + ', "event_id": "last"}', "last"),
        (json.dumps(good | {"timestamp": "2024-01-01 00:00+00:00"}), "e"),
        (json.dumps(good | {"timestamp": "2024-01-01T00:00:00Z"}), "e"),
        (json.dumps(good | {"skills": ["e\u0301", "\u00e9", " b"]}), "e"),
        *((x, None) for x in (json.dumps(good | {"skills": ["a\u0001"]}), json.dumps(good | {"skills": [1]}), json.dumps(good | {"timestamp": "2024-13-01T00:00:00Z"}), json.dumps(good | {"timestamp": "2024-01-01"}), json.dumps(good | {"attempt_kind": None}), json.dumps(good | {"duration_ms": True}), json.dumps(good) + " x", json.dumps(good).replace("1", "NaN"), json.dumps(good | {"event_id": "x" * 513}))),
    ]
    path = tmp_path / "x.ndjson"
    path.write_bytes("\n".join(["\t", *(x for x, _ in cases)]).encode() + b'\n{"event_id": "\xff"}\n')
    rows = ingest.validated(readers.read_ndjson(spark, str(path))).orderBy("row").collect()
    assert [r.row for r in rows] == list(range(2, len(cases) + 3))
    assert [None if r.reason else r.event_id for r in rows] == [x for _, x in cases] + [None]
    assert rows[6].skills == ["b", "\u00e9"] and rows[-1].reason == "not valid UTF-8" and rows[4].timestamp.hour == 0


def test_import_is_strict_and_counts(spark, tmp_path):
    n = 2500
    rows = ingest.classified(ingest.validated(workload.workload(spark, n), "scale-synthetic"))
    assert {k: v for k, v in ingest.import_counts(rows).first().asDict().items() if k in ("received", "accepted", "duplicates", "conflicts", "rejected")} == workload.expected(n)
    good = {"event_id": "e", "question_id": "q", "correct": True, "source_sequence": 1}
    bad = [{"correct": v} for v in ("false", "true", 0, 1, None, [], {})] + [{"source_sequence": 2**63}, {"source_sequence": 1.5}, {"timestamp": "2024-01-01T00:00:00"}, {"timestamp": 5}, {"extra": 1}, {"event_id": " "}, {"event_id": "a\u0001"}, {"duration_ms": -1}, {"time_semantics": "real"}, {"duration_scope": "event"}, {"skills": "s"}, {"order_scope": "x"}, {"source_namespace": "other"}]
    fine = [{"timestamp": "2024-01-01T00:00:00+01:00", "time_semantics": "real"}, {"duration_ms": 0, "duration_scope": "event"}, {"skills": ["b", "a", "a"]}, {"event_id": "é"}]
    path = tmp_path / "x.ndjson"
    path.write_text("\n".join(["", "not json", '"text"', *(json.dumps(good | x) for x in bad + fine)]))
    rows = ingest.validated(readers.read_ndjson(spark, str(path))).orderBy("row").collect()
    assert [r.row for r in rows][:2] == [2, 3] and all(r.reason for r in rows[: 2 + len(bad)]) and [r.reason for r in rows[2 + len(bad) :]] == [None] * len(fine)
    assert rows[-2].skills == ["a", "b"] and rows[-1].event_id == "é" and rows[-4].timestamp.hour == 23


def test_json_and_legacy_sources(spark, tmp_path):
    path = tmp_path / "x.json"
    path.write_text('[{"a": "[}\\""}, 5]')
    assert [bool(r.error) for r in readers.read_records(spark, str(path), "json").orderBy("row").collect()] == [False, True]
    for text in ("{}", "[1,]", "[1", "[1] x"):
        path.write_text(text)
        with pytest.raises(ValueError):
            readers.read_records(spark, str(path), "json").count()
    path.write_text(json.dumps({"LocalSubmissions": {"q1": {"attempts": [{"id": "x", "correct": True}, {"correct": False}]}, "q2": {"attempts": [{"id": 7, "correct": True}]}}}))
    rows = ingest.validated(readers.read_legacy(spark, str(path))).orderBy("row").collect()
    assert [(r.question_id, r.source_sequence, r.correct, r.reason) for r in rows] == [("q1", 0, True, None), ("q1", 1, False, None), ("q2", 0, True, None)]
    with pytest.raises(ValueError):
        readers.read_records(spark, str(path), "xml")


def test_store_versions_and_round_trips(spark, tmp_path):
    store, good = Store(tmp_path / "store"), {"event_id": "e0", "question_id": "=SUM(A1)", "correct": True, "source_sequence": 1, "skills": ["s"]}
    one, two = tmp_path / "1.ndjson", tmp_path / "2.ndjson"
    one.write_text(json.dumps(good))
    two.write_text("\n".join(json.dumps(good | x) for x in ({}, {"correct": False}, {"event_id": "e1"})))
    own = store.create_workspace("w")
    first, second = (store.import_file(spark, own, str(p), "ndjson") for p in (one, two))
    assert (second["accepted"], second["duplicates"], second["conflicts"]) == (1, 1, 1) and store.import_file(spark, own, str(two), "ndjson") == second
    rows = store.attempts(spark, second["dataset"])
    assert rows.count() == 2 and store.ancestors(second["dataset"]) == [first["dataset"]] and store.descendants(first["dataset"]) == [second["dataset"]]
    with pytest.raises(ValueError):
        store.add_lineage(first["dataset"], [second["dataset"]])
    key = lambda t: sorted((r.identity, r.content_hash) for r in t.collect())
    for format in ("ndjson", "csv", "parquet"):
        place = tmp_path / f"out.{format}"
        export(rows, str(place), format)
        back = ingest.validated(readers.read_records(spark, str(place), format))
        assert back.where("reason is not null").count() == 0 and key(back) == key(rows)
    (next((tmp_path / "store" / "datasets" / first["dataset"] / "attempts").glob("*.parquet"))).write_bytes(b"x")
    assert store.verify(second["dataset"]) and (tmp_path / "store" / "staging" / "left").mkdir() is None and store.reconcile() == ["left"]


def test_csv_guard(spark):
    r = spark.createDataFrame([("=1",), ("'x",), ("-a",), ("b",)], "v string").select(csv_guarded(F.col("v")).alias("g"), csv_unguarded(csv_guarded(F.col("v"))).alias("u"), "v").collect()
    assert [x.g for x in r] == ["'=1", "'x", "'-a", "b"] and all(x.u == x.v for x in r)


def test_streams(spark, tmp_path):
    rows = table(spark, [{"timestamp": 1440 + 10 * i, "time_semantics": "real", "correct": i % 2 == 0} for i in range(6)])
    rows.union(rows).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for name, out, mode in (("once", live.without_repeats(stream), "append"), ("windows", live.accuracy_by_window(stream), "complete")):
        q = out.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(60)
    assert spark.table("once").count() == 6 and spark.table("windows").first().n == 12


def test_experiment(spark):
    demo = workload.demo_attempts(spark, 16, 40).cache()
    made = experiment.run(demo, ("global", "item_prior", "recent", "logistic", "bkt")).cache()
    assert made.where("probability is null or calibrated is null").count() == 0
    counts = {r["count"] for r in made.groupBy("model").count().collect()}
    assert len(counts) == 1
    saved = experiment.report(made).cache()
    assert saved.count() == 10 and experiment.recomputed(made, saved).count() == 0
    assert experiment.compare(made, "logistic", "global").first().difference_lower is not None
    assert experiment.inspect(made, "bkt", "error", limit=5).count() == 5


def test_tutoring_logs(spark, tmp_path):
    (tmp_path / "questions.csv").write_text("question_id,bundle_id,explanation_id,correct_answer,part,tags,deployed_at\nq1,b1,e1,b,1,2;1;-1,0\nq2,b1,e1,A,1,-1,0\n")
    logs = tmp_path / "logs"
    logs.mkdir()
    for u in range(4):
        (logs / f"u{u}.csv").write_text("timestamp,solving_id,question_id,user_answer,elapsed_time\n" + "".join(f"{1000 * k},{k},q{1 + k % 3},b,{500}\n" for k in range(9)))
    table = tutoring.questions(spark, str(tmp_path / "questions.csv"))
    rows = tutoring.attempts_from_logs(tutoring.logs(spark, str(logs)), table)
    assert rows.count() == 24 and rows.where("correct").count() == 12 and table.where("question_id = 'q1'").first().skills == ["ednet:1", "ednet:2"]
    kept = tutoring.whole_learners(rows, 7, 2)
    assert kept.select("learner_id").distinct().count() == 2 and kept.count() == 12
    (tmp_path / "questions.csv").write_text("question_id,bundle_id,correct_answer,tags\nq1,b,x,1\n")
    with pytest.raises(ValueError):
        tutoring.questions(spark, str(tmp_path / "questions.csv"))
