"""Queries over whole tables by name, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expressions import DOMAIN, csv_guarded, known_order, z_value
from ..models import baselines, bkt, hierarchical, irt, trace
from ..operators import experiment, ingest, integrity, leakage, metrics, overview, planner, snapshots, splits, units
from ..schema import CONTENT
from ..sources.projection import attempts_from_events
from . import lineage

Query = Callable[[SparkSession, str], DataFrame]
LEARNER = "u8"
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

ATTEMPTS_SQL = """
raw AS (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events),
attempts AS (SELECT 'testdata' AS source_namespace, CAST(event_id AS VARCHAR) AS event_id, 'u' || user_id AS learner_id, 'q' || k AS question_id,
  CASE WHEN k % 4 = 0 THEN CAST([] AS VARCHAR[]) WHEN k % 4 = 1 THEN ['s' || (k % 5)] ELSE ['s' || (k % 5), 't' || (k % 3)] END AS skills,
  event_type IN ('click', 'purchase', 'view') AS correct,
  CASE k % 3 WHEN 0 THEN 'practice' WHEN 1 THEN 'review' ELSE 'unknown' END AS attempt_kind, event_id AS source_sequence,
  CASE WHEN k % 10 <> 7 THEN date_trunc('hour', ts) - {moved} END AS timestamp,
  CASE WHEN event_type <> 'error' THEN value * 1000 END AS duration_ms,
  CASE WHEN event_type <> 'signup' THEN 'd' || day(ts) END AS session_id, 'b' || (k % 6) AS bundle_id,
  CASE WHEN user_id % 7 = 0 THEN 'question' ELSE 'learner' END AS order_scope,
  CASE WHEN k % 10 = 7 THEN 'unknown' WHEN user_id % 5 = 0 THEN 'shifted' ELSE 'real' END AS time_semantics,
  CASE WHEN event_type = 'error' THEN 'unknown' WHEN k % 2 = 0 THEN 'bundle' ELSE 'event' END AS duration_scope,
  CASE WHEN user_id % 7 = 0 THEN 'q' || k ELSE '' END AS domain FROM raw)"""
MOVED = "(CASE k % 3 WHEN 0 THEN INTERVAL 0 HOUR WHEN 1 THEN INTERVAL 1 HOUR ELSE INTERVAL 30 HOUR END)"
ORDER = "timestamp NULLS LAST, source_sequence, event_id"
UNITS_SQL = f"""
placed AS (SELECT *, row_number() OVER (PARTITION BY source_namespace, learner_id, domain ORDER BY {ORDER}) AS pos FROM attempts),
reaching AS (SELECT *, greatest(pos, CASE WHEN session_id IS NOT NULL THEN max(pos) OVER (PARTITION BY source_namespace, learner_id, domain, session_id) END,
  CASE WHEN timestamp IS NOT NULL THEN max(pos) OVER (PARTITION BY source_namespace, learner_id, domain, timestamp) END) AS reach FROM placed),
opening AS (SELECT *, CASE WHEN pos > coalesce(max(reach) OVER (PARTITION BY source_namespace, learner_id, domain ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) THEN 1 ELSE 0 END AS opens FROM reaching),
united AS (SELECT *, sum(opens) OVER (PARTITION BY source_namespace, learner_id, domain ORDER BY pos ROWS UNBOUNDED PRECEDING) AS unit FROM opening)"""


def sql(body: str, *more: str, shifted: bool = False) -> str:
    """``body`` after the attempts' and other common expressions."""
    return "WITH " + ",".join([ATTEMPTS_SQL.replace("{moved}", MOVED if shifted else "INTERVAL 0 HOUR"), *more]) + "\n" + body


def wilson_sql(s: str, n: str, digits: int = 9) -> str:
    z = z_value()
    p, m = f"({s} / {n})", f"({z * z!r} / {n})"
    half = f"{z!r} * sqrt({p} * (1 - {p}) / {n} + {z * z / 4!r} / ({n} * {n}))"
    bound = lambda sign: f"({p} + {z * z / 2!r} / {n} {sign} {half}) / (1 + {m})"
    seen = lambda c: f"round(CASE WHEN {n} > 0 THEN {c} END, {digits})"
    return f"{seen(p)} AS estimate, {seen(f'greatest(0.0, {bound("-")})')} AS lower, {seen(f'least(1.0, {bound("+")})')} AS upper"


def attempts(spark: SparkSession, sf_dir: str, shifted: bool = False) -> DataFrame:
    return attempts_from_events(spark.read.parquet(f"{sf_dir}/events.parquet"), shifted)


def rounded(rows: DataFrame, digits: int = 9) -> DataFrame:
    """Doubles rounded, as sums in another order differ in the last places."""
    return rows.select(*[F.round(c, digits).alias(c) if t == "double" else F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) if t == "timestamp" else F.col(c) for c, t in rows.dtypes])


def query(name: str, oracle: str | None = None, shifted: bool = False) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Registers a function of attempts as a query of the events table."""

    def put(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: rounded(f(attempts(spark, sf_dir, shifted)))
        if oracle:
            SQL[name] = oracle
        return f

    return put


ITEM = "source_namespace, learner_id, question_id"
SUMS = "count(*) AS n, CAST(coalesce(sum(correct::INTEGER), 0) AS BIGINT) AS successes"
STAMP = "strftime({0}({1}), '%Y-%m-%d %H:%M:%S')"

query("ag01_coverage_summary", sql(f"""SELECT *, {wilson_sql('successes', 'n')} FROM (SELECT {SUMS}, count(DISTINCT learner_id) AS learners, count(DISTINCT question_id) AS questions,
  count(timestamp) AS timestamped, count(duration_ms) AS duration_known, count(*) FILTER (WHERE order_scope = 'question') AS question_only, count(*) FILTER (WHERE time_semantics = 'shifted') AS shifted FROM attempts)"""))(overview.coverage)
FIRST_SQL = f"first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {ITEM} ORDER BY {ORDER}) AS rn FROM attempts) WHERE rn = 1)"
query("ag02_first_attempt", sql(f"SELECT *, {wilson_sql('successes', 'n')} FROM (SELECT {SUMS} FROM first)", FIRST_SQL))(overview.first_attempts)
query("ag03_duration_stats", sql("""SELECT count(*) AS n, round(median(d), 9) AS median_ms, round(quantile_cont(d, 0.25), 9) AS q25_ms, round(quantile_cont(d, 0.75), 9) AS q75_ms, round(quantile_cont(d, 0.9), 9) AS p90_ms, round(sum(d), 9) AS total_ms FROM (
  SELECT duration_ms AS d FROM attempts WHERE duration_scope = 'event' AND duration_ms IS NOT NULL UNION ALL
  SELECT duration_ms FROM (SELECT *, row_number() OVER (PARTITION BY source_namespace, learner_id, session_id, bundle_id ORDER BY source_sequence, event_id) AS rn FROM attempts
    WHERE duration_ms IS NOT NULL AND duration_scope = 'bundle' AND session_id IS NOT NULL AND bundle_id IS NOT NULL) WHERE rn = 1)"""))(overview.duration_stats)
query("ag04_retries", sql(f"""SELECT count(*) AS questions, count(r) AS solved, count(*) FILTER (WHERE r IS NULL) AS censored, round(avg(r), 9) AS mean_retries, round(median(r), 9) AS median_retries FROM (
  SELECT min(b) FILTER (WHERE correct) AS r FROM (SELECT *, row_number() OVER (PARTITION BY {ITEM} ORDER BY {ORDER}) - 1 AS b FROM attempts) GROUP BY {ITEM})"""))(overview.retries)


def _groups_sql(column: str, source: str = "attempts", where: str = "true") -> str:
    return sql(f"""SELECT *, {wilson_sql('successes', 'n')} FROM (SELECT {column} AS id, {SUMS}, count(DISTINCT learner_id) AS learners, count(DISTINCT question_id) AS questions, count(duration_ms) AS known_durations,
  {STAMP.format('min', 'timestamp')} AS first_timestamp, {STAMP.format('max', 'timestamp')} AS last_timestamp FROM {source} WHERE {where} GROUP BY {column})""")


EXPLODED = "(SELECT *, unnest(skills) AS skill FROM attempts)"
for _d, _c, _s in (("question", "question_id", "attempts"), ("learner", "learner_id", "attempts"), ("skill", "skill", EXPLODED)):
    query(f"ag05_groups_{_d}" if _d != "skill" else "ag06_groups_skill", _groups_sql(_c, _s))(lambda a, d=_d: overview.groups(a, d))
query("pf2_search_questions", _groups_sql("question_id", where="question_id LIKE '%q1_%'"))(lambda a: overview.groups(a, "question", search="q1_"))
query("pf9_group_page", sql("SELECT question_id AS id, count(*) AS n FROM attempts GROUP BY 1 ORDER BY n DESC, id LIMIT 20 OFFSET 10"))(lambda a: overview.page(overview.groups(a, "question"), 10, 20).select("id", "n"))
query("ag07_group_totals", sql("SELECT count(DISTINCT question_id) AS questions, count(DISTINCT learner_id) AS learners FROM attempts"))(lambda a: a.agg(F.count_distinct("question_id").alias("questions"), F.count_distinct("learner_id").alias("learners")))
query("ag08_order_domains", sql("SELECT learner_id, count(DISTINCT {'a': source_namespace, 'b': domain}) AS domains FROM attempts GROUP BY 1"))(overview.order_domains)
query("ag09_sessions", sql("""SELECT source_namespace, learner_id, session_id, count(*) AS n, CAST(sum(correct::INTEGER) AS BIGINT) AS successes, count(DISTINCT question_id) AS questions, count(DISTINCT bundle_id) AS bundles,
  strftime(min(timestamp), '%Y-%m-%d %H:%M:%S') AS first_timestamp, strftime(max(timestamp), '%Y-%m-%d %H:%M:%S') AS last_timestamp, bool_or(time_semantics = 'shifted') AS shifted,
  round(sum(duration_ms) FILTER (WHERE timed), 9) AS known_duration_ms, count(duration_ms) FILTER (WHERE timed) AS duration_observations FROM (
  SELECT *, duration_scope = 'event' OR (duration_scope = 'bundle' AND bundle_id IS NOT NULL AND rn = 1) AS timed FROM (
  SELECT *, row_number() OVER (PARTITION BY source_namespace, learner_id, session_id, bundle_id, duration_scope, (duration_ms IS NULL) ORDER BY source_sequence, event_id) AS rn FROM attempts WHERE session_id IS NOT NULL))
  GROUP BY 1, 2, 3"""))(overview.sessions)
query("ag11_item_durations", sql("""SELECT learner_id, question_id, count(*) AS n, round(median(duration_ms) / 1000, 9) AS median_seconds, round(quantile_cont(duration_ms, 0.25) / 1000, 9) AS q25_seconds, round(quantile_cont(duration_ms, 0.75) / 1000, 9) AS q75_seconds
  FROM attempts WHERE duration_ms > 0 AND duration_scope = 'event' GROUP BY 1, 2"""))(overview.item_durations)
STREAKS_SQL = f"""SELECT source_namespace, learner_id, domain, CAST(max(length) AS BIGINT) AS longest_correct_streak FROM (SELECT source_namespace, learner_id, domain, wrong, sum(correct::INTEGER) AS length FROM (
  SELECT *, sum(CASE WHEN correct THEN 0 ELSE 1 END) OVER (PARTITION BY source_namespace, learner_id, domain ORDER BY {ORDER} ROWS UNBOUNDED PRECEDING) AS wrong FROM attempts) GROUP BY ALL) GROUP BY 1, 2, 3"""
query("a2_streaks", sql(STREAKS_SQL))(overview.streaks)
TREND = "SELECT *, {w} FROM (SELECT bucket, min(x) AS x_start, max(x) AS x_end, count(*) AS n, CAST(sum(correct::INTEGER) AS BIGINT) AS successes, min(correct::INTEGER) AS minimum, max(correct::INTEGER) AS maximum FROM ({s}) GROUP BY bucket)"
query("a3_trend_order", sql(TREND.format(w=wilson_sql("successes", "n"), s=f"SELECT *, CAST(source_sequence AS DOUBLE) AS x, CAST(ntile(20) OVER (ORDER BY {ORDER}) AS INTEGER) AS bucket FROM attempts WHERE learner_id = '{LEARNER}'")))(lambda a: overview.trend(a, LEARNER, 20))
query("a3_trend_time", sql(TREND.format(w=wilson_sql("successes", "n"), s=f"SELECT *, CAST(epoch(timestamp) AS DOUBLE) AS x, CAST(ntile(20) OVER (ORDER BY {ORDER}) AS INTEGER) AS bucket FROM attempts WHERE learner_id = '{LEARNER}' AND timestamp IS NOT NULL AND time_semantics = 'real'")))(lambda a: overview.trend(a, LEARNER, 20, "time"))
query("a4_history_page", sql(f"""SELECT event_id, question_id, domain, correct, source_sequence, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp, round(duration_ms, 9) AS duration_ms, session_id, len(skills) AS n_skills FROM attempts WHERE learner_id = '{LEARNER}' ORDER BY source_namespace, domain, {ORDER.replace('timestamp ', 'attempts.timestamp ')} LIMIT 100"""))(
    lambda a: overview.page(overview.history(a, LEARNER), 0, 100).select("event_id", "question_id", "domain", "correct", "source_sequence", "timestamp", "duration_ms", "session_id", F.size("skills").cast("long").alias("n_skills"))
)
COHORT_SQL = f"""target AS (SELECT DISTINCT source_namespace, question_id FROM attempts WHERE learner_id = '{LEARNER}'),
peers AS (SELECT learner_id, count(*) AS n, avg(correct::INTEGER) AS accuracy, count(DISTINCT question_id) AS shared_items FROM attempts JOIN target USING (source_namespace, question_id) GROUP BY 1 HAVING count(*) >= 20)"""
query("j1_cohort_rows", sql("SELECT learner_id, n, round(accuracy, 9) AS accuracy, shared_items FROM peers", COHORT_SQL))(lambda a: overview.cohort_rows(a, LEARNER))
query("a1_cohort_percentile", sql(f"""SELECT round(100 * (count(*) FILTER (WHERE p.accuracy < t.accuracy) + 0.5 * count(*) FILTER (WHERE p.accuracy = t.accuracy)) / count(*), 9) AS percentile, count(*) AS eligible_peers, t.n AS target_attempts, i.items AS target_items
  FROM peers p, (SELECT * FROM peers WHERE learner_id = '{LEARNER}') t, (SELECT count(DISTINCT question_id) AS items FROM target) i WHERE p.learner_id <> '{LEARNER}' AND p.shared_items >= greatest(2.0, i.items * 0.5) GROUP BY t.n, t.accuracy, i.items""", COHORT_SQL))(lambda a: overview.cohort_percentile(a, LEARNER))
query("ag12_integrity", sql("""SELECT count(*) AS row_count, count(DISTINCT event_id) AS unique_identities, count(timestamp) AS known_timestamps, count(*) FILTER (WHERE timestamp IS NULL) AS unknown_timestamps, count(*) FILTER (WHERE time_semantics = 'shifted') AS shifted_timestamps,
  count(*) FILTER (WHERE duration_scope = 'bundle' AND (session_id IS NULL OR bundle_id IS NULL)) AS bundle_duration_without_identity FROM attempts"""))(integrity.integrity_counts)
query("ag13_timestamp_ties", sql("SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS timestamp_ties FROM (SELECT count(*) AS n FROM attempts WHERE timestamp IS NOT NULL GROUP BY source_namespace, learner_id, timestamp HAVING count(*) > 1)"))(integrity.timestamp_ties)
query("ag14_ambiguous_sequences", sql("SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS ambiguous_source_sequences FROM (SELECT count(*) AS n FROM attempts GROUP BY source_namespace, learner_id, domain, source_sequence HAVING count(*) > 1)"))(integrity.ambiguous_sequences)
query("ag15_multi_bundle_sessions", sql("SELECT count(*) FILTER (WHERE b > 1) AS sessions_with_multiple_bundles FROM (SELECT count(DISTINCT bundle_id) AS b FROM attempts WHERE session_id IS NOT NULL GROUP BY source_namespace, learner_id, session_id)"))(integrity.multi_bundle_sessions)
query("w5_time_inversions", sql("SELECT count(*) FILTER (WHERE timestamp < previous) AS source_order_timestamp_inversions FROM (SELECT timestamp, lag(timestamp) OVER (PARTITION BY source_namespace, learner_id, domain ORDER BY source_sequence, event_id) AS previous FROM attempts)", shifted=True), True)(integrity.time_inversions)
DRIFT_SQL = f"""backed AS (SELECT *, row_number() OVER (ORDER BY timestamp DESC NULLS LAST, source_sequence DESC, event_id DESC) AS back FROM attempts WHERE learner_id = '{LEARNER}'),
parts AS (SELECT *, CASE WHEN back <= 100 THEN 'current' ELSE 'reference' END AS part FROM backed WHERE back <= 200)"""
query("d1_drift_windows", sql(f"""SELECT *, {wilson_sql('successes', 'n')} FROM (SELECT part, {SUMS}, count(*) FILTER (WHERE timestamp IS NULL) AS no_timestamp, count(*) FILTER (WHERE duration_ms IS NULL) AS no_duration, count(*) FILTER (WHERE session_id IS NULL) AS no_session,
  count(DISTINCT question_id) AS items, count(*) FILTER (WHERE question_id NOT IN (SELECT question_id FROM parts WHERE part = 'reference')) AS unseen FROM parts GROUP BY part)""", DRIFT_SQL))(lambda a: integrity.drift_table(a, LEARNER))
query("pf11_last_rows", sql("SELECT event_id, part, back FROM parts", DRIFT_SQL))(lambda a: integrity.drift_windows(a, LEARNER).select("event_id", "part", F.col("back").cast("long").alias("back")))

FEATURES = """SELECT event_id, CAST(first_value(n) OVER u AS BIGINT) AS past_attempts, CAST(first_value(s) OVER u AS BIGINT) AS past_successes, round((first_value(s) OVER u + 1) / (first_value(n) OVER u + 2), 9) AS past_accuracy,
  round((first_value(rs) OVER u + 1) / (first_value(rn) OVER u + 2), 9) AS recent_accuracy, CAST(first_value(i) OVER v AS BIGINT) AS item_past_attempts, round((first_value(t) OVER v + 1) / (first_value(i) OVER v + 2), 9) AS item_past_accuracy FROM (
  SELECT *, count(*) OVER d AS n, coalesce(sum(correct::INTEGER) OVER d, 0) AS s, count(*) OVER r AS rn, coalesce(sum(correct::INTEGER) OVER r, 0) AS rs, count(*) OVER q AS i, coalesce(sum(correct::INTEGER) OVER q, 0) AS t FROM united
  WINDOW d AS (PARTITION BY source_namespace, learner_id, domain ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), r AS (PARTITION BY source_namespace, learner_id, domain ORDER BY pos ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING),
  q AS (PARTITION BY source_namespace, learner_id, domain, question_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  WINDOW u AS (PARTITION BY source_namespace, learner_id, domain, unit ORDER BY pos), v AS (PARTITION BY source_namespace, learner_id, domain, unit, question_id ORDER BY pos)"""
for _n, _sh in (("", False), ("_shifted", True)):
    query(f"ft2_units{_n}", sql("SELECT learner_id, domain, CAST(unit AS BIGINT) AS unit, count(*) AS size FROM united GROUP BY 1, 2, 3", UNITS_SQL, shifted=_sh), _sh)(lambda a: units.unit_sizes(a).select("learner_id", "domain", "unit", "size"))
    query(f"ft3_history_features{_n}", sql(FEATURES, UNITS_SQL, shifted=_sh), _sh)(lambda a: units.history_features(a).select("event_id", "past_attempts", "past_successes", "past_accuracy", "recent_accuracy", "item_past_attempts", "item_past_accuracy"))
query("ft4_long_units", sql("SELECT learner_id, domain, CAST(unit AS BIGINT) AS unit, count(*) AS size FROM united GROUP BY 1, 2, 3 HAVING count(*) > 60", UNITS_SQL))(lambda a: units.check_units(a, 60).select("learner_id", "domain", "unit", "size"))
query("ft6_gap_features", sql("""SELECT event_id, CASE WHEN timestamp IS NULL OR previous IS NULL THEN 1.0 ELSE 0.0 END AS gap_unknown, round(CASE WHEN timestamp IS NULL OR previous IS NULL THEN 0 ELSE ln(1 + greatest(0, epoch(timestamp) - epoch(previous))) END, 9) AS gap_log_seconds FROM (
  SELECT *, first_value(known) OVER (PARTITION BY source_namespace, learner_id, domain, unit ORDER BY pos) AS previous FROM (
  SELECT *, last_value(timestamp IGNORE NULLS) OVER (PARTITION BY source_namespace, learner_id, domain ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known FROM united))""", UNITS_SQL))(lambda a: units.gap_features(a).drop("source_namespace"))
query("ft6_skill_features", sql("""SELECT event_id, skill, CAST(first_value(n) OVER u AS BIGINT) AS prior_attempts, round((first_value(s) OVER u + 1) / (first_value(n) OVER u + 2), 9) AS prior_rate FROM (
  SELECT *, count(*) OVER d AS n, coalesce(sum(correct::INTEGER) OVER d, 0) AS s FROM (SELECT *, unnest(skills) AS skill FROM united) WINDOW d AS (PARTITION BY source_namespace, learner_id, domain, skill ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  WINDOW u AS (PARTITION BY source_namespace, learner_id, domain, unit, skill ORDER BY pos)""", UNITS_SQL))(lambda a: units.skill_features(a).drop("source_namespace"))
GAPS, SKILLS = SQL["ft6_gap_features"].split("united AS", 1)[1].split("\n", 1)[1], 12
query("ft6_feature_map", sql(f"SELECT f.event_id, CAST({SKILLS} + 3 * len(a.skills) AS INTEGER) AS n_features, f.past_accuracy AS learner_rate, f.item_past_accuracy AS item_rate, g.gap_log_seconds FROM ({FEATURES}) f JOIN ({GAPS}) g USING (event_id) JOIN attempts a USING (event_id)", UNITS_SQL))(lambda a: units.feature_map(a).select("event_id", F.size("features").alias("n_features"), F.col("features")["learner_rate"].alias("learner_rate"), F.col("features")["item_rate"].alias("item_rate"), F.col("features")["gap_log_seconds"].alias("gap_log_seconds")))


def halves(a: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first half of each domain's units, and the rest."""
    rows = units.units(a).withColumn("half", F.col("unit") * 2 <= F.max("unit").over(Window.partitionBy(*DOMAIN)))
    return rows.where("half").select(*a.columns), rows.where("not half").select(*a.columns)


def resumed(plain: Callable[[DataFrame], DataFrame], restored: Callable[[snapshots.State, DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Features of the first half of each domain's units, and of the rest from a snapshot of it."""

    def of(a: DataFrame) -> DataFrame:
        first, rest = halves(a)
        return plain(first).unionByName(restored(snapshots.snapshot(first), rest))

    return of


for _n, _sh in (("", False), ("_shifted", True)):
    query(f"ft7_restored_features{_n}", SQL[f"ft3_history_features{_n}"], _sh)(lambda a: resumed(units.features, snapshots.restored)(a).select("event_id", "past_attempts", "past_successes", "past_accuracy", "recent_accuracy", "item_past_attempts", "item_past_accuracy"))
query("ft7_restored_gaps", SQL["ft6_gap_features"])(lambda a: resumed(units.features, snapshots.restored)(a).select("event_id", "gap_unknown", "gap_log_seconds"))
query("ft7_restored_skills", SQL["ft6_skill_features"])(lambda a: resumed(units.skill_features, snapshots.restored_skills)(a).drop("source_namespace"))

FORWARD_SQL = """counted AS (SELECT *, max(unit) OVER (PARTITION BY source_namespace, learner_id, domain) AS units FROM united),
cuts AS (SELECT *, greatest(1, floor(units * CAST(0.6 AS DOUBLE))) AS a FROM counted),
split AS (SELECT *, CASE WHEN units < 5 THEN 'excluded' WHEN unit <= a THEN 'train' WHEN unit <= least(greatest(a + 1, floor(units * CAST(0.8 AS DOUBLE))), units - 1) THEN 'validation' ELSE 'test' END AS part FROM cuts)"""
query("sp1_forward_split", sql("SELECT event_id, part FROM split", UNITS_SQL, FORWARD_SQL))(lambda a: splits.forward_split(a).select("event_id", "part"))
query("sp3_rolling_splits", sql("""SELECT event_id, fold, CASE WHEN units < 7 THEN 'excluded' WHEN unit <= a THEN 'train' WHEN unit <= b THEN 'validation' WHEN unit <= least(units, greatest(b + 1, floor(units * (CAST(0.55 AS DOUBLE) + CAST(0.35 AS DOUBLE) * fold / 3)))) THEN 'test' ELSE 'excluded' END AS part FROM (
  SELECT *, greatest(a + 1, floor(units * (CAST(0.45 AS DOUBLE) + CAST(0.35 AS DOUBLE) * fold / 3))) AS b FROM (
  SELECT *, greatest(1, floor(units * (CAST(0.35 AS DOUBLE) + CAST(0.35 AS DOUBLE) * fold / 3))) AS a FROM counted, (SELECT unnest([0, 1, 2]) AS fold)))""", UNITS_SQL, FORWARD_SQL.split(",\ncuts")[0]))(lambda a: splits.rolling_splits(a).select("event_id", "fold", "part"))
SIZES_SQL = """sized AS (SELECT n, greatest(1, CAST(floor(n * 0.6::DOUBLE) AS BIGINT)) AS a FROM (SELECT count(DISTINCT {'s': source_namespace, 'l': learner_id}) AS n FROM attempts)),
bounded AS (SELECT n, a, least(n - 1, greatest(a + 1, CAST(floor(n * (0.6::DOUBLE + 0.2::DOUBLE)) AS BIGINT))) AS b FROM sized)"""
query("sp2_part_sizes", sql("SELECT part, learners, CAST(0 AS BIGINT) AS in_several FROM (SELECT 'train' AS part, a AS learners FROM bounded UNION ALL SELECT 'validation', b - a FROM bounded UNION ALL SELECT 'test', n - b FROM bounded)", SIZES_SQL))(
    lambda a: splits.learner_split(a).groupBy("source_namespace", "learner_id").agg(F.min("part").alias("part"), F.count_distinct("part").alias("parts")).groupBy("part").agg(F.count("*").alias("learners"), F.count_if(F.col("parts") > 1).alias("in_several"))
)
query("sp2_learner_split")(lambda a: splits.learner_split(a).groupBy("part").agg(F.count_distinct("learner_id").alias("learners"), F.count("*").alias("n")))
query("sp4_split_audit", "SELECT CAST(0 AS BIGINT) AS without_part, CAST(0 AS BIGINT) AS with_several, CAST(0 AS BIGINT) AS without_attempt, CAST(0 AS BIGINT) AS units_across_parts, CAST(0 AS BIGINT) AS units_before_earlier_parts")(lambda a: splits.audit_split(a, splits.forward_split(a)))


def parts_of(a: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Train and test attempts of the forward split."""
    both = a.join(splits.forward_split(a).select("source_namespace", "event_id", "part"), ["source_namespace", "event_id"])
    return both.where("part = 'train'"), both.where("part = 'test'")


def item_predictions(a: DataFrame) -> DataFrame:
    return baselines.predict_item(*parts_of(a))


RATE = "rate AS (SELECT (sum(correct::INTEGER) + 1) / (count(*) + 2) AS g FROM split WHERE part = 'train')"
ITEM_SQL = """rates AS (SELECT question_id, (sum(correct::INTEGER) + 10 * any_value(g)) / (count(*) + 10) AS p FROM split, rate WHERE part = 'train' GROUP BY 1),
predicted AS (SELECT s.*, coalesce(r.p, g) AS p0 FROM split s CROSS JOIN rate LEFT JOIN rates r USING (question_id) WHERE part = 'test'),
scored AS (SELECT *, least(greatest(p0, 1e-9), 1 - 1e-9) AS p, correct::INTEGER AS y FROM predicted)"""
PARTS = (UNITS_SQL, FORWARD_SQL, RATE)
query("m1_global_rate", sql("SELECT event_id, round(g, 9) AS probability FROM split, rate WHERE part = 'test'", *PARTS))(lambda a: baselines.predict_global(*parts_of(a)).select("event_id", "probability"))
query("m2_item_prior", sql("SELECT event_id, round(p0, 9) AS probability FROM predicted", *PARTS, ITEM_SQL))(lambda a: item_predictions(a).select("event_id", "probability"))
query("m3_recent_history", sql(f"SELECT event_id, round((first_value(rs) OVER u + 2 * g) / (first_value(rn) OVER u + 2), 9) AS probability FROM (SELECT *, count(*) OVER r AS rn, coalesce(sum(correct::INTEGER) OVER r, 0) AS rs FROM split WINDOW r AS (PARTITION BY source_namespace, learner_id, domain ORDER BY pos ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)), rate WINDOW u AS (PARTITION BY source_namespace, learner_id, domain, unit ORDER BY pos)", *PARTS))(
    lambda a: baselines.predict_recent(a, baselines.rate_of(parts_of(a)[0])).select("event_id", "probability")
)
query("ag18_calibration_bins", sql(f"""SELECT bin, n, successes, round(prediction, 9) AS prediction, {wilson_sql('successes', 'n')} FROM (SELECT b.bin, coalesce(n, 0) AS n, CAST(coalesce(successes, 0) AS BIGINT) AS successes, prediction FROM (SELECT CAST(unnest(range(10)) AS INTEGER) AS bin) b
  LEFT JOIN (SELECT CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, count(*) AS n, sum(y) AS successes, avg(p) AS prediction FROM scored GROUP BY 1) USING (bin))""", *PARTS, ITEM_SQL))(lambda a: metrics.calibration_bins(item_predictions(a)))
query("ag18_calibration_error", sql("SELECT round(sum(n * abs(p - r)) / sum(n), 9) AS ece FROM (SELECT count(*) AS n, avg(p) AS p, avg(y) AS r FROM scored GROUP BY least(floor(p * 10), 9))", *PARTS, ITEM_SQL))(lambda a: metrics.calibration_error(item_predictions(a)))
LOSS = "-(CASE WHEN correct THEN ln(p) ELSE ln(1 - p) END)"
SUMMARY_SQL = f"""SELECT {{k}} count(*) AS n, CAST(sum(y) AS BIGINT) AS positives, round(avg(y), 9) AS class_balance, round(avg({LOSS}), 9) AS log_loss, round(avg((p - y) ** 2), 9) AS brier, sum(CASE WHEN (p >= 0.5) = correct THEN 1 ELSE 0 END) AS right_, sum(y) AS pos, sum(1 - y) AS neg, sum(CASE WHEN correct THEN rk END) AS ranks
  FROM (SELECT *, (rank() OVER ({{w}} ORDER BY p) + count(*) OVER ({{w}} ORDER BY p) - rank() OVER ({{w}} ORDER BY p) + rank() OVER ({{w}} ORDER BY p)) / 2 AS rk FROM scored) {{g}}"""
RANKED = "SELECT {cols} n, positives, class_balance, log_loss, brier, {wil}, round(CASE WHEN pos > 0 AND neg > 0 THEN (ranks - pos * (pos + 1) / 2) / (pos * neg) END, 9) AS auroc FROM ({s})"


def _summary_sql(key: str = "", source: str = "scored", *more: str) -> str:
    inner = SUMMARY_SQL.format(k=f"{key}," if key else "", w=f"PARTITION BY {key}" if key else "", g=f"GROUP BY {key}" if key else "").replace("FROM scored", f"FROM {source}")
    wil = wilson_sql("right_", "n").replace("AS estimate", "AS accuracy").replace("AS lower", "AS accuracy_lower").replace("AS upper", "AS accuracy_upper")
    return sql(RANKED.format(cols=f"{key}," if key else "", wil=wil, s=inner), *PARTS, ITEM_SQL, *more)


query("ag19_metric_summary", _summary_sql())(lambda a: metrics.metric_summary(item_predictions(a)))
query("ag20_slices_by_kind", _summary_sql("attempt_kind"))(lambda a: metrics.metric_summary(item_predictions(a), "attempt_kind"))
query("ag20_slices_by_skill", _summary_sql("skill").replace("FROM scored)", "FROM (SELECT *, unnest(skills) AS skill FROM scored))"))(lambda a: metrics.metric_summary(item_predictions(a).withColumn("skill", F.explode("skills")), "skill"))
SLICED = """sliced AS (SELECT correct, p, y, 'learner' AS slice, CASE WHEN (learner_id, domain) IN (SELECT (learner_id, domain) FROM split WHERE part = 'train') THEN 'warm' ELSE 'cold' END AS value FROM scored
  UNION ALL SELECT correct, p, y, 'item', CASE WHEN question_id IN (SELECT question_id FROM split WHERE part = 'train') THEN 'warm' ELSE 'cold' END FROM scored
  UNION ALL SELECT correct, p, y, 'each_learner', learner_id FROM scored UNION ALL SELECT correct, p, y, 'untagged', '' FROM scored WHERE len(skills) = 0
  UNION ALL SELECT correct, p, y, 'skill', unnest(skills) FROM scored)"""
query("ag20_slices", _summary_sql("slice, value", "sliced", SLICED))(lambda a: metrics.slices(item_predictions(a), parts_of(a)[0]))
SHIFT_SQL = """SELECT round(sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2)), 9) AS distance, count(*) FILTER (WHERE a > 0) AS train_categories, count(*) FILTER (WHERE b > 0) AS test_categories,
  CAST(sum(CASE WHEN a = 0 THEN b ELSE 0 END) AS BIGINT) AS unseen_rows, round(sum(CASE WHEN a = 0 THEN b ELSE 0 END) / any_value(m), 9) AS unseen_share FROM (SELECT *, a / n AS p, b / m AS q FROM (
  SELECT count(*) FILTER (WHERE part = 'train') AS a, count(*) FILTER (WHERE part = 'test') AS b FROM split WHERE part IN ('train', 'test') GROUP BY {c}), (SELECT count(*) FILTER (WHERE part = 'train') AS n, count(*) FILTER (WHERE part = 'test') AS m FROM split))"""
for _c in ("question_id", "learner_id", "attempt_kind"):
    query(f"ag21_shift_{_c}", sql(SHIFT_SQL.format(c=_c), UNITS_SQL, FORWARD_SQL))(lambda a, c=_c: metrics.distribution_shift(*parts_of(a), c))
query("ag22_residuals", sql("SELECT count(*) AS n, round(avg(y - p), 9) AS mean_residual, round(avg(abs(y - p)), 9) AS mean_absolute_residual, count(*) FILTER (WHERE p < 0.01) AS below_01, count(*) FILTER (WHERE p > 0.99) AS above_99, count(*) FILTER (WHERE (p > 0.99 AND y = 0) OR (p < 0.01 AND y = 1)) AS high_confidence_errors FROM scored", *PARTS, ITEM_SQL))(lambda a: metrics.residuals(item_predictions(a)))
query("ag23_sequence_errors", sql(f"""SELECT CAST(least(floor(CAST(pos0 AS DOUBLE) / size * 10), 9) AS INTEGER) AS bin, count(*) AS n, round(avg(y), 9) AS observed, round(avg(p), 9) AS predicted, round(avg((p - y) ** 2), 9) AS brier FROM (
  SELECT *, row_number() OVER (PARTITION BY source_namespace, learner_id ORDER BY {ORDER}) - 1 AS pos0, count(*) OVER (PARTITION BY source_namespace, learner_id) AS size FROM scored) GROUP BY 1""", *PARTS, ITEM_SQL))(lambda a: metrics.sequence_errors(item_predictions(a), known_order()))
query("ag24_learning_curve", sql(f"""SELECT CAST(floor(past / 25) * 25 AS BIGINT) AS bucket, count(*) AS n, round(avg({LOSS}), 9) AS log_loss, round(avg(CASE WHEN (p >= 0.5) = correct THEN 1 ELSE 0 END), 9) AS accuracy FROM (
  SELECT *, min(pos) OVER (PARTITION BY source_namespace, learner_id, domain, unit) - 1 AS past FROM scored) GROUP BY 1""", *PARTS, ITEM_SQL))(lambda a: metrics.learning_curve(item_predictions(a).join(baselines.unit_starts(a).select("source_namespace", "event_id", "past"), ["source_namespace", "event_id"]), "past"))
query("ag25_sparse_items", sql("SELECT question_id, count(*) AS n, CAST(sum(correct::INTEGER) AS BIGINT) AS s FROM attempts GROUP BY 1 ORDER BY n, question_id LIMIT 20"))(lambda a: hierarchical.group_counts(a, "question_id").orderBy("n", "question_id").limit(20))
query("ag26_item_totals", sql("SELECT learner_id, question_id, count(*) AS n, CAST(sum(correct::INTEGER) AS BIGINT) AS s, array_to_string(any_value(skills), ',') AS tags FROM attempts GROUP BY 1, 2"))(lambda a: planner.candidates(a).select("learner_id", "question_id", "n", "s", F.array_join("tags", ",").alias("tags")))
query("ag27_accuracy", sql(f"SELECT {SUMS} FROM attempts"))(lambda a: overview.coverage(a).select("n", "successes"))
query("ag27_question_groups", sql("SELECT question_id, count(*) AS n, avg(correct::INTEGER) AS accuracy FROM attempts GROUP BY 1").replace("avg(correct::INTEGER)", "round(avg(correct::INTEGER), 9)"))(lambda a: a.groupBy("question_id").agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("int")).alias("accuracy")))
query("ag27_skill_groups", sql("SELECT skill, count(*) AS n, round(avg(correct::INTEGER), 9) AS accuracy FROM (SELECT *, unnest(skills) AS skill FROM attempts) GROUP BY 1"))(lambda a: a.select(F.explode("skills").alias("skill"), "correct").groupBy("skill").agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("int")).alias("accuracy")))
query("ag27_learner_history", sql(f"SELECT event_id, source_sequence, correct FROM attempts WHERE learner_id = '{LEARNER}' ORDER BY source_sequence LIMIT 100"))(lambda a: a.where(F.col("learner_id") == LEARNER).select("event_id", "source_sequence", "correct").orderBy("source_sequence").limit(100))
query("pf7_skill_members", sql("SELECT event_id FROM attempts WHERE list_contains(skills, 's1')"))(lambda a: a.where(F.array_contains("skills", "s1")).select("event_id"))
query("pf6_learner_members", sql("SELECT event_id FROM attempts WHERE learner_id IN ('u1', 'u2', 'u8')"))(lambda a: a.where(F.col("learner_id").isin("u1", "u2", "u8")).select("event_id"))
query("pf8_hard_predictions", sql("SELECT event_id, round(p0, 9) AS probability FROM predicted ORDER BY abs(correct::INTEGER - p0) DESC, event_id LIMIT 50", *PARTS, ITEM_SQL))(lambda a: item_predictions(a).orderBy(F.desc(F.abs(F.col("correct").cast("int") - F.col("probability"))), "event_id").limit(50).select("event_id", "probability"))
query("j7_paired_losses", sql(f"SELECT learner_id, count(*) AS n, round(sum({LOSS} - (CASE WHEN correct THEN -ln(g) ELSE -ln(1 - g) END)), 9) AS difference FROM scored, rate GROUP BY 1", *PARTS, ITEM_SQL))(lambda a: metrics.paired_sums(item_predictions(a), baselines.predict_global(*parts_of(a))))
query("j10_seen_in_train", sql("SELECT event_id, question_id NOT IN (SELECT question_id FROM split WHERE part = 'train') AS cold_item FROM split WHERE part = 'test'", UNITS_SQL, FORWARD_SQL))(
    lambda a: parts_of(a)[1].join(parts_of(a)[0].select("question_id").distinct().withColumn("seen", F.lit(True)), "question_id", "left").select("event_id", F.col("seen").isNull().alias("cold_item"))
)
query("so1_duration_union", sql("SELECT duration_scope, count(*) AS n FROM attempts WHERE duration_ms IS NOT NULL AND duration_scope IN ('event', 'bundle') GROUP BY 1"))(lambda a: a.where("duration_ms is not null and duration_scope = 'event'").unionByName(a.where("duration_ms is not null and duration_scope = 'bundle'")).groupBy("duration_scope").agg(F.count("*").alias("n")))
query("so4_unseen_tags", sql("SELECT skill FROM (SELECT unnest(skills) AS skill FROM split WHERE part = 'test' EXCEPT SELECT unnest(skills) FROM split WHERE part = 'train')", UNITS_SQL, FORWARD_SQL))(lambda a: parts_of(a)[1].select(F.explode("skills").alias("skill")).exceptAll(parts_of(a)[0].select(F.explode("skills").alias("skill")).distinct()).distinct().join(parts_of(a)[0].select(F.explode("skills").alias("skill")).distinct(), "skill", "left_anti"))
query("sk3_csv_guard", sql("""SELECT event_id, CASE WHEN regexp_matches(cell, '^[=+@\\t\\r-]') THEN '''' || cell ELSE cell END AS guarded FROM (
  SELECT event_id, CASE source_sequence % 6 WHEN 0 THEN '=' WHEN 1 THEN '+' WHEN 2 THEN '-' WHEN 3 THEN '@' WHEN 4 THEN chr(9) ELSE '' END || question_id AS cell FROM attempts)"""))(
    lambda a: a.select("event_id", csv_guarded(F.concat(F.element_at(F.array(*map(F.lit, ("=", "+", "-", "@", "\t", ""))), (F.col("source_sequence") % 6 + 1).cast("int")), "question_id")).alias("guarded"))
)
query("sk2_export_order", sql("SELECT source_namespace, learner_id, source_sequence, event_id, question_id, correct FROM attempts ORDER BY 1, 2, 3, 4"))(lambda a: a.select("source_namespace", "learner_id", "source_sequence", "event_id", "question_id", "correct").orderBy("source_namespace", "learner_id", "source_sequence", "event_id"))
query("m5_uniform_prior", sql("SELECT event_id, round(coalesce(r.p, 0.5), 9) AS probability FROM split LEFT JOIN (SELECT question_id, (sum(correct::INTEGER) + 1) / (count(*) + 2) AS p FROM split WHERE part = 'train' GROUP BY 1) r USING (question_id) WHERE part = 'test'", UNITS_SQL, FORWARD_SQL))(
    lambda a: hierarchical.predict(*parts_of(a), "source_namespace", "question_id", shrinkage=False).select("event_id", "probability")
)
query("m5_hierarchical")(lambda a: hierarchical.predict(*parts_of(a), "source_namespace", "question_id").select("event_id", "probability"))
query("e4_cluster_bootstrap")(lambda a: metrics.bootstrap(metrics.cluster_sums(item_predictions(a))))
query("e4_auroc_interval")(lambda a: metrics.auroc_interval(item_predictions(a)))
query("ag22_residual_interval")(lambda a: metrics.residual_interval(item_predictions(a)))
query("d1_calibration_windows", sql(f"""SELECT part, bin, n, successes, round(prediction, 9) AS prediction, {wilson_sql('successes', 'n')} FROM (SELECT k.bin, k.part, coalesce(n, 0) AS n, CAST(coalesce(successes, 0) AS BIGINT) AS successes, prediction FROM (SELECT CAST(b AS INTEGER) AS bin, part FROM range(10) t(b), (VALUES ('reference'), ('current')) v(part)) k
  LEFT JOIN (SELECT part, CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, count(*) AS n, sum(correct::INTEGER) AS successes, avg(p) AS prediction FROM foreseen GROUP BY 1, 2) USING (bin, part))""", *PARTS, ITEM_SQL, f"""foreseen AS (SELECT correct, CASE WHEN back <= 100 THEN 'current' ELSE 'reference' END AS part, least(greatest(coalesce(r.p, g), 1e-9), 1 - 1e-9) AS p FROM (
  SELECT *, row_number() OVER (ORDER BY timestamp DESC NULLS LAST, source_sequence DESC, event_id DESC) AS back FROM attempts WHERE learner_id = '{LEARNER}') CROSS JOIN rate LEFT JOIN rates r USING (question_id) WHERE back <= 200)"""))(lambda a: integrity.window_calibration(integrity.drift_windows(a, LEARNER), baselines.predict_item(parts_of(a)[0], a)))


def with_outcomes(a: DataFrame, every: int, name: Column) -> DataFrame:
    """Feature maps into which the outcomes of one attempt in so many leak, which the guards must find."""
    rows = units.feature_map(a).join(a.select("source_namespace", "event_id", "correct"), ["source_namespace", "event_id"])
    leak = F.map_concat("features", F.create_map(name, F.col("correct").cast("double")))
    return rows.withColumn("features", F.when(F.col("event_id").cast("long") % every == 0, leak).otherwise(F.col("features"))).drop("correct")


query("ft9_unknown_features", sql("SELECT name, count(*) AS n FROM (SELECT unnest(CASE WHEN source_sequence % 7 = 0 THEN ['outcome:' || (source_sequence % 3)] ELSE [] END) AS name FROM attempts) GROUP BY 1"))(
    lambda a: leakage.unknown_features(with_outcomes(a, 7, F.concat(F.lit("outcome:"), F.col("event_id").cast("long") % 3)))
)
query("ft10_late_dependencies", sql("""SELECT t.event_id, d.event_id AS depends_on, CASE WHEN (t.learner_id, t.domain) <> (d.learner_id, d.domain) THEN 'other domain' WHEN t.unit = d.unit THEN 'same unit' ELSE 'later unit' END AS reason
  FROM united t JOIN united d ON CAST(d.event_id AS BIGINT) = CAST(t.event_id AS BIGINT) - 150 WHERE (t.learner_id, t.domain) <> (d.learner_id, d.domain) OR d.unit >= t.unit""", UNITS_SQL))(
    lambda a: leakage.late_dependencies(a, a.select("source_namespace", "event_id", (F.col("event_id").cast("long") - 150).cast("string").alias("depends_on"))).where("reason <> 'unknown'").drop("source_namespace")
)
query("ft11_changed_prefixes", sql("SELECT event_id FROM united WHERE unit = 3 AND source_sequence % 5 = 0", UNITS_SQL))(
    lambda a: leakage.changed_prefixes(a, 3, lambda rows: with_outcomes(rows, 5, F.lit("skill:outcome"))).drop("source_namespace")
)
query("ft12_fit_scopes", sql("SELECT c.component, c.part, count(*) AS n FROM split JOIN (VALUES ('model_parameters', 'train'), ('item_priors', 'train'), ('hierarchical_prior', 'train'), ('feature_vocabulary', 'train'), ('feature_scaler', 'train'), ('hyperparameter_selection', 'validation'), ('probability_calibration', 'validation')) c(component, part) USING (part) GROUP BY 1, 2", UNITS_SQL, FORWARD_SQL))(
    lambda a: leakage.scope_digests(leakage.fit_scopes(splits.forward_split(a))).drop("digest")
)
query("e5_paired_bootstrap")(lambda a: metrics.bootstrap(metrics.paired_sums(item_predictions(a), baselines.predict_global(*parts_of(a))), ("difference",)))
# Beta quantiles of whole numbers by halving a sum of binomial terms; then the choice, a question of each learner at a time
BETA_WIDTH_SQL = """tried AS (SELECT learner_id, question_id, count(*) AS n, CAST(sum(correct::INTEGER) AS BIGINT) AS s FROM attempts GROUP BY 1, 2),
halved(n, s, q, low, high, step) AS (SELECT n, s, q, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE), 0 FROM (SELECT DISTINCT n, s FROM tried), (SELECT unnest([0.025, 0.975]::DOUBLE[]) AS q) UNION ALL
  SELECT n, s, q, CASE WHEN below < q THEN mid ELSE low END, CASE WHEN below < q THEN high ELSE mid END, step + 1 FROM (SELECT *, (low + high) / 2 AS mid,
    list_sum(list_transform(range(s + 1, n + 2), lambda j: exp(lgamma(n + 2) - lgamma(j + 1) - lgamma(n + 2 - j) + j * ln((low + high) / 2) + (n + 1 - j) * ln(1 - (low + high) / 2)))) AS below FROM halved WHERE step < 48)),
bounds AS (SELECT n, s, max(low) FILTER (WHERE q > 0.5) - max(low) FILTER (WHERE q < 0.5) AS width FROM halved WHERE step = 48 GROUP BY 1, 2)"""
PLAN_SQL = """lately AS (SELECT DISTINCT learner_id, question_id FROM (SELECT *, row_number() OVER (PARTITION BY learner_id ORDER BY timestamp DESC NULLS FIRST, source_sequence DESC, event_id DESC) AS back FROM attempts) JOIN (SELECT learner_id FROM attempts GROUP BY 1 HAVING bool_and(order_scope = 'learner')) USING (learner_id) WHERE back <= 10),
timed AS (SELECT learner_id, question_id, quantile_cont(duration_ms, 0.5) / 1000 AS seconds FROM attempts WHERE duration_ms > 0 AND duration_scope = 'event' GROUP BY 1, 2 HAVING count(*) >= 3),
best AS (SELECT *, row_number() OVER (PARTITION BY learner_id ORDER BY score DESC, question_id) AS turn FROM (
  SELECT t.learner_id, t.question_id, 0.4::DOUBLE * (1 - (s + 1) / (n + 2)) + 0.4::DOUBLE * width + 0.2::DOUBLE - CASE WHEN l.question_id IS NULL THEN 0 ELSE 0.25::DOUBLE END AS score, seconds
  FROM tried t JOIN bounds USING (n, s) JOIN timed USING (learner_id, question_id) LEFT JOIN lately l ON l.learner_id = t.learner_id AND l.question_id = t.question_id)),
chosen(learner_id, turn, question_id, score, seconds, remaining, place, taken) AS (SELECT DISTINCT learner_id, CAST(0 AS BIGINT), '', CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(900 AS DOUBLE), 0, false FROM best UNION ALL
  SELECT b.learner_id, b.turn, b.question_id, b.score, b.seconds, CASE WHEN fits THEN remaining - b.seconds ELSE remaining END, CASE WHEN fits THEN place + 1 ELSE place END, fits FROM (
    SELECT c.remaining, c.place, b.*, b.seconds <= c.remaining AND c.place < 12 AS fits FROM chosen c JOIN best b ON b.learner_id = c.learner_id AND b.turn = c.turn + 1) b)"""
query("p1_plan", sql("SELECT learner_id, place, question_id, round(score, 9) AS score, round(seconds, 9) AS planned_seconds, round(remaining, 9) AS remaining_seconds FROM chosen WHERE taken", BETA_WIDTH_SQL, PLAN_SQL).replace("WITH", "WITH RECURSIVE", 1))(planner.plan)


#: Parameters of the skills s0 to s4, as a fit gives them.
SKILL_PARAMETERS = [(f"s{k}", 0.2 + 0.1 * k, 0.05 + 0.03 * k, 0.05 + 0.02 * k, 0.25 - 0.03 * k, 0.01 * k) for k in range(5)]
TRACED_SQL = f"""parameters(skill, initial, learning, slip, guess, forgetting) AS (VALUES {", ".join(f"('{s}', {', '.join(f'{x!r}::DOUBLE' for x in p)})" for s, *p in SKILL_PARAMETERS)}),
firsts AS (SELECT source_namespace, learner_id, domain, event_id, skills[1] AS skill, correct, row_number() OVER (PARTITION BY source_namespace, learner_id, domain, skills[1] ORDER BY {ORDER}) AS r FROM attempts WHERE len(skills) > 0),
traced(source_namespace, learner_id, domain, skill, r, k) AS (SELECT DISTINCT source_namespace, learner_id, domain, skill, CAST(0 AS BIGINT), initial FROM firsts JOIN parameters USING (skill) UNION ALL
  SELECT source_namespace, learner_id, domain, skill, r, after * (1 - forgetting) + (1 - after) * learning FROM (
    SELECT f.source_namespace, f.learner_id, f.domain, f.skill, f.r, p.forgetting, p.learning, CASE WHEN f.correct THEN t.k * (1 - slip) / (t.k * (1 - slip) + (1 - t.k) * guess) ELSE t.k * slip / (1 - (t.k * (1 - slip) + (1 - t.k) * guess)) END AS after
    FROM traced t JOIN firsts f ON f.source_namespace = t.source_namespace AND f.learner_id = t.learner_id AND f.domain = t.domain AND f.skill = t.skill AND f.r = t.r + 1 JOIN parameters p ON p.skill = f.skill))"""
MODEL_SQL = f"""{TRACED_SQL},
believed AS (SELECT source_namespace, learner_id, domain, skill, arg_max(k, r) AS k FROM traced GROUP BY 1, 2, 3, 4),
latest AS (SELECT learner_id, source_namespace, order_scope FROM (SELECT *, row_number() OVER (PARTITION BY learner_id ORDER BY timestamp DESC NULLS FIRST, source_sequence DESC, event_id DESC) AS back FROM attempts) WHERE back = 1),
tagged AS (SELECT learner_id, question_id, min(skills[1]) AS skill FROM attempts WHERE len(skills) > 0 GROUP BY 1, 2),
foreseen AS (SELECT g.learner_id AS who, g.question_id AS what, coalesce(b.k, p.initial) * (1 - p.slip) + (1 - coalesce(b.k, p.initial)) * p.guess AS chance FROM tagged g JOIN latest l USING (learner_id) JOIN parameters p ON p.skill = g.skill
  LEFT JOIN believed b ON b.source_namespace = l.source_namespace AND b.learner_id = g.learner_id AND b.skill = g.skill AND b.domain = CASE WHEN l.order_scope = 'question' THEN g.question_id ELSE '' END)"""
MODELLED = "CASE WHEN l.question_id IS NULL THEN 0 ELSE 0.25::DOUBLE END"
query("p1_plan_with_model", SQL["p1_plan"].replace("lately AS", f"{MODEL_SQL},\nlately AS", 1).replace(MODELLED, f"{MODELLED} + 0.2::DOUBLE * coalesce(1 - chance, 0)", 1).replace("FROM tried t JOIN bounds", "FROM tried t LEFT JOIN foreseen e ON e.who = t.learner_id AND e.what = t.question_id JOIN bounds", 1))(
    lambda a: planner.plan(a, model=given_parameters(a.sparkSession))
)

REPLAY_SQL = """SELECT event_id, skill, round(p0, 9) AS probability, round(k0, 9) AS before_unit, round(prior, 9) AS prior, round(following, 9) AS following, unit_size FROM (
  SELECT *, k0 * (1 - slip) + (1 - k0) * guess AS p0 FROM (
    SELECT f.event_id, f.skill, t.k AS prior, u.k AS following, p.slip, p.guess, first_value(t.k) OVER (PARTITION BY f.source_namespace, f.learner_id, f.domain, f.skill, w.unit ORDER BY f.r) AS k0, w.unit_size
    FROM firsts f JOIN traced t ON t.source_namespace = f.source_namespace AND t.learner_id = f.learner_id AND t.domain = f.domain AND t.skill = f.skill AND t.r = f.r - 1
    JOIN traced u ON u.source_namespace = f.source_namespace AND u.learner_id = f.learner_id AND u.domain = f.domain AND u.skill = f.skill AND u.r = f.r
    JOIN parameters p ON p.skill = f.skill
    JOIN (SELECT event_id, unit, count(*) OVER (PARTITION BY source_namespace, learner_id, domain, unit) AS unit_size FROM united) w ON w.event_id = f.event_id))"""


def given_parameters(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SKILL_PARAMETERS, "skill string, " + ", ".join(f"{n} double" for n in bkt.NAMES))


query("m14_replay", sql(REPLAY_SQL, UNITS_SQL, TRACED_SQL).replace("WITH", "WITH RECURSIVE", 1))(
    lambda a: trace.trace(a, given_parameters(a.sparkSession)).select("event_id", "probability", "unit_size", F.explode("updates").alias("u")).select("event_id", "u.skill", "probability", "u.before_unit", "u.prior", "u.following", "unit_size")
)



def event_graph(a: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of attempts that rest on two earlier ones each; some contents are missing or changed."""
    place = F.col("source_sequence")
    found = F.when((place > 300) & (place % 101 == 7), None).when((place > 300) & (place % 97 == 5), F.lit("other")).otherwise(F.col("question_id"))
    nodes = a.select(place.cast("string").alias("id"), F.col("question_id").alias("checksum"), found.alias("found"))
    above = F.explode(F.array(F.floor(place / 16), F.floor(place / 10))).alias("parent")
    return nodes, a.where(place > 0).select(place.cast("string").alias("child"), above).select("child", F.col("parent").cast("string").alias("parent"))


query("l1_unsound_lineage", sql("""SELECT CAST(i AS VARCHAR) AS id, level, coalesce(reason, 'ancestor') AS reason FROM own JOIN highest USING (i) WHERE reason IS NOT NULL OR i IN (SELECT i FROM spoilt)""", """
ids AS (SELECT source_sequence AS i FROM attempts), edges AS (SELECT i AS c, i // 16 AS p FROM ids WHERE i > 0 UNION SELECT i, i // 10 FROM ids WHERE i > 0),
every AS (SELECT i FROM ids UNION SELECT p FROM edges),
own AS (SELECT i, CASE WHEN i NOT IN (SELECT i FROM ids) THEN 'unknown' WHEN i > 300 AND i % 101 = 7 THEN 'missing' WHEN i > 300 AND i % 97 = 5 THEN 'changed' END AS reason FROM every),
spoilt(i) AS (SELECT i FROM own WHERE reason IN ('missing', 'changed') UNION SELECT c FROM edges JOIN spoilt ON p = spoilt.i),
leveled(i, level) AS (SELECT i, 0 FROM every WHERE i NOT IN (SELECT c FROM edges) UNION SELECT c, level + 1 FROM edges JOIN leveled ON p = leveled.i),
highest AS (SELECT i, max(level) AS level FROM leveled GROUP BY 1)""").replace("WITH", "WITH RECURSIVE", 1))(lambda a: lineage.unsound(*event_graph(a)))

def _knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = parts_of(attempts(spark, sf_dir))
    return rounded(bkt.predict(test, bkt.fit(spark, train), baselines.rate_of(train)).select("event_id", "probability"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = parts_of(attempts(spark, sf_dir))
    rows = irt.eligible(irt.responses(train), 4, 6)  # the core that these tables have
    learners, items = irt.fit(rows)
    return rounded(irt.predict_online(irt.support(rows, learners, items)[0], items, test).select("event_id", "probability"))


def event_records(a: DataFrame) -> DataFrame:
    """The attempts as records of a file, with some again: of every thousand one as it is, one with another outcome, and one whose outcome is a number."""
    own = [F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias(c) if c == "timestamp" else F.col(c) for c in CONTENT]
    text = lambda correct: F.to_json(F.struct(*[correct.alias("correct") if c == "correct" else x for c, x in zip(CONTENT, own, strict=True)]))
    kind = F.col("source_sequence") % 1000
    again = F.when(kind == 1, text(F.col("correct"))).when(kind == 2, text(~F.col("correct"))).when(kind == 3, text(F.col("correct").cast("int")))
    rows = a.select((2 * F.col("source_sequence") + 1).alias("row"), text(F.col("correct")).alias("value"))
    return rows.union(a.where(kind.isin(1, 2, 3)).select(2 * F.col("source_sequence") + 2, again)).withColumn("error", F.lit(None).cast("string"))


def _imported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of an import of the events' own attempts."""
    # records are parsed by all tasks, however few blocks the table has
    rows = event_records(attempts(spark, sf_dir)).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "row")
    return ingest.import_counts(ingest.classified(ingest.validated(rows, namespace="testdata")))


def _experiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(experiment.report(experiment.run(attempts(spark, sf_dir))), 6)


QUERIES |= {
    "e1_experiment": _experiment,
    "m9_knowledge_tracing": _knowledge,
    "m12_item_response": _items,
    "in4_import_counts": _imported,
}
SQL["in4_import_counts"] = sql("""SELECT count(*) + sum(a + b + c) AS received, count(*) AS accepted, sum(a) AS duplicates, sum(b) AS conflicts, sum(c) AS rejected, count(*) FILTER (WHERE timestamp IS NULL) AS no_timestamp, count(*) FILTER (WHERE duration_ms IS NULL) AS no_duration,
  count(*) FILTER (WHERE session_id IS NULL) AS no_session, count(*) FILTER (WHERE len(skills) = 0) AS no_skills, count(*) FILTER (WHERE time_semantics = 'shifted') AS shifted, count(*) FILTER (WHERE order_scope = 'question') AS question_only, count(*) FILTER (WHERE duration_scope = 'bundle') AS bundle_duration, CAST(0 AS BIGINT) AS position_only
  FROM (SELECT *, (source_sequence % 1000 = 1)::BIGINT AS a, (source_sequence % 1000 = 2)::BIGINT AS b, (source_sequence % 1000 = 3)::BIGINT AS c FROM attempts)""").replace("sum(a)", "CAST(sum(a) AS BIGINT)").replace("sum(b)", "CAST(sum(b) AS BIGINT)").replace("sum(c)", "CAST(sum(c) AS BIGINT)").replace("sum(a + b + c)", "CAST(sum(a + b + c) AS BIGINT)")
