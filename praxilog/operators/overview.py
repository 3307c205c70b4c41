"""Accuracy, first attempts, durations, retries, groups, histories and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import known_order, order_domain, wilson, within
from ..functions.lineage import cut
from ..functions.quantiles import exact_quantiles

ITEM = ("source_namespace", "learner_id", "question_id")


def hits() -> Column:
    return F.col("correct").cast("int")



def of_learner(attempts: DataFrame, learner: str | None) -> DataFrame:
    """One learner's attempts; all for None or an empty name."""
    return attempts.where(F.col("learner_id") == learner) if learner else attempts


def page(rows: DataFrame, offset: int, limit: int) -> DataFrame:
    if offset < 0 or not 1 <= limit <= 500:
        raise ValueError("offset must not be negative and limit be 1 to 500")
    return rows.offset(offset).limit(limit)


def coverage(attempts: DataFrame) -> DataFrame:
    """One row: how many attempts, learners and questions there are, what is known of them, and accuracy with bounds."""
    row = attempts.agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum(hits()), F.lit(0)).alias("successes"),
        F.count_distinct("learner_id").alias("learners"),
        F.count_distinct("question_id").alias("questions"),
        F.count("timestamp").alias("timestamped"),
        F.count("duration_ms").alias("duration_known"),
        F.count_if(F.col("order_scope") == "question").alias("question_only"),
        F.count_if(F.col("time_semantics") == "shifted").alias("shifted"),
    )
    return row.select("*", *[c.alias(k) for k, c in wilson(F.col("successes"), F.col("n")).items()])


def first_attempts(attempts: DataFrame) -> DataFrame:
    """One row: accuracy over each learner's first attempt at each question."""
    first = attempts.select(*ITEM, "timestamp", "source_sequence", "event_id", "correct").withColumn("rn", F.row_number().over(within(*ITEM))).where("rn = 1")
    row = first.agg(F.count("*").alias("n"), F.coalesce(F.sum(hits()), F.lit(0)).alias("successes"))
    return row.select("*", *[c.alias(k) for k, c in wilson(F.col("successes"), F.col("n")).items()])


def bundle_rank(*more) -> object:
    keys = ("source_namespace", "learner_id", "session_id", "bundle_id", *more)
    return F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("source_sequence").asc_nulls_last(), F.col("event_id").asc_nulls_last()))


def known_durations(attempts: DataFrame) -> DataFrame:
    """``duration_ms`` of each event, and once of each bundle within a session; unknown scopes have none."""
    known = attempts.where("duration_ms is not null")
    bundles = known.where("duration_scope = 'bundle' and session_id is not null and bundle_id is not null").withColumn("rn", bundle_rank())
    return known.where("duration_scope = 'event'").select("duration_ms").unionByName(bundles.where("rn = 1").select("duration_ms"))


def duration_stats(attempts: DataFrame) -> DataFrame:
    """One row: exact quantiles and the total of :func:`known_durations`."""
    names = {"median_ms": 0.5, "q25_ms": 0.25, "q75_ms": 0.75, "p90_ms": 0.9}
    n, found, (total,) = exact_quantiles(cut(known_durations(attempts)), "duration_ms", list(names.values()), F.sum("duration_ms"))
    return attempts.sparkSession.createDataFrame([(n, *found, total)], "n long, " + ", ".join(f"{c} double" for c in names) + ", total_ms double")


def retries(attempts: DataFrame) -> DataFrame:
    """One row: wrong attempts before a learner's first right one at a question; those never solved are censored."""
    placed = attempts.select(*ITEM, "timestamp", "source_sequence", "event_id", "correct").withColumn("before", F.row_number().over(within(*ITEM)) - 1)
    each = placed.groupBy(*ITEM).agg(F.min(F.when(F.col("correct"), F.col("before"))).alias("retries"))
    _, (median,), row = exact_quantiles(cut(each), "retries", [0.5], F.count("*"), F.count("retries"), F.count_if(F.col("retries").isNull()), F.avg("retries"))
    return attempts.sparkSession.createDataFrame([(*row, median)], "questions long, solved long, censored long, mean_retries double, median_retries double")


def groups(attempts: DataFrame, dimension: str, learner: str | None = None, search: str = "") -> DataFrame:
    """A row for each question, learner or skill, most attempts first. A skill's groups overlap; ``search`` is a LIKE part."""
    column = {"question": "question_id", "learner": "learner_id", "skill": "skill"}[dimension]
    rows = of_learner(attempts, learner)
    if dimension == "skill":
        rows = rows.withColumn("skill", F.explode("skills"))
    if search:
        rows = rows.where(F.col(column).like(f"%{search}%"))
    out = rows.groupBy(F.col(column).alias("id")).agg(
        F.count("*").alias("n"),
        F.sum(hits()).alias("successes"),
        F.count_distinct("learner_id").alias("learners"),
        F.count_distinct("question_id").alias("questions"),
        F.count("duration_ms").alias("known_durations"),
        F.min("timestamp").alias("first_timestamp"),
        F.max("timestamp").alias("last_timestamp"),
    )
    return out.select("*", *[c.alias(k) for k, c in wilson(F.col("successes"), F.col("n")).items()]).orderBy(F.desc("n"), "id")


def history(attempts: DataFrame, learner: str, question: str | None = None) -> DataFrame:
    """One learner's attempts in order: sources, then order domains, then known order."""
    rows = attempts.where(F.col("learner_id") == learner)
    if question:
        rows = rows.where(F.col("question_id") == question)
    rows = rows.select("source_namespace", order_domain().alias("domain"), "event_id", "question_id", "skills", "correct", "attempt_kind", "source_sequence", "timestamp", "duration_ms", "session_id", "bundle_id", "order_scope", "time_semantics")
    return rows.orderBy("source_namespace", "domain", *known_order())


def sessions(attempts: DataFrame, learner: str | None = None) -> DataFrame:
    """A row for each named session; the elapsed time of a bundle counts once."""
    rows = of_learner(attempts, learner).where("session_id is not null")
    rows = rows.withColumn("rn", bundle_rank("duration_scope", F.col("duration_ms").isNull()))
    timed = (F.col("duration_scope") == "event") | ((F.col("duration_scope") == "bundle") & F.col("bundle_id").isNotNull() & (F.col("rn") == 1))
    spent = F.when(timed, F.col("duration_ms"))
    return rows.groupBy("source_namespace", "learner_id", "session_id").agg(
        F.count("*").alias("n"),
        F.sum(hits()).alias("successes"),
        F.count_distinct("question_id").alias("questions"),
        F.count_distinct("bundle_id").alias("bundles"),
        F.min("timestamp").alias("first_timestamp"),
        F.max("timestamp").alias("last_timestamp"),
        F.bool_or(F.col("time_semantics") == "shifted").alias("shifted"),
        F.sum(spent).alias("known_duration_ms"),
        F.count(spent).alias("duration_observations"),
    )


def item_durations(attempts: DataFrame) -> DataFrame:
    """Quartiles, in seconds, of each learner's own event durations above zero at each question."""
    q = lambda x: (F.percentile("duration_ms", F.lit(x)) / 1000)
    return attempts.where("duration_ms > 0 and duration_scope = 'event'").groupBy("learner_id", "question_id").agg(F.count("*").alias("n"), q(0.5).alias("median_seconds"), q(0.25).alias("q25_seconds"), q(0.75).alias("q75_seconds"))


def order_domains(attempts: DataFrame) -> DataFrame:
    """How many order domains each learner has."""
    return attempts.groupBy("learner_id").agg(F.count_distinct(F.struct("source_namespace", order_domain())).alias("domains"))


def streaks(attempts: DataFrame, learner: str | None = None) -> DataFrame:
    """The longest run of right answers of each order domain, 0 where all are wrong."""
    rows = of_learner(attempts, learner).withColumn("domain", order_domain())
    keys = ("source_namespace", "learner_id", "domain")
    wrong = F.sum(F.when(F.col("correct"), 0).otherwise(1)).over(within(*keys).rowsBetween(Window.unboundedPreceding, 0))
    runs = rows.withColumn("wrong", wrong).groupBy(*keys, "wrong").agg(F.sum(hits()).alias("length"))
    return runs.groupBy(*keys).agg(F.max("length").alias("longest_correct_streak"))


def trend(attempts: DataFrame, learner: str, bins: int = 80, axis: str = "order", question: str | None = None) -> DataFrame:
    """One learner's accuracy in ``bins`` bins of equal size, by source order or by real time.

    The order axis refuses a learner of several order domains: there is no common order.
    """
    if not 2 <= bins <= 500 or axis not in ("order", "time"):
        raise ValueError("bins must be 2 to 500 and axis order or time")
    rows = attempts.where(F.col("learner_id") == learner)
    if question:
        rows = rows.where(F.col("question_id") == question)
    if axis == "time":
        rows = rows.where("timestamp is not null and time_semantics = 'real'").withColumn("x", F.unix_micros("timestamp") / 1e6)
    else:
        if rows.select("source_namespace", order_domain()).distinct().limit(2).count() > 1:
            raise ValueError("the learner has several order domains; choose a question")
        rows = rows.withColumn("x", F.col("source_sequence").cast("double"))
    rows = rows.withColumn("bucket", F.ntile(bins).over(Window.partitionBy("learner_id").orderBy(*known_order())))
    out = rows.groupBy("bucket").agg(F.min("x").alias("x_start"), F.max("x").alias("x_end"), F.count("*").alias("n"), F.sum(hits()).alias("successes"), F.min(hits()).alias("minimum"), F.max(hits()).alias("maximum"))
    return out.select("*", *[c.alias(k) for k, c in wilson(F.col("successes"), F.col("n")).items()])


def cohort_rows(attempts: DataFrame, learner: str, minimum_attempts: int = 20) -> DataFrame:
    """Accuracy of each learner with enough attempts on the items that one learner has tried."""
    items = attempts.where(F.col("learner_id") == learner).select("source_namespace", "question_id").distinct()
    shared = attempts.join(items, ["source_namespace", "question_id"], "left_semi")
    return shared.groupBy("learner_id").agg(F.count("*").alias("n"), F.avg(hits()).alias("accuracy"), F.count_distinct("question_id").alias("shared_items")).where(F.col("n") >= minimum_attempts)


def cohort_percentile(attempts: DataFrame, learner: str, minimum_attempts: int = 20) -> DataFrame:
    """One row: the learner's mid-rank percentile among peers with at least two and half of its items; none without peers."""
    rows = cut(cohort_rows(attempts, learner, minimum_attempts))
    own = rows.where(F.col("learner_id") == learner).first()
    items = attempts.where(F.col("learner_id") == learner).agg(F.count_distinct("question_id")).first()[0]
    accuracy, tries = (own["accuracy"], own["n"]) if own else (None, None)
    peers = rows.where((F.col("learner_id") != learner) & (F.col("shared_items") >= max(2.0, items * 0.5)) & F.lit(own is not None))
    mine = F.lit(accuracy).cast("double")
    below = F.count_if(F.col("accuracy") < mine) + 0.5 * F.count_if(F.col("accuracy") == mine)
    out = peers.agg((100 * below / F.nullif(F.count("*"), F.lit(0))).alias("percentile"), F.count("*").alias("eligible_peers"), F.lit(tries).cast("long").alias("target_attempts"), F.lit(items).cast("long").alias("target_items"))
    return out.where("eligible_peers > 0")
