"""Quality rules: a table of thresholds that becomes one projection of built-in functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, words_of

#: Function words of English, German, French and Spanish that stop-word ratios count.
STOP_WORDS = (
    "the of and to in a is that for it was on are as with at by this from or an be "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an "
    "le la les de des et en un une du que est pour dans qui sur par au pas il plus "
    "el los las del y por con para su al lo como más se no una"
).split()
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Threshold:
    """A text passes if ``low <= metric <= high``; a bound that is None doesn't bind."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None

    def passes(self) -> Column:
        value = F.col(self.metric)
        checks = [value >= F.lit(float(self.low))] if self.low is not None else []
        checks += [value <= F.lit(float(self.high))] if self.high is not None else []
        out = F.lit(True)
        for c in checks:
            out = out & c
        return out


#: The table that stands for production; ratios are of 0 where their base is 0.
THRESHOLDS = (
    Threshold("word_length", "mean_word_chars", 2.0, 15.0),
    Threshold("symbols", "symbol_ratio", None, 0.10),
    Threshold("stop_words", "stop_ratio", 0.02, None),
    Threshold("repeated_lines", "dup_line_ratio", None, 0.30),
)


def _ratio(above: str, below: str) -> Column:
    return F.when(F.col(below) > 0, F.col(above) / F.col(below)).otherwise(F.lit(0.0))


def measures(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and the counts and ratios that thresholds may name.

    Words are runs of other than ASCII white space; null texts count as empty ones and have
    zeros throughout. ``n_repeat_words`` counts each word place that is in a three-word
    window found twice or more, once. One row for each row of ``docs``.
    """
    out = docs.select(*[F.col(k) for k in keep], F.coalesce(F.col(text), F.lit("")).alias("__t"))
    out = out.withColumn("__w", words_of(F.col("__t")))
    windows = F.transform(
        F.slice("__w", F.lit(1), F.greatest(F.size("__w") - 2, F.lit(0))),
        lambda w, i: F.struct(F.xxhash64(w, F.get("__w", i + 1), F.get("__w", i + 2)).alias("h"), i.alias("p")),
    )
    out = out.withColumn("__s", F.sort_array(windows))
    same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
    twice = F.filter("__s", lambda x, i: same(x, F.get("__s", i + 1)) | same(x, F.get("__s", i - 1)))
    places = F.flatten(F.transform(twice, lambda x: F.array(x["p"], x["p"] + 1, x["p"] + 2)))
    lines = F.filter(F.split("__t", "\n"), lambda x: x.rlike(rf"[^ \t-\r]"))
    out = out.withColumn("__l", lines)
    length = lambda c: F.length(c).cast("long")
    out = out.select(
        *keep,
        F.size("__w").cast("long").alias("n_words"),
        length(F.translate("__t", " \t\n\x0b\f\r", "")).alias("word_chars"),
        (length("__t") - length(F.translate("__t", SYMBOLS, ""))).alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct(places)).cast("long").alias("n_repeat_words"),
        F.size("__l").cast("long").alias("n_lines"),
        F.size(F.filter("__w", lambda w: F.lower(w).isin(*dict.fromkeys(STOP_WORDS)))).cast("long").alias("n_stop_words"),
    )
    return out.select(
        "*",
        _ratio("word_chars", "n_words").alias("mean_word_chars"),
        _ratio("n_symbols", "word_chars").alias("symbol_ratio"),
        _ratio("n_stop_words", "n_words").alias("stop_ratio"),
        _ratio("n_dup_lines", "n_lines").alias("dup_line_ratio"),
    )


def quality_rules(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), thresholds: tuple[Threshold, ...] = THRESHOLDS) -> DataFrame:
    """:func:`measures` with ``base_failed``, ``failed`` (names of failed thresholds) and ``kept``.

    The base rule fails texts of under 50 words and those of which more than half are
    repeated words, so empty and null texts fail it. No rows: no rows.
    """
    out = measures(docs, text, keep)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    failed = F.filter(F.array(*[F.when(~t.passes(), F.lit(t.name)) for t in thresholds]), lambda x: x.isNotNull()) if thresholds else F.array().cast("array<string>")
    return out.withColumn("base_failed", base).withColumn("failed", failed).withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))
