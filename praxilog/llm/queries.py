"""Queries that apply the operators to whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontam, langid, linededup, pieces, quality, simhash, spelling, suffix, tokencount, toxicity, urlfilter, warc
from .common import fold, scratch

RULES = (
    urlfilter.Rule("com", "/en/", False),
    urlfilter.Rule("example.com", "/en/7", True),
    urlfilter.Rule("net", "/de/", True),
    urlfilter.Rule("example.net", "/de/8", False),
    urlfilter.Rule("org", "/es/", False),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    languages, prototypes = langid.fit_prototypes(docs.where(fold("doc_id", 4) != 2))
    return langid.identify(docs, languages, prototypes, keep={"doc_id": F.col("doc_id"), "held_out": fold("doc_id", 4) == 2})


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_report(table(spark, sf_dir, "documents"), wide=True)


def toxic_network(docs: DataFrame, labels: DataFrame) -> toxicity.Network | None:
    return toxicity.fit(*toxicity.sample(docs, labels.where(fold("doc_id", 3) != 1)))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = toxic_network(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, net, keep={"doc_id": F.col("doc_id"), "held_out": fold("doc_id", 3) == 1})


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(table(spark, sf_dir, "pages"), RULES)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json").decode(), scratch(spark, "token-counts"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("items").alias("found")).select("doc_id", F.col("found.item").alias("item_id"), "found.similarity")


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.archive(table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json").decode(), tokenizer_file("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_quality_rules, op3_line_dedup, op4_toxicity, op5_sentencepiece, op6_url_filter, op7_simhash, op8_token_counts, op9_suffix_dedup, op10_decontamination, op11_warc, op12_spelling_variants, op13_tokenizer_alignment)}


def quality_sql(thresholds: tuple[quality.Threshold, ...] = quality.THRESHOLDS) -> str:
    """The threshold table as DuckDB SQL."""
    space = r"[ \t-\r]"
    passes = " AND ".join(f"{t.metric} {op} {float(x)!r}" for t in thresholds for op, x in ((">=", t.low), ("<=", t.high)) if x is not None)
    stops = ", ".join(f"'{w}'" for w in dict.fromkeys(quality.STOP_WORDS))
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
w AS (SELECT doc_id, x, list_filter(regexp_split_to_array(x, '{space}+'), lambda y: y <> '') AS words,
             list_filter(string_split(x, chr(10)), lambda y: regexp_matches(y, '[^ \\t-\\r]')) AS lines FROM t),
g AS (SELECT doc_id, x, words, lines, CASE WHEN len(words) < 3 THEN [] ELSE
             list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) END AS grams FROM w),
e AS (SELECT doc_id, unnest(grams) AS gram, generate_subscripts(grams, 1) AS p FROM g),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM e) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM r) GROUP BY doc_id),
m AS (SELECT g.doc_id, CAST(len(words) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(x, '{space}', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines,
             len(list_filter(words, lambda y: lower(y) IN ({stops}))) AS n_stop_words
      FROM g LEFT JOIN c ON g.doc_id = c.doc_id),
f AS (SELECT *, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0.0 END AS mean_word_chars,
             CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0.0 END AS symbol_ratio,
             CASE WHEN n_words > 0 THEN n_stop_words / n_words ELSE 0.0 END AS stop_ratio,
             CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0.0 END AS dup_line_ratio,
             n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {passes} AS kept FROM f"""


WARC_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS x FROM pages),
d AS (SELECT page_id, CAST(strlen(x) AS BIGINT) AS payload_bytes, sha1(x) AS payload_digest, max(page_id) OVER (PARTITION BY x) AS newest FROM p),
r AS (SELECT *, payload_bytes >= {warc.LEAST_BYTES} AND page_id IS DISTINCT FROM newest AS again FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN newest END AS refers_to FROM r"""


SPELLING_SQL = f"""
WITH RECURSIVE r AS (SELECT doc_id, x, count(*) AS n FROM (
       SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{spelling.UPPER}', '{spelling.LOWER}'), '[A-Za-zÀ-ÿ]+')) AS x FROM documents) GROUP BY doc_id, x),
b AS (SELECT *, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || x, ''), lambda c:
       CASE WHEN ord(c) < 128 THEN [CAST(ord(c) AS BIGINT)] ELSE [CAST(192 + ord(c) // 64 AS BIGINT), CAST(128 + ord(c) % 64 AS BIGINT)] END)) AS bytes FROM r WHERE length(x) >= {spelling.LEAST_CHARS}),
-- crc32 bit by bit: each byte comes in with its first of eight steps
c AS (SELECT x, n, xor(list_reduce(flatten(list_transform(bytes, lambda y: [y, 0, 0, 0, 0, 0, 0, 0])), lambda h, y:
       CASE WHEN xor(h, y) & 1 = 1 THEN xor(xor(h, y) >> 1, 3988292384) ELSE xor(h, y) >> 1 END, 4294967295), 4294967295) AS h FROM b),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
       SELECT CASE WHEN h % {spelling.DAMAGED} = 0 THEN x[:h % length(x)] || x[h % length(x) + 2:] ELSE x END AS word, n FROM c)
      WHERE length(word) >= {spelling.LEAST_CHARS} GROUP BY word HAVING sum(n) >= {spelling.LEAST_TIMES}),
p AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
l AS (SELECT DISTINCT p.word AS a, p.n AS a_n, w.word AS b, w.n AS b_n FROM p JOIN w ON w.word = p.word[:i - 1] || p.word[i + 1:]),
s AS (SELECT word, n, word[:i - 1] || '?' || word[i + 1:] AS k FROM p),
e AS (SELECT a, b, b_n FROM l UNION ALL SELECT b, a, a_n FROM l
      UNION ALL SELECT x.word, y.word, y.n FROM s x JOIN s y ON x.k = y.k AND x.word <> y.word),
t AS (SELECT a, count(*) AS n_near, arg_min(b, (-b_n, b)) AS best, max(b_n) AS best_n FROM e GROUP BY a),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= {spelling.MORE} * w.n THEN best END AS form,
             CASE WHEN best_n >= {spelling.MORE} * w.n THEN best_n END AS form_n FROM w LEFT JOIN t ON t.a = w.word),
g AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT g.word, f.word, f.form FROM g JOIN f ON g.next = f.word)
SELECT f.word, form, root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM f JOIN g ON f.word = g.word AND g.next IS NULL"""


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": quality_sql(), "op11_warc": WARC_SQL, "op12_spelling_variants": SPELLING_SQL}
