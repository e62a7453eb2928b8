"""Samples, perturbed samples and response logs derived from the driver's tables, as DataFrames and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import hex_number
from ..functions.plan import spread
from ..schema import LEVELS, STRATEGIES

def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def single(spark: SparkSession, d: str) -> DataFrame:
    """Every document as a clean sample; gold label from ``labels``, null where there is none."""
    docs, labels = spread(table(spark, d, "documents").select("doc_id", "text")), table(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("gold_label"))
    return docs.join(labels, "doc_id", "left").select(F.col("doc_id").cast("string").alias("sample_id"), F.lit("docs").alias("dataset_name"), F.coalesce("text", F.lit("")).alias("text_a"), "gold_label")


def texts(spark: SparkSession, d: str) -> DataFrame:
    """Every document as a clean sample without a gold label, so that texts need not meet labels."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    return docs.select(F.col("doc_id").cast("string").alias("sample_id"), F.lit("docs").alias("dataset_name"), F.coalesce("text", F.lit("")).alias("text_a"))


SINGLE = "single AS (SELECT d.doc_id::VARCHAR AS sample_id, 'docs' AS dataset_name, coalesce(text, '') AS text_a, quality::VARCHAR AS gold_label FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """A user's turn and the answer to it."""
    c = spread(table(spark, d, "conversations"))
    a = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("text_a"))
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("text_b"))
    j = a.join(b, ["conv_id", "turn"])
    return j.select(F.concat_ws("-", "conv_id", "turn").alias("sample_id"), F.lit("pairs").alias("dataset_name"), "text_a", "text_b", F.pmod(F.col("conv_id") + F.col("turn"), F.lit(2)).cast("string").alias("gold_label"))


PAIRS = "pairs AS (SELECT a.conv_id || '-' || a.turn AS sample_id, 'pairs' AS dataset_name, a.text AS text_a, b.text AS text_b, ((a.conv_id + a.turn) % 2)::VARCHAR AS gold_label FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user')"


#: Letters as Han characters, so that words of the segmenter's dictionary and others come up.
_LATIN, _HAN = "enitsaroldcu", "今天我们不错时间学生很好"


def han(spark: SparkSession, d: str) -> DataFrame:
    """The pairs in Han characters."""
    to_han = lambda c: F.translate(c, _LATIN, _HAN).alias(c)
    return pairs(spark, d).select("sample_id", "dataset_name", to_han("text_a"), to_han("text_b"))


def two_fields(table: str = "pairs", a: str = "text_a", b: str = "text_b") -> str:
    return f"SELECT sample_id, dataset_name, 0 AS f, {a} AS t FROM {table} UNION ALL SELECT sample_id, dataset_name, 1, {b} FROM {table}"


HAN = f"{PAIRS}, han AS (SELECT sample_id, dataset_name, translate(text_a, '{_LATIN}', '{_HAN}') AS text_a, translate(text_b, '{_LATIN}', '{_HAN}') AS text_b FROM pairs)"


def choices(spark: SparkSession, d: str) -> DataFrame:
    """A customer as a multiple-choice sample: which region?  (options: all region names, by key)"""
    r = table(spark, d, "region").groupBy().agg(F.array_sort(F.collect_list(F.struct("r_regionkey", "r_name"))).alias("r"))
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    c = c.crossJoin(F.broadcast(r))  # one row
    return c.select(
        F.col("c_custkey").cast("string").alias("sample_id"), F.lit("choices").alias("dataset_name"), F.concat_ws("\n", "c_name", "c_mktsegment", "n_name").alias("context"), F.lit("region?").alias("question"),
        F.col("r.r_name").alias("options"), F.element_at(F.transform(F.filter("r", lambda x: x["r_regionkey"] == F.col("n_regionkey")), lambda x: x["r_name"]), 1).alias("answer"),
    )


CHOICES = "choices AS (SELECT c_custkey::VARCHAR AS sample_id, 'choices' AS dataset_name, c_name || chr(10) || c_mktsegment || chr(10) || n_name AS context, 'region?' AS question, (SELECT list(r_name ORDER BY r_regionkey) FROM region) AS options, r_name AS answer FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


#: Task of a sample by its number, with the labels that stand for quality 0 and 1 (as gold labels, and as answers).
TASKS = [
    ("pair_paraphrase", ("0", "1"), ("0", "1")), ("question_matching", ("0", "1"), ("0", "1")), ("nli", ("contradiction", "entailment"), ("contradiction", "entailment")), ("sentiment_polarity", ("negative", "positive"), ("negative", "positive")),
    ("sentiment_rating", ("1", "5"), ("1", "5")), ("multiple_choice_mrc", ("0", "1"), ("A", "B")),
]
_EACH = [(s, x) for s in STRATEGIES for x in LEVELS]


def _number(*parts: str, of: int) -> Column:
    return F.pmod(hex_number(F.concat_ws("|", *parts)), F.lit(of)).cast("int")


def samples(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents as samples of six tasks in two datasets, clean and for every strategy and level; one in ten perturbed rows was not applied.

    gold_label: as the task has it; ``answer`` and ``other``: the right and a wrong answer.
    """
    clean = single(spark, d).where("gold_label is not null").select("sample_id", F.col("gold_label").alias("quality"), _number("sample_id", of=6).alias("task_number"))
    clean = clean.withColumn("dataset_name", F.when(F.col("task_number") % 2 == 0, "even").otherwise("odd"))
    pick = lambda f: F.array(*[F.lit(f(t)) for t in TASKS])
    at = lambda values: F.get(values, F.col("task_number"))
    by_quality = lambda k, right: F.when((F.col("quality") == "1") == right, at(pick(lambda t: t[k][1]))).otherwise(at(pick(lambda t: t[k][0])))
    clean = clean.select("sample_id", "dataset_name", at(pick(lambda t: t[0])).alias("task"), by_quality(1, F.lit(True)).alias("gold_label"), by_quality(2, F.lit(True)).alias("answer"), by_quality(2, F.lit(False)).alias("other"))
    each = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{s}', '{x}')" for s, x in _EACH) + ", (CAST(NULL AS STRING), CAST(NULL AS STRING)) AS v(corruption_name, corruption_level)")
    rows = clean.crossJoin(F.broadcast(each)).withColumn("bucket", bucket())  # 22 rows
    name = F.col("corruption_name")
    return rows.select("*", F.lit(0).alias("n_options"), F.when(name.isNotNull(), F.col("bucket") != 9).alias("corruption_applied"), F.when(name.isNotNull(), F.col("bucket") % 3).otherwise(0).alias("change_count"))


def bucket() -> Column:
    return F.pmod(hex_number(F.concat_ws("|", F.col("dataset_name"), F.col("sample_id"), F.coalesce("corruption_name", F.lit("clean")), F.coalesce("corruption_level", F.lit("n/a")))), F.lit(10))


def _by_task(f) -> str:
    return "CASE task_number " + " ".join(f"WHEN {i} THEN '{f(t)}'" for i, t in enumerate(TASKS)) + " END"


SAMPLES = f"""{SINGLE},
each AS (SELECT * FROM (VALUES {", ".join(f"('{s}', '{x}')" for s, x in _EACH)}, (NULL, NULL)) AS v(corruption_name, corruption_level)),
numbered AS (SELECT sample_id, gold_label AS quality, (('0x' || substr(sha256(sample_id), 1, 8))::BIGINT % 6)::INT AS task_number FROM single WHERE gold_label IS NOT NULL),
tasked AS (SELECT sample_id, CASE WHEN task_number % 2 = 0 THEN 'even' ELSE 'odd' END AS dataset_name, {_by_task(lambda t: t[0])} AS task, CASE quality WHEN '1' THEN {_by_task(lambda t: t[1][1])} ELSE {_by_task(lambda t: t[1][0])} END AS gold_label,
  CASE quality WHEN '1' THEN {_by_task(lambda t: t[2][1])} ELSE {_by_task(lambda t: t[2][0])} END AS answer, CASE quality WHEN '1' THEN {_by_task(lambda t: t[2][0])} ELSE {_by_task(lambda t: t[2][1])} END AS other FROM numbered),
samples AS (SELECT *, 0 AS n_options, ('0x' || substr(sha256(dataset_name || '|' || sample_id || '|' || coalesce(corruption_name, 'clean') || '|' || coalesce(corruption_level, 'n/a')), 1, 8))::BIGINT % 10 AS bucket FROM tasked, each),
sampled AS (SELECT *, CASE WHEN corruption_name IS NOT NULL THEN bucket <> 9 END AS corruption_applied, CASE WHEN corruption_name IS NOT NULL THEN bucket % 3 ELSE 0 END AS change_count FROM samples)"""


def responses(spark: SparkSession, d: str) -> DataFrame:
    """A response for each sample but one in ten, in nine shapes; every third key is logged twice, the second time as '0'."""
    g, b = F.col("answer"), F.col("bucket")
    wide = F.translate(g, "01", "０１")
    text = (
        F.when(b == 1, F.concat(F.lit(" "), g, F.lit(" "))).when(b == 2, wide).when(b == 3, F.concat(g, F.lit("\n答案："))).when(b == 4, F.concat(F.lit("The answer is "), g))
        .when(b == 5, F.concat(g, F.lit("."))).when(b == 6, "").when(b == 7, F.col("other")).otherwise(g)
    )
    own = samples(spark, d).where(b != 8).withColumn("text", text)
    twice = F.pmod(F.length("sample_id") + b, F.lit(3)) == 0
    own = own.withColumn("seq", F.explode(F.when(twice, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    raw = F.to_json(F.struct(F.array(F.struct(F.struct(F.when(F.col("seq") == 0, F.col("text")).otherwise("0").alias("content")).alias("message"))).alias("choices")))
    return own.select("dataset_name", "sample_id", "corruption_name", "corruption_level", "seq", raw.alias("raw_response"))


_SUFFIX = "(?:[ \\t\\r\\n]+答案:?)?$"
RESPONSES = f"""{SAMPLES},
texts AS (SELECT *, CASE bucket WHEN 1 THEN ' ' || answer || ' ' WHEN 2 THEN translate(answer, '01', '０１') WHEN 3 THEN answer || chr(10) || '答案：' WHEN 4 THEN 'The answer is ' || answer
  WHEN 5 THEN answer || '.' WHEN 6 THEN '' WHEN 7 THEN other ELSE answer END AS text FROM sampled WHERE bucket <> 8),
records AS (SELECT dataset_name, sample_id, corruption_name, corruption_level, task, seq, CASE WHEN seq = 0 THEN text ELSE '0' END AS text FROM (SELECT *, unnest(CASE WHEN (length(sample_id) + bucket) % 3 = 0 THEN [0, 1] ELSE [0] END) AS seq FROM texts)),
normal AS (SELECT *, trim(translate(text, '０１：　', '01: '), chr(32) || chr(9) || chr(10) || chr(13)) AS t FROM records WHERE seq = 0),
parsed AS (SELECT dataset_name, sample_id, corruption_name, corruption_level, nullif(CASE task WHEN 'nli' THEN regexp_extract(lower(t), '^(entailment|neutral|contradiction){_SUFFIX}', 1) WHEN 'sentiment_polarity' THEN regexp_extract(lower(t), '^(positive|negative){_SUFFIX}', 1)
  WHEN 'sentiment_rating' THEN regexp_extract(t, '^([1-5]){_SUFFIX}', 1) WHEN 'multiple_choice_mrc' THEN regexp_extract(t, '^([A-D]){_SUFFIX}', 1) ELSE regexp_extract(t, '^([01]){_SUFFIX}', 1) END, '') AS label, t FROM normal),
outcomes AS (SELECT s.dataset_name, s.sample_id, s.corruption_name, s.corruption_level, s.corruption_name IS NULL AS is_clean, coalesce(corruption_applied, true) AS applied, p.sample_id IS NOT NULL AS has_response,
  coalesce(label = CASE WHEN task = 'multiple_choice_mrc' THEN chr(65 + gold_label::INT) ELSE gold_label END, false) AS correct, CASE WHEN p.sample_id IS NOT NULL THEN label IS NULL ELSE s.corruption_name IS NULL END AS parse_failed,
  CASE WHEN p.sample_id IS NULL THEN NULL WHEN label IS NOT NULL THEN 'success' WHEN t = '' THEN 'failure_empty' WHEN regexp_matches(t, '\\s') THEN 'failure_multiple_tokens' WHEN regexp_matches(t, '^[A-Da-d].') THEN 'failure_prefix'
  WHEN regexp_matches(t, '[^0-9A-Za-z_]') THEN 'failure_punctuation' ELSE 'failure_invalid_label' END AS parse_status
  FROM sampled s LEFT JOIN parsed p ON s.dataset_name = p.dataset_name AND s.sample_id = p.sample_id AND s.corruption_name IS NOT DISTINCT FROM p.corruption_name AND s.corruption_level IS NOT DISTINCT FROM p.corruption_level),
clean AS (SELECT dataset_name, sample_id, bool_or(correct) AS clean_correct FROM outcomes WHERE is_clean GROUP BY ALL),
paired AS (SELECT o.*, coalesce(clean_correct, false) AS clean_correct FROM outcomes o LEFT JOIN clean USING (dataset_name, sample_id) WHERE NOT is_clean),
buckets AS (SELECT dataset_name, corruption_name, corruption_level, count(*) AS eligible, count(*) FILTER (applied) AS applied, count(*) FILTER (NOT applied) AS not_applied, count(*) FILTER (applied AND has_response) AS responses,
  count(*) FILTER (applied AND NOT has_response) AS api_errors, count(*) FILTER (applied AND has_response AND parse_failed) AS parse_failures, count(*) FILTER (applied AND has_response AND correct) AS correct,
  count(*) FILTER (applied AND has_response AND clean_correct) AS crr_den, count(*) FILTER (applied AND has_response AND clean_correct AND correct) AS crr_num FROM paired GROUP BY ALL),
rated AS (SELECT *, crr_num::DOUBLE / nullif(crr_den, 0) AS crr, coalesce(applied::DOUBLE / nullif(eligible, 0), 0) AS success_rate, coalesce(parse_failures::DOUBLE / nullif(responses, 0), 0) AS parse_failure_rate FROM buckets)"""


def requests(spark: SparkSession, d: str) -> DataFrame:
    """Events as a request log: a key for each user and kind of event, many times over; events of kind 'error' failed."""
    e = table(spark, d, "events")
    return e.select("event_id", "ts", F.sha2(F.concat_ws(",", F.col("user_id").cast("string"), "event_type"), 256).alias("request_key"), (F.col("event_type") == "error").alias("is_error"), "props")


REQUESTS = "requests AS (SELECT event_id, ts, sha256(user_id || ',' || event_type) AS request_key, event_type = 'error' AS is_error, props FROM events)"
