"""The corpus pipeline: language ID, quality rules, near-duplicates, mixing, SentencePiece coding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and reread as the next one's ``docs``.
All but the last return the columns of ``documents``; the last returns coded documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm import language_id, mixing, near_dedup, piece_dropout, quality_rules
from quern.llm.common import materialize, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
QUALITY_POLICY = "full-1"
#: Up to so many (id, text) that occur several times are broadcast (three longs each).
REPEATED_BROADCAST = 1_000_000
#: Trained models and dropout apply to every row, so SQL cannot express the result.
ORACLE_SQL = None


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language the network tells: not ``und``, and a score of language_id.MIN_SCORE or more.

    Null, empty and letterless texts are ``und`` and go, as does everything where no row has a language to learn.  Other columns may be null; extra ones are dropped.
    """
    net = language_id.fit(docs)
    kept = language_id.predict(docs.select(*COLUMNS), net)
    return kept.where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= language_id.MIN_SCORE)).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that pass every rule of the quality policy.  Null and empty texts have too few words and go; extra columns are dropped, even those named like a measurement."""
    return quality_rules.ledger(docs.select(*COLUMNS)).where(~quality_rules.rejected(QUALITY_POLICY)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates (five-word shingles, similarity 0.8): the one of least id.

    Unlike texts of one id all stay; of rows with one id and text one stays (the least in its other columns).  Rows without id are all kept.
    """
    found = near_dedup.near_duplicates(docs, rows=True).where("first and doc_id is not null")
    keep = materialize(found.groupBy(F.col("doc_id").alias("k_id"), F.col("th").alias("k_th")).agg(F.count("*").alias("n")), "pipe-keep")
    own = docs.select(*COLUMNS).withColumn("th", F.xxhash64("text"))
    same = (F.col("doc_id") == F.col("k_id")) & (F.col("th") == F.col("k_th"))
    out = own.join(keep.where("n = 1"), same, "left_semi").select(*COLUMNS).unionByName(own.where("doc_id is null").select(*COLUMNS))
    again = keep.where("n > 1")
    if m := again.count():  # rows that are there several times meet before the shuffle
        again = F.broadcast(again) if m <= REPEATED_BROADCAST else again
        once = own.join(again, same).groupBy("doc_id", "th").agg(F.min(F.struct(*COLUMNS)).alias("r"))
        out = out.unionByName(once.select("r.*"))
    return out


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix takes (0, 1 or 2), as rows.

    Rows are allotted one by one, whether their ids are null, repeated or not; documents without words go.  Texts are written once with their numbers and never shuffled.
    """
    taken = mixing.allocate(mixing.sized(docs.select(*COLUMNS)), draw="draw", keep=("text", "lang", "n_chars"))
    return taken.where("copies > 0").withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every document, with merge-dropout; copies that the mix made are told apart by numbers, so each is cut by its own draws.

    Rows of one id and text are the same, so it doesn't matter which one gets which number.  Null and empty texts have no ids; a null id is replaced by the text in the key.
    """
    same = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.lit(0))
    return piece_dropout.encode(docs.select("doc_id", "text", (F.row_number().over(same) - 1).alias("copy")), copy="copy")


STAGES = [("language_id", languages), ("quality_rules", quality), ("near_duplicates", near_duplicates), ("mixing", mix), ("sentencepiece", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each but the last written to the shared folder and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipe-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
