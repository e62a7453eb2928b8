"""Identity recovery: which candidate a logged request was made from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import request_key


def recover(observed: DataFrame, candidates: DataFrame, model: str) -> DataFrame:
    """observed: record_id, sample_id, is_clean, corruption_name, corruption_level, messages_hash, request_key.  candidates: sample_uid, sample_id and the same bucket, seed, prompt version and limits.

    A candidate matches where its key, rebuilt with the observed messages hash, is the observed key.  The bucket and the sample id are the equi-join, the hash the
    residual condition.  Returns record_id, n_matches, sample_uid (the only match) and status.
    """
    c = candidates.select([F.col(x).alias(f"c_{x}") for x in candidates.columns])
    rebuilt = request_key(
        sample_uid=F.col("c_sample_uid"), is_clean=F.col("c_is_clean"), corruption_name=F.col("c_corruption_name"), corruption_level=F.col("c_corruption_level"), corruption_seed=F.col("c_seed"), model_uid=F.lit(model),
        prompt_template_version=F.col("c_prompt_version"), temperature=F.lit(0.0), max_new_tokens=F.col("c_max_new_tokens"), messages_hash=F.col("messages_hash"),
    )
    bucket = (F.col("sample_id") == F.col("c_sample_id")) & (F.col("is_clean") == F.col("c_is_clean")) & F.col("corruption_name").eqNullSafe(F.col("c_corruption_name")) & F.col("corruption_level").eqNullSafe(F.col("c_corruption_level"))
    hits = observed.join(c, bucket & (rebuilt == F.col("request_key"))).groupBy("record_id").agg(F.count("*").alias("n_matches"), F.min("c_sample_uid").alias("uid"))
    out = observed.select("record_id", "messages_hash").join(hits, "record_id", "left").withColumn("n_matches", F.coalesce("n_matches", F.lit(0)))
    status = F.when(F.col("messages_hash").isNull(), "no_messages").when(F.col("n_matches") == 0, "unmatched").when(F.col("n_matches") == 1, "recovered").otherwise("ambiguous")
    return out.select("record_id", "n_matches", F.when(F.col("n_matches") == 1, F.col("uid")).alias("sample_uid"), status.alias("status"))


def attempts(observed: DataFrame, candidates: DataFrame, bucket: list[str]) -> DataFrame:
    """How many (record, candidate) pairs a search without the id would try: the sum over buckets of records times candidates, from the counts of buckets alone."""
    n = observed.groupBy(*bucket).agg(F.count("*").alias("n"))
    m = candidates.groupBy(*[F.col(c).alias(f"m_{c}") for c in bucket]).agg(F.count("*").alias("m"))
    same = F.lit(True)
    for c in bucket:
        same = same & F.col(c).eqNullSafe(F.col(f"m_{c}"))
    return n.join(m, same).agg(F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0)).alias("attempts"))


def outcome_counts(recovered: DataFrame, by: list[str]) -> DataFrame:
    """Records by status for each dataset or bucket."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return recovered.groupBy(*by).agg(F.count("*").alias("records"), n("recovered"), n("unmatched"), n("ambiguous"), n("no_messages"))


def assigned_several(recovered: DataFrame) -> DataFrame:
    """``recovered`` with ``several``: whether its sample was recovered for other records too."""
    uid = F.col("sample_uid")
    n = recovered.where(uid.isNotNull()).groupBy(uid.alias("s_uid")).agg((F.count("*") > 1).alias("several"))
    return recovered.join(n, uid == F.col("s_uid"), "left").drop("s_uid").withColumn("several", F.coalesce("several", F.lit(False)))
