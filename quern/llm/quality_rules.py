"""Quality rules as a bitmask ledger, with DataFrame operations only.

``ledger`` measures every text once and stores the measurements and one failure bit for each
rule.  Policies are versioned sets of bits and are applied to the stored bits; ``ablation``
tells, from bitwise aggregates of the ledger alone, what each rule of a policy rejects by itself.

Everything is computed within its row (no shuffle): word windows are 64-bit hashes, their
repeats are found by sorting one array of (hash, place) per text that has any repeat at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, spaced_words, table, text_or_empty

WINDOW = 5
#: (name, fails where); the place in the list is the bit and never changes, new rules go to the end.
RULES = [
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "100 * n_symbols > 30 * n_words"),
    ("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("long_words", "word_chars > 20 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("exclamations", "100 * n_exclaims > 50 * n_words"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
#: Version -> bits that reject.
POLICIES = {"base-1": BIT["few_words"] | BIT["repeated_windows"], "full-1": sum(BIT.values())}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_exclaims"]


def _windows(words: Column) -> Column:
    """64-bit hashes of all word windows, in order (none for fewer words than a window has)."""
    n = F.size(words)
    at = F.when(n >= WINDOW, F.sequence(F.lit(0), F.greatest(n - WINDOW, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))


def _covered(windows: Column) -> Column:
    """Words within windows that occur twice or more.

    (hash, start) pairs are sorted, so that equal windows stand side by side however many there are; the sorted starts of repeated windows then cover
    min(distance, WINDOW) words each.
    """

    def starts(s: Column) -> Column:
        same = lambda i, j: F.coalesce(F.get(s, i)["h"] == F.get(s, j)["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: same(i, i - 1) | same(i, i + 1)), lambda i: F.get(s, i)["i"]))

    def total(p: Column) -> Column:
        step = F.transform(p, lambda x, i: F.least(F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x)

    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return let(let(pairs, starts), total)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns of ``MEASURES`` (all long); null text counts as empty, all measures 0."""
    own = docs.columns
    t = F.col("__t")
    df = docs.withColumn("__t", text_or_empty(text))
    lines = F.filter(F.split("__t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.select(*own, spaced_words(t).alias("__w"), lines.alias("__l"), F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"), F.regexp_count(t, F.lit("!")).cast("long").alias("n_exclaims"))
    df = df.select(
        *own, "n_symbols", "n_exclaims", F.size("__w").cast("long").alias("n_words"), F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.size("__l").cast("long").alias("n_lines"), (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"), _windows(F.col("__w")).alias("__g"),
    )
    repeated = F.size(F.array_distinct("__g")) < F.size("__g")
    return df.withColumn("n_repeat_words", F.when(repeated, _covered(F.col("__g"))).otherwise(0).cast("long")).select(*own, *MEASURES)


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with its measurements and ``fail_bits``, each rule evaluated once.

    Columns of ``docs`` that have the name of a measurement are replaced.  Null or empty text fails ``few_words`` only.
    """
    docs = docs.drop(*[c for c in docs.columns if c in {*MEASURES, "fail_bits"}])
    bits = [F.when(F.expr(cond), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, (_, cond) in enumerate(RULES)]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    # never true, but not foldable: a filter on the ledger stays above it, else the optimizer would copy all measuring into the filter
    barrier = F.when(F.spark_partition_id() < 0, F.lit(1)).otherwise(F.lit(0)).cast("long")
    return measure(docs, text).withColumn("fail_bits", total.bitwiseOR(barrier))


def rejected(policy: str) -> Column:
    """Whether the policy of this version rejects a row of a ledger."""
    return F.col("fail_bits").bitwiseAND(F.lit(POLICIES[policy])) != 0


def ablation(entries: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: rows that fail it, rows that only it rejects, rows kept with and without it.

    Rows are first counted by bit pattern (at most 2 to the number of rules), so the shuffle carries patterns.  An empty ledger gives zeros.
    """
    patterns = entries.groupBy(F.col("fail_bits").bitwiseAND(F.lit(POLICIES[policy])).alias("bits")).agg(F.count("*").alias("n"))
    n = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).alias
    own = [(name, bit) for name, bit in BIT.items() if bit & POLICIES[policy]]
    rows = F.array(*[
        F.struct(F.lit(name).alias("rule"), F.col(f"f_{name}").alias("n_fail"), F.col(f"o_{name}").alias("n_only"), F.col("kept").alias("n_kept"), (F.col("kept") + F.col(f"o_{name}")).alias("n_kept_without"))
        for name, _ in own
    ])
    sums = [n(F.col("bits").bitwiseAND(F.lit(bit)) != 0)(f"f_{name}") for name, bit in own] + [n(F.col("bits") == bit)(f"o_{name}") for name, bit in own]
    return patterns.agg(n(F.col("bits") == 0)("kept"), *sums).select(F.inline(rows))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ledger(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", rejected("base-1").alias("base_failed"), (~rejected("full-1")).alias("kept"), "fail_bits"
    )


def oracle() -> str:
    bits = " + ".join(f"(CASE WHEN {cond} THEN {1 << i} ELSE 0 END)" for i, (_, cond) in enumerate(RULES))
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
g AS (SELECT rid, unnest(range(1, greatest(len(w) - {WINDOW - 2}, 1))) AS pos, w FROM w),
c AS (SELECT rid, pos, count(*) OVER (PARTITION BY rid, w[pos], w[pos + 1], w[pos + 2], w[pos + 3], w[pos + 4]) AS n FROM g),
r AS (SELECT rid, count(DISTINCT pos + k) AS n_repeat_words FROM c, range({WINDOW}) AS x(k) WHERE n > 1 GROUP BY rid),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines, length(regexp_replace(t, '[^!]', '', 'g'))::BIGINT AS n_exclaims
      FROM w LEFT JOIN r USING (rid)),
b AS (SELECT *, ({bits})::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & {POLICIES["base-1"]}) <> 0 AS base_failed, (fail_bits & {POLICIES["full-1"]}) = 0 AS kept, fail_bits FROM b"""
