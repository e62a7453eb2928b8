import pytest
from pyspark.sql import functions as F

from quern.functions import compat, edits, keys, labels, text


def one(spark, column, value="x", type_="string"):
    return spark.createDataFrame([(value,)], f"v {type_}").select(column.alias("r")).first().r


def ops_of(*rows):
    lit = lambda k, a, b, o, r: edits.op(k, F.lit(a), F.lit(b), F.lit(o), F.lit(r))
    return F.array(*[lit(*r) for r in rows])


@pytest.mark.parametrize("clean, rows, want", [
    ("测试", [("replace", 0, 1, "测", "X"), ("replace", 1, 2, "试", "Y")], "XY"),
    ("第一句", [("replace", 0, 1, "第", "苐")], "苐一句"),
    ("第一句", [("duplicate", 0, 1, "第", "第")], "第第一句"),
    ("测试", [("insert", 1, 1, "", "α")], "测α试"),
    ("测试", [("delete", 0, 2, "测试", "")], ""),
    ("a😀b", [("replace", 1, 2, "😀", "😁😁"), ("insert", 3, 3, "", "!")], "a😁😁b!"),
])
def test_apply(spark, clean, rows, want):
    assert one(spark, edits.apply_ops(F.col("v"), ops_of(*rows)), clean) == want


def test_apply_takes_any_order(spark):
    rows = [("delete", 4, 5, "e", ""), ("replace", 0, 1, "a", "X"), ("duplicate", 2, 3, "c", "c"), ("insert", 3, 3, "", "+")]
    assert {one(spark, edits.apply_ops(F.col("v"), ops_of(*r)), "abcdef") for r in (rows, rows[::-1])} == {"Xbcc+df"}


def test_redaction_leaves_no_text(spark):
    o = F.array(edits.op("replace", F.lit(0), F.lit(1), F.lit("秘"), F.lit("密"), metadata=F.create_map(*map(F.lit, ("candidate_count", "3", "unicode_category", "Lo", "note", "秘")))))
    r = one(spark, F.to_json(edits.redact(o)))
    assert "秘" not in r and "密" not in r and '"candidate_count":"3"' in r and "note" not in r
    bad = F.array(edits.op("replace", F.lit(0), F.lit(1), F.lit("a"), F.lit("b"), metadata=F.create_map(F.lit("candidate_count"), F.lit("see 秘"))))
    with pytest.raises(Exception, match="unsafe metadata"):
        one(spark, F.to_json(edits.redact(bad)))


def test_text_classes(spark):
    assert one(spark, text.visible_length(F.col("v")), "  第一句  ") == 3
    assert one(spark, text.strip(F.col("v")), "　 a b \n") == "a b"
    assert one(spark, text.fold_width(F.col("v")), "Ａ１（　") == "A1( "
    assert one(spark, text.has_han(F.col("v")), "䷀") is False and one(spark, F.col("v").rlike(text.HAN_WIDE), "䷀") is True
    assert one(spark, text.has_line_separator(F.struct(F.array(F.col("v")))), "a ") is True
    assert one(spark, text.show_secret(F.col("v")), "sk-0123456789") == "sk-0...6789" and one(spark, text.show_secret(F.col("v")), "short") == "****"


PARSES = [
    ("pair_paraphrase", "1", "1", "success"), ("pair_paraphrase", "１", "1", "success"), ("nli", "ENTAILMENT", "entailment", "success"), ("multiple_choice_mrc", "B\n\n答案：", "B", "success"),
    ("multiple_choice_mrc", "D", None, "failure_invalid_label"), ("pair_paraphrase", "The answer is 1", None, "failure_multiple_tokens"), ("pair_paraphrase", "", None, "failure_empty"), ("pair_paraphrase", "1.", None, "failure_punctuation"),
    ("multiple_choice_mrc", "B.", None, "failure_prefix"), ("nli", "Neutral </s>", "neutral", "success"), ("nli", "neutral <|eot_id|>", "neutral", "success"), ("sentiment_rating", "5 <s", "5", "success"), ("sentiment_rating", "6", None, "failure_invalid_label"),
    ("multiple_choice_mrc", "b", None, "failure_invalid_label"), ("sentiment_polarity", "positive!", None, "failure_punctuation"), (None, "1", None, "failure_no_task"), ("pair_paraphrase", None, None, "failure_empty"),
]


def test_parses(spark):
    df = spark.createDataFrame([(i, t, r) for i, (t, r, _, _) in enumerate(PARSES)], "i int, task string, raw string")
    got = {x.i: tuple(x.p) for x in df.select("i", labels.parse_label(F.col("raw"), F.col("task"), F.lit("ABC")).alias("p")).collect()}
    assert got == {i: (label, status) for i, (_, _, label, status) in enumerate(PARSES)}


def test_keys_are_those_of_canonical_json(spark):
    import hashlib
    import json

    m = [{"role": "user", "content": "问\n\"1\""}]
    got = one(spark, keys.messages_hash(F.array(F.struct(F.lit("user").alias("role"), F.col("v").alias("content")))), "问\n\"1\"")
    assert got == hashlib.sha256(json.dumps(m, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
    parts = {"sample_uid": "a___test___1", "is_clean": True, "model_uid": "m", "prompt_template_version": "v2", "temperature": 0.0, "max_new_tokens": 4, "messages_hash": "h", "schema_version": 1}
    want = hashlib.sha256(json.dumps(parts, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    lits = {k: F.lit(v) for k, v in parts.items()} | {"corruption_name": F.lit(None).cast("string")}
    assert one(spark, keys.request_key(**lits)) == want
    changed = {one(spark, keys.request_key(**lits | {k: F.lit("other")})) for k in ("sample_uid", "model_uid", "messages_hash", "corruption_name")}
    assert len(changed | {want}) == 5


def test_drawn_ranks(spark):
    df = spark.range(300).selectExpr("id as seed", "cast(id % 37 as int) as n", "least(cast(id % 5 as int), cast(id % 37 as int)) as k")
    for r in df.withColumn("r", keys.strata(F.col("seed"), F.col("n"), F.col("k"))).collect():
        assert len(r.r) == r.k and sorted(set(r.r)) == r.r and all(0 <= x < r.n for x in r.r)
    # every place of a stratum comes up, about equally often
    seeds = spark.range(4000).select(keys.row_seed(F.lit(1), F.lit("d"), F.col("id").cast("string"), F.lit("x"), F.lit("low")).alias("seed"))
    n = [r["count"] for r in seeds.select(F.explode(keys.strata(F.col("seed"), F.lit(20), F.lit(2))).alias("r")).groupBy("r").count().collect()]
    assert len(n) == 20 and 300 < min(n) and max(n) < 500


def test_labels_without_parse(spark):
    assert one(spark, labels.legacy_normalize(F.col("v")), "  Positive\n") == "positive"
    assert one(spark, labels.raw_label(F.col("v")), " A. \n") == "A." and one(spark, labels.raw_label(F.col("v")), " \t") is None


def test_compat(spark):
    df = spark.createDataFrame([("中文文本", "中文A👫1，【文】·「本」"), ("abcd", "badc"), ("abc", "ac"), (None, "x"), ("abc", "cba"), ("aab", "aba"), ("", "")], "a string, b string")
    r = df.select(compat.clean_noise(F.col("a"), compat.diff_ops("a", "b")).alias("clean"), compat.local_swaps(F.col("a"), F.col("b")).alias("swaps"), compat.diff_ops("a", "b").alias("ops"), compat.nfkc("b").alias("folded")).collect()
    assert r[0].clean == "中文A1，【文】·「本」" and r[2].clean is None and r[3].clean is None
    assert [x.swaps for x in r] == [None, 2, None, None, None, 1, 0]
    assert [tuple(o) for o in r[2].ops] == [("delete", 1, 2, "b", "")]
    assert one(spark, compat.nfkc(F.col("v")), " Ａﬁ ") == "Afi"
    assert one(spark, compat.seeded_choice(F.lit(7), F.lit(20), F.lit(3))) == one(spark, compat.seeded_choice(F.lit(7), F.lit(20), F.lit(3)))


def chosen(spark, text, candidates, **how):
    return compat.choose_candidate(spark.createDataFrame([(text, candidates)], "t string, c array<string>"), "t", "c", **how).first().chosen


def test_best_candidate(spark):
    a = "abcdefghijklmnopqrst"
    assert chosen(spark, a, [a, None, "Xbcdefghijklmnopqrst", "XYcdefghijklmnopqrst"], target_units=2, most_share=0.5) == "XYcdefghijklmnopqrst"
    assert chosen(spark, a, ["X" * 20], target_units=2, most_share=0.1) is None and chosen(spark, a, ["XYZ" + a[3:]], most_units=2) is None and chosen(spark, None, ["a"]) is None
    # units and swaps have targets of their own: one swap is two edited units
    assert chosen(spark, "abcd", ["badc", "bacd", "dcba"], target_units=2, target_swaps=1, swaps=True) == "bacd"
    assert chosen(spark, "abcd", ["badc", "dcba"], swaps=True, most_swaps=1) is None
    assert chosen(spark, "中文文本", ["中文", "中文A👫文本"], target_units=1, most_share=1.0, noise=True) == "中文A文本"
    make = lambda text, rate, seed: [text + "!" * seed, None, text]
    df = spark.createDataFrame([("ab",), (None,)], "t string").withColumn("c", compat.candidates_of(make, F.col("t"), F.lit(0.1), F.lit(2)))
    assert [r.chosen for r in compat.choose_candidate(df, "t", "c").collect()] == ["ab!!", None]


def test_candidates_are_ranked_once_by_rows_on_all_cores(spark, tmp_path):
    import __spark_entry__ as entry

    spark.range(40).selectExpr("id AS c_custkey", "concat('Customer#', id) AS c_name").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    out = entry.queries()["o1_candidate_top1"](spark, str(tmp_path))
    assert out.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism  # one small file is one split
    # each of the three choices once, not once for every use of what is chosen
    assert out._jdf.queryExecution().optimizedPlan().toString().count("array_min(") == 3


def test_local_swaps_equal_a_plain_loop(spark):
    import itertools

    def plain(a, b):
        n = i = 0
        while i < len(a):
            if a[i] != b[i]:
                if a[i : i + 2] != b[i : i + 2][::-1] or i + 1 == len(a):
                    return None
                n, i = n + 1, i + 1
            i += 1
        return n

    words = ["".join(w) for w in itertools.product("ab😀", repeat=4)]
    rows = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string").select("a", "b", compat.local_swaps(F.col("a"), F.col("b")).alias("n")).collect()
    assert all(r.n == plain(r.a, r.b) for r in rows)
