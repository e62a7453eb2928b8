import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.errors import AnswerUnreadable, CallTimeout, DuplicateKey, GateFailed, InvalidRecord, MissingField
from quern.operators import audit, endpoints, metrics, prompts
from quern.schema import RECORD, SAMPLE
from quern.sources import readers, sinks
from quern.streaming import request_log

KEYED = T.StructType([T.StructField(n, T.StringType()) for n in ("sample_id", "dataset_name", "gold_label")])


def lines(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join((r if isinstance(r, str) else json.dumps(r, ensure_ascii=False)) + "\n" for r in rows), encoding="utf-8")
    return str(path)


def test_jsonl_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1", "中 文", None)], KEYED)
    sinks.write_jsonl(df, str(tmp_path / "o"))
    assert readers.read_jsonl(spark, str(tmp_path / "o"), KEYED).collect() == df.collect()
    raw = spark.read.text(str(tmp_path / "o")).first().value
    assert "中" in raw and "gold_label" not in raw and SAMPLE["clean_payload"].dataType["options"].dataType.simpleString() == "array<string>"


def test_strict_and_lenient_lines(spark, tmp_path):
    good = {"sample_id": "1", "dataset_name": "d", "gold_label": "0"}
    with pytest.raises(InvalidRecord):
        readers.read_jsonl(spark, lines(tmp_path / "a.jsonl", [good, "", good]), KEYED)
    bad = lines(tmp_path / "b.jsonl", [good, "{broken"])
    with pytest.raises(Exception):
        readers.read_jsonl(spark, bad, KEYED).collect()
    assert readers.read_jsonl(spark, bad, KEYED, strict=False).count() == 1
    with pytest.raises(DuplicateKey):
        readers.read_keyed(spark, lines(tmp_path / "c.jsonl", [good, good]), KEYED, ["dataset_name", "sample_id"])
    with pytest.raises(InvalidRecord):
        readers.read_rows(spark, bad, KEYED, expected=7)
    for k, line in enumerate(("\t", " \u3000 ", {"dataset_name": "d"}, {"sample_id": "", "dataset_name": "d"}, "{broken")):
        path = lines(tmp_path / f"strict{k}" / "x.jsonl", [good, line])
        with pytest.raises(InvalidRecord):
            readers.read_jsonl(spark, path, KEYED)
        with pytest.raises(InvalidRecord):
            readers.read_keyed(spark, path, KEYED, ["sample_id"])
    assert readers.read_rows(spark, lines(tmp_path / "rows.jsonl", [good]), KEYED, expected=1).count() == 1
    named = readers.read_keyed(spark, str(tmp_path / "rows.jsonl"), KEYED, ["sample_id"], "vis", "low").first()
    assert (named.corruption_name, named.corruption_level) == ("vis", "low")


def test_layouts(spark, tmp_path):
    row = lambda i: {"sample_id": str(i), "dataset_name": "d", "gold_label": "0"}
    clean = lines(tmp_path / "clean/all_clean.jsonl", [row(i) for i in range(4)])
    lines(tmp_path / "p/red_char/low.jsonl", [row(i) for i in range(4)])
    lines(tmp_path / "p/d/vis/high.jsonl", [row(i) for i in range(2)])
    df = readers.read_layout(spark, clean, str(tmp_path / "p"), KEYED)
    assert {(r.corruption_name, r.corruption_level): r["count"] for r in df.groupBy("corruption_name", "corruption_level").count().collect()} == {(None, None): 4, ("red_char", "low"): 4, ("vis", "high"): 2}
    assert tuple(readers.layout_counts(df).first()) == (4, 6, 10)
    lines(tmp_path / "clean/x_clean.jsonl", [row(i) for i in range(9)])  # all_clean.jsonl goes first
    assert readers.read_layout(spark, str(tmp_path / "clean"), str(tmp_path / "p"), KEYED).where("corruption_name is null").count() == 4
    for n in ("a", "b"):
        lines(tmp_path / f"each/{n}_clean.jsonl", [row(n)])
    assert readers.read_layout(spark, str(tmp_path / "each"), str(tmp_path / "p"), KEYED).where("corruption_name is null").count() == 2
    lines(tmp_path / "p/e/cr/low.jsonl", [row(3)])  # the old name of a strategy, and a sample that is there already
    with pytest.raises(DuplicateKey):
        readers.read_layout(spark, clean, str(tmp_path / "p"), KEYED)
    lines(tmp_path / "q/mystery/low.jsonl", [row(3)])
    with pytest.raises(Exception, match="unknown in a path"):
        readers.read_layout(spark, clean, str(tmp_path / "q"), KEYED).collect()
    with pytest.raises(InvalidRecord):
        readers.clean_files(spark, str(tmp_path / "p"))


def test_log_and_catalog(spark, tmp_path):
    rec = {"request_key": "k", "sample_id": "1", "dataset_name": "d", "raw_response": "1"}
    lines(tmp_path / "log/r1_clean.jsonl", [rec])
    lines(tmp_path / "log/r1_red_word_high.jsonl", [rec, rec | {"request_key": None}])
    df = readers.read_log(spark, str(tmp_path / "log"), "r1")
    assert sorted((str(r.corruption_name), str(r.corruption_level)) for r in df.collect()) == [("None", "None"), ("red_word", "high"), ("red_word", "high")]
    lines(tmp_path / "other/r1_mystery_low.jsonl", [rec])
    with pytest.raises(Exception, match="unknown log file"):
        readers.read_log(spark, str(tmp_path / "other"), "r1").collect()
    for name, n in (("a", 3), ("b", 4000)):  # the larger file is dealt to a task first
        lines(tmp_path / f"two/{name}_clean.jsonl", [rec | {"raw_response": f"{name}{i}", "sample_id": str(i % 2)} for i in range(n)])
    two = readers.read_log(spark, str(tmp_path / "two"))
    assert {(r.sample_id, r.raw_response) for r in metrics.first_records(two).collect()} == {("0", "a0"), ("1", "a1")}
    keys, legacy = readers.read_request_keys(spark, str(tmp_path / "log"))
    assert [r[0] for r in keys.collect()] == ["k"] and [r[0] for r in legacy.collect()] == ["1"]
    with pytest.raises(Exception):
        readers.read_log(spark, lines(tmp_path / "x/clean.jsonl", [{"raw_response": "1"}])).collect()
    for name, body in {"a_manifest.json": '{"run_id": "real", "dry_run": false}', "b_manifest.json": '{"run_id": "", "dry_run": true}', "c.json": "{no"}.items():
        lines(tmp_path / "runs" / name, [body])
    cat = readers.read_run_catalog(spark, str(tmp_path / "runs"))
    assert [r.name for r in readers.read_run_catalog(spark, str(tmp_path / "runs"), bad=True).collect()] == ["c.json"]
    assert sorted(r.run_id for r in cat.collect()) == ["b", "real"] and readers.only_real_run(cat) == "real"
    with pytest.raises(InvalidRecord):
        readers.only_real_run(cat, "zzz")


def test_tables_and_nested_files(spark, tmp_path):
    t = lines(tmp_path / "x.tsv", ["language\tsentence1", "zh\t一", "en\ta"])
    assert [r.sentence1 for r in readers.read_tsv(spark, t, T.StructType([T.StructField("language", T.StringType()), T.StructField("sentence1", T.StringType())])).collect()] == ["一"]
    c = lines(tmp_path / "x.csv", ["﻿id,review,star", '1,"好, ""很好""\n的",5.0'])
    r = readers.read_csv(spark, c, T.StructType([T.StructField(n, T.StringType()) for n in ("id", "review", "star")])).collect()
    assert [tuple(x) for x in r] == [("1", '好, "很好"\n的', "5.0")]
    nested = lines(tmp_path / "m.json", [json.dumps([[["一 ", "二"], [{"question": "q", "choice": ["甲", "乙"], "answer": "乙"}, {"question": "r", "choice": ["a"], "answer": "a"}], "doc7"]])])
    got = readers.read_nested_choices(spark, nested, "m").collect()
    assert [(x.sample_id, x.context, x.answer) for x in got] == [("c3-m-test-doc7-0", "一\n二", "乙"), ("c3-m-test-doc7-1", "一\n二", "a")]
    spark.createDataFrame([("a", "b", 1.0)], "question1 string, question2 string, score double").write.parquet(str(tmp_path / "p"))
    assert [tuple(x) for x in readers.read_pairs_parquet(spark, str(tmp_path / "p")).collect()] == [("lcqmc-test-00000", "a", "b", 1)]
    for k in range(4):
        spark.createDataFrame([(f"{k}-{i}", "b", 1.0) for i in range(50)], "question1 string, question2 string, score double").coalesce(1).write.parquet(str(tmp_path / f"many/{k}"))
    got = readers.read_pairs_parquet(spark, str(tmp_path / "many/*")).collect()
    assert {(r.id, r.sentence1) for r in got} == {(f"lcqmc-test-{50 * k + i:05d}", f"{k}-{i}") for k in range(4) for i in range(50)}
    big = spark.createDataFrame([("f", 99_999), ("f", 100_000)], "f string, r long")
    assert sorted(r.id for r in readers.positional_ids(big, "f", "r").collect()) == ["lcqmc-test-100000", "lcqmc-test-99999"]
    t = lines(tmp_path / "y.tsv", ["language\tsentence1", 'zh\t"一\t二\n三"'])
    assert [r.sentence1 for r in readers.read_tsv(spark, t, T.StructType([T.StructField("language", T.StringType()), T.StructField("sentence1", T.StringType())])).collect()] == ["一\t二\n三"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("d", "vis", "low", i) for i in range(5)] + [("d", "del", "high", 9)], "dataset_name string, corruption_name string, corruption_level string, n long")
    sinks.write_partitioned(df, str(tmp_path / "p"), files_per_bucket=2)
    assert spark.read.parquet(str(tmp_path / "p")).where("corruption_name = 'vis'").count() == 5
    m = json.loads(sinks.manifest(df, "corruption_name", seed="42").first().manifest)
    assert m == {"total": 6, "counts": {"del": 1, "vis": 5}, "seed": "42"}
    with pytest.raises(MissingField):
        sinks.write_sidecar(df, str(tmp_path / "s"), "run-1")
    optional = tuple(c for c in sinks.SIDECAR if c != "sample_id")
    sinks.write_sidecar(df.withColumn("sample_id", F.lit("1")), str(tmp_path / "s"), "run-1", optional)
    assert spark.read.json(str(tmp_path / "s")).first().run_id == "run-1"
    files = spark.createDataFrame([("a.json", 5, "00")], "file_name string, file_size long, sha256 string")
    known = dict.fromkeys(("dataset", "canonical_source_url", "resolved_url", "official_split", "license_access_note", "code_commit"), "x")
    p = sinks.provenance(df, files, ["n"], 7, **known).first()
    assert p.asDict().keys() == set(sinks.PROVENANCE) and (p.observed_row_count, p.expected_row_count, p.file_name, p.dataset) == (6, 7, "a.json", "x") and p.retrieved_at.endswith("+00:00")
    with pytest.raises(MissingField):
        sinks.provenance(df, files, ["n"], dataset="x")
    (tmp_path / "f").mkdir()
    (tmp_path / "f/a.bin").write_bytes(b"abc")
    good = "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    assert [r.ok for r in readers.verify_files(spark, str(tmp_path / "f"), {"a.bin": good}).collect()] == [True]
    assert [r.ok for r in readers.verify_files(spark, str(tmp_path / "f"), {}).collect()] == [False]


def test_resume_and_stream(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{i:02d}:00", f"k{i % 4}", i == 1) for i in range(12)]
    log = spark.createDataFrame(rows, "event_id long, t string, request_key string, is_error boolean").withColumn("ts", F.col("t").cast("timestamp")).drop("t")
    ask = spark.createDataFrame([("k1",), ("k9",)], "request_key string")
    first = log.where("event_id < 4")
    assert {r[0] for r in request_log.pending(ask, first).collect()} == {"k1", "k9"} and {r[0] for r in request_log.pending(ask, first, retry_errors=False).collect()} == {"k9"}
    batch = {(r.request_key, r.event_id) for r in request_log.first_per_key(log).collect()}
    log.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = request_log.ingest(spark.readStream.schema(log.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {(r.request_key, r.event_id) for r in got} == batch and len(got) == 4
    w = request_log.windowed_errors(spark.readStream.schema(log.schema).parquet(str(tmp_path / "in")))
    s = w.writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    s.awaitTermination()
    assert [(r.n, r.errors) for r in spark.table("windows").collect()] == [(12, 1)]


def test_endpoints(spark):
    df = spark.createDataFrame([("a", [("user", "hi")]), ("b", [("user", "fail")])], "request_key string, messages array<struct<role: string, content: string>>")

    def client(messages):
        if messages[0]["content"] == "fail":
            raise TimeoutError
        return "1"

    r = {x.request_key: x for x in endpoints.call_model(df, client, retries=2, wait=0).collect()}
    assert (r["a"].raw_response, r["a"].error) == ("1", None) and (r["b"].raw_response, r["b"].error, r["b"].attempts) == ("", "TimeoutError", 3)

    def typed(messages):
        raise CallTimeout if messages[0]["content"] == "fail" else AnswerUnreadable

    r = {x.request_key: (x.error, x.attempts) for x in endpoints.call_model(df, typed, retries=2, wait=0).collect()}
    assert r == {"a": ("AnswerUnreadable", 1), "b": ("CallTimeout", 3)}
    known = spark.createDataFrame([("a", "0")], "request_key string, response string")
    assert {x.request_key: x.response for x in endpoints.mock_model(df, known).collect()} == {"a": "0", "b": endpoints.UNKNOWN}


def test_metrics_by_hand(spark):
    s = spark.createDataFrame(
        [("d", "1", None, None, "1"), ("d", "2", None, None, "0"), ("d", "3", None, None, "1")] + [("d", i, "vis", "low", g) for i, g in (("1", "1"), ("2", "0"), ("3", "1"))],
        "dataset_name string, sample_id string, corruption_name string, corruption_level string, gold_label string",
    ).withColumns({"task": F.lit("pair_paraphrase"), "n_options": F.lit(0), "corruption_applied": F.lit(True)})
    r = spark.createDataFrame([("d", "1", None, None, 0, "1"), ("d", "1", None, None, 1, "0"), ("d", "2", None, None, 0, "0"), ("d", "1", "vis", "low", 0, "1"), ("d", "2", "vis", "low", 0, "yes")], RECORD_KEY)
    facts = metrics.facts(metrics.outcomes(s, r))
    c = metrics.clean_metrics(facts).first()
    assert (c.total, c.correct, c.parse_fail) == (3, 2, 1)
    b = metrics.bucket_metrics(facts).first()
    assert (b.eligible, b.responses, b.api_errors, b.parse_failures, b.correct, b.crr_num, b.crr_den, b.crr) == (3, 2, 1, 1, 1, 1, 2, 0.5)
    st = metrics.strategy_metrics(facts)
    assert st.first().macro_crr_pct == 50 and abs(st.first().drop_pct - (200 / 3 - 50)) < 1e-9
    assert "vis" in metrics.markdown(metrics.clean_metrics(facts), st) and metrics.rollup(facts).count() == 4
    assert tuple(metrics.record_counts(r).first()) == (3, 2)


RECORD_KEY = "dataset_name string, sample_id string, corruption_name string, corruption_level string, seq int, raw_response string"


def test_gates_and_prompts(spark):
    df = spark.createDataFrame([(1,)], "x int")
    assert [r.ok for r in audit.gate(df, {"n": (F.count("*"), 1), "m": (F.count("*"), 2)}).collect()] == [True, False]
    audit.assert_empty(df.where("x > 1"), "nothing")
    with pytest.raises(GateFailed):
        audit.assert_empty(df, "rows")
    text = df.select(prompts.user_prompt(F.lit("multiple_choice_mrc"), {"context": F.lit("c"), "question": F.lit("q"), "options": F.array(F.lit("甲"), F.lit("乙"))}).alias("p")).first().p
    assert "A. 甲\nB. 乙" in text and "允许输出：A B" in text
    with pytest.raises(Exception):
        df.select(prompts.version_of(F.lit("no such task"))).collect()
    assert RECORD["messages"].dataType.elementType.names == ["role", "content"]
