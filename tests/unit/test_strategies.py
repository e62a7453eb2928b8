import pytest
from pyspark.sql import functions as F

from quern.errors import InvalidRecord
from quern.functions import edits
from quern.functions.segment import tokens
from quern.operators import assign, audit, runner, samples, strategies
from quern.schema import LEVELS, SAMPLE, STRATEGIES

TEXTS = ["今天天气很好心情也不错，在第一句的末尾有人钓鱼。", "Some plain text, for the sake of testing every strategy here.", "", None, "!!! 123", "a", "第", "﻿abc ﻿def 😀ghi"]
FIELDS = "sample_id string, dataset_name string, text_a string, text_b string"


@pytest.fixture(scope="module")
def clean(spark):
    return spark.createDataFrame([(str(i), "d", t, u) for i, (t, u) in enumerate((t, u) for t in TEXTS for u in TEXTS[:4])], FIELDS)


@pytest.mark.parametrize("unit", ["han", "letter"])
@pytest.mark.parametrize("name", STRATEGIES)
def test_contract(clean, name, unit):
    """On both fields: operations name their field, are disjoint and in order, and give the texts; one field changes where the strategy says so."""
    df = strategies.perturb(clean, name, ["text_a", "text_b"], unit=unit)
    again = [edits.apply_ops(F.coalesce(f, F.lit("")), F.filter("ops", lambda o, i: o["field"] == "text_a") if f == "text_a" else F.filter("ops", lambda o, i: o["field"] == "text_b")).alias(f"again_{f}") for f in ("text_a", "text_b")]
    rows = df.select("*", *again, edits.violations(F.col("ops"), F.array(F.lit("text_a"), F.lit("text_b"))).alias("bad")).collect()
    assert len(rows) == 3 * clean.count() and any(r.ops for r in rows)
    for r in rows:
        assert r.bad == [] and r.change_count == len(r.ops) and r.status == ("APPLIED" if r.ops else "NOT_APPLIED") and (r.failure_reason is None) == bool(r.ops)
        if not r.ops:
            assert r.corrupted is None
            continue
        for f in ("text_a", "text_b"):
            own, t = [o for o in r.ops if o.field == f], r[f] or ""
            assert all(t[o.start : o.end] == o.original for o in own) and all(a.end <= b.start for a, b in zip(own, own[1:]))
            assert r.corrupted[f] == (r[f"again_{f}"] if own else r[f])
        changed = {o.field for o in r.ops}
        if name in strategies.ONE_AT_LOW and r.level == "low":
            assert len(changed) == 1 and len(r.ops) == 1
    same = strategies.perturb(clean.repartition(5), name, ["text_a", "text_b"], unit=unit).select("sample_id", "level", "corrupted")
    assert sorted(map(str, same.collect())) == sorted(map(str, df.select("sample_id", "level", "corrupted").collect()))


def test_a_column_of_strategies_does_what_each_does(clean):
    one = clean.drop("text_b")
    every = {(r.strategy, r.sample_id, r.level): (r.corrupted, r.ops) for r in runner.run_every(one).collect()}
    each = {(n, r.sample_id, r.level): (r.corrupted, r.ops) for n in STRATEGIES for r in strategies.perturb(one, n).collect()}
    assert every == each


def test_repeats_touch_both_fields_above_low_and_pick_by_seed(spark):
    df = spark.createDataFrame([(str(i), "d", "一些文字在这里", "另外一些文字") for i in range(60)], FIELDS)
    for name in ("red_char", "red_word"):
        rows = strategies.perturb(df, name, ["text_a", "text_b"], unit="han").collect()
        low = [{o.field for o in r.ops} for r in rows if r.level == "low"]
        assert {frozenset(x) for x in low} == {frozenset(["text_a"]), frozenset(["text_b"])}
        assert all({o.field for o in r.ops} == {"text_a", "text_b"} for r in rows if r.level != "low")
        assert {r.change_count for r in rows if r.level == "medium"} == {2} and {r.change_count for r in rows if r.level == "high"} == {4}
    assert all(o.metadata == {"repeat_count": "1"} for r in strategies.perturb(df, "red_char", unit="han").collect() for o in r.ops)


def test_words_of_han_texts(spark):
    cut = {"今天天气很好心情也不错": ["今天", "天气", "很好", "心情", "也", "不错"], "我们在北京 see you": ["我们", "在", "北京", " ", "see", " ", "you"], "": []}
    df = spark.createDataFrame([(k,) for k in cut], "t string")
    assert {r.t: [w for w in r.w if w] for r in df.select("t", tokens(F.col("t")).alias("w")).collect()} == cut
    text = "今天天气很好心情也不错"
    rows = strategies.perturb(spark.createDataFrame([(str(i), "d", text, None) for i in range(30)], FIELDS), "red_word", unit="han").collect()
    assert {o.original for r in rows for o in r.ops} == {"今天", "天气", "很好", "心情", "也", "不错"}
    assert all(r.corrupted.replace(r.ops[0].original * 2, r.ops[0].original, 1) == text for r in rows if r.change_count == 1)


def test_swaps_reach_every_pair(spark):
    df = spark.createDataFrame([(str(i), "d", " abcd", None) for i in range(80)] + [("x", "d", " ab", None)], FIELDS)
    rows = strategies.perturb(df, "swap").collect()
    assert {o.start for r in rows for o in r.ops if r.sample_id != "x"} == {1, 2, 3}
    assert {r.corrupted for r in rows if r.sample_id == "x"} == {" ba"}
    rate = df.limit(1).select(strategies.swap_rate(F.lit("low"), F.lit(1000)).alias("r"), strategies.swap_rate(F.lit("low"), F.lit(2)).alias("q")).first()
    assert (rate.r, rate.q) == (0.15, 5.0)


def test_look_alike_budget_of_a_short_pair(spark):
    df = spark.createDataFrame([("1", "d", "钓鱼怎么调漂", "钓鱼怎么调漂？")], FIELDS)
    r = {x.level: x for x in strategies.perturb(df, "vis", ["text_a", "text_b"], unit="han").collect()}
    assert [r[x].change_count for x in LEVELS] == [1, 2, 3] and len({c for c in strategies.STOP}) == 31


def test_illegal_targets_and_names(spark):
    df = spark.createDataFrame([("1", "d", "some words", "more words", "pair", ["text_b"]), ("2", "d", "some words", "more", "single_text", ["text_b"]), ("3", "d", "some", "x", "other", ["text_a"])], FIELDS + ", kind string, targets array<string>")
    rows = strategies.perturb(df, "del", ["text_a", "text_b"], targets="targets", kind="kind").collect()
    assert {(r.sample_id, r.status) for r in rows} == {("1", "APPLIED"), ("2", "INVALID"), ("3", "INVALID")}
    assert {o.field for r in rows for o in r.ops} == {"text_b"} and all(r.corrupted is None for r in rows if r.status == "INVALID")
    for bad in ({"strategy": "nothing"}, {"strategy": "del", "levels": ["extreme"]}):
        with pytest.raises(ValueError):
            strategies.perturb(df, **bad)
    counts = {(r.strategy, r.level): r for r in runner.status_counts(runner.run_every(df, ["text_a", "text_b"], targets="targets", kind="kind")).collect()}
    assert len(counts) == 21 and all((r.n, r.invalid) == (3, 2) for r in counts.values())


def sample_rows(spark):
    empty = {f.name: None for f in SAMPLE} | {"split": "test", "language": "zh", "label_projection_status": "not_applicable", "corruption_applied": False, "change_count": 0, "schema_version": "1", "dataset_version": "1"}
    payload = lambda kind, **x: {n: x.get(n) for n in ("payload_kind", "text_a", "text_b", "context", "question", "options")} | {"payload_kind": kind}
    rows = [
        empty | {"sample_id": "p", "dataset_name": "lcqmc", "benchmark_task_type": "question_matching", "clean_payload": payload("pair", text_a="今天天气很好", text_b="心情也不错"), "gold_label": "1", "target_fields": ["text_a", "text_b"]},
        empty | {"sample_id": "c", "dataset_name": "c3", "benchmark_task_type": "multiple_choice_mrc", "clean_payload": payload("mrc", context="我们在北京学习", question="在哪里？", options=["北京", "上海"]), "gold_label": "0", "gold_label_text": "北京", "target_fields": ["context"]},
        empty | {"sample_id": "s", "dataset_name": "asap", "benchmark_task_type": "sentiment_polarity", "clean_payload": payload("single_text", text_a="服务态度非常好"), "gold_label": "positive", "source_gold_label": "5", "target_fields": ["text_a"],
                 "label_projection_name": "asap_polarity", "label_projection_version": "1.0.0", "label_projection_status": "accepted"},
    ]
    return spark.createDataFrame([tuple(r[f.name] for f in SAMPLE) for r in rows], SAMPLE)


def test_whole_samples_stay_valid(spark):
    clean = sample_rows(spark)
    samples.assert_valid(clean)
    for name in STRATEGIES:
        out = runner.perturb_samples(clean, name).drop("status")
        assert out.columns == clean.columns
        bad = [(r.sample_id, r.violations) for r in samples.validate(out).collect() if r.violations]
        assert bad == [], (name, bad)
    rows = {(r.sample_id, r.corruption_level): r for r in runner.perturb_samples(clean, "red_char").collect()}
    assert len(rows) == 9 and {o.field for r in rows.values() for o in r.internal_change_trace.ops if r.sample_id == "c"} == {"context"}
    assert rows["c", "low"].corrupted_payload.question == "在哪里？" and "学" not in str(rows["c", "low"].public_redacted_trace)
    with pytest.raises(Exception, match="already perturbed"):
        runner.perturb_samples(runner.perturb_samples(clean, "del").drop("status"), "del").collect()


def test_spoilt_samples(spark):
    rows, p = sample_rows(spark), F.col("clean_payload")
    spoil = {
        "split_not_test": {"split": F.lit("train")}, "unknown_dataset": {"dataset_name": F.lit("x")}, "payload_kind_mismatch": {"clean_payload": p.withField("payload_kind", F.lit("other"))}, "no_target_field": {"target_fields": F.array().cast("array<string>")},
        "repeated_target_field": {"target_fields": F.concat("target_fields", "target_fields")}, "clean_state": {"change_count": F.lit(2).cast("long")}, "failure_state": {"corruption_name": F.lit("vis")}, "blank_id": {"sample_id": F.lit(" ")},
        "corrupted_kind_mismatch": {"corrupted_payload": p.withField("payload_kind", F.lit("other"))}, "success_state": {"corruption_name": F.lit("vis"), "corruption_applied": F.lit(True)}, "unknown_level": {"corruption_level": F.lit("extreme")},
    }
    for name, change in spoil.items():
        assert all(name in r.violations for r in samples.validate(rows.withColumns(change)).collect()), name
    one = {
        "label_outside_space": ("p", {"gold_label": F.lit("7")}), "choice_index_outside": ("c", {"gold_label": F.lit("2")}), "choice_text_mismatch": ("c", {"gold_label_text": F.lit("上海")}), "projection_star": ("s", {"source_gold_label": F.lit("3")}),
        "projection_polarity": ("s", {"gold_label": F.lit("negative")}), "projection_identity": ("s", {"label_projection_version": F.lit("2")}), "projection_without_need": ("p", {"label_projection_name": F.lit("x")}),
        "choice_question_changed": ("c", {"corrupted_payload": p.withField("question", F.lit("?"))}), "choice_options_changed": ("c", {"corrupted_payload": p.withField("options", F.array(F.lit("北京"), F.lit("x")))}), "choice_targets": ("c", {"target_fields": F.array(F.lit("question"))}),
    }
    for name, (who, change) in one.items():
        assert name in samples.validate(rows.where(F.col("sample_id") == who).withColumns(change)).first().violations, name
    done = runner.perturb_samples(rows, "del").drop("status")
    t = F.col("internal_change_trace")
    traces = {
        "trace_length": {"change_count": F.col("change_count") + 1}, "trace_foreign_field": {"internal_change_trace": t.withField("ops", F.transform(t["ops"], lambda o: o.withField("field", F.lit("question"))))}, "trace_identity": {"corruption_seed": F.lit(1).cast("long")},
        "public_trace_length": {"public_redacted_trace": F.col("public_redacted_trace").withField("ops", F.slice("public_redacted_trace.ops", 1, 0))}, "op_end_before_start": {"internal_change_trace": t.withField("ops", F.transform(t["ops"], lambda o: o.withField("end", F.lit(-1).cast("long"))))},
        "op_index_gap": {"internal_change_trace": t.withField("ops", F.transform(t["ops"], lambda o: o.withField("op_index", F.lit(9).cast("long"))))},
    }
    for name, change in traces.items():
        assert all(name in r.violations for r in samples.validate(done.withColumns(change)).collect()), name
    with pytest.raises(InvalidRecord):
        samples.assert_valid(rows.withColumn("split", F.lit("train")))


def test_eligibility_and_assignment(spark, monkeypatch):
    df = spark.createDataFrame([(str(i), "d", t) for i, t in enumerate(["word one", "!!!", ""] * 400)], "sample_id string, dataset_name string, t string").withColumn("eligible", assign.eligible(F.col("t")))
    got = assign.assign_balanced(df)
    n = {r.strategy: r["count"] for r in got.where("t = 'word one'").groupBy("strategy").count().collect()}
    assert len(n) == 7 and max(n.values()) - min(n.values()) <= 1
    assert {r.strategy for r in got.where("t = '!!!'").select("strategy").distinct().collect()} == {"add_noise"}
    assert {r.strategy for r in got.where("t = ''").select("strategy").distinct().collect()} == {None}
    monkeypatch.setattr(assign, "ROWS_A_TASK", 50)  # many buckets: the same result
    assert sorted(map(str, assign.assign_balanced(df).select("sample_id", "strategy").collect())) == sorted(map(str, got.select("sample_id", "strategy").collect()))
    few = {r.strategy: r["count"] for r in assign.assign_constrained(df).groupBy("strategy").count().collect()}
    # 400 rows only take noise, so the others share 400 rows among six
    assert few.pop(None) == 400 and few.pop("add_noise") == 400 and len(few) == 6 and max(few.values()) - min(few.values()) <= 1 and sum(few.values()) == 400


def test_shares_use_the_least_used(spark):
    got = assign.shares([(("a", "b"), 10), (("a",), 4), (("a", "b", "c"), 7), ((), 3)])
    assert got == {("a",): [4], ("a", "b"): [3, 7], ("a", "b", "c"): [0, 0, 7], (): []}


def test_fallback_takes_the_least_assigned(spark):
    rows = [("1", "d", "xq xq", "vis", ["vis", "swap", "del"]), ("2", "d", "xq", "swap", ["swap"]), ("3", "d", "qq", "swap", ["swap"]), ("4", "d", "lo", "vis", ["vis"])]
    df = spark.createDataFrame(rows, "sample_id string, dataset_name string, text_a string, strategy string, eligible array<string>")
    assert {r.sample_id: r.strategy for r in runner.with_fallback(df).collect()} == {"1": "del", "2": "swap", "3": None, "4": "vis"}


def test_audit(spark):
    fields = "dataset_name string, sample_id string, split string, language string, gold_label string, clean_payload string"
    clean = spark.createDataFrame([("d", "1", "test", "zh", "a", "abc"), ("d", "2", "test", "zh", "a", "abc"), ("d", "2", "train", "zh", "a", "abc")], fields)
    row = lambda i, st, x, pay="abd", path=None, gold="a", n=1: ("d", i, gold, "abc", path or st, x, st, x, pay, n > 0, n)
    rows = [row("1", "del", x) for x in LEVELS] + [row("1", "vis", "low", "abc"), row("2", "del", "low", "x ", gold="b"), row("2", "del", "low", path="vis", n=0), row("9", "del", "low")]
    df = spark.createDataFrame(rows, "dataset_name string, sample_id string, gold_label string, clean_payload string, path_name string, path_level string, corruption_name string, corruption_level string, corrupted_payload string, corruption_applied boolean, change_count int")
    expected = spark.createDataFrame([("d", 2), ("e", 1)], "dataset_name string, n long")
    got = sorted((r.dataset_name, str(r.sample_id), r.rule) for r in audit.audit_dataset(clean, df, expected, ["del", "vis"]).collect())
    want = [("d", "1", "nothing_changed"), ("d", "1", "repeated_level"), ("d", "1", "several_strategies"), ("d", "2", "clean_field_changed"), ("d", "2", "invalid_flags"), ("d", "2", "levels_missing"), ("d", "2", "line_separator"), ("d", "2", "path_mismatch"), ("d", "2", "repeated_level"), ("d", "9", "unknown_sample")]
    want += [("d", "None", r) for r in ("clean_count", "repeated_clean_id", "split_or_language", "missing_file/vis/medium", "missing_file/vis/high", "assignment_count", "strategies_missing")]
    want += [("e", "None", r) for r in ("clean_count", "perturbed_count", "assignment_count", "strategies_missing")] + [("e", "None", f"missing_file/{s}/{x}") for s in ("del", "vis") for x in LEVELS]
    assert got == sorted(want)


def test_uniform_choice_sorts_k_places_of_a_row(spark):
    import hashlib

    df = spark.createDataFrame([(1, 50), (2, 2), (3, 0), (4, 5), (4, 9)], "k long, n int")  # a key may come twice
    out = strategies.uniform_choice(df, "k", F.col("n"), 3, F.col("k"))
    best = lambda k, places: sorted(places, key=lambda p: (hashlib.sha256(f"{k}|{p}".encode()).hexdigest(), p))[:3]
    want = [(k, p) for k, places in ((1, range(50)), (2, range(2)), (4, [*range(5), *range(9)])) for p in best(k, places)]
    assert sorted(map(tuple, out.collect())) == sorted(want)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "slice(" in plan.split("Window")[-1]  # rows are cut to k places below the window


def test_many_edits_are_made_without_a_cut_for_each(spark):
    texts = ["", "é", "﻿a\0b 😀𠮷c" * 30, "z" * 300, " 12 "]
    df = spark.createDataFrame([(str(i), "d", t) for i, t in enumerate(texts)], "sample_id string, dataset_name string, text_a string")
    for name in ("homo", "del", "add_noise"):
        out = strategies.perturb(df, name)
        plan = out.select("corrupted")._jdf.queryExecution().optimizedPlan().toString()
        assert "edit_many" in plan and "UTF-32" not in plan  # a decode for each stretch between two edits before
        # the text is what its operations make of the clean one, which are drawn by columns
        rows = out.select("sample_id", "change_count", "corrupted", F.size("ops").alias("n"), edits.apply_ops(F.col("text_a"), F.col("ops")).alias("again"), "text_a").collect()
        assert all(r.n == r.change_count and r.again == (r.corrupted if r.n else r.text_a) for r in rows), name
        assert {r.sample_id for r in rows if r.n} >= {"2", "3"}


def test_texts_are_not_numbered(spark):
    df = spark.createDataFrame([(str(i), "d", "word " * i) for i in range(9)], "sample_id string, dataset_name string, text_a string")
    plan = runner.run_assigned(df)._jdf.queryExecution().optimizedPlan()
    nodes = [plan]
    while nodes:
        n = nodes.pop()
        assert n.nodeName() != "Window" or "text_a" not in n.output().mkString(",")
        nodes += [n.children().apply(i) for i in range(n.children().size())]
