"""Extra columns with the names that operators use inside or return."""

from pyspark.sql import functions as F

from quern.llm import language_id, licenses, media, mixing, near_dedup, piece_dropout, quality_rules, rule_ensemble, token_files, urls
from quern.llm.common import materialize, shared_path

NAMES = ["id", "rid", "score", "size", "media", "digest", "key", "rep", "comp", "component_id", "kept", "host", "path", "rule", "verdict", "lang_pred", "ids", "variant", "n_words", "fail_bits", "predicted", "Labels", "target", "copies", "start", "cell", "rank", "a", "b"]


def test_every_operator(spark, docs):
    df = docs([(1, "some plain words of a text, under the MIT license", "en", "a"), (2, "einige Worte in einem kurzen Text", "de", "b")] * 2)
    more = df.withColumns({n: F.lit("clash") for n in NAMES})
    table = materialize(mixing.sized(more), "clash")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int").withColumns({n: F.lit("clash") for n in ("score", "text", "id")})
    pages = more.select("*", F.lit("http://www.example.com/en/").alias("url"), F.col("doc_id").alias("page_id"))
    net, path = language_id.fit(more), shared_path(spark, "clash")
    token_files.write_token_files(more, path)
    got = {
        "licenses": licenses.license_report(more), "media": media.stored_features(media.encode_wav(more)), "urls": urls.judge(pages, urls.rules_table(spark, urls.RULES)), "near": near_dedup.near_duplicates(more),
        "rules": quality_rules.ledger(more), "files": token_files.read_token_files(spark, path), "mix": mixing.allocate(table), "lang": language_id.predict(more, net),
        "ensemble": rule_ensemble.score(more, rule_ensemble.fit(more, labels)), "pieces": piece_dropout.encode(more), "sniff": media.sniff(more.withColumn("media", F.lit("GIF89a").cast("binary"))),
    }
    for name, out in got.items():
        assert out.count() == 4 and len(out.collect()) == 4 and len(set(map(str.lower, out.columns))) == len(out.columns), name
    assert got["licenses"].where("base_labels = 'mit'").count() == 2 and got["near"].select("component_id").distinct().count() == 2
    assert got["urls"].where("rule = 'www.example.com/en/'").count() == 4 and got["pieces"].where("lossless").count() == 4
