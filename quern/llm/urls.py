"""URL filter: host-suffix and path-prefix expressions, joined on short hash prefixes.

A url expands into the (host suffix, path prefix) pairs that a rule could name, plus one
expression that stands for the default rule: only suffixes of as many labels and prefixes of such lengths
as rules have, so that a url of many labels and slashes costs no more than the rules ask for.  Expressions meet rules on the first 8 hex digits
of their SHA-256; the whole digest confirms, and the longest rule wins.  Rules are broadcast up
to ``MAX_BROADCAST_RULES``; beyond that rules are copied over ``salts`` and each url row
picks one salt, so that a host with a third of all rows is spread over as many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, table, text_or_empty, values

#: (verdict, host and path)
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
DEFAULT_VERDICT = "allow"
PREFIX_HEX = 8
MAX_BROADCAST_RULES = 100_000
SALTS = 32
#: Joins host and path in an expression; stands in no host, as a host ends at '/', '?' or '#'.
JOINER = "?"


def host_of(url: Column) -> Column:
    """After the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; '' without '://' or for null."""
    rest = _rest(url)
    return ascii_lower(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"(?s)^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def rules_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """(verdict, rule) pairs as a table: verdict, rule, host, path."""
    rows = [(v, r, r.partition("/")[0].translate(str.maketrans(UPPER, LOWER)), "/" + r.partition("/")[2]) for v, r in rules]
    return values(spark, rows, {"verdict": "string", "rule": "string", "host": "string", "path": "string"})


def _shapes(rules: DataFrame) -> tuple[int, dict[int, tuple[list[int], list[int]]]]:
    """The number of rules; number of host labels -> (path lengths of rules that end at '/', path lengths of other rules).

    At most one entry for each number of labels and length: sets of small integers, however many rules there are.
    """
    total, out = 0, {}
    shape = [F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("n"), (~F.endswith("path", F.lit("/"))).cast("int").alias("odd")]
    for labels, n, odd, k in sorted(map(tuple, rules.groupBy(*shape).agg(F.count("*")).collect())):
        out.setdefault(labels, ([], []))[odd].append(n)
        total += k
    return total, out


def _joined(suffix: Column, path: Column, lengths: Column) -> Column:
    return F.transform(lengths, lambda i: F.concat(suffix, F.lit(JOINER), F.substring(path, F.lit(1), i)))


def _expressions(host: Column, path: Column, shapes: dict[int, tuple[list[int], list[int]]]) -> Column:
    """The expressions of a url that rules of these shapes could be equal to."""
    labels, out = F.regexp_count(host, F.lit(r"\.")) + 1, []
    for n, (at_slash, odd) in shapes.items():
        fit = [F.filter(F.array(*map(F.lit, at_slash)), lambda i: F.substring(path, i, F.lit(1)) == "/")] if at_slash else []
        fit += [F.filter(F.array(*map(F.lit, odd)), lambda i: i <= F.length(path))] if odd else []
        out.append(F.when(labels >= n, _joined(F.substring_index(host, ".", -n), path, F.concat(*fit))).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.concat(F.array(F.lit("")), *out))


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT_VERDICT, url: str = "url", id_col: str = "page_id", salts: int = SALTS) -> DataFrame:
    """One row for each row of ``pages``: id, host, path, rule (null: none fits), verdict.

    Among the rules that fit, the longest (host and path together) wins, then the longer host,
    then block over allow.  Null or repeated ids are fine; extra columns are dropped.
    A url of any length costs as many expressions as the rules have shapes (numbers of labels and lengths of paths) that it fits.
    """
    n, shapes = _shapes(rules)
    digest = F.sha2(F.concat("host", F.lit(JOINER), "path"), 256)
    keyed = rules.select(
        "verdict", "rule", (F.length("host") + F.length("path")).alias("len"), F.length("host").alias("host_len"), digest.alias("rule_digest")
    ).unionByName(rules.sparkSession.range(1).select(
        F.lit(default).alias("verdict"), F.lit(None).cast("string").alias("rule"), F.lit(-1).alias("len"), F.lit(-1).alias("host_len"), F.sha2(F.lit(""), 256).alias("rule_digest"))
    ).withColumn("prefix", F.substring("rule_digest", 1, PREFIX_HEX))
    u = F.col("__u")
    rows = pages.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), text_or_empty(url).alias("__u"))
    rows = rows.select("rid", "id", host_of(u).alias("host"), path_of(u).alias("path"))
    each = rows.select("rid", "id", "host", "path", F.explode(_expressions(F.col("host"), F.col("path"), shapes)).alias("expression"))
    each = each.select("rid", "id", "host", "path", F.sha2("expression", 256).alias("digest")).withColumn("prefix", F.substring("digest", 1, PREFIX_HEX))
    if n <= MAX_BROADCAST_RULES:
        met = each.join(F.broadcast(keyed), "prefix")
    else:
        keyed = keyed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        met = each.withColumn("salt", F.pmod(F.xxhash64("rid"), F.lit(salts)).cast("int")).join(keyed, ["prefix", "salt"])
    rank = F.struct("len", "host_len", F.col("verdict") == "block", "rule", "verdict")
    return (
        met.where("digest = rule_digest")
        .groupBy("rid", F.col("id").alias(id_col), "host", "path")
        .agg(F.max(rank).alias("best"))
        .select(id_col, "host", "path", "best.rule", "best.verdict")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), rules_table(spark, RULES))


def oracle() -> str:
    rules = ", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in RULES)
    return f"""
WITH rules(verdict, rule, rhost, rpath) AS (VALUES {rules}),
u AS (SELECT row_number() OVER () AS rid, page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT rid, page_id, translate(regexp_extract(rest, '(?s)^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM u),
fit AS (SELECT rid, rule, verdict, row_number() OVER (PARTITION BY rid ORDER BY length(rhost) + length(rpath) DESC, length(rhost) DESC, verdict DESC, rule DESC) AS k
        FROM p JOIN rules ON (host = rhost OR host LIKE '%.' || rhost) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, '{DEFAULT_VERDICT}') AS verdict FROM p LEFT JOIN fit ON p.rid = fit.rid AND fit.k = 1"""
