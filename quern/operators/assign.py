"""Eligibility and balanced assignment of strategies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.keys import hex_number
from ..functions.text import UNIT, is_blank
from .strategies import LOOK_ALIKE, STOP, _one_of

#: Rows that one task numbers, about.
ROWS_A_TASK = 200_000


def eligible(text: Column | Sequence[Column], unit: str = "letter") -> Column:
    """Strategies whose static test the text (or one of several fields) passes, in a fixed order."""
    t = F.coalesce(text, F.lit("")) if isinstance(text, Column) else F.concat_ws("\n", *text)
    has = t.rlike(UNIT[unit])
    tests = [*[(n, has) for n in ("homo", "del", "swap", "red_char", "red_word")], ("vis", t.rlike(_one_of(LOOK_ALIKE, STOP))), ("add_noise", ~is_blank(t))]
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in tests]))


def numbered(df: DataFrame, name: str, within: Sequence[str], key: str, seed: str, first: Sequence[Column] = ()) -> DataFrame:
    """``df`` with ``name``: each row's place from 0 among the rows alike in ``within``, in the order of ``first``, then of a keyed hash.

    The hash range is cut into buckets of about ROWS_A_TASK rows; rows are numbered within buckets, and the counts of the buckets before are added.  The result
    is the same for any number of buckets, and no task sees a whole dataset.  ``df`` is read for the counts and again for the rows.
    """
    names = [f"__f{i}" for i in range(len(first))]
    rows = df.withColumns({n: c for n, c in zip(names, first, strict=True)} | {"__h": hex_number(F.concat_ws("|", F.lit(seed), F.col("dataset_name"), F.col(key)))})
    buckets = max(1, min(-(-df.count() // ROWS_A_TASK), 1 << 16))
    rows = rows.withColumn("__b", F.floor(F.col("__h") * buckets / float(1 << 32)).cast("int"))
    cell = [*within, *names, "__b"]
    place = F.row_number().over(Window.partitionBy(*cell).orderBy("__h", key)) - 1
    counts = rows.groupBy(*cell).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over((Window.partitionBy(*within) if within else Window.partitionBy()).orderBy(*names, "__b")) - F.col("__n")
    counts = counts.select(*[F.col(c).alias(f"__c_{c}") for c in cell], before.alias("__before"))
    same = F.lit(True)
    for c in cell:
        same = same & F.col(c).eqNullSafe(F.col(f"__c_{c}"))
    out = rows.withColumn("__k", place).join(counts, same)
    return out.withColumn(name, (F.col("__k") + F.col("__before")).cast("long")).drop(*names, "__h", "__b", "__k", "__before", *[f"__c_{c}" for c in cell])


def assign_balanced(df: DataFrame, key: str = "sample_id", seed: str = "assign") -> DataFrame:
    """``df`` (dataset_name, key, eligible) with ``strategy``: within each dataset and eligible set, counts of strategies differ by one at most; null for rows that nothing fits."""
    rows = numbered(df, "__place", ["dataset_name", "eligible"], key, seed)
    place = F.pmod("__place", F.greatest(F.size("eligible"), F.lit(1))).cast("int")
    return rows.withColumn("strategy", F.get("eligible", place)).drop("__place")


def shares(sets: Sequence[tuple[tuple[str, ...], int]]) -> dict[tuple[str, ...], list[int]]:
    """Rows of each eligible set for each of its strategies: sets of few strategies choose first, and the least used strategy gets the next row."""
    used: dict[str, int] = {}
    out = {}
    for names, n in sorted(sets, key=lambda x: (len(x[0]), x[0])):
        give = dict.fromkeys(names, 0)
        while n and names:
            least = min(used.get(s, 0) for s in names)
            low = [s for s in names if used.get(s, 0) == least]
            above = min((used.get(s, 0) for s in names if used.get(s, 0) > least), default=None)
            step = n // len(low) if above is None else min(above - least, n // len(low))
            for i, s in enumerate(low):
                more = step if step else int(i < n)
                give[s], used[s] = give[s] + more, used.get(s, 0) + more
            n -= step * len(low) if step else min(n, len(low))
        out[names] = [give[s] for s in names]
    return out


def assign_constrained(df: DataFrame, key: str = "sample_id", seed: str = "assign") -> DataFrame:
    """``df`` (dataset_name, key, eligible) with ``strategy``: rows with few choices come first and take what is least used, so that counts are even over a whole dataset.

    The driver sees one row for each dataset and eligible set (128 sets at most) and gives out shares; rows take theirs by their number within the set.
    """
    counts = [(r[0], tuple(r[1] or ()), r[2]) for r in df.groupBy("dataset_name", "eligible").count().collect()]
    by_dataset: dict = {}
    for dataset, names, n in counts:
        by_dataset.setdefault(dataset, []).append((names, n))
    given = [(d, list(names), cuts) for d, sets in by_dataset.items() for names, cuts in shares(sets).items()]
    table = df.sparkSession.createDataFrame(given, "s_dataset string, s_eligible array<string>, s_share array<long>")
    rows = numbered(df, "__place", ["dataset_name", "eligible"], key, seed)
    rows = rows.join(F.broadcast(table), F.col("dataset_name").eqNullSafe(F.col("s_dataset")) & F.coalesce("eligible", F.array().cast("array<string>")).eqNullSafe(F.col("s_eligible")))
    ends = F.transform("s_share", lambda x, i: F.aggregate(F.slice("s_share", F.lit(1), i + 1), F.lit(0).cast("long"), lambda a, b: a + b))
    at = F.size(F.filter(ends, lambda e: e <= F.col("__place")))
    return rows.withColumn("strategy", F.get("eligible", at)).drop("__place", "s_dataset", "s_eligible", "s_share")
