"""Identity that file names and folders carry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the order in which names are tried
NAMES = ["add_noise", "red_char", "red_word", "homo", "swap", "del", "vis", "tpwr", "vscr", "cr", "wr", "muni"]
LEGACY = ["tpwr", "vscr", "cr", "wr", "muni"]


def _after_run(stem: Column, run_id: Column | None) -> Column:
    return stem if run_id is None else F.when(F.startswith(stem, F.concat(run_id, F.lit("_"))), F.substring(stem, F.length(run_id) + 2, F.length(stem))).otherwise(stem)


def file_bucket(stem: Column, run_id: Column | None = None) -> Column:
    """Struct (strategy, level, unknown) of a file stem: the first known name at its start, or after an underscore; both null when clean."""
    key = _after_run(stem, run_id)
    found = F.lit(None).cast("struct<strategy: string, level: string, unknown: boolean>")
    for name in reversed(NAMES):
        level = F.when(F.startswith(key, F.lit(f"{name}_")), F.substring(key, F.lit(len(name) + 2), F.length(key))).when(F.contains(key, F.lit(f"_{name}_")), F.substring_index(key, f"_{name}_", -1))
        found = F.when(level.isNotNull(), F.struct(F.lit(name).alias("strategy"), level.alias("level"), F.lit(False).alias("unknown"))).otherwise(found)
    none = F.lit(None).cast("string")
    clean = (key == "clean") | F.endswith(key, F.lit("_clean"))
    return F.when(clean, F.struct(none.alias("strategy"), none.alias("level"), F.lit(False).alias("unknown"))).otherwise(F.coalesce(found, F.struct(none.alias("strategy"), none.alias("level"), F.lit(True).alias("unknown"))))


def legacy_bucket(stem: Column, run_id: Column | None = None) -> Column:
    """Struct (strategy, level, is_clean); null and false for names that aren't legacy ones."""
    key = _after_run(stem, run_id)
    body = "|".join(LEGACY)
    return F.struct(F.nullif(F.regexp_extract(key, f"^({body})_(.+)$", 1), F.lit("")).alias("strategy"), F.nullif(F.regexp_extract(key, f"^({body})_(.+)$", 2), F.lit("")).alias("level"), (key == "clean").alias("is_clean"))
