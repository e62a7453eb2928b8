"""Identity: sample uids, message hashes, request keys, row seeds and hash ranks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KEY_VERSION = 1


def sample_uid(dataset: Column, split: Column, sample_id: Column) -> Column:
    return F.concat_ws("___", dataset, split, sample_id)


def messages_hash(messages: Column) -> Column:
    """SHA-256 of the canonical JSON of messages (role, content): members in alphabetical order, no spaces."""
    return F.sha2(F.to_json(F.transform(messages, lambda m: F.struct(m["content"].alias("content"), m["role"].alias("role")))), 256)


def request_key(**parts: Column) -> Column:
    """SHA-256 of the canonical JSON of the parts, in alphabetical order; null parts are left out."""
    parts.setdefault("schema_version", F.lit(KEY_VERSION))
    return F.sha2(F.to_json(F.struct(*[parts[k].alias(k) for k in sorted(parts)])), 256)


def hex_number(text: Column, digits: int = 8, start: int = 1) -> Column:
    """A non-negative number from hexadecimal digits of SHA-256."""
    return F.conv(F.substring(F.sha2(text, 256), start, digits), 16, 10).cast("long")


def row_seed(base: Column, dataset: Column, sample_id: Column, strategy: Column, level: Column) -> Column:
    """The first 8 bytes of SHA-256 over 'base|dataset|id|strategy|level', modulo 2^31."""
    return hex_number(F.concat_ws("|", base.cast("string"), dataset, sample_id, strategy, level), 8, 9).bitwiseAND(F.lit(2147483647))


#: Draws are residues of this prime, so that products stay within 64 bits.
PRIME = 2147483647


def mix(seed: Column, j: Column, salt: int = 0) -> Column:
    """The j-th number (below PRIME) of a seed below PRIME: plain arithmetic, so that many draws of a row cost no digest each."""
    a = (seed + (j.cast("long") + 1) * 1000003 + salt * 7368787) % PRIME
    return ((a * a) % PRIME * 48271 + seed) % PRIME


def mix_numbers(seed: int, j, salt: int = 0):
    """``mix`` of an array of 64-bit numbers."""
    a = (seed + (j + 1) * 1000003 + salt * 7368787) % PRIME
    return ((a * a) % PRIME * 48271 + seed) % PRIME


def sql_mix(seed: str, j: str, salt: int = 0) -> str:
    """``mix`` as SQL text."""
    a = f"(({seed} + ({j} + 1) * 1000003 + {salt * 7368787}) % {PRIME})"
    return f"((({a} * {a}) % {PRIME} * 48271 + {seed}) % {PRIME})"


def strata(seed: Column, n: Column, k: Column, first: Column | int = 0) -> Column:
    """k of the ranks 0 to n - 1, ascending and distinct: one from each of k even strata, by the numbers ``first``, ``first`` + 1, ... of the seed.

    n and k are bound once for each row: within the inner lambda their expressions would be computed anew for every rank.
    """
    start = F.lit(first) if isinstance(first, int) else first

    def ranks(b: Column) -> Column:
        def one(j: Column) -> Column:
            lo, hi = F.floor(j * b["n"] / b["k"]), F.floor((j + 1) * b["n"] / b["k"])
            return (lo + mix(b["seed"], b["first"] + j) % F.greatest(hi - lo, F.lit(1))).cast("int")

        return F.when(b["k"] > 0, F.transform(F.sequence(F.lit(0), F.greatest(b["k"], F.lit(1)) - 1), one)).otherwise(F.array().cast("array<int>"))

    bound = F.struct(n.cast("long").alias("n"), k.cast("int").alias("k"), seed.alias("seed"), start.cast("long").alias("first"))
    return F.get(F.transform(F.array(bound), ranks), F.lit(0))
