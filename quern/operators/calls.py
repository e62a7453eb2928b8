"""What a perturbation may be asked for: fields by kind of payload, levels, seeds, and rows that are still clean."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import FIELDS_OF, LEVELS


def allowed_fields(kind: Column) -> Column:
    """Fields that may be changed in a payload of this kind; none for an unknown kind."""
    out = F.array().cast("array<string>")
    for name, fields in FIELDS_OF.items():
        out = F.when(kind == name, F.array(*map(F.lit, fields))).otherwise(out)
    return out


def illegal_targets(targets: Column, kind: Column) -> Column:
    """Those of the target fields that the payload's kind does not allow."""
    return F.array_except(F.coalesce(targets, F.array().cast("array<string>")), allowed_fields(kind))


def problem(level: Column, seed: Column, targets: Column, kind: Column) -> Column:
    """Why a call is invalid, null if it is valid: tried in this order."""
    none = F.size(F.coalesce(targets, F.array().cast("array<string>"))) == 0
    return (
        F.when(~F.coalesce(level.isin(LEVELS), F.lit(False)), "unknown_level")
        .when(F.coalesce(seed < 0, F.lit(True)), "negative_seed")
        .when(none, "no_target_field")
        .when(F.size(illegal_targets(targets, kind)) > 0, "illegal_target_field")
    )


def still_clean(corruption_name: Column, value: Column) -> Column:
    """``value``, or an error for a row that is perturbed already."""
    return F.when(corruption_name.isNotNull(), F.raise_error(F.concat(F.lit("already perturbed: "), corruption_name))).otherwise(value)
