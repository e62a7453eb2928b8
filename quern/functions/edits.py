"""Edit operations: arrays of structs with code-point offsets into the clean text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import SAFE_METADATA


def op(kind: str | Column, start: Column, end: Column, original: Column, replacement: Column, field: Column | None = None, unit: str = "char", metadata: Column | None = None, index: Column | None = None) -> Column:
    return F.struct(
        (F.lit(0) if index is None else index).cast("long").alias("op_index"), (F.lit(kind) if isinstance(kind, str) else kind).alias("op_type"), (F.lit("text_a") if field is None else field).alias("field"),
        start.cast("long").alias("start"), end.cast("long").alias("end"), original.alias("original"), replacement.alias("replacement"), F.lit(unit).alias("unit_kind"),
        (F.create_map().cast("map<string,string>") if metadata is None else metadata).alias("metadata"),
    )


def reindex(ops: Column) -> Column:
    """op_index from 0 in the order of the array."""
    return F.transform(ops, lambda o, i: o.withField("op_index", i.cast("long")))


def apply_ops(text: Column, ops: Column) -> Column:
    """The text after all operations, applied from its end to its start so that offsets stay those of the clean text."""
    order = F.reverse(F.array_sort(ops, lambda a, b: F.when(a["start"] != b["start"], (a["start"] - b["start"]).cast("int")).otherwise((a["end"] - b["end"]).cast("int"))))

    def splice(t: Column, o: Column) -> Column:
        s, e = o["start"].cast("int"), o["end"].cast("int")
        head, tail = F.substring(t, F.lit(1), s), F.substring(t, e + 1, F.length(t))
        kept = F.when(o["op_type"] == "duplicate", F.concat(F.substring(t, s + 1, e - s), o["replacement"])).when(o["op_type"] == "delete", F.lit("")).otherwise(o["replacement"])
        return F.concat(head, kept, tail)

    return F.aggregate(order, text, splice)


def _plain(key: Column, value: Column) -> Column:
    return F.when(value.rlike(r"^(\d+|[A-Z][a-z])$"), value).otherwise(F.raise_error(F.concat(F.lit("unsafe metadata: "), key)))


def redact(ops: Column) -> Column:
    """Operations without any text; of the metadata only allowed keys stay.  A value of an allowed key that is no plain number or category name is an error, as it could hold text."""
    safe = F.array(*[F.lit(k) for k in SAFE_METADATA])
    return F.transform(ops, lambda o: F.struct(
        o["op_index"].alias("op_index"), o["op_type"].alias("op_type"), o["field"].alias("field"), o["start"].alias("start"), o["end"].alias("end"), o["unit_kind"].alias("unit_kind"),
        F.transform_values(F.map_filter(o["metadata"], lambda k, v: F.array_contains(safe, k)), _plain).alias("metadata"),
    ))


def edit_units(ops: Column) -> Column:
    """The sum over operations of the longer of what goes and what comes."""
    size = lambda c: F.length(F.coalesce(c, F.lit("")))
    return F.aggregate(ops, F.lit(0), lambda a, o: a + F.when(o["op_type"] == "duplicate", size(o["replacement"])).otherwise(F.greatest(size(o["original"]), size(o["replacement"]))))


def violations(ops: Column, fields: Column) -> Column:
    """Names of the rules that operations break."""
    return F.array_compact(F.array(
        F.when(F.exists(ops, lambda o: o["end"] < o["start"]), "end_before_start"),
        F.when(~F.forall(F.transform(ops, lambda o, i: o["op_index"] == i), lambda x: x), "op_index_gap"),
        F.when(F.exists(ops, lambda o: ~F.array_contains(fields, o["field"])), "foreign_field"),
        F.when(F.exists(ops, lambda o: ~o["op_type"].isin("replace", "insert", "delete", "duplicate")), "unknown_kind"),
    ))
