"""Lenient decode of a log value into an event."""

from pyspark.sql import Column, functions as F, types as T

from ..schemas import EVENT, ITEM
from .ingress import ITEM_TYPE, object_type, zero_filled_items

_RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"
ZERO_TIME = "0001-01-01T00:00:00Z"


def sealed(value: Column) -> Column:
    """The text parsed as the first element of a list whose second is its own digest.

    Spark's JSON parsers stop reading after the first value. A text that ends
    early, or that brings along another element, no longer has the digest in
    second place, see ``sealed_document``.
    """
    return F.try_parse_json(F.concat(F.lit("["), value, F.lit(',"'), F.md5(value), F.lit('"]')))


def sealed_document(listed: Column, value: Column) -> Column:
    """The JSON value a text consists of, as a variant; NULL if anything else is in it."""
    intact = F.equal_null(F.try_variant_get(listed, "$[1]", "string"), F.md5(value)) & (
        F.try_variant_get(listed, "$[2]", "variant").isNull()
    )
    return F.when(intact, F.try_variant_get(listed, "$[0]", "variant"))


_FIELDS = [
    ("event_id", "STRING"),
    ("event_type", "STRING"),
    ("order_id", "STRING"),
    ("occurred_at", "STRING"),
    ("customer_id", "STRING"),
    ("total_cents", "BIGINT"),
]
_KNOWN_FIELDS = "struct<" + ", ".join(f"{name}: variant" for name, _ in _FIELDS) + ">"
_KNOWN_ITEM_FIELDS = "array<struct<" + ", ".join(f"{f.name}: variant" for f in ITEM.fields) + ">>"
_FIELD_TYPES = object_type(*_FIELDS)
_PLAIN_EVENT = object_type(*_FIELDS, ("items", rf"ARRAY<({ITEM_TYPE}|VOID)>"))
_TIME_AS_TEXT = T.StructType(
    [T.StructField(f.name, T.StringType()) if f.name == "occurred_at" else f for f in EVENT.fields]
)


def event_fits(document: Column) -> Column:
    """Whether every known field is absent, null or of its type. Unknown fields do not matter.

    One type description settles a document of known fields. Otherwise the
    known fields are picked out first and described by themselves.
    """
    kind = F.schema_of_variant(document)
    fields = F.schema_of_variant(
        F.to_variant_object(F.try_variant_get(document, "$", _KNOWN_FIELDS))
    )
    items = F.try_variant_get(document, "$.items", "variant")
    item_fields = F.schema_of_variant(
        F.to_variant_object(F.try_variant_get(items, "$", _KNOWN_ITEM_FIELDS))
    )
    picked = (
        kind.startswith("OBJECT<")
        & F.coalesce(fields.rlike(f"^(VOID|{_FIELD_TYPES})$"), F.lit(True))
        & F.coalesce(F.schema_of_variant(items).rlike("^(VOID$|ARRAY<(VOID>$|OBJECT<))"), F.lit(True))
        & F.coalesce(item_fields.rlike(f"^(VOID|ARRAY<(VOID|{ITEM_TYPE})>)$"), F.lit(True))
    )
    return F.when(kind.rlike(f"^(VOID|{_PLAIN_EVENT})$"), True).when(kind.isNotNull(), picked).otherwise(False)


def event_of(value: Column) -> Column:
    """Typed fields of a value whose document fits (the time still as text); a JSON null has none."""
    return F.coalesce(F.from_json(value, _TIME_AS_TEXT), F.from_json(F.lit("{}"), _TIME_AS_TEXT))


def event_time(typed: Column) -> Column:
    """When the event occurred; NULL where the text is not RFC 3339, year 1 where it is missing."""
    text = F.coalesce(typed["occurred_at"], F.lit(ZERO_TIME))
    return F.when(typed.isNotNull() & text.rlike(_RFC3339), text.try_cast("timestamp"))


def zero_filled_event(typed: Column, occurred_at: Column) -> Column:
    """The event with zero values for missing fields."""

    def text(field: str) -> Column:
        return F.coalesce(typed[field], F.lit("")).alias(field)

    return F.struct(
        text("event_id"),
        text("event_type"),
        text("order_id"),
        occurred_at.alias("occurred_at"),
        text("customer_id"),
        zero_filled_items(typed["items"]).alias("items"),
        F.coalesce(typed["total_cents"], F.lit(0).cast("bigint")).alias("total_cents"),
    )


def event_json(event_columns: dict[str, Column]) -> Column:
    """A log value: the event as JSON, times in RFC 3339 with microseconds."""
    fields = [
        (rfc3339(c) if name == "occurred_at" else c).alias(name)
        for name, c in ((f.name, event_columns[f.name]) for f in EVENT.fields)
    ]
    return F.to_json(F.struct(*fields))


def rfc3339(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
