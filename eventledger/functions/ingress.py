"""Checks on an incoming request: strict decode, validation, ids, totals."""

from pyspark.sql import Column, functions as F

from ..schemas import MAX_BODY_BYTES, MAX_IDEMPOTENCY_KEY_BYTES, REQUEST


def object_type(*fields: tuple[str, str]) -> str:
    """Pattern of the type text of an object holding any subset of ``fields``.

    ``schema_of_variant`` prints fields in name order, so an optional field
    followed by an optional comma covers every subset.
    """
    inner = "".join(rf"({name}: ({kind}|VOID)(, (?!>))?)?" for name, kind in sorted(fields))
    return f"OBJECT<{inner}>"


ITEM_TYPE = object_type(("sku", "STRING"), ("quantity", "BIGINT"), ("unit_price_cents", "BIGINT"))
_REQUEST_TYPE = object_type(
    ("customer_id", "STRING"), ("items", rf"ARRAY<({ITEM_TYPE}|VOID)>")
)


def request_document(body: Column) -> Column:
    """The first JSON value of a body within the size limit, as a variant."""
    return F.when(F.octet_length(body) <= MAX_BODY_BYTES, F.try_parse_json(body))


def request_fits(document: Column) -> Column:
    """True for a JSON object of known fields of the right types; never NULL.

    One type description of the whole document settles types and unknown fields
    at every level. A null counts as an absent field.
    """
    shaped = F.schema_of_variant(document).rlike(f"^(VOID|{_REQUEST_TYPE})$")
    return F.coalesce(shaped, F.lit(False))


def request_fields(body: Column) -> Column:
    """The request struct of a body whose document fits."""
    return F.from_json(body, REQUEST)


def zero_filled_items(items: Column) -> Column:
    """Missing item fields as '' and 0; a missing list as an empty one."""
    filled = F.transform(
        items,
        lambda it: F.struct(
            F.coalesce(it["sku"], F.lit("")).alias("sku"),
            F.coalesce(it["quantity"], F.lit(0).cast("bigint")).alias("quantity"),
            F.coalesce(it["unit_price_cents"], F.lit(0).cast("bigint")).alias("unit_price_cents"),
        ),
    )
    return F.coalesce(filled, F.array().cast(REQUEST["items"].dataType))


def is_blank(text: Column) -> Column:
    """Nothing but white space, Unicode's included; plain text is settled by its first character."""
    plain = F.trim(text)
    return (
        F.when(plain == "", True)
        .when(F.ascii(plain).between(0x21, 0x7E), False)
        .otherwise(text.rlike(r"^(?U)\s*$"))
    )


# The items of a request that have a problem, with their place in the list.
FAULTY = "array<struct<at:bigint,sku:string,quantity:bigint,unit_price_cents:bigint>>"


def item_is_faulty(item: Column) -> Column:
    return is_blank(item["sku"]) | (item["quantity"] <= 0) | (item["unit_price_cents"] < 0)


def problems_of(customer_id: Column, n_items: Column, faulty: Column) -> Column:
    """Every problem of a request, in order; empty when it is acceptable.

    ``faulty`` has the type FAULTY; items without a problem may be in it too.
    """

    def of_item(it: Column) -> Column:
        at = F.concat(F.lit("items["), it["at"].cast("string"), F.lit("]."))
        return F.array(
            F.when(is_blank(it["sku"]), F.concat(at, F.lit("sku is required"))),
            F.when(it["quantity"] <= 0, F.concat(at, F.lit("quantity must be > 0"))),
            F.when(it["unit_price_cents"] < 0, F.concat(at, F.lit("unit_price_cents must be >= 0"))),
        )

    whole = F.array(
        F.when(is_blank(customer_id), F.lit("customer_id is required")),
        F.when(n_items == 0, F.lit("at least one item is required")),
    )
    return F.array_compact(F.concat(whole, F.flatten(F.transform(faulty, of_item))))


def validation_problems(customer_id: Column, items: Column) -> Column:
    """The same for a request with the list of its items."""
    placed = F.transform(
        items,
        lambda it, i: F.struct(i.cast("bigint").alias("at"), it["sku"], it["quantity"], it["unit_price_cents"]).cast(
            "struct<at:bigint,sku:string,quantity:bigint,unit_price_cents:bigint>"
        ),
    )
    return problems_of(customer_id, F.size(items), placed)


def validation_message(problems: Column) -> Column:
    """One line for the caller, NULL when there is nothing to say."""
    return F.when(
        F.size(problems) > 0, F.concat(F.lit("invalid order: "), F.concat_ws("; ", problems))
    )


def idempotency_key_ok(key: Column) -> Column:
    """Empty, or at most 255 bytes of printable ASCII without spaces."""
    return (F.octet_length(key) <= MAX_IDEMPOTENCY_KEY_BYTES) & key.rlike(r"^[\x21-\x7e]*\z")


def total_cents(items: Column) -> Column:
    """Sum of price times quantity; NULL where it leaves 64 bits."""
    return F.aggregate(
        items,
        F.lit(0).cast("bigint"),
        lambda total, it: F.try_add(total, F.try_multiply(it["unit_price_cents"], it["quantity"])),
    )
