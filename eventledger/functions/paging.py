"""Page sizes and opaque page tokens."""

import base64
import binascii
import datetime as dt
import json
import re

from pyspark.sql import Column, functions as F

from ..schemas import DEFAULT_PAGE_SIZE, MAX_PAGE_SIZE
from .events import rfc3339


class InvalidArgument(ValueError):
    """The caller sent something unusable; retrying cannot help."""


def page_size_or_default(n: int) -> int:
    if n <= 0:
        return DEFAULT_PAGE_SIZE
    return min(n, MAX_PAGE_SIZE)


def page_size_from_text(raw: str) -> int:
    """Size asked for at the edge: absent means 0 ("use the default")."""
    if raw == "":
        return 0
    if not re.fullmatch(r"[+-]?[0-9]+", raw):
        raise InvalidArgument("page_size must be a number")
    n = int(raw)
    if n < 0:
        raise InvalidArgument("page_size must not be negative")
    return min(n, MAX_PAGE_SIZE)


def page_token(processed_at: Column, order_id: Column) -> Column:
    """Position after a row: base64url of a small JSON object, without padding.

    The time keeps all six fractional digits; a shorter one would repeat or
    skip rows.
    """
    text = F.to_json(F.struct(rfc3339(processed_at).alias("p"), order_id.alias("o")))
    # base64() breaks lines, a token has none
    plain = F.regexp_replace(F.base64(F.encode(text, "UTF-8")), r"[\r\n]", "")
    return F.rtrim(F.translate(plain, "+/", "-_"), F.lit("="))


def encode_cursor(processed_at: dt.datetime, order_id: str) -> str:
    stamp = processed_at.strftime("%Y-%m-%dT%H:%M:%S.%fZ")
    text = json.dumps({"p": stamp, "o": order_id}, separators=(",", ":"))
    return base64.urlsafe_b64encode(text.encode()).rstrip(b"=").decode()


def decode_cursor(token: str) -> tuple[str, str]:
    """(time text, order id) of a token."""
    if not re.fullmatch(r"[A-Za-z0-9_-]*", token):
        raise InvalidArgument("page token is not valid base64")
    try:
        raw = base64.urlsafe_b64decode(token + "=" * (-len(token) % 4))
    except binascii.Error as err:
        raise InvalidArgument("page token is not valid base64") from err
    try:
        fields = json.loads(raw)
        if not isinstance(fields, dict):
            raise ValueError("not an object")
        stamp, order_id = fields.get("p") or "", fields.get("o") or ""
        if not isinstance(stamp, str) or not isinstance(order_id, str):
            raise ValueError("wrong type")
        if stamp:
            dt.datetime.fromisoformat(stamp.replace("Z", "+00:00"))
    except ValueError as err:
        raise InvalidArgument("page token is not a valid cursor") from err
    if not stamp or not order_id or stamp.startswith("0001-01-01T00:00:00"):
        raise InvalidArgument("page token is incomplete")
    return stamp, order_id
