"""Column helpers that queries share: states, overdue and fine rules, local days, search text."""

from __future__ import annotations

import hashlib
import hmac
import re
from functools import reduce
from operator import or_
from urllib.parse import quote_plus

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

OPEN = ("BORROWED", "OVERDUE", "LOST")
ACTIVE = ("BORROWED", "OVERDUE")
ACTIVE_HOLD = ("WAITING", "NOTIFIED", "READY_FOR_PICKUP")


def at(moment: str) -> Column:
    """A zone-less timestamp literal."""
    return F.lit(moment).cast("timestamp_ntz")


def is_overdue(now: Column, status: str = "status", due: str = "due_date") -> Column:
    return (F.col(status) == "OVERDUE") | ((F.col(status) == "BORROWED") & (F.col(due) < now))


def optional_bound(name: str, value: object, op: str) -> Column:
    """name >= value or name <= value; without a value, whatever isn't null."""
    c, v = F.col(name), F.coalesce(F.lit(value), F.col(name))
    return {">=": c >= v, "<=": c <= v}[op]


def is_unpaid_fine() -> Column:
    return (F.col("fine_amount") > 0) & F.col("fine_paid_at").isNull() & F.col("fine_waived_by").isNull()


def fine_status(waived_first: bool = False) -> Column:
    """NONE, UNPAID, PAID or WAIVED; lists test WAIVED first, searches PAID."""
    paid, waived = (F.col("fine_paid_at").isNotNull(), "PAID"), (F.col("fine_waived_by").isNotNull(), "WAIVED")
    out = F.when(F.coalesce("fine_amount", F.lit(0)) <= 0, "NONE")
    for test, name in (waived, paid) if waived_first else (paid, waived):
        out = out.when(test, name)
    return out.otherwise("UNPAID")


def days_overdue_elapsed(end: Column, due: Column) -> Column:
    """Whole days of elapsed time past due, 0 at least."""
    seconds = F.unix_timestamp(end.cast("timestamp")) - F.unix_timestamp(due.cast("timestamp"))
    return F.greatest(F.floor(seconds / 86400), F.lit(0)).cast("long")


def local_day(moment: Column | str, hours: int = 7) -> Column:
    """The local calendar day of a zone-less UTC moment."""
    return F.to_date((F.col(moment) if isinstance(moment, str) else moment) + F.expr(f"INTERVAL {hours} HOURS"))


def days_overdue_calendar(end: Column, due: Column) -> Column:
    return F.greatest(F.datediff(local_day(end), local_day(due)), F.lit(0)).cast("long")


def contains(text: str | None, *names: str) -> Column | None:
    """OR of case-insensitive LIKE over columns; None for blank text. Wildcards in text keep their meaning."""
    text = (text or "").strip().lower()
    return reduce(or_, [F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).like(f"%{text}%") for c in names]) if text else None


def whole_number(text: str | None) -> int | None:
    """What a search text is as a 64-bit id."""
    text = (text or "").strip()
    n = int(text) if re.fullmatch("[+-]?[0-9]+", text) else None
    return n if n is not None and -(1 << 63) <= n < 1 << 63 else None


def matches(kind: str | None, value: str | None, columns: dict[str, str]) -> Column | None:
    """A discriminated filter: contains on the column that kind names; no kind, no filter; an unknown kind, no rows."""
    if kind is None:
        return None
    return F.lower(columns[kind]).like(f"%{(value or '').lower()}%") if kind in columns else F.lit(False)


def isbn_digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9Xx]", "")


def canonical_json(c: Column) -> Column:
    """A map as JSON with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c))))


def signature(secret: str):
    """A pandas UDF: HMAC-SHA512 (hex) of a map's entries, sorted and URL-encoded; Spark has no HMAC."""

    @F.pandas_udf("string")
    def sign(params: pd.Series) -> pd.Series:
        text = params.map(lambda m: "&".join(f"{quote_plus(k)}={quote_plus(v)}" for k, v in sorted((m or {}).items()) if v))
        return text.map(lambda t: hmac.new(secret.encode(), t.encode(), hashlib.sha512).hexdigest())

    return sign
