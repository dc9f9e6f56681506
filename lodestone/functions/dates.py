"""Free-form dates: one table of layouts, read in Python and in Spark."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone
from email.utils import parsedate_to_datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.binding import let

# (shape, Spark pattern, strptime pattern); the first shape that matches wins.
LAYOUTS = [
    (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd", "%Y-%m-%d"),
    (r"^\d{4}/\d{2}/\d{2}$", "yyyy/MM/dd", "%Y/%m/%d"),
    (r"^\d{8}$", "yyyyMMdd", "%Y%m%d"),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}$", "yyyy-MM-dd HH:mm", "%Y-%m-%d %H:%M"),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$", "yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S"),
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$", "yyyy-MM-dd'T'HH:mm:ss", "%Y-%m-%dT%H:%M:%S"),
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(Z|[+-]\d{2}:\d{2})$", "yyyy-MM-dd'T'HH:mm:ssXXX", "%Y-%m-%dT%H:%M:%S%z"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy", "%m/%d/%Y"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{2}:\d{2}:\d{2}$", "M/d/yyyy HH:mm:ss", "%m/%d/%Y %H:%M:%S"),
    (r"^[A-Z][a-z]{2}, \d{2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}:\d{2} GMT$", "", ""),
]
FRACTION = r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2})\.\d{1,9}(.*)$"
# Unix time by digit count: divisor to whole seconds.
UNIX_DIGITS = {10: 1, 13: 1_000, 16: 1_000_000, 19: 1_000_000_000}


def parse_any_date(text: str) -> int | None:
    """Unix seconds of a date in one of the known layouts, else None."""
    s = re.sub(FRACTION, r"\1\2", text.strip())
    if s.isascii() and s.isdigit() and len(s) in UNIX_DIGITS:
        return int(s) // UNIX_DIGITS[len(s)]
    for shape, _, layout in LAYOUTS:
        if re.match(shape, s):
            try:
                moment = datetime.strptime(s, layout) if layout else parsedate_to_datetime(s)
            except ValueError:
                return None
            if moment.tzinfo is None:
                moment = moment.replace(tzinfo=timezone.utc)
            return int(moment.timestamp())
    return None


def unix_seconds_of(text: Column) -> Column:
    """``parse_any_date`` as an expression (session time zone must be UTC)."""
    return let(F.regexp_replace(F.trim(text), FRACTION, "$1$2"), _seconds)


def _seconds(s: Column) -> Column:
    branches = F.when(F.lit(False), F.lit(None).cast("bigint"))
    for digits, divisor in UNIX_DIGITS.items():
        whole = F.floor(F.try_to_number(s, F.lit("9" * digits)) / F.lit(divisor))
        branches = branches.when(s.rlike(rf"^\d{{{digits}}}$"), whole.cast("bigint"))
    for shape, pattern, _ in LAYOUTS:
        if pattern:
            stamp = F.try_to_timestamp(s, F.lit(pattern))
        else:
            stamp = F.try_to_timestamp(F.substring(s, 6, 20), F.lit("dd MMM yyyy HH:mm:ss"))
        branches = branches.when(s.rlike(shape), F.unix_timestamp(stamp))
    return branches


def parse_relative_date(text: str, now: datetime) -> int | None:
    """``yesterday``, ``last month``, ``3 weeks ago`` and so on, at UTC midnight."""
    s = text.strip().lower()
    named = {
        "today": (0, 0, 0),
        "yesterday": (0, 0, 1),
        "last week": (0, 0, 7),
        "last month": (0, 1, 0),
        "last year": (1, 0, 0),
    }
    back = named.get(s)
    if back is None:
        m = re.match(r"^([+-]?\d+)\s+(day|week|month|year)s?\s+ago", s)
        if not m:
            return None
        n, unit = int(m.group(1)), m.group(2)
        back = {"day": (0, 0, n), "week": (0, 0, 7 * n), "month": (0, n, 0), "year": (n, 0, 0)}[unit]
    years, months, days = back
    moment = now.astimezone(timezone.utc)
    # A day past the end of the target month rolls into the next one.
    month0 = moment.year * 12 + moment.month - 1 - years * 12 - months
    first = datetime(month0 // 12, month0 % 12 + 1, 1, tzinfo=timezone.utc)
    return int((first + timedelta(days=moment.day - 1 - days)).timestamp())
