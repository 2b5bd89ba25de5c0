"""Field plausibility checks as one CASE expression per field."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions.text import is_present, strip

_EMAIL = r"(?U)^[^@\s]+@[^@\s]+\.[^@\s]+$"
_LOOSE_DATE = r"(?U)(?=\d)(?:\b(?:19|20)\d{2}\b|\b\d{1,2}[./-]\d{1,2}[./-]\d{2,4}\b)"
_ISO_DAY = r"^(\d{4})(?:-(\d{2})-(\d{2})|(\d{2})(\d{2}))"
_ISO_WEEK = r"^(\d{4})-?W(\d{2})(?:-?[1-7])?"
_ISO_ZONE = r"(?:[+-]\d{2}(?::?\d{2}(?::?\d{2}(?:\.\d+)?)?)?)?"
_ISO_TIME = (
    r"(?:.(?:[01]\d|2[0-3])(?::[0-5]\d(?::[0-5]\d(?:[.,]\d+)?)?|[0-5]\d(?:[0-5]\d(?:[.,]\d+)?)?)?"
    + _ISO_ZONE
    + ")?$"
)
_NUMBER = r"^[+-]?(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+(?:_\d+)*)?$"
_SPECIAL_NUMBER = r"(?i)^[+-]?(?:inf|infinity|nan)$"


def _iso_date(text: Column) -> Column:
    """An ISO 8601 date or date-time that names a real calendar day."""
    value = F.regexp_replace(text, "Z", "+00:00")
    day = F.regexp_replace(value, f"{_ISO_DAY}.*$", "$1-$2$4-$3$5").try_cast("date")
    year = F.regexp_extract(value, _ISO_WEEK, 1)
    week = F.regexp_extract(value, _ISO_WEEK, 2).try_cast("int")
    # A year has a week 53 when it begins or ends on a Thursday.
    ends = [F.concat(year, F.lit(d)).try_cast("date") for d in ("-01-01", "-12-31")]
    long_year = (F.dayofweek(ends[0]) == 5) | (F.dayofweek(ends[1]) == 5)
    return F.coalesce(
        F.when(value.startswith("0000"), False)
        .when(value.rlike(_ISO_DAY + _ISO_TIME), day.isNotNull())
        .when(
            value.rlike(_ISO_WEEK + _ISO_TIME),
            week.between(1, 52) | ((week == 53) & long_year),
        ),
        F.lit(False),
    )


def _number(text: Column) -> Column:
    """The double that a number text stands for, else null."""
    return F.when(
        text.rlike(_NUMBER), F.regexp_replace(text, "_", "").try_cast("double")
    ).when(
        text.rlike(_SPECIAL_NUMBER),
        F.when(text.rlike("(?i)nan$"), F.lit(float("nan")))
        .when(text.startswith("-"), F.lit(float("-inf")))
        .otherwise(F.lit(float("inf"))),
    )


def possible_errors(field: str, spec: Any = None) -> list[str]:
    """The codes ``field_error`` can give for a field, known before the data is read."""
    name, kind = field.lower(), _kind(spec)
    codes = ["required"] if _required(spec) else []
    if "url" in name or kind == "url":
        codes.append("invalid_url")
    elif "email" in name or kind == "email":
        codes.append("invalid_email")
    elif "date" in name or name.endswith("_from") or kind == "date":
        codes.append("implausible_date")
    elif name in ("price", "salary", "original_price"):
        codes += ["missing_number", "negative_value"]
    elif kind in ("number", "integer"):
        codes += ["invalid_number", "below_minimum", "above_maximum"]
    elif name in ("rooms", "rating", "reviews_count"):
        codes.append("negative_value")
    return codes


def _kind(spec: Any) -> str:
    return str(spec.get("type", "")).lower() if isinstance(spec, dict) else ""


def _required(spec: Any) -> bool:
    return isinstance(spec, dict) and bool(spec.get("required"))


def field_error(
    field: str, value: Column, spec: Any = None, *, stripped: bool = False
) -> Column:
    """Error code of one value, or null when it is plausible.

    The branch is chosen on the driver from the field's name and spec, so the plan
    holds only the checks that can apply.
    """
    text = value if stripped else strip(value)
    codes = possible_errors(field, spec)
    check = F.lit(None).cast("string")
    if "invalid_url" in codes:
        # Schemes are case-insensitive, and a host must follow.
        check = F.when(~text.rlike(r"(?i)^https?://[^/?#]"), "invalid_url")
    elif "invalid_email" in codes:
        check = F.when(~text.rlike(_EMAIL), "invalid_email")
    elif "implausible_date" in codes:
        check = F.when(~(text.rlike(_LOOSE_DATE) | _iso_date(text)), "implausible_date")
    elif "missing_number" in codes:
        check = F.when(~text.rlike(r"(?U)\d"), "missing_number").when(
            text.rlike(r"(?U)(?:^|\s)-\s*\d"), "negative_value"
        )
    elif "invalid_number" in codes:
        number = _number(text)
        check = F.when(number.isNull(), "invalid_number")
        # A NaN passes both bounds, as an unordered comparison does.
        if spec.get("min") is not None:
            check = check.when(
                ~F.isnan(number) & (number < float(spec["min"])), "below_minimum"
            )
        if spec.get("max") is not None:
            check = check.when(
                ~F.isnan(number) & (number > float(spec["max"])), "above_maximum"
            )
    elif "negative_value" in codes:
        first = F.regexp_extract(text, r"(-?\d+(?:[.,]\d+)?)", 1)
        check = F.when(
            F.regexp_replace(first, ",", ".").try_cast("double") < 0, "negative_value"
        )
    absent = F.lit("required" if _required(spec) else None).cast("string")
    return F.when(is_present(text, stripped=True), check).otherwise(absent)
