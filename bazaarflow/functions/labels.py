"""Display texts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from bazaarflow import texts
from bazaarflow.functions.values import first_truthy


def display_name(first: Column, last: Column, present: Column) -> Column:
    """'first last' of a joined row, 'Unknown' when nothing was joined; null parts are dropped."""
    return F.when(present, F.concat_ws(" ", first, last)).otherwise(texts.UNKNOWN)


def user_name(first: Column, last: Column) -> Column:
    return F.trim(F.concat_ws(" ", first, last))


def _joined(areas: Column) -> Column:
    return F.array_join(areas, ", ", "")


def area_label_queue(areas: Column, profile_area: Column) -> Column:
    """Listed areas (an empty list is ''), else the profile's area."""
    return F.when(areas.isNotNull(), _joined(areas)).otherwise(
        first_truthy(profile_area, F.lit(texts.NOT_SPECIFIED)))


def area_label_list(areas: Column) -> Column:
    """Listed areas; an empty or missing list is 'Not specified'."""
    return F.when(F.size(areas) > 0, _joined(areas)).otherwise(texts.NOT_SPECIFIED)


def money_label(amount: Column) -> Column:
    """Rupee amount with grouped thousands and up to three decimals."""
    return F.concat(F.lit(texts.MONEY_SIGN), F.call_function("format_number", amount, F.lit(texts.MONEY_FORMAT)))


def status_label(status: Column) -> Column:
    """Customer-facing status; 'in-progress' is one word for title case."""
    return F.when(status == "cancelled", texts.REJECTED_LABEL).otherwise(
        F.initcap(status))


def capitalize(text: Column) -> Column:
    return F.concat(F.upper(F.left(text, F.lit(1))), F.substr(text, F.lit(2)))


def date_label(moment: Column) -> Column:
    return F.date_format(moment, texts.DAY_FORMAT)


def initial(name: Column) -> Column:
    return F.coalesce(F.upper(F.left(F.nullif(name, F.lit("")), F.lit(1))), F.lit(texts.NO_INITIAL))


def contact(phone: Column, email: Column) -> Column:
    return first_truthy(phone, email)


def asset_path(folder: Column, owner: Column, uploaded_at: Column, file_name: Column) -> Column:
    """folder/owner/milliseconds-name, with the name reduced to safe characters.

    Null where any part is missing: a shorter path would name another file.
    """
    safe = F.regexp_replace(file_name, r"[^a-zA-Z0-9.\-]", "")
    stamped = F.concat(F.unix_millis(uploaded_at).cast("string"), F.lit("-"), safe)
    return F.concat(folder, F.lit("/"), owner, F.lit("/"), stamped)
