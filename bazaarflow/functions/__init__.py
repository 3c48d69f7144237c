"""Column functions; all are built from Spark's own expressions."""

from bazaarflow.functions.labels import (
    area_label_list, area_label_queue, asset_path, capitalize, contact, date_label,
    display_name, initial, money_label, status_label, user_name,
)
from bazaarflow.functions.predicates import booking_bucket, mask_contact, text_match
from bazaarflow.functions.values import (
    first_truthy, first_truthy_number, is_unfit_number, js_number, msisdn, normalize_phone, number_or_zero,
    parse_list, slot_minutes, split_name,
)

__all__ = [
    "area_label_list", "area_label_queue", "asset_path", "booking_bucket", "capitalize",
    "contact", "date_label", "display_name", "first_truthy", "first_truthy_number", "initial",
    "is_unfit_number", "js_number", "mask_contact", "money_label", "msisdn", "normalize_phone", "number_or_zero",
    "parse_list", "slot_minutes", "split_name", "status_label", "text_match",
    "user_name",
]
