from .text import is_number, lower_case, nan_to_null, number_of, python_regex, strip, to_number, upper_case
from .times import coerce_timestamp, iso_text, micros, strict_timestamp, timestamp_text, truncate

__all__ = [
    "coerce_timestamp",
    "is_number",
    "iso_text",
    "lower_case",
    "micros",
    "nan_to_null",
    "number_of",
    "python_regex",
    "strict_timestamp",
    "strip",
    "timestamp_text",
    "to_number",
    "truncate",
    "upper_case",
]
