from .risk import (as_percent, bar_width, day_label, format_number, format_percent,
                   gauge_percent, interpretation, month_label, warning_active, warning_level, warning_message,
                   warning_tone, year_label)
from .values import (clean_number, clean_text, clean_values, conform, lenient_double,
                     numeric_columns, require_columns, to_flag)

__all__ = [
    "as_percent", "bar_width", "clean_number", "clean_text", "clean_values", "conform",
    "day_label", "format_number", "format_percent", "gauge_percent", "interpretation", "lenient_double", "month_label",
    "numeric_columns", "require_columns", "to_flag", "warning_active", "warning_level",
    "warning_message", "warning_tone", "year_label",
]
