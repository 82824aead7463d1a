from .anomaly import (
    analysis_context,
    anomaly_rows,
    classic,
    esd,
    iqr,
    moving_average,
    narrative,
    summary,
    zscore,
)
from .asof import asof_join
from .clean import clean, clean_counts, clean_observed, drop_duplicate_rows, string_columns
from .decompose import analyze, auto_anomalies, mstl_anomalies, stl_anomalies
from .distinct import exact_distinct, repeated_values
from .infer import coerce_timestamps, date_fractions, infer_date_col, infer_value_col
from .profile import (
    column_profile,
    column_types,
    display_profile,
    first_rows,
    numeric_columns,
    profile_dataset,
    random_rows,
    sample_by_key,
    summarize,
    table_shape,
)
from .profilestate import merge_states, profile_of, profile_state
from .quantile import exact_quantiles
from .rangecount import count_within
from .rangejoin import range_join
from .series import long_enough, ordered, resample, series_points
from .sqlrun import QueryError, distinct_on, preview_sql, run_sql
from .validate import (
    check_counts,
    compile_rules,
    list_rules_report,
    repeated_rows,
    unique_examples,
    validate_dataframe,
    validation_report,
    violating_rows,
)

__all__ = [name for name in dir() if not name.startswith("_")]
