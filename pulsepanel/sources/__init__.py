from pulsepanel.sources.sinks import (
    materialize, read_report_csv, remove_scratch, write_json_summary, write_parquet,
    write_report_csv,
)
from pulsepanel.sources.tables import (
    ensure_columns, period_list, read_table, require_columns, require_rows, scan_month_filter,
)

__all__ = [
    "materialize", "read_report_csv", "remove_scratch", "write_json_summary",
    "write_parquet", "write_report_csv", "ensure_columns", "period_list",
    "read_table", "require_columns", "require_rows", "scan_month_filter",
]
