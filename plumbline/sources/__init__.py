from .datasets import dataset_meta, open_dataset, read_table, register_dataset, rows_per_file
from .delimited import read_csv
from .rulefile import load_rules
from .sinks import load_table, write_csv, write_parquet
from .workbook import decode_workbooks, read_workbooks, read_xlsx

__all__ = [
    "dataset_meta",
    "decode_workbooks",
    "load_rules",
    "load_table",
    "open_dataset",
    "read_csv",
    "read_table",
    "read_workbooks",
    "read_xlsx",
    "register_dataset",
    "rows_per_file",
    "write_csv",
    "write_parquet",
]
