"""Sources: policy-gated CSV, tables, and sinks for results."""

from .csv import IoBudget, IoError, Policy, check_resource, read_csv, read_csv_frame
from .sinks import dump_lines, lines, write_result

__all__ = ["IoBudget", "IoError", "Policy", "check_resource", "dump_lines", "lines", "read_csv", "read_csv_frame", "write_result"]
