"""The texts of messages, which users' reports rely on."""

from __future__ import annotations

HEADER_COUNT = "header column count: expected {expected}, got {got}"
HEADER_NAME = "header column {i}: expected '{expected}', got '{got}'"
NOT_DECODABLE = "file not decodable as {encoding}: {lines} lines"
EMPTY_FILE = "file is empty"
RAGGED = "ragged rows (col count != {width}) at lines {lines}"
ROW_COUNT = "row count: expected {expected}, got {got}"
NO_TABLE = "table {table} does not exist"
COLUMN_ORDER = "column order/count mismatch: expected {expected}, got {got}"
MISSING_COLUMN = "missing column '{column}'"
TYPE_MISMATCH = "column '{column}' type mismatch: expected {expected}, got {got}"
NULLABILITY = "column '{column}' nullability mismatch: expected nullable={expected}, got {got}"
PRIMARY_KEY = "primary key mismatch: expected {expected}, got {got}"
READ_ONLY = "refusing to load under a read-only session"
CONTROL_TOTAL = "control total {column} {measure}: expected {expected}, got {got}"
