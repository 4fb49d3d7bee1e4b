"""Data contracts: what a feed looks like and what table it must become."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import types as T

from .functions.transforms import inputs_of, parse
from .functions.values import bound, date_pattern, java_regex

TYPES = {"integer", "decimal", "string", "date", "timestamp", "boolean"}
#: SQL type names of a contract's types, as created
SQL_TYPES = {"integer": "bigint", "decimal": "decimal(38,{scale})", "string": "string", "date": "date", "timestamp": "timestamp_ntz", "boolean": "boolean"}
#: live types that each contract type accepts
ACCEPTED = {
    "integer": (T.ShortType, T.IntegerType, T.LongType),
    "decimal": (T.DecimalType,),
    "string": (T.StringType, T.VarcharType, T.CharType),
    "date": (T.DateType,),
    "timestamp": (T.TimestampNTZType, T.TimestampType),
    "boolean": (T.BooleanType,),
}


#: the table property that holds a table's key
KEYS_PROPERTY = "keys"


class ContractError(ValueError):
    """The contract itself is wrong; raised before any data is read."""


@dataclass(frozen=True)
class Column:
    name: str
    type: str
    nullable: bool
    source_name: str | None = None
    transform: str | None = None
    unique: bool = False
    scale: int = 2
    max_length: int | None = None
    range: tuple[Any, Any] | None = None
    allowed_values: tuple[str, ...] | None = None
    regex: str | None = None
    date_format: str = "%Y-%m-%d"
    ts_format: str | None = None

    @property
    def sql_type(self) -> str:
        return SQL_TYPES[self.type].format(scale=self.scale)


@dataclass(frozen=True)
class Contract:
    name: str
    version: str
    table: str
    keys: tuple[str, ...]
    columns: tuple[Column, ...]
    source: dict[str, Any] = field(default_factory=dict)
    metadata: dict[str, Any] = field(default_factory=dict)

    def column(self, name: str) -> Column:
        return next(c for c in self.columns if c.name == name)

    @property
    def source_columns(self) -> list[str]:
        return list(self.source.get("columns", []))

    def struct(self) -> T.StructType:
        """The target's schema, with the contract's nullability."""
        kinds = {"integer": T.LongType(), "string": T.StringType(), "date": T.DateType(), "timestamp": T.TimestampNTZType(), "boolean": T.BooleanType()}
        return T.StructType([T.StructField(c.name, T.DecimalType(38, c.scale) if c.type == "decimal" else kinds[c.type], c.nullable) for c in self.columns])

    def ddl(self) -> str:
        """CREATE TABLE text; Spark has no enforced key, so keys are a table property."""
        kind = lambda c: f"varchar({c.max_length})" if c.type == "string" and c.max_length else c.sql_type
        cols = ", ".join(f"`{c.name}` {kind(c)}" + ("" if c.nullable else " NOT NULL") for c in self.columns)
        keys = ",".join(self.keys)
        return f"CREATE TABLE IF NOT EXISTS {self.table} ({cols}) USING parquet TBLPROPERTIES ('{KEYS_PROPERTY}' = '{keys}')"


def load(raw: dict[str, Any] | str, unknown_inputs: bool = False) -> Contract:
    """A contract from a dict or YAML text, checked in full: required fields, types, ranges,
    keys that are columns, inputs that are in the feed, transforms and formats that parse. With
    ``unknown_inputs``, placeholders that the feed lacks are let through and render as nothing."""
    if isinstance(raw, str):
        import yaml

        raw = yaml.safe_load(raw)
    missing = [k for k in ("contract_name", "version", "source", "target", "keys", "columns") if not raw.get(k)]
    if missing:
        raise ContractError(f"missing: {', '.join(missing)}")
    feed = set(raw["source"].get("columns", []))
    columns = []
    for c in raw["columns"]:
        where = c.get("name", "?")
        if not {"name", "type", "nullable"} <= set(c):
            raise ContractError(f"column {where}: name, type and nullable are required")
        if c["type"] not in TYPES:
            raise ContractError(f"column {where}: unknown type {c['type']}")
        if "range" in c and len(c["range"]) != 2:
            raise ContractError(f"column {where}: range needs two numbers")
        for b in c.get("range", ()):
            bound(b)
        if not c.get("source_name") and not c.get("transform"):
            raise ContractError(f"column {where}: neither source_name nor transform")
        inputs = inputs_of(parse(c["transform"], feed)) if c.get("transform") else []
        used = ([c["source_name"]] if c.get("source_name") else []) + ([] if unknown_inputs else inputs)
        if feed and set(used) - feed:
            raise ContractError(f"column {where}: not in the feed: {', '.join(sorted(set(used) - feed))}")
        for key in ("date_format", "ts_format"):
            if c.get(key):
                date_pattern(c[key])
        if c.get("regex"):
            java_regex(c["regex"])
        own = {k: v for k, v in c.items() if k in Column.__dataclass_fields__}
        own |= {k: tuple(c[k]) for k in ("range",) if k in c} | ({"allowed_values": tuple(map(str, c["allowed_values"]))} if "allowed_values" in c else {})
        columns.append(Column(**own))
    names = [c.name for c in columns]
    if len(set(names)) < len(names):
        raise ContractError("repeated column name")
    if set(raw["keys"]) - set(names):
        raise ContractError(f"keys that are no column: {', '.join(sorted(set(raw['keys']) - set(names)))}")
    return Contract(raw["contract_name"], str(raw["version"]), raw["target"]["table"], tuple(raw["keys"]), tuple(columns), raw["source"], raw.get("metadata", {}))
