"""Declared schemas: five type names (and decimal), nullable fields, natural keys."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import types as T

TYPES: dict[str, T.DataType] = {
    "string": T.StringType(),
    "double": T.DoubleType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
    "long": T.LongType(),
}


def data_type(name: str) -> T.DataType:
    """The Spark type of a declared type name; KeyError if there is none."""
    if m := re.fullmatch(r"decimal\((\d+),\s*(\d+)\)", name):
        return T.DecimalType(int(m[1]), int(m[2]))
    return TYPES[name]


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    natural_key: bool = False


@dataclass(frozen=True)
class Schema:
    key: str
    fields: tuple[Field, ...]

    @property
    def natural_keys(self) -> list[str]:
        return [f.name for f in self.fields if f.natural_key]

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, data_type(f.type), True) for f in self.fields])


def from_config(key: str, config: dict) -> Schema:
    """The schema ``config["schemas"][key]``; keys are lower case, ``<name>_<entity>`` for data."""
    fields = config["schemas"][key.lower()]["fields"]
    return Schema(key.lower(), tuple(Field(f["name"], f["type"], bool(f.get("natural_key"))) for f in fields))




def _struct(text: str) -> T.StructType:
    """"name type, …" as a schema, without a session."""
    names = (x.split() for x in text.split(", "))
    return T.StructType([T.StructField(n, data_type(t), True) for n, t in names])


#: System tables written beside every job.
SYSTEM: dict[str, T.StructType] = {
    "audit": _struct("run_id string, job_name string, target string, start_time timestamp, end_time timestamp, duration double, records_incoming long, records_inserted long, records_conflicted long, environment string, status string, load_type string"),
    "error": _struct("run_id string, source_system string, error_message string, error_time timestamp, environment string"),
    "lineage": _struct("run_id string, source_system string, source_path string, target_path string, start_time timestamp, end_time timestamp, environment string, load_type string"),
    "dq": _struct("run_id string, source_system string, entity string, rule string, records_rejected long, check_time timestamp"),
    "checkpoint": _struct("source_system string, entity string, last_ingestion_ts timestamp, last_run_id string, last_run_ts timestamp, environment string"),
}
