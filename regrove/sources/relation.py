"""From a table name, a DataFrame, a pandas frame, a path or a reader call to a DataFrame."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

READER = re.compile(r"^\s*(?:read|scan)_(\w+?)(?:_auto|_scan)?\s*\((.*)\)\s*$", re.DOTALL)
#: Arguments of reader calls by Spark's option; those of an empty name say what Spark does anyway.
OPTIONS = {
    "csv": {"delim": "sep", "sep": "sep", "delimiter": "sep", "header": "header", "quote": "quote", "escape": "escape", "nullstr": "nullValue", "null": "nullValue", "comment": "comment", "dateformat": "dateFormat", "timestampformat": "timestampFormat", "encoding": "encoding", "ignore_errors": "mode"},
    "json": {"dateformat": "dateFormat", "timestampformat": "timestampFormat", "ignore_errors": "mode"},
    "parquet": {"union_by_name": "mergeSchema"},
}
SAYS_NOTHING = {"hive_partitioning", "auto_detect", "compression", "sample_size", "parallel"}
#: Endings and names of readers by Spark's format.
FORMATS = {"parquet": "parquet", "pq": "parquet", "csv": "csv", "tsv": "csv", "txt": "csv", "json": "json", "ndjson": "json", "jsonl": "json", "orc": "orc", "avro": "avro"}


def relation(spark: SparkSession | None = None, *, table: Any = None, data: Any = None, path: str | None = None) -> DataFrame:
    """The input; where several are given, ``table`` goes before ``data`` and ``data`` before ``path``.

    ``table``: the name of a table or view, a SQL query, or a DataFrame; ``data``: a DataFrame, pandas frame or Arrow table; ``path``: files of one
    format by a path or glob (hive partitions become columns), or a call like ``read_parquet('path')``.
    """
    spark = spark or SparkSession.builder.getOrCreate()
    if table is not None:
        if isinstance(table, DataFrame) or hasattr(table, "sparkSession"):
            return table
        return spark.sql(table) if re.match(r"\s*(select|with)\s", table, re.IGNORECASE) else spark.table(table)
    if data is not None:
        return data if hasattr(data, "sparkSession") else spark.createDataFrame(data)
    if path is not None:
        return read_path(spark, path)
    raise ValueError("give one of table, data and path")


def reader_call(text: str) -> tuple[list[str], dict[str, object]]:
    """(paths, arguments) of what stands in a reader call's parentheses: a text or a list of texts, then ``name = value``."""
    value = r"'(?:[^']|'')*'|\[[^\]]*\]|\{[^}]*\}|[\w.+-]+"
    parts = list(re.finditer(rf"\s*(?:(\w+)\s*:?=\s*)?({value})\s*(,|$)", text.strip(), re.DOTALL))
    if "".join(m[0] for m in parts) != text.strip() or not parts or parts[0][1]:
        raise ValueError(f"a reader call is a path or a list of paths, then name = value: {text!r}")
    unquoted = lambda x: x[1:-1].replace("''", "'")
    paths = [unquoted(x) for x in re.findall(r"'(?:[^']|'')*'", parts[0][2])]
    if not paths:
        raise ValueError(f"no path in a reader call: {text!r}")
    given: dict[str, object] = {}
    for m in parts[1:]:
        if not m[1] or m[2][0] in "[{":
            raise ValueError(f"not understood in a reader call: {m[0].strip(' ,')!r}")
        given[m[1].lower()] = unquoted(m[2]) if m[2][0] == "'" else {"true": True, "false": False}.get(m[2].lower(), m[2])
    return paths, given


def read_path(spark: SparkSession, path: str) -> DataFrame:
    """Files by path or glob, or by a reader call, whose arguments become Spark's options; one that has no equal raises."""
    call, options = READER.match(path), {}
    if call:
        kind = FORMATS.get(call[1].lower())
        if not kind:
            raise ValueError(f"no reader for {call[1]!r}")
        paths, given = reader_call(call[2])
        for name, value in given.items():
            if name in SAYS_NOTHING:
                continue
            if name not in OPTIONS.get(kind, {}):
                raise ValueError(f"read_{call[1]} has no argument {name!r} here")
            if OPTIONS[kind][name] == "mode":
                value = "DROPMALFORMED" if value is True else "PERMISSIVE"
            options[OPTIONS[kind][name]] = value
    else:
        paths = [path.strip().strip("\"'")]
        plain = re.sub(r"\.(gz|bz2|zst|snappy)$", "", paths[0].rstrip("/*"))
        kind = FORMATS.get(plain.rpartition(".")[2].lower(), "parquet")
    reader = spark.read.format(kind)
    if kind == "csv":
        reader = reader.option("header", True).option("inferSchema", True)
        if paths[0].rstrip("/*").endswith((".tsv", ".txt")):
            reader = reader.option("sep", "\t")
    reader = reader.options(**options)
    if len(paths) > 1:
        return reader.load(paths)
    path = paths[0]
    if "**" in path:  # files at any depth below; directories like year=2012 become columns
        root, _, name = path.partition("**")
        if (name := name.strip("/")) and name not in ("*", "*.*"):
            reader = reader.option("pathGlobFilter", name.rpartition("/")[2])
        return reader.load(root.rstrip("/"))
    return reader.load(path)


def kind_of(df: DataFrame, name: str) -> str:
    """``factor`` (strings, booleans), ``numeric``, or ``other`` (dates and times: fixed effects and clusters only)."""
    found = {f.name.lower(): f.dataType for f in df.schema}.get(name.lower())
    if found is None:
        raise ValueError(f"no column {name!r}")
    if isinstance(found, (T.StringType, T.BooleanType, T.CharType, T.VarcharType)):
        return "factor"
    if isinstance(found, T.NumericType):
        return "numeric"
    if isinstance(found, (T.ArrayType, T.MapType, T.StructType, T.BinaryType)):
        raise ValueError(f"column {name!r} is of a type that no model can use: {found.simpleString()}")
    return "other"


def complete_rows(df: DataFrame, names: list[str]) -> DataFrame:
    """Rows without a null in any of the columns; pushed down to the scan."""
    out = df
    for n in names:
        out = out.where(F.col(f"`{n}`").isNotNull())
    return out
