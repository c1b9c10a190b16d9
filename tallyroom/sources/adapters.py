"""Provider adapters: payload bytes of one source to canonical rows."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame

ROW_SCHEMA = "source_id string, record_id string, name string, reason string"

Parser = Callable[[bytes], list[tuple]]


def json_directory(payload: bytes) -> list[tuple]:
    """``{"records": [{"id", "name"}]}`` with a closed field set."""
    rows = []
    for record in json.loads(payload.decode("utf-8"))["records"]:
        unknown = sorted(set(record) - {"id", "name"})
        reason = f"unknown field {unknown[0]}" if unknown else None if record.get("name") else "empty name"
        rows.append((str(record.get("id")), record.get("name"), reason))
    return rows


def csv_directory(payload: bytes) -> list[tuple]:
    """``id,name`` with a header, UTF-8 with an optional byte-order mark, else
    Windows-1252."""
    try:
        text = payload.decode("utf-8-sig")
    except UnicodeDecodeError:
        text = payload.decode("cp1252")
    reader = csv.reader(io.StringIO(text))
    if next(reader, None) != ["id", "name"]:
        return [(None, None, "header changed")]
    return [(row[0], row[1], None) if len(row) == 2 else (row[0] if row else None, None, "wrong number of cells") for row in reader]


ADAPTERS: dict[str, Parser] = {
    "json-directory": json_directory,
    "csv-directory": csv_directory,
}


def parsed(parser: Parser | None, payload: bytes | None) -> list[tuple]:
    """Rows of one payload; a payload its adapter cannot read is one refused row."""
    if parser is None:
        return [(None, None, "no adapter")]
    try:
        return parser(payload)
    except (ValueError, LookupError, TypeError, AttributeError, csv.Error) as problem:
        return [(None, None, f"unreadable payload: {type(problem).__name__}")]


def parse_payloads(payloads: DataFrame, adapters: dict[str, Parser] | None = None) -> DataFrame:
    """``payloads(source_id, adapter, payload)`` to canonical rows, each payload
    by its named adapter; an unknown adapter, or a payload that it cannot read, is
    refused, not guessed."""
    registry = dict(adapters or ADAPTERS)

    def run(batches):
        for batch in batches:
            out = []
            for source_id, adapter, payload in zip(batch["source_id"], batch["adapter"], batch["payload"]):
                rows = parsed(registry.get(adapter), payload)
                out.extend((source_id, *row) for row in rows)
            yield pd.DataFrame(out, columns=["source_id", "record_id", "name", "reason"])

    return payloads.select("source_id", "adapter", "payload").mapInPandas(run, ROW_SCHEMA)
