"""Opaque page cursors: URL-safe base64 of `{"ts": ..., "eid": ...}`, with `rank` on ranked pages."""

from __future__ import annotations

import base64
import binascii
import json
from datetime import datetime
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventloom.functions.timeops import as_datetime


class Cursor(NamedTuple):
    timestamp: datetime
    event_id: str
    rank: float | None = None


def cursor_column(timestamp: Column, event_id: Column, rank: Column | None = None) -> Column:
    """Cursor text of a row, made on the executors."""
    stamp = F.date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    parts = [stamp.alias("ts"), event_id.alias("eid")]
    if rank is not None:
        parts.append(rank.alias("rank"))
    body = F.to_json(F.struct(*parts))
    # Long texts come in lines.
    return F.translate(F.base64(body.cast("binary")), "+/\r\n", "-_")


def decode_cursor(text: str) -> Cursor:
    """Position held by a cursor given as an argument; ValueError when it is not one."""
    try:
        body = json.loads(base64.b64decode(text, altchars=b"-_", validate=True))
        return Cursor(as_datetime(body["ts"]), body["eid"], body.get("rank"))
    except (binascii.Error, UnicodeDecodeError, KeyError, TypeError, AttributeError) as error:
        raise ValueError(f"invalid cursor: {text!r}") from error
