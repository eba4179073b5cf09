"""Byte tables: lower-casing A-Z and cutting UTF-8 texts into words at ASCII separators."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _translated(byte: int) -> int:
    if 0x41 <= byte <= 0x5A:
        return byte + 0x20
    return byte if byte >= 0x80 or chr(byte).isalnum() else 0x20


#: Letters A-Z become a-z; digits, a-z and all bytes of non-ASCII characters stay; the rest is blank.
LOWER_AND_BLANK = bytes(map(_translated, range(256)))


def utf8(column: str = "text") -> Column:
    """A text column as its UTF-8 bytes, so that tasks need not encode it again."""
    return F.col(column).cast("string").cast("binary")


def terms(text: bytes | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and non-ASCII characters; none for null."""
    return text.translate(LOWER_AND_BLANK).split() if text else []


def values(column: pa.Array):
    """The Python values of a column, a thousand at a time."""
    for at in range(0, len(column), 1000):
        yield from column.slice(at, 1000).to_pylist()
