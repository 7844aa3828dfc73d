"""Keys: bytewise ordered text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_KEY_BYTES, MAX_VALUE_BYTES = 1 << 20, 5 << 20
DEFAULT_COLLECTION = "default"


def prefix_successor(prefix: str) -> str | None:
    """The least text above every text that starts with ``prefix``; None if there is none."""
    while prefix:
        code = ord(prefix[-1]) + 1
        if code <= 0x10FFFF:
            # surrogates are no characters
            return prefix[:-1] + chr(0xE000 if code == 0xD800 else code)
        prefix = prefix[:-1]
    return None


def valid_collection_name(name: str) -> bool:
    return re.fullmatch(r"[A-Za-z0-9-]+", name) is not None


def padded(prefix: Column, number: Column, width: int = 10) -> Column:
    """``prefix:number`` with leading zeros, so that keys order as the numbers do."""
    return F.concat(prefix, F.lit(":"), F.lpad(number.cast("string"), width, "0"))


def key_crc32(key: Column) -> Column:
    """The IEEE checksum of a key's bytes."""
    return F.crc32(key.cast("binary"))
