"""Identities: content hashes and name-based ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the namespace of point ids.
NAMESPACE = "6f9619ff8b86d011b42d00c04fc964ff"


def content_id(content: Column) -> Column:
    """SHA-256 of the content, in hex."""
    return F.sha2(content.cast("binary"), 256)


def point_id(key: Column) -> Column:
    """Name-based UUID (version 5) of a key, without a Python function."""
    h = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE)), F.encode(key, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))
