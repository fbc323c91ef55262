"""Content hashes and stable ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_uuid(c: Column) -> Column:
    """The MD5 of a key in UUID form."""
    h = F.md5(c.cast("binary"))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def content_hash(**fields: Column) -> Column:
    """SHA-256 of the fields as JSON with sorted names; nulls count as absent."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)])), 256)


def ordered_hash(parts: Column) -> Column:
    """SHA-256 over an array of hashes, each followed by a bar."""
    return F.sha2(F.concat(F.array_join(parts, "|"), F.when(F.size(parts) > 0, "|").otherwise("")), 256)
