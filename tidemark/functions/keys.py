"""Content-derived keys and portable hashes.

``ph`` is the only randomness in the package: the first 15 hex digits of an MD5 as a
60-bit integer. It does not depend on partitioning, row order or the engine, so a sample
or split drawn today is drawn again tomorrow, and any SQL engine can reproduce it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PH_BITS = 60


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def composite_key(*cols: Column | str, sep: str = "|") -> Column:
    """``a|b|c`` string key. Nulls are skipped, as in ``concat_ws``."""
    return F.concat_ws(sep, *[_col(c).cast("string") for c in cols])


def ph(key: Column | str) -> Column:
    """Portable 60-bit hash of a string key."""
    return F.conv(F.substring(F.md5(_col(key).cast("string")), 1, 15), 16, 10).cast("long")


def _seeded(seed: int | str | Column, key: Column | str) -> Column:
    s = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.concat(s.cast("string"), F.lit(":"), _col(key).cast("string"))


def seeded_ph(seed: int | str | Column, key: Column | str) -> Column:
    """``ph(seed:key)``: an independent order of the same keys for every seed."""
    return ph(_seeded(seed, key))


def seeded_hex(seed: int | str | Column, key: Column | str) -> Column:
    """The 15 hex digits of ``seeded_ph``: the same order as text."""
    return F.substring(F.md5(_seeded(seed, key)), 1, PH_BITS // 4)


def item_id(user: Column | str, asin: Column | str, ts: Column | str, text_hash: Column | str) -> Column:
    """Stable record id over the columns that define a record, unique once records are deduplicated."""
    return F.md5(composite_key(user, asin, ts, text_hash))


def in_tenths(key: Column | str, tenths: int = 8) -> Column:
    """True for the keys whose hash falls in the first ``tenths`` of ten equal parts."""
    return F.pmod(ph(key), F.lit(10)) < tenths
