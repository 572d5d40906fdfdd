"""Zone transition tables: wall clock times to instants, many at once.

A table holds, for one zone of one release of the time zone database, every
change of offset as two arrays: the wall clock times up to which an offset
holds, and the offsets. Reading a wall clock time is then one binary search.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from functools import lru_cache
from pathlib import Path
from zoneinfo import TZPATH, ZoneInfo

import numpy as np

FIRST_YEAR, LAST_YEAR = 1900, 2100
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


@lru_cache(maxsize=1)
def release() -> str:
    """Release of the time zone database that the tables are made from."""
    for folder in TZPATH:
        path = Path(folder, "tzdata.zi")
        if path.exists():
            return path.open().readline().split()[-1]
    try:
        import tzdata

        return tzdata.IANA_VERSION
    except ImportError:
        return "unknown"


def _offset(zone: ZoneInfo, second: int) -> int:
    return int((_EPOCH + timedelta(seconds=second)).astimezone(zone).utcoffset().total_seconds())


@lru_cache(maxsize=1024)
def _table(version: str, name: str) -> tuple[np.ndarray, np.ndarray] | None:
    try:
        zone = ZoneInfo(name)
    except Exception:  # an unknown or malformed name
        return None
    start = int((datetime(FIRST_YEAR, 1, 1, tzinfo=timezone.utc) - _EPOCH).total_seconds())
    end = int((datetime(LAST_YEAR, 1, 1, tzinfo=timezone.utc) - _EPOCH).total_seconds())
    week = 7 * 86400
    offsets, until = [_offset(zone, start)], []
    for left in range(start, end, week):
        right = min(left + week, end)
        before = offsets[-1]
        while _offset(zone, right) != before:
            low, high = left, right
            while high - low > 1:
                middle = (low + high) // 2
                if _offset(zone, middle) == before:
                    low = middle
                else:
                    high = middle
            after = _offset(zone, high)
            until.append(high + max(before, after))
            offsets.append(after)
            before, left = after, high
    return np.array(until, dtype=np.int64), np.array(offsets, dtype=np.int64)


def transitions(name: str) -> tuple[np.ndarray, np.ndarray] | None:
    """(wall clock seconds up to which each offset holds, offsets in seconds); None for an unknown zone."""
    return _table(release(), name)


def wall_to_utc(seconds: np.ndarray, name: str) -> np.ndarray | None:
    """Instants, in seconds, of wall clock times of a zone.

    Of a time that occurs twice the earlier instant counts; a time that is
    skipped moves forward by the length of the gap. In both cases the offset
    before the change holds.
    """
    found = transitions(name)
    if found is None:
        return None
    until, offsets = found
    return seconds - offsets[np.searchsorted(until, seconds, side="right")]
