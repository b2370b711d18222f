"""When scheduled work is due. The clock is given; a scheduler outside calls this and starts `availableNow` runs."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

SYNC_EVERY, EXTRACT_EVERY, NIGHTLY_HOUR = dt.timedelta(hours=1), dt.timedelta(hours=6), 3


@dataclass(frozen=True)
class Due:
    sync: bool
    extract: bool


def due(now: dt.datetime, last_sync: dt.datetime | None, last_extract: dt.datetime | None) -> Due:
    """Sync if never or over an hour ago; extract, once it has run, over six hours later or in the nightly hour (once an hour)."""
    sync = last_sync is None or now - last_sync > SYNC_EVERY
    since = None if last_extract is None else now - last_extract
    extract = since is not None and (since > EXTRACT_EVERY or now.hour == NIGHTLY_HOUR and since > SYNC_EVERY)
    return Due(sync, extract)
