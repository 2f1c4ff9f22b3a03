"""Query parameters: lenient parsing (P17), limit clamp (T2) and the filter builder (F1-F8)."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import BLOCK_BUCKET_SIZE, DEFAULT_LIMIT, MAX_LIMIT

_INT = re.compile(r"^[+-]?[0-9]+$")
_UINT = re.compile(r"^\+?[0-9]+$")
# RFC 3339 date-time: date, 'T', time, optional fraction, 'Z' or a numeric offset.
_RFC3339 = re.compile(
    r"^(\d{4})-(\d{2})-(\d{2})T(\d{2}):(\d{2}):(\d{2})(\.\d+)?(Z|[+-]\d{2}:[0-5]\d)$"
)
_INT64_MAX = 2**63 - 1
_UINT64_MAX = 2**64 - 1


@dataclass(frozen=True)
class TransferQueryParams:
    token: str = ""
    from_: str = ""
    to: str = ""
    start_block: int | None = None
    end_block: int | None = None
    start_time: datetime | None = None  # aware or naive UTC
    end_time: datetime | None = None
    limit: int = DEFAULT_LIMIT
    offset: int = 0


def _parse_int(s: str) -> int | None:
    if not _INT.match(s):
        return None
    v = int(s)
    return v if -_INT64_MAX - 1 <= v <= _INT64_MAX else None


def _parse_uint(s: str) -> int | None:
    if not _UINT.match(s):
        return None
    v = int(s)
    return v if v <= _UINT64_MAX else None


def parse_rfc3339(s: str) -> datetime | None:
    """RFC 3339 timestamp as an aware datetime; None when it does not parse."""
    if not _RFC3339.match(s):
        return None
    try:
        return datetime.fromisoformat(s.replace("Z", "+00:00"))
    except ValueError:
        return None


def parse_params(query: dict[str, str], listing: bool = True) -> TransferQueryParams:
    """Parameters from a request's query string; unparsable numbers and times are ignored."""
    p: dict = {}
    for key, field in (("token", "token"), ("from", "from_"), ("to", "to")):
        if query.get(key):
            p[field] = query[key]
    if listing:
        for key in ("limit", "offset"):
            if query.get(key):
                v = _parse_int(query[key])
                if v is not None:
                    p[key] = v
    for key in ("start_block", "end_block"):
        if query.get(key):
            v = _parse_uint(query[key])
            if v is not None:
                p[key] = v
    for key in ("start_time", "end_time"):
        if query.get(key):
            v = parse_rfc3339(query[key])
            if v is not None:
                p[key] = v
    return TransferQueryParams(**p)


def effective_limit(limit: int) -> int:
    """<= 0 becomes the default page, above the maximum becomes the maximum."""
    if limit <= 0:
        return DEFAULT_LIMIT
    return min(limit, MAX_LIMIT)


def clamp(params: TransferQueryParams) -> TransferQueryParams:
    if params.offset < 0:
        raise ValueError(f"offset must be >= 0, got {params.offset}")
    return replace(params, limit=effective_limit(params.limit))


def _utc_instant(t: datetime) -> Column:
    if t.tzinfo is not None:
        t = t.astimezone(timezone.utc).replace(tzinfo=None)
    epoch_us = (t - datetime(1970, 1, 1)) // timedelta(microseconds=1)
    return F.timestamp_micros(F.lit(epoch_us))


def build_filter(params: TransferQueryParams, normalize: bool = False) -> Column:
    """F1-F8: conjunction of the given predicates; no parameter means every row.

    Address equality is exact (stored addresses are lower case), as in the
    reference; ``normalize=True`` lower-cases the arguments first. Block bounds
    also give a ``block_bucket`` predicate, which prunes store directories.
    """
    cond = F.lit(True)

    def addr(v: str) -> str:
        return v.lower() if normalize else v

    if params.token:
        cond = cond & (F.col("token") == addr(params.token))
    if params.from_:
        cond = cond & (F.col("from") == addr(params.from_))
    if params.to:
        cond = cond & (F.col("to") == addr(params.to))
    # bounds are unsigned 64-bit, block numbers signed: no row can reach a larger start, any is below a larger end
    if params.start_block is not None:
        cond = cond & (F.col("block_number") >= F.lit(params.start_block) if params.start_block <= _INT64_MAX else F.lit(False))
    if params.end_block is not None and params.end_block <= _INT64_MAX:
        cond = cond & (F.col("block_number") <= F.lit(params.end_block))
    if params.start_time is not None:
        cond = cond & (F.col("timestamp") >= _utc_instant(params.start_time))
    if params.end_time is not None:
        cond = cond & (F.col("timestamp") <= _utc_instant(params.end_time))
    return cond


def bucket_filter(params: TransferQueryParams) -> Column | None:
    """Derived partition predicate on ``block_bucket`` (Catalyst cannot infer ``div``)."""
    cond = None
    if params.start_block is not None and params.start_block <= _INT64_MAX:
        cond = F.col("block_bucket") >= F.lit(params.start_block // BLOCK_BUCKET_SIZE)
    if params.end_block is not None and params.end_block <= _INT64_MAX:
        c = F.col("block_bucket") <= F.lit(params.end_block // BLOCK_BUCKET_SIZE)
        cond = c if cond is None else cond & c
    return cond
