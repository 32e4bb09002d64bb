"""Shared helpers: the folder for intermediate tables, caches of Python workers, rows from Arrow batches."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions.storage import counted, drop_stored, session_path, shared_path, shared_root, stored

__all__ = ["batches", "counted", "crc_mod", "drop_stored", "session_path", "shared_path", "shared_root", "smallest_hashes", "stored", "worker_cache"]

_WORKER: dict[tuple, object] = {}


def _trim() -> None:
    """Give freed memory back to the system, where the C library can: a worker's next operator needs it, or the executor does."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def worker_cache(name: str, key, make):
    """make(), kept from task to task in a Python worker. A worker keeps one such object: asking for another drops it, so one
    operator's cache, whose size is bounded, is all that a reused worker holds."""
    if (name, key) not in _WORKER:
        _WORKER.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        _trim()
        _WORKER[name, key] = make()
        _trim()
    return _WORKER[name, key]


def crc_mod(doc_id, n: int):
    """crc32 of the id as text, modulo n; null ids count as 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % n, F.lit(0))


def smallest_hashes(rows, share: float, key: str = "doc_id"):
    """About that share of the rows, by the smallest 64-bit hashes of key; all rows for a share of 1. The hash's whole range counts, so the share may be as small as 1e-18."""
    limit = -(1 << 63) + int(share * (1 << 64))
    return rows if share >= 1 else rows.where(F.xxhash64(key) < F.lit(limit))


def batches(it, columns: list[str], max_bytes: int = 2_000_000):
    """Lists of row tuples from Arrow batches, cut so that one list holds about max_bytes of strings."""
    for batch in it:
        cols = [batch.column(batch.schema.get_field_index(c)) for c in columns]
        rows, held = [], 0
        for i in range(batch.num_rows):
            row = tuple(c[i].as_py() for c in cols)
            rows.append(row)
            held += sum(len(v) for v in row if isinstance(v, (str, bytes)))
            if held >= max_bytes or len(rows) >= 5_000:
                yield rows
                rows, held = [], 0
        if rows:
            yield rows
