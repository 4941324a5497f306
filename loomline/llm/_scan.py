"""Vectorised scanning of UTF-8 text: token bounds and 64-bit token hashes by prefix sums, without a loop over tokens."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# Workers need not be able to import this module, nor anything of this package: no name of it may stay here.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Odd, so it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15 | 1
SPACE, LETTER, DIGIT, OTHER = 0, 1, 2, 3


def byte_classes():
    """Class of each byte; every byte of a character beyond ASCII counts as a letter."""
    import numpy as np

    cls = np.full(256, OTHER, np.uint8)
    cls[[9, 10, 11, 12, 13, 32]] = SPACE
    cls[48:58] = DIGIT
    cls[65:91] = cls[97:123] = cls[128:] = LETTER
    return cls


class Hasher:
    """Hash of buf[s:e] as the sum of (byte + 1) * BASE ** i, shifted back by the inverse; equal bytes, equal hash."""

    def __init__(self):
        import numpy as np

        self.powers = np.ones(1, np.uint64)
        self.inverse = np.ones(1, np.uint64)

    def grow(self, n: int):
        import numpy as np

        if len(self.powers) < n:
            inv = pow(BASE, -1, 1 << 64)
            with np.errstate(over="ignore"):
                self.powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, BASE, np.uint64))])
                self.inverse = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, inv, np.uint64))])

    def spans(self, buf, starts, ends):
        import numpy as np

        self.grow(len(buf) + 1)
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * self.powers[: len(buf)])])
            return mix((sums[ends] - sums[starts]) * self.inverse[starts])


def mix(h):
    """Spread the bits of a sum of powers."""
    import numpy as np

    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))


def word_hash(raw: bytes) -> int:
    """The hash that Hasher gives to these bytes, as a signed long."""
    full = (1 << 64) - 1
    h, p = 0, 1
    for b in raw:
        h = (h + (b + 1) * p) & full
        p = p * BASE & full
    h = (h ^ (h >> 31)) * 0xBF58476D1CE4E5B9 & full
    h ^= h >> 29
    return h - (1 << 64) if h >= 1 << 63 else h


def lower(buf):
    """ASCII and Latin-1 letters in lower case, byte for byte."""
    import numpy as np

    low = np.where((buf >= 65) & (buf <= 90), buf + 32, buf).astype(np.uint8)
    upper = np.zeros(len(buf), bool)
    if len(buf) > 1:
        upper[1:] = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
    low[upper] += 32
    return low


def runs(cls, kinds):
    """Starts and ends of the maximal runs of each class in kinds, in order."""
    import numpy as np

    if not len(cls):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)
    at = np.flatnonzero(np.concatenate([[True], cls[1:] != cls[:-1]]))
    ends = np.append(at[1:], len(cls))
    kind = cls[at]
    keep = np.isin(kind, kinds)
    return at[keep], ends[keep], kind[keep]


#: Largest Arrow batch that Spark hands to a worker; a smaller setting of the session stays.
BATCH_ROWS, BATCH_BYTES = 1024, 8 << 20


def over(rows, run, schema):
    """rows.mapInArrow(run, schema) with small batches and workers that give their memory back when a task ends."""
    conf, jvm = rows.sparkSession.conf, rows.sparkSession.sparkContext._jvm
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = conf.get(key)
        if now.startswith("-") or not 0 < jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(now) <= most:
            conf.set(key, str(most))

    def task(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return rows.mapInArrow(task, schema)


def release():
    """Give freed memory back to the machine: workers are used again by later tasks, which need it themselves."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batches, rows: int = 1024, size: int = 4 << 20):
    """Arrow batches in parts of at most `rows` rows and about `size` bytes of strings (or one row), so that a worker
    holds few texts as Python objects."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for b in batches:
        lens = np.zeros(b.num_rows, np.int64)
        for c in b.columns:
            if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type):
                lens += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        upto, s = np.concatenate([[0], np.cumsum(lens)]), 0
        while s < b.num_rows:
            e = min(s + rows, max(s + 1, int(np.searchsorted(upto, upto[s] + size, "right")) - 1))
            yield b.slice(s, e - s)
            s = e


def groups(raws: list[bytes], limit: int = 1 << 19):
    """Indices of consecutive texts of together about `limit` bytes; a longer text comes alone."""
    at, size = [], 0
    for i, r in enumerate(raws):
        if at and size + len(r) > limit:
            yield at
            at, size = [], 0
        at.append(i)
        size += len(r) + 1
    if at:
        yield at
