"""Byte ranges over HTTP, with a policy by status, a time limit for each attempt and waits with jitter."""

from __future__ import annotations

import random
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable

from pointquarry.functions.transfer import MIB, RETRYABLE

#: Attempts at a range, the first wait in seconds and the longest, and the least time limit of an attempt.
ATTEMPTS, WAIT_S, MOST_S, LIMIT_S = 4, 0.3, 3.0, 10.0


class RangeError(ValueError):
    """A response that another attempt cannot mend."""


class Ranges:
    """Reads ranges of one file. The size of the file is learnt from the first good response, so a later one cannot pretend
    that the file ends where it was cut short."""

    def __init__(self, url: str, attempts: int = ATTEMPTS, wait_s: float = WAIT_S, limit_s: float = LIMIT_S, seed: int | None = None, sleep: Callable[[float], None] = time.sleep):
        self.url, self.attempts, self.wait_s, self.limit_s, self.sleep = url, attempts, wait_s, limit_s, sleep
        self.total: int | None = None
        self.jitter = random.Random(seed)

    def waits(self, attempt: int) -> float:
        """Between the doubled wait and twice that, never more than the longest."""
        return min(MOST_S, self.wait_s * 2**attempt * (1 + self.jitter.random()))

    def checked(self, begin: int, end: int, status: int, stated: str | None, data: bytes) -> bytes:
        """The bytes if they are those asked for; too few raise an ``OSError``, which is tried again, the rest a ``RangeError``."""
        found = re.search(r"/\s*(\d+)\s*$", stated or "")
        total = self.total if self.total is not None else int(found[1]) if found else None
        if status != 206:
            raise RangeError(f"{self.url}: no ranges, status {status}")
        if len(data) > end - begin:
            raise RangeError(f"{self.url}: {len(data)} bytes for {end - begin}")
        if len(data) < end - begin and (total is None or begin + len(data) < total):
            raise OSError(f"{self.url}: {len(data)} of {end - begin} bytes at {begin}")
        if self.total is None and found:
            self.total = int(found[1])
        return data

    def read(self, begin: int, end: int) -> bytes:
        """Bytes [begin, end), fewer only at the end of the file."""
        limit = max(self.limit_s, -(-(end - begin) // MIB) * 2.0)
        for attempt in range(self.attempts):
            try:
                request = urllib.request.Request(self.url, headers={"Range": f"bytes={begin}-{end - 1}"})
                with urllib.request.urlopen(request, timeout=limit) as response:
                    return self.checked(begin, end, response.status, response.headers.get("Content-Range"), response.read(end - begin + 1))
            except urllib.error.HTTPError as e:
                if e.code not in RETRYABLE:
                    raise RangeError(f"{self.url}: status {e.code} for bytes {begin} to {end}") from e
                if attempt + 1 == self.attempts:
                    raise
            except OSError:
                if attempt + 1 == self.attempts:
                    raise
            self.sleep(self.waits(attempt))
        raise AssertionError("no attempt")


#: The readers of this process by URL, so that each learns its file's size once.
READERS: dict[str, Ranges] = {}


def reader_of(url: str) -> Ranges:
    if len(READERS) > 4096:
        READERS.clear()
    return READERS.setdefault(url, Ranges(url))
