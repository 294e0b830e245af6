"""JSON over HTTP with a policy for when to try again, shared by readers and model clients."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

#: Statuses that a later try may change: too many requests, and the server's own failures.
BUSY = range(500, 600)


@dataclass(frozen=True)
class Patience:
    """How long to wait for an answer, how often to ask, and how long to pause at most between two tries."""

    timeout: float = 30
    tries: int = 3
    longest: float = 8
    longest_asked: float = 60

    def __post_init__(self) -> None:
        if self.tries < 1:
            raise ValueError("at least one try is needed")

    def pause(self, failed: int, error: Exception) -> float | None:
        """Seconds before the next try after so many failures; None if another try is of no use.

        A server that names a time in Retry-After is given it.
        """
        if failed >= self.tries:
            return None
        if not isinstance(error, urllib.error.HTTPError):
            return min(2.0 ** (failed - 1), self.longest)
        if error.code != 429 and error.code not in BUSY:
            return None
        asked = (error.headers or {}).get("Retry-After", "")
        return min(float(asked), self.longest_asked) if asked.isdigit() else min(2.0 ** (failed - 1), self.longest)


@dataclass
class Client:
    """GET and POST of JSON. `wait` and `open_url` can be replaced in tests."""

    patience: Patience = Patience()
    headers: dict[str, str] | None = None
    wait: Callable[[float], None] = time.sleep
    open_url: Callable[..., Any] = urllib.request.urlopen

    def __call__(self, url: str, payload: dict[str, Any] | None = None) -> dict[str, Any]:
        headers = dict(self.headers or {})
        body = None
        if payload is not None:
            headers["Content-Type"], body = "application/json", json.dumps(payload).encode()
        request = urllib.request.Request(url, body, headers)
        failed = 0
        while True:
            try:
                with self.open_url(request, timeout=self.patience.timeout) as answer:
                    return json.load(answer)
            except (OSError, ValueError) as e:  # network, time-out and HTTP errors; text that is no JSON
                failed += 1
                pause = self.patience.pause(failed, e)
                if pause is None:
                    raise
            self.wait(pause)


@dataclass
class Paced:
    """A fetch that holds a rate: two requests begin `pause` seconds apart or more, further tries and pages included.

    One such object serves a lane of requests in turn, so when a server asks to
    wait, all that come after in the lane wait too.
    """

    fetch: Callable[..., dict[str, Any]]
    pause: float = 0
    clock: Callable[[], float] = time.monotonic
    wait: Callable[[float], None] = time.sleep
    free: float = float("-inf")

    def __call__(self, url: str, payload: dict[str, Any] | None = None) -> dict[str, Any]:
        left = self.free - self.clock()
        if left > 0:
            self.wait(left)
        try:
            return self.fetch(url, payload) if payload is not None else self.fetch(url)
        finally:  # from its end on: what it waited for a busy server counts in full
            self.free = self.clock() + self.pause


def bearer(key: str) -> dict[str, str]:
    return {"Authorization": f"Bearer {key}"} if key else {}
