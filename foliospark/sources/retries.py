"""When a request is sent again, and after which wait: on the worker that sends it, and as columns over logged attempts."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from datetime import UTC, datetime
from email.utils import parsedate_to_datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions.scalars import RETRYABLE, first_key, retry_after_seconds

#: Status, headers and body.
Answer = tuple[int, dict, str]
Validator = Callable[[int, dict, str], bool]

# The headers that ask for a wait, the first that is there counts.
WAIT_HEADERS = ("retry-after", "x-ratelimit-retry-after")


class InvalidAnswer(Exception):
    """No valid answer came, and the policy says that this is an error."""

    def __init__(self, answer: Answer, message: str) -> None:
        super().__init__(f"{message} (status {answer[0]})")
        self.answer = answer


def well_answered(status: int, headers: dict, body: str) -> bool:
    """The validator by default: any status that is no error."""
    return 200 <= status < 400


def retry_after(value: str | None, now: datetime) -> float | None:
    """Seconds to wait by a Retry-After header: a number, an ISO or an HTTP date; never below 0."""
    if not value:
        return None
    try:
        return max(0, int(value))
    except ValueError:
        pass
    for read in (lambda v: datetime.fromisoformat(v.replace("Z", "+00:00")), parsedate_to_datetime):
        try:
            at = read(value)
        except (TypeError, ValueError):
            continue
        return max(0, int((at.replace(tzinfo=at.tzinfo or UTC) - now).total_seconds()))
    return None


def asked_wait(headers: Mapping[str, str], now: datetime | None = None) -> float | None:
    """The wait that an answer's headers ask for, whatever their case."""
    lowered = {k.lower(): v for k, v in headers.items() if v is not None}
    value = next((lowered[h] for h in WAIT_HEADERS if h in lowered), None)
    return retry_after(value, now or datetime.now(UTC))


@dataclass(frozen=True)
class RetryPolicy:
    """How often and after which waits a request is sent again.

    ``retries`` counts attempts after the first; the wait before attempt n + 1 is ``factor`` * 2^n, at most ``longest``,
    unless the answer asks for one. Negative numbers count as 0. ``strict`` raises ``InvalidAnswer`` where no valid answer came.
    """

    retries: int = 3
    factor: float = 0.5
    longest: float = 120.0
    statuses: tuple[int, ...] = RETRYABLE
    strict: bool = False

    def __post_init__(self) -> None:
        for name in ("retries", "factor", "longest"):
            object.__setattr__(self, name, max(getattr(self, name), 0))

    def delay(self, attempt: int, headers: Mapping[str, str]) -> float:
        """Seconds between an attempt (the first is 1) and the next."""
        asked = asked_wait(headers)
        return min(self.factor * 2**attempt, self.longest) if asked is None else asked

    def run(self, send: Callable[[], Answer], sleep: Callable[[float], None] = time.sleep, valid: Validator = well_answered) -> Answer:
        """Sends until an answer is valid, isn't worth another attempt, or attempts run out; no wait follows the last."""
        for attempt in range(1, self.retries + 2):
            answer = send()
            if valid(*answer):
                return answer
            if answer[0] not in self.statuses:
                return self._failed(answer, "an answer that is not valid and not worth a retry")
            if attempt <= self.retries:
                sleep(self.delay(attempt, answer[1]))
        return self._failed(answer, "retries ran out without a valid answer")

    def _failed(self, answer: Answer, message: str) -> Answer:
        if self.strict:
            raise InvalidAnswer(answer, message)
        return answer

    def retryable(self, code: Column) -> Column:
        return F.coalesce(code.isin(*self.statuses), F.lit(False)) if self.statuses else F.lit(False)

    def wait(self, attempt: Column, headers: Column, now: Column) -> Column:
        """The same wait as a column; ``headers`` is a map, null for none, ``now`` the time of the answer."""
        present = F.map_filter(F.coalesce(headers, F.expr("cast(map() as map<string,string>)")), lambda _, v: v.isNotNull())
        value = first_key(present, *WAIT_HEADERS, any_case=True)
        asked = retry_after_seconds(value, now)
        doubled = F.least(F.lit(self.factor) * F.pow(F.lit(2.0), attempt), F.lit(float(self.longest)))
        return F.coalesce(asked.cast("double"), doubled)
