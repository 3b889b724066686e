"""Which responses are retried, and after how long."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Statuses that are retried, first delays, the longest delay and the shared pause, in seconds.
RETRYABLE = (429, 500, 502, 503, 504)
TOO_MANY, TOO_MANY_BASE, OTHER_BASE, LONGEST, PAUSE = 429, 1.0, 0.05, 30.0, 10.0


def retry_after(header: Column, now: Column) -> Column:
    """Seconds of a Retry-After header: a number, or an HTTP date after now; else null."""
    date = F.try_to_timestamp(F.substring(header, 6, 100), F.lit("dd MMM yyyy HH:mm:ss zzz"))
    ahead = F.unix_micros(date).cast("double") / 1e6 - F.unix_micros(now).cast("double") / 1e6
    return F.coalesce(header.try_cast("double"), F.when(ahead > 0, ahead))


def longest_delay(status: Column, attempt: Column) -> Column:
    """The bound that a delay is drawn below."""
    base = F.when(status == TOO_MANY, TOO_MANY_BASE).otherwise(OTHER_BASE)
    return F.least(base * F.pow(F.lit(2.0), attempt), F.lit(LONGEST))


def delay_bound(status: Column, attempt: Column, after: Column) -> Column:
    """The bound with what the server asks for, which has no limit; a null is no wish."""
    return F.greatest(longest_delay(status, attempt), after)


def sampled_delay(status: Column, attempt: Column, after: Column, seed: int) -> Column:
    return F.greatest(F.rand(seed) * longest_delay(status, attempt), after)


def is_retryable(status: Column) -> Column:
    return status.isin(*RETRYABLE)


def goes_on(status: Column, attempt: Column, attempts: Column | int) -> Column:
    """Whether another of `attempts` attempts follows; they are numbered from 0."""
    return is_retryable(status) & (attempt < F.lit(attempts) - 1 if isinstance(attempts, int) else attempt < attempts - 1)


def outcome(status: Column, length: Column, parallel: Column) -> Column:
    """ok, retry or failed. An empty body, or no answer at all (a null status), fails at once in sequence and is retried
    in parallel."""
    nothing = F.when(parallel, "retry").otherwise("failed")
    return F.when((status == 200) & (length > 0), "ok").when(status.isNull() | (status == 200), nothing).when(is_retryable(status), "retry").otherwise("failed")


def refresh(status: Column, can_refresh: Column | None = None, renewed: Column | None = None) -> Column:
    """What a playlist request leads to: its text, a new address, another try (no answer, a null status) or the end.

    can_refresh is whether there is something that finds new addresses, renewed whether it found one; both hold where
    not given, a null doesn't.
    """
    found = F.lit(True)
    for given in (can_refresh, renewed):
        found = found if given is None else found & F.coalesce(given, F.lit(False))
    return F.when(status.isNull(), "retry").when(status == 200, "text").when(status.isin(403, 410) & found, "refresh").otherwise("stop")


#: Steps after which another try follows.
GOING_ON = ("retry", "refresh")
