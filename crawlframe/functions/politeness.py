"""Delays of the per-domain politeness rules, in nanoseconds, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000_000
DEFAULT_DELAY, MIN_DELAY, MAX_DELAY = SECOND, SECOND // 4, 30 * SECOND
MULTIPLIER, ALPHA = 5, 0.3
BACKOFF_ERRORS, DEAD_ERRORS = 5, 10


def clamp(delay: Column) -> Column:
    return F.least(F.greatest(delay, F.lit(MIN_DELAY)), F.lit(MAX_DELAY))


def ema(average: Column, latency: Column) -> Column:
    """The moving average of latencies, cut to whole nanoseconds; 0 means that there is none yet."""
    mixed = (F.lit(ALPHA) * latency.cast("double") + F.lit(1 - ALPHA) * average.cast("double")).cast("bigint")
    return F.when(average == 0, latency).otherwise(mixed)


def adaptive_delay(average: Column, robots_delay: Column) -> Column:
    return F.greatest(clamp(average * MULTIPLIER), F.coalesce(robots_delay, F.lit(0)))


def error_backoff(errors: Column) -> Column:
    """2**min(errors - 5, 6) minutes from the fifth error on; else 0."""
    minutes = F.pow(F.lit(2), F.least(errors - BACKOFF_ERRORS, F.lit(6))).cast("bigint")
    return F.when(errors >= BACKOFF_ERRORS, minutes * 60 * SECOND).otherwise(F.lit(0).cast("bigint"))


def step(s: Column, e: Column, compat: bool = False) -> Column:
    """The state struct(dead, delay, ema, last, backoff, errors) after the event struct(ts_ns, outcome, latency_ns, robots_delay_ns, retry_after_ns).

    A 429 doubles the delay and backs off by Retry-After if there is one, else by
    the new delay; an error counts and backs off from the fifth on, but the tenth
    only marks the domain dead; nxdomain marks it dead and changes nothing else.
    compat: a failed fetch is also recorded as a fetch, so that errors never add
    up, as the crawler that this follows does. A null latency leaves the average.
    """
    ok, limited = e["outcome"] == "ok", e["outcome"] == "rate_limited"
    error, gone = e["outcome"] == "error", e["outcome"] == "nxdomain"
    recorded = (ok | error | gone) if compat else ok
    average = F.when(recorded & e["latency_ns"].isNotNull(), ema(s["ema"], e["latency_ns"])).otherwise(s["ema"])
    slower = clamp(s["delay"] * 2)
    before = F.when(recorded, F.lit(0)).otherwise(s["errors"])
    errors = F.when(error, before + 1).otherwise(before)
    dies = error & (errors >= DEAD_ERRORS)
    wait = F.when(e["retry_after_ns"] > 0, e["retry_after_ns"]).otherwise(slower)
    return F.struct(
        (s["dead"] | gone | dies).alias("dead"),
        F.when(recorded, adaptive_delay(average, e["robots_delay_ns"])).when(limited, slower).otherwise(s["delay"]).cast("bigint").alias("delay"),
        average.cast("bigint").alias("ema"),
        F.when(recorded, e["ts_ns"]).otherwise(s["last"]).cast("bigint").alias("last"),
        F.when(limited, e["ts_ns"] + wait)
        .when(error & ~dies & (errors >= BACKOFF_ERRORS), e["ts_ns"] + error_backoff(errors))
        .otherwise(s["backoff"]).cast("bigint").alias("backoff"),
        errors.cast("int").alias("errors"),
    )


#: The state of a domain that nothing is known of.
FRESH = (False, DEFAULT_DELAY, 0, None, None, 0)


def advance(state: tuple, outcome: str, ts: int, latency: int | None, robots: int | None, retry: int | None = None, compat: bool = False) -> tuple:
    """The same as step for one state and event, for folds that take a domain's events one after another."""
    dead, delay, average, last, backoff, errors = state
    failed = outcome in ("error", "nxdomain")
    if outcome == "ok" or (compat and failed):
        if latency is not None:
            average = latency if average == 0 else int(ALPHA * float(latency) + (1 - ALPHA) * float(average))
        delay = max(min(max(average * MULTIPLIER, MIN_DELAY), MAX_DELAY), robots or 0)
        last, errors = ts, 0
    if outcome == "rate_limited":
        delay = min(max(delay * 2, MIN_DELAY), MAX_DELAY)
        backoff = ts + (retry if retry and retry > 0 else delay)
    elif outcome == "nxdomain":
        dead = True
    elif outcome == "error":
        errors += 1
        if errors >= DEAD_ERRORS:
            dead = True
        elif errors >= BACKOFF_ERRORS:
            backoff = ts + 2 ** min(errors - BACKOFF_ERRORS, 6) * 60 * SECOND
    return dead, delay, average, last, backoff, errors


_CODEC = (("crawl_delay_ns", 8), ("robots_delay_ns", 8), ("avg_latency_ns", 8), ("last_fetch_ns", 8), ("backoff_until_ns", 8), ("consecutive_errors", 4))
STATE_BYTES = 46
#: What an unset time is stored as.
_NEVER = -6795364578871345152


def _little(value: Column, width: int) -> Column:
    """The little-endian hex digits of an integer."""
    digits = F.lpad(F.hex(value.cast("bigint").bitwiseAND(F.lit((1 << 32) - 1) if width == 4 else F.lit(-1))), 2 * width, "0")
    return F.concat(*(F.substring(digits, 2 * k + 1, 2) for k in reversed(range(width))))


def encode_state(state: Column) -> Column:
    """A domain's state as 46 bytes: the version 1, the flags (1 dead, 2 sitemap looked for), then little-endian numbers."""
    flags = F.when(state["dead"], 1).otherwise(0) + F.when(state["sitemap_checked"], 2).otherwise(0)
    fields = (_little(F.coalesce(state[c], F.lit(_NEVER if c in ("last_fetch_ns", "backoff_until_ns") else 0)), n) for c, n in _CODEC)
    return F.unhex(F.concat(F.lit("01"), F.lpad(F.hex(flags), 2, "0"), *fields))


def decode_state(data: Column) -> Column:
    """struct of the fields; null for data that is too short or of another version; a delay of 0 or less is the default."""
    digits = F.hex(data)

    def number(at: int, width: int) -> Column:
        big = F.concat(*(F.substring(digits, 2 * (at + k) + 1, 2) for k in reversed(range(width))))
        half = lambda start: F.conv(F.substring(big, start, 8), 16, 10).cast("bigint")
        if width == 4:
            return half(1).bitwiseXOR(F.lit(1 << 31)) - (1 << 31)
        return F.shiftleft(half(1), 32).bitwiseOR(half(9))

    fields, at = {}, 2
    for name, width in _CODEC:
        fields[name] = number(at, width)
        at += width
    for name in ("last_fetch_ns", "backoff_until_ns"):
        fields[name] = F.nullif(fields[name], F.lit(_NEVER))
    fields["crawl_delay_ns"] = F.when(fields["crawl_delay_ns"] <= 0, F.lit(DEFAULT_DELAY)).otherwise(fields["crawl_delay_ns"])
    fields["consecutive_errors"] = fields["consecutive_errors"].cast("int")
    flags = F.conv(F.substring(digits, 3, 2), 16, 10).cast("int")
    bit = lambda b: flags.bitwiseAND(F.lit(b)) > 0
    good = (F.octet_length(data) >= STATE_BYTES) & digits.startswith("01")
    return F.when(good, F.struct(bit(1).alias("dead"), bit(2).alias("sitemap_checked"), *(c.alias(n) for n, c in fields.items())))


def next_fetch(now: Column, last_fetch: Column, delay: Column, backoff_until: Column) -> Column:
    """All in nanoseconds since the epoch: the end of a backoff, else the last fetch and the delay; unknown: now."""
    return (
        F.when(backoff_until > now, backoff_until)
        .when(last_fetch.isNotNull(), last_fetch + delay)
        .otherwise(now)
    )


def can_fetch(now: Column, last_fetch: Column, delay: Column, backoff_until: Column) -> Column:
    """struct(ok, wait): not in a backoff; what is left of the delay alone doesn't forbid."""
    left = F.greatest(F.coalesce(last_fetch + delay - now, F.lit(0)), F.lit(0))
    return F.when(backoff_until > now, F.struct(F.lit(False).alias("ok"), (backoff_until - now).alias("wait"))).otherwise(
        F.struct(F.lit(True).alias("ok"), left.alias("wait"))
    )
