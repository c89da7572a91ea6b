"""What remote services say and take: kinds of errors, waits before another try, credentials. Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What errors that pass by themselves say, bounds of waits in seconds, and of credentials.
TRANSIENT = ["429", "resource_exhausted", "rate limit", "rate_limit", "503", "unavailable", "overloaded", "timeout", "timed out", "502", "504", "connection reset", "temporarily"]
TOLD_MOST, OWN_MOST, OWN_STEP, MARGIN = 45.0, 20.0, 2.5, 1.0
MOST_CHARS = 512
# Kinds of errors by what they say, in the order in which they are tried ("+" for words that must stand together), and what to do.
ERRORS = [
    ("quota", ["429", "quota", "rate limit"], "has had its quota for now: wait, or take another model or service."),
    ("credit", ["402", "credit", "billing"], "has no credit left: top up, or take another service."),
    ("access", ["not available on", "model agreement"], "doesn't let this account use that model: take another."),
    ("context", ["413", "context+length"], "can't take so long an input: take a model of a longer context, or shorten it."),
    ("key", ["401", "403", "invalid api key", "unauthor"], "rejects the key: see that it is whole, active and of this service."),
    ("model", ["404", "not found", "does not exist", "decommission"], "doesn't know that model: take another."),
    ("connection", ["connect", "refused"], "can't be reached: see that it runs and that its address is right."),
]


def _says(text: Column, words: list[str]) -> Column:
    """Whether a lower-case text holds one of the words, or all parts of one that are joined by a plus."""
    found = F.lit(False)
    for w in words:
        both = F.lit(True)
        for part in w.split("+"):
            both &= text.contains(part)
        found |= both
    return found


def error_kind(message: Column) -> Column:
    """What kind of error a service's message tells of; empty if none is known."""
    low = F.lower(F.coalesce(message, F.lit("")))
    out = F
    for kind, words, _ in ERRORS:
        out = out.when(_says(low, words), kind)
    return out.otherwise("")


def error_hint(message: Column, service: Column) -> Column:
    """The service's name and what to do; empty for unknown errors."""
    kind = error_kind(message)
    out = F
    for name, _, advice in ERRORS:
        out = out.when(kind == name, F.concat(service, F.lit(f" {advice}")))
    return out.otherwise("")


def is_transient(message: Column) -> Column:
    """Whether another try may help."""
    return _says(F.lower(F.coalesce(message, F.lit(""))), TRANSIENT)


def retry_delay(message: Column, attempt: Column) -> Column:
    """Seconds to wait before another try: what the message asks for and a second, 45 at most; else two and a half for each attempt from 0, 20 at most."""
    told = F.regexp_extract(message, r"(?i)try again in\s*([0-9.]+)\s*(?:ms|s|m)\b", 1).try_cast("double")
    unit = F.lower(F.regexp_extract(message, r"(?i)try again in\s*[0-9.]+\s*(ms|s|m)\b", 1))
    asked = F.regexp_extract(message, r"(?i)retry[^0-9]{0,20}(\d+(?:\.\d+)?)\s*s", 1).try_cast("double")
    seconds = F.coalesce(told * F.when(unit == "ms", 0.001).when(unit == "m", 60.0).otherwise(1.0), asked)
    return F.when(seconds.isNotNull(), F.least(seconds + MARGIN, F.lit(TOLD_MOST))).otherwise(F.least(OWN_STEP * (attempt + 1), F.lit(OWN_MOST)))


def _kept(c: Column, pattern: str, most: int = MOST_CHARS) -> Column:
    return F.when((F.length(c) <= most) & c.rlike(pattern), c).otherwise("")


def clean_key(c: Column) -> Column:
    """A key without blanks around it; empty if it holds anything but visible ASCII signs or is too long."""
    return _kept(F.trim(F.coalesce(c, F.lit(""))), r"^[\x21-\x7e]+$")


def clean_base_url(c: Column) -> Column:
    """An address of http or https without slashes at its end; else empty."""
    return _kept(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), "/+$", ""), r"^https?://[\x21-\x7e]+$")


def clean_account(c: Column) -> Column:
    """An account of 8 to 64 letters and digits; else empty."""
    return _kept(F.trim(F.coalesce(c, F.lit(""))), "^[0-9A-Za-z]{8,64}$")


def credential_tag(c: Column) -> Column:
    """Sixteen hex digits that stand for a credential; none for a missing one."""
    return F.when(F.coalesce(c, F.lit("")) == "", "none").otherwise(F.substring(F.sha2(F.encode(c, "UTF-8"), 256), 1, 16))
