"""Dates, decay windows, hosts and scores as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

#: Days until a source of a host counts as old; first match in this order.
DECAY_DAYS = {"huggingface.co": 120, "github.com": 180, "stackoverflow.com": 365, "arxiv.org": 1095, "wikipedia.org": 1460, "openlibrary.org": 1825}
#: Days for other sources; topics whose windows are longer, and by what factor.
DEFAULT_DAYS = 90
VOLATILE = {"llm": 1.1, "react": 1.1, "docker": 1.1, "claude": 1.1, "agent": 1.1, "mcp": 1.1}


def host(url) -> Column:
    """The lower-case host of a URL without user and port; empty where there is none."""
    return F.lower(F.regexp_extract(F.trim(col(url)), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def within(h: Column, domain: str) -> Column:
    return (h == domain) | F.endswith(h, F.lit("." + domain))


def allowed(url, domains: list[str]) -> Column:
    h, out = host(url), F.lit(False)
    for d in domains:
        out = out | within(h, d)
    return out


def backoff(attempt, first: float = 1.0, most: float = 30.0) -> Column:
    """Seconds to wait before a further attempt (from 0): twice as long each time, up to a limit."""
    return F.least(F.lit(most), F.lit(first) * F.pow(F.lit(2.0), col(attempt)))


def longest_window(sources, topics=None) -> Column:
    """The longest time that any of an array of sources lets a page stand; that of an unknown source without any."""
    each = F.transform(col(sources), lambda s: decay_days(s, topics) if topics is not None else decay_days(s))
    none = decay_days(F.lit(""), topics) if topics is not None else decay_days(F.lit(""))
    return F.coalesce(F.array_max(each), none)


def volatility(topics) -> Column:
    """The largest factor of a topic named in the first 4096 characters."""
    s, out = F.substring(col(topics), 1, 4096), F.lit(1.0)
    for key, factor in VOLATILE.items():
        out = F.greatest(out, F.when(s.rlike(rf"(?i)\b{key}\b"), factor).otherwise(1.0))
    return F.coalesce(out, F.lit(1.0))


def decay_days(ref, topics=None) -> Column:
    h = F.coalesce(host(ref), F.lit(""))
    out = F.lit(DEFAULT_DAYS)
    for key, days in reversed(DECAY_DAYS.items()):
        out = F.when(within(h, key), days).otherwise(out)
    if topics is None:
        return out
    # the small addend keeps products like 90 x 1.1 from falling below the whole number
    return F.greatest(F.lit(1), F.least(F.floor(out * volatility(topics) + 1e-9).cast("int"), F.lit(DEFAULT_DAYS * 50)))


def parsed(ts) -> Column:
    """ISO timestamps; Z and no zone are UTC; null where malformed."""
    return F.try_to_timestamp(F.regexp_replace(col(ts), "Z$", "+00:00"))


def similarity(distance) -> Column:
    return F.round(1 / (1 + col(distance)), 4)


def trust(useful, wrong, incomplete) -> Column:
    return (col(useful) + 1) / (col(useful) + 2 * col(wrong) + col(incomplete) + 2)


def idf(total, df) -> Column:
    return F.log((col(total) - col(df) + 0.5) / (col(df) + 0.5) + 1)


#: Characters of context, and its shares in percent.
TIER, SHARES = 20_000, {"wiki_pages": 60, "chat_history": 20, "index": 5, "system": 15}


def tier_budget(part: str) -> int:
    return TIER * SHARES[part] // 100
