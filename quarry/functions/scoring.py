"""Scores as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B, RRF_K = 1.2, 0.75, 60
# Fixed values of the authority score: top-level domains of institutions and of short-lived sites, second-level
# institutions, and platforms whose many hosts are no sign of a farm.
INSTITUTIONAL = ["gov", "edu", "mil"]
SUSPECT = [
    "sbs", "cfd", "top", "xyz", "biz", "online", "site", "website", "store", "fun", "tk", "ml", "ga", "cf", "monster", "loan", "work", "mom", "bond",
    "click", "quest", "rest", "fyi", "buzz", "gq", "support", "lol", "icu",
]
SECOND_LEVEL = [".ac.uk", ".ac.jp", ".nhs.uk", ".gov.uk"]
PLATFORMS = [
    "github.io", "gitlab.io", "netlify.app", "vercel.app", "pages.dev", "web.app", "firebaseapp.com", "appspot.com", "herokuapp.com", "glitch.me", "replit.dev",
    "repl.co", "deno.dev", "fly.dev", "workers.dev", "neocities.org", "tumblr.com", "wordpress.com", "blogspot.com", "substack.com", "medium.com", "ghost.io",
    "mastodon.social", "mastodon.online", "bandcamp.com", "itch.io", "soundcloud.com", "fandom.com", "wikia.com", "sched.com", "bbc.co.uk", "bbc.com",
    "reddit.com", "quora.com", "medium.dev",
]
# Popularity ranks and what they add, the best first; weight of the multiplier.
RANK_BOOST = [(100, 0.30), (1_000, 0.22), (10_000, 0.16), (100_000, 0.10), (1_000_000, 0.05)]
ALPHA = 2.0


def idf(n_docs: Column, df: Column) -> Column:
    return F.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def saturation(tf: Column, length: Column, mean_length: Column) -> Column:
    """What a term's idf is multiplied by."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean_length))


def rrf(rank: Column, weight: Column | float = 1.0) -> Column:
    """Reciprocal rank; rank counts from 1."""
    return (weight if isinstance(weight, Column) else F.lit(weight)) / (RRF_K + rank)


def best_rank(rank: Column) -> Column:
    """The variant that keeps the best place alone and counts from 0."""
    return 1.0 / (RRF_K + rank - 1)


def decay(age_days: Column, half_life: float = 180.0) -> Column:
    """Future dates count as age 0, unknown ones as no decay."""
    return F.coalesce(F.exp(-math.log(2) * F.greatest(age_days, F.lit(0.0)) / half_life), F.lit(1.0))


def refresh_days(since_change: Column, least: float, most: float) -> Column:
    """Half the time since the last change, in bounds; never changed: the least."""
    return F.coalesce(F.least(F.greatest(since_change / 2, F.lit(least)), F.lit(most)), F.lit(least))


def backoff_seconds(refusals: Column, delay_ms: Column) -> Column:
    """Delay of a host after that many refusals in a row: its own delay, a second at least, doubled up to eight times."""
    return F.greatest(delay_ms / 1000.0, F.lit(1.0)) * F.pow(F.lit(2.0), F.least(refusals, F.lit(8)))


def retry_after(header: Column, now: Column) -> Column:
    """Seconds that a Retry-After header asks for, as seconds or a date; 0 where it says nothing or lies in the past."""
    h = F.trim(F.coalesce(header, F.lit("")))
    seconds = F.when(h.rlike(r"^\+?\d{1,9}$"), F.regexp_replace(h, r"^\+", "").try_cast("long"))
    date = F.try_to_timestamp(F.regexp_extract(h, r"^\w{3}, (\d{2} \w{3} \d{4} \d{2}:\d{2}:\d{2}) GMT$", 1), F.lit("dd MMM yyyy HH:mm:ss"))
    wait = F.unix_timestamp(date) - F.unix_timestamp(now)
    return F.greatest(F.coalesce(seconds, wait, F.lit(0)), F.lit(0)).cast("double")


def link_priority(base: Column, depth: Column) -> Column:
    return F.greatest(base / (1 + 0.25 * depth), F.lit(0.05))


def rank_boost(rank: Column) -> Column:
    """What a popularity rank adds; null and unranked add nothing."""
    out = F.lit(0.0)
    for most, add in reversed(RANK_BOOST):
        out = F.when(rank <= most, add).otherwise(out)
    return F.when(rank > 0, out).otherwise(0.0)


def authority(host: Column, domain: Column, tld: Column, n_subdomains: Column, signals: dict[str, Column] | None = None) -> Column:
    """A host's score within 0 and 1. signals (each may be missing): trusted (boolean of host or domain), rank and
    domain_rank, flow and domain_flow; those of the domain count less and only where the host has none."""
    get = lambda name, kind: (signals or {}).get(name, F.lit(None).cast(kind))
    trusted = F.coalesce(get("trusted", "boolean"), F.lit(False))
    rank, wide_rank, flow, wide_flow = get("rank", "int"), get("domain_rank", "int"), get("flow", "int"), get("domain_flow", "int")
    s = F.lit(0.5) + F.when(trusted, 0.4).otherwise(0.0)
    s = s + F.when(rank > 0, rank_boost(rank)).when(wide_rank > 0, rank_boost(wide_rank) * 0.8).otherwise(0.0)
    s = s + F.when(flow > 0, flow / 100.0 * 0.15).when(wide_flow > 0, wide_flow / 100.0 * 0.12).otherwise(0.0)
    s = s + F.when(tld.isin(INSTITUTIONAL), 0.2).when(tld.isin(SUSPECT), -0.3).otherwise(0.0)
    second = F.lit(False)
    for x in SECOND_LEVEL:
        second = second | host.endswith(x)
    s = s + F.when(second, 0.15).otherwise(0.0)
    farm = F.when(n_subdomains >= 100000, 0.4).when(n_subdomains >= 10000, 0.3).when(n_subdomains >= 1000, 0.1).otherwise(0.0)
    s = s - F.when(trusted | domain.isin(PLATFORMS), 0.0).otherwise(farm)
    return F.greatest(F.least(s, F.lit(1.0)), F.lit(0.0))


def multiplier(score: Column, alpha: float = ALPHA) -> Column:
    return 1 + alpha * score


def authority_class(score: Column) -> Column:
    return F.when(score >= 0.75, "trusted").when(score >= 0.40, "keep").when(score >= 0.25, "down-weight").otherwise("block")
