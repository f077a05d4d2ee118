"""Text as columns: tokens, titles, phrases, ids, digests."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are never indexed.
STOPWORDS = (
    "a an the and or but is are was were be been being to of in on at by for with as from into about "
    "this that these those it its their they them i you we he she will would can could should may might "
    "do does did done has have had not no"
).split()

TITLE_WEIGHT = 3

# Titles of short pages that are no content, and answers that say nothing.
CHECK_TITLES = ["just a moment", "access denied", "attention required! | cloudflare", "checking your browser", "verify you are human", "page not found", "404 not found", "sign in", "log in", "login"]
PARKED_TITLES = ["domain for sale", "this domain is for sale", "buy this domain", "website coming soon", "under construction"]


def tokens(text: Column) -> Column:
    """Lower-case ASCII words of two signs or more, stopwords left out."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+")
    return F.filter(parts, lambda t: (F.length(t) >= 2) & ~t.isin(STOPWORDS))


def letter_tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits of any script."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{Nd}]+"), lambda t: t != "")


def first_line(text: Column, most: int = 200) -> Column:
    """The first line with something on it, as a title."""
    return F.substring(F.trim(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?:^|\n)[ \t\r]*([^\s][^\n]*)", 1)), 1, most)


def phrases(query: Column) -> Column:
    """Quoted phrases, trimmed and lower-cased; an unterminated quote is plain text."""
    return F.filter(F.transform(F.regexp_extract_all(query, F.lit('"([^"]*)"'), 1), lambda p: F.lower(F.trim(p))), lambda p: p != "")


def has_phrases(text: Column, title: Column, wanted: Column) -> Column:
    return F.forall(wanted, lambda p: F.lower(text).contains(p) | F.lower(title).contains(p))


def collapsed(text: Column) -> Column:
    return F.regexp_replace(text, "[ \t\n\r]+", " ")


def cited_ids(text: Column) -> Column:
    """Distinct source numbers in [1] and [1,2]."""
    groups = F.regexp_extract_all(text, F.lit(r"\[(\d+(?:\s*,\s*\d+)*)\]"), 1)
    return F.array_distinct(F.transform(F.flatten(F.transform(groups, lambda g: F.split(g, r"\s*,\s*"))), lambda x: x.cast("int")))


def listed(text: Column) -> Column:
    """Comma-separated values, trimmed, lower-cased, empty ones dropped."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")


def without_thinking(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""))


def language(tag: Column) -> Column:
    """Primary subtag in lower case; empty is null."""
    return F.nullif(F.split(F.lower(F.trim(tag)), "[-_]")[0], F.lit(""))


def digest(*parts: Column) -> Column:
    """SHA-256 of parts joined by a zero byte."""
    return F.sha2(F.concat_ws("\x00", *parts), 256)


def _per_text(make: Callable[[str], str]) -> Callable[[Column], Column]:
    """A function of single texts as a column function over Arrow batches, for what counts bytes."""

    @F.pandas_udf("string")
    def apply(s: pd.Series) -> pd.Series:
        return s.map(make, na_action="ignore")

    return apply


def cut_bytes(text: str, most: int) -> bytes:
    """The first bytes of a text, whole characters only."""
    data = text.encode()[: max(most, 0)]
    return data.decode("utf-8", "ignore").encode()


def excerpt_of(text: str, most: int) -> str:
    """At most `most` bytes, cut back to white space where some is among the last 16, trimmed, with an ellipsis."""
    if len(text.encode()) <= most:
        return text
    head = cut_bytes(text, most)
    for i in range(len(head) - 1, max(len(head) - 17, 0), -1):
        if head[i : i + 1] in (b" ", b"\n", b"\t"):
            head = head[:i]
            break
    return head.decode().strip() + "…"


def excerpt(text: Column, most: int) -> Column:
    return _per_text(lambda t: excerpt_of(t, most))(text)


def context_of(text: str, n_sources: int, each: int = 10_000, total: int = 30_000) -> str:
    """A source's share of what a model reads: so many bytes each, and in all."""
    most = min(each, total // max(1, n_sources))
    if len(text.encode()) <= most:
        return text
    return cut_bytes(text, most - 3).decode().strip() + "…" if most >= 3 else ""


def context(text: Column, n_sources: int) -> Column:
    return _per_text(lambda t: context_of(t, n_sources))(text)


#: Estimated tokens of an ASCII character and of any other, and the most bytes that are embedded.
ASCII_TOKENS, WIDE_TOKENS, EMBED_BYTES = 0.35, 1.0, 2500


def embed_head_of(text: str, most_tokens: int) -> str:
    """The beginning of a text that a model of so many tokens takes: up to the character at which the estimate reaches
    them or the bytes run out, cut back to white space in its second half."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    if not len(codes):
        return text
    size = 1 + (codes > 0x7F).astype(int) + (codes > 0x7FF) + (codes > 0xFFFF)
    start = np.cumsum(size) - size
    tokens = np.cumsum(np.where(codes > 0x7F, WIDE_TOKENS, ASCII_TOKENS))
    over = np.flatnonzero((tokens >= most_tokens) | (start >= EMBED_BYTES))
    if not len(over):
        return text
    at = int(over[0])
    white = np.flatnonzero(np.isin(codes[: at + 1], [32, 10, 9, 13]))
    return text[: int(white[-1])] if len(white) and start[white[-1]] > int(start[at]) // 2 else text[:at]


def embed_head(text: Column, most_tokens: int) -> Column:
    return _per_text(lambda t: embed_head_of(t, most_tokens))(text)


def date_bound(text: Column) -> Column:
    """A time of a full timestamp with a zone, or midnight UTC of a date; null for anything else."""
    full = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"), F.try_to_timestamp(text))
    return F.coalesce(full, F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))))


# Question forms and the words that replace them, the most specific first.
ENTITY_FORMS = [
    (r"^who (?:created|invented|founded|built|developed|designed|made|started) (?:the )?(.+?)\??$", ["creator inventor founder", "history origin", "developer designer"]),
    (r"^who (?:wrote|authored|composed) (?:the )?(.+?)\??$", ["author writer", "book novel publication"]),
    (r"^who (?:discovered) (.+?)\??$", ["discoverer", "discovery history"]),
    (r"^who is (?:the )?(.+?)\??$", ["biography", "about"]),
    (r"^when (?:was|did|were) (?:the )?(.+?)(?: (?:created|invented|founded|born|happen|happened|occur|land|landed))?\??$", ["date year", "history origin"]),
    (r"^where is (?:the )?(.+?)\??$", ["location address country"]),
    (r"^how tall is (?:the )?(.+?)\??$", ["height meters feet", "tall"]),
    (r"^how (?:big|large|long|wide|deep|high) is (?:the )?(.+?)\??$", ["size dimensions", "length width"]),
    (r"^what is the capital of (.+?)\??$", ["capital city"]),
    (r"^what is the (?:largest|biggest|longest|tallest|shortest) (.+?)\??$", ["superlative record"]),
    (r"^what is the population of (.+?)\??$", ["population inhabitants census"]),
]


def entity_rewrites(query: Column) -> Column:
    """Keyword queries for an entity question; empty if no form fits."""
    q = F.lower(F.trim(query))
    out = F.array().cast("array<string>")
    for form, tails in reversed(ENTITY_FORMS):
        entity = F.regexp_replace(F.trim(F.regexp_extract(q, form, 1)), r"[ \t.!?]+$", "")
        out = F.when(entity != "", F.array(*[F.concat(entity, F.lit(" " + t)) for t in tails])).otherwise(out)
    return out


def page_problem(title: Column, text: Column) -> Column:
    """'unverified', 'rejected' or null for a short page by its title."""
    name = F.regexp_replace(F.lower(F.regexp_replace(F.trim(title), r"\s+", " ")), "^[ .!…]+|[ .!…]+$", "")
    short = F.length(F.trim(text)) < 2000
    return F.when(short & name.isin(CHECK_TITLES), "unverified").when(short & name.isin(PARKED_TITLES), "rejected")
