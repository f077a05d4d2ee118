"""What language models answer, made safe: lists, plans, verdicts, as columns. A reply that cannot be read never fails."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases of an answer that says nothing, retrievers of a plan.
NO_INFO = ["do not contain", "do not provide", "sources don", "not contain the", "no information", "do not include", "do not have", "do not cover", "not mention", "no mention"]
RETRIEVERS = ["bm25", "dense", "hybrid"]
PLAN = "intent string, queries array<string>, retriever string, since_days int, decay_days int"
VERDICT = "sufficient boolean, missing string, refine_queries array<string>"


def unfenced(reply: Column) -> Column:
    """A reply without a fence of back-ticks around it."""
    return F.trim(F.regexp_replace(F.trim(reply), r"^```(?:json)?|```$", ""))


def between(text: Column, first: str, last: str) -> Column:
    """From the first opening sign to the last closing one; null without both in this order."""
    start, back = F.instr(text, first), F.instr(F.reverse(text), last)
    end = F.length(text) - back + 1
    return F.when((start > 0) & (back > 0) & (end > start), F.substring(text, start, end - start + 1))


def string_list(reply: Column, fallback: Column) -> Column:
    """The array of strings in a reply; the fallback alone where there is none."""
    found = F.from_json(between(unfenced(reply), "[", "]"), "array<string>", {"mode": "PERMISSIVE"})
    return F.when(F.size(found) > 0, found).otherwise(F.array(fallback))


def places(reply: Column, n: Column) -> Column:
    """The order of candidates that a listwise reranker replied with: its places that exist, then those that it left
    out in their old order; the old order where nothing can be read."""
    found = F.from_json(between(unfenced(reply), "[", "]"), "array<int>")
    good = F.array_distinct(F.filter(found, lambda i: i.isNotNull() & (i >= 0) & (i < n)))
    every = F.sequence(F.lit(0), n - 1)
    return F.when(n < 1, F.array().cast("array<int>")).otherwise(F.when(F.size(good) > 0, F.concat(good, F.array_except(every, good))).otherwise(every))


def plan(reply: Column, question: Column) -> Column:
    """A struct of PLAN: one query at least and five at most, a known retriever, days from 1 to 3650 or null."""
    raw = F.trim(reply)
    raw = F.when(raw.startswith("```"), F.regexp_replace(F.regexp_replace(raw, r"^```[^\n]*\n", ""), r"```$", "")).otherwise(raw)
    p = F.from_json(raw, PLAN)
    days = lambda c: F.when((c > 0) & (c <= 3650), c)
    some = F.size(p["queries"]) > 0
    return F.struct(
        F.when(F.coalesce(p["intent"], F.lit("")) == "", "research").otherwise(p["intent"]).alias("intent"),
        F.when(some, F.slice(p["queries"], 1, 5)).otherwise(F.array(question)).alias("queries"),
        F.when(p["retriever"].isin(RETRIEVERS), p["retriever"]).otherwise("hybrid").alias("retriever"),
        days(p["since_days"]).alias("since_days"),
        days(p["decay_days"]).alias("decay_days"),
    )


def verdict(reply: Column) -> Column:
    """A struct of VERDICT with three refinements at most; null where nothing can be read."""
    inner = F.regexp_replace(F.trim(reply), r"(?s)```(?:json)?\s*(.*?)\s*```", "$1")
    v = F.from_json(between(inner, "{", "}"), VERDICT)
    some = v["sufficient"].isNotNull() | v["missing"].isNotNull() | v["refine_queries"].isNotNull()
    return F.when(some, F.struct(F.coalesce(v["sufficient"], F.lit(False)).alias("sufficient"), F.coalesce(v["missing"], F.lit("")).alias("missing"), F.slice(F.coalesce(v["refine_queries"], F.array().cast("array<string>")), 1, 3).alias("refine_queries")))


def says_nothing(answer: Column) -> Column:
    """A short answer that only tells that the sources do not."""
    low, found = F.lower(answer), F.lit(False)
    for p in NO_INFO:
        found = found | low.contains(p)
    return (F.octet_length(answer) <= 800) & found


def query_problem(q: Column, most: int = 2048) -> Column:
    """'required', 'too_long', 'invalid_chars' or empty."""
    return F.when(F.coalesce(q, F.lit("")) == "", "required").when(F.octet_length(q) > most, "too_long").when(q.rlike(r"[\p{Cc}\p{Cf}]"), "invalid_chars").otherwise("")
