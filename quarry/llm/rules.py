"""Quality rules as a bitmask ledger: every rule is evaluated once, policies are applied to the stored bits.

`measure` reads each whole text once; `ledger` stores measurements and failure bits in a table; `apply_policy` decides by
a versioned mask without touching texts again; `ablation` counts, from a histogram of masks alone, what each rule of a
policy rejects by itself and what would come back without it. Rules are written once, for columns and arrays alike.

Nulls: a null text has no words. Empty table: empty results. Repeated rows are measured one by one. Extra columns of
the input are not carried into the ledger; `filter_documents` keeps them all and adds none. Ties do not arise.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents_schema, per_batch, prepare, strings, table, written

WHITE = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_shout")


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more."""
    n = len(words)
    if n < 4:
        return 0
    index: dict[bytes, int] = {}
    a = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, n)
    m = len(index)
    if m == n:
        return 0
    if m < 2_000_000:
        key = (a[:-2] * m + a[1:-1]) * m + a[2:]
    else:
        _, pair = np.unique(a[:-2] * m + a[1:-1], return_inverse=True)
        key = pair * m + a[2:]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(n, bool)
    for k in range(3):
        cover[k : n - 2 + k] |= twice
    return int(cover.sum())


def measure_text(text: str) -> tuple[int, ...]:
    """MEASURES of one text; words are runs of anything but ASCII white space."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    upper = len(data) - len(data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    lower = len(data) - len(data.translate(None, b"abcdefghijklmnopqrstuvwxyz"))
    return (
        len(words),
        len(text) - (len(data) - len(data.translate(None, WHITE))),
        len(data) - len(data.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        upper,
        upper + lower,
        data.count(b"!!"),
    )


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and MEASURES of every whole text."""

    def run(b: pa.RecordBatch) -> dict:
        got = [measure_text(t) for t in strings(b.column(1))]
        return {"doc_id": b.column(0)} | {m: [g[k] for g in got] for k, m in enumerate(MEASURES)}

    return per_batch(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))


#: Rule k sets bit k of `failed`. Each reads measurements only, as columns or as arrays.
RULES = {
    "few_words": lambda m: m["n_words"] < 50,
    "repeated_spans": lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"],
    "symbol_heavy": lambda m: 100 * m["n_symbols"] > 8 * m["word_chars"],
    "repeated_lines": lambda m: 100 * m["n_dup_lines"] > 50 * m["n_lines"],
    "odd_word_length": lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 25 * m["n_words"]),
    "mostly_capitals": lambda m: 100 * m["n_upper"] > 60 * m["n_letters"],
    "shouting": lambda m: 100 * m["n_shout"] > 30 * m["n_words"],
}
BIT = {name: 1 << k for k, name in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_spans"]
#: Policies by version; a document is kept when no bit of the mask is set.
POLICIES = {
    1: BASE | BIT["symbol_heavy"] | BIT["repeated_lines"] | BIT["odd_word_length"],
    2: BASE | BIT["symbol_heavy"] | BIT["repeated_lines"] | BIT["odd_word_length"] | BIT["mostly_capitals"] | BIT["shouting"],
}
CURRENT = 2


def with_bits(measured: DataFrame) -> DataFrame:
    """Measurements and one failure bit per rule, each evaluated once."""
    bits, m = F.lit(0), {name: F.col(name) for name in MEASURES}
    for name, fails in RULES.items():
        bits = bits.bitwiseOR(F.when(F.coalesce(fails(m), F.lit(False)), BIT[name]).otherwise(0))
    return measured.withColumn("failed", bits.cast("int"))


def ledger(docs: DataFrame) -> DataFrame:
    """The written ledger of docs: doc_id, MEASURES and failed."""
    return written(with_bits(measure(docs)), "ledger")


def apply_policy(rows: DataFrame, version: int = CURRENT) -> DataFrame:
    return rows.withColumns(
        {
            "base_failed": F.col("failed").bitwiseAND(BASE) != 0,
            "kept": F.col("failed").bitwiseAND(POLICIES[version]) == 0,
            "policy": F.lit(version),
        }
    )


def ablation(rows: DataFrame, version: int = CURRENT) -> DataFrame:
    """Per rule of a policy: rejected by it, rejected by it alone, kept without it. Works on a histogram of masks."""
    spark, mask = rows.sparkSession, POLICIES[version]
    counts = rows.groupBy(F.col("failed").bitwiseAND(mask).alias("bits")).agg(F.count("*").alias("n"))
    rules = spark.createDataFrame([(k, b) for k, b in BIT.items() if b & mask], "rule string, bit int")
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    alone = F.col("bits") == F.col("bit")
    return (
        rules.join(F.broadcast(counts), F.lit(True), "left")
        .groupBy("rule", "bit")
        .agg(
            F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("n_rejected"),
            F.coalesce(F.sum(F.when(alone, F.col("n"))), F.lit(0)).alias("n_rejected_alone"),
            F.coalesce(F.sum(F.when((F.col("bits") == 0) | alone, F.col("n"))), F.lit(0)).alias("n_kept_without"),
        )
    )


def failed_bits(texts: list[str]) -> np.ndarray:
    """The failure bits of texts, by the same rules on arrays."""
    got = np.array([measure_text(t) for t in texts], np.int64).reshape(-1, len(MEASURES))
    m = {name: got[:, k] for k, name in enumerate(MEASURES)}
    return sum(fails(m).astype(np.int64) * BIT[name] for name, fails in RULES.items())


def filter_documents(docs: DataFrame, version: int = CURRENT) -> DataFrame:
    """The rows that a policy keeps, with the columns of docs, decided while they are read."""
    mask, at = POLICIES[version], docs.columns.index("text")

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(failed_bits(strings(b.column(at))) & mask == 0))

    return docs.mapInArrow(run, documents_schema(docs))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Besides the contract's columns: the failure bits, the policy, and where one rule alone rejects the document, that
    rule and how many documents it alone rejects."""
    prepare(spark)
    rows = ledger(table(spark, sf_dir, "documents"))
    alone = ablation(rows).select(F.col("rule").alias("only_rule"), F.col("n_rejected_alone"), F.col("bit"))
    decided = apply_policy(rows).withColumn("_bits", F.col("failed").bitwiseAND(POLICIES[CURRENT]))
    out = decided.join(F.broadcast(alone), F.col("_bits") == F.col("bit"), "left")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed", "policy", "only_rule", "n_rejected_alone")
