"""The inverted index: forward rows, postings by term, document frequencies, corpus statistics; passages."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..storage import spread, written

#: Directories that postings are dealt to by term.
TERM_BUCKETS = 16
FORWARD = "doc_id long, host string, lang string, title_len long, body_len long, doc_len long, terms array<string>, tfs array<int>"


def adapted(documents: DataFrame) -> DataFrame:
    """Driver documents with a title (their first line) and an address."""
    return documents.withColumns({"title": T.first_line(F.col("text")), "url": F.concat(F.lit("doc://"), "source", F.lit("/"), F.col("doc_id").cast("string"))})


def words_of() -> Callable[[str | None], list[str]]:
    """The tokenizer of single texts, for use in workers: the words of T.tokens."""
    find, stop = re.compile("[a-z0-9]{2,}").findall, frozenset(T.STOPWORDS)
    return lambda text: [w for w in find((text or "").lower()) if w not in stop]


def forward(docs: DataFrame, tokenize: Callable[[], Callable[[str | None], list[str]]] = words_of) -> DataFrame:
    """One row per document with its distinct terms and their counts (title words count threefold); texts are read
    once. docs: doc_id, title, text, url, and lang if there is one. `tokenize` makes the tokenizer in a worker."""
    host = U.host(F.col("url")) if "url" in docs.columns else F.lit(None).cast("string")
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long"), host.alias("host"), lang.alias("lang"), "title", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenize()
        for b in batches:
            titles, bodies, terms, tfs = [], [], [], []
            for title, text in zip(b.column(3).to_pylist(), b.column(4).to_pylist()):
                head, body = words(title), words(text)
                n = Counter(body)
                for w in head:
                    n[w] += T.TITLE_WEIGHT
                titles.append(len(head))
                bodies.append(len(body))
                terms.append(list(n))
                tfs.append(list(n.values()))
            sizes = [x + y for x, y in zip(titles, bodies)]
            cols = [pa.array(titles, pa.int64()), pa.array(bodies, pa.int64()), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.string())), pa.array(tfs, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *cols], ["doc_id", "host", "lang", "title_len", "body_len", "doc_len", "terms", "tfs"])

    return rows.mapInArrow(run, FORWARD)


def exploded(rows: DataFrame) -> DataFrame:
    """Postings of forward rows: term, doc_id, host, lang, doc_len, tf."""
    x = rows.select("doc_id", "host", "lang", "doc_len", F.explode(F.arrays_zip("terms", "tfs")).alias("_x"))
    return x.select(F.col("_x.terms").alias("term"), "doc_id", "host", "lang", "doc_len", F.col("_x.tfs").cast("long").alias("tf"))


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(TERM_BUCKETS)).cast("int")


def statistics(rows: DataFrame) -> DataFrame:
    """One row: documents, their mean length, words. Documents without a word have no length and do not count."""
    sized = rows.where("doc_len > 0")
    return sized.agg(F.count("*").alias("n_docs"), F.avg("doc_len").alias("mean_len"), F.coalesce(F.sum("doc_len"), F.lit(0)).alias("n_tokens"))


class Index:
    """A stored index: forward rows, postings in directories by term, term frequencies, statistics."""

    def __init__(self, rows: DataFrame, terms: DataFrame, stats: DataFrame):
        self.rows, self.terms, self.stats = rows, terms, stats
        self._postings: DataFrame | None = None

    @classmethod
    def of(cls, docs: DataFrame, tokenize: Callable = words_of) -> Index:
        """Tokenises docs once and writes what searches read."""
        return cls.over(written(forward(spread(docs), tokenize), "forward"))

    @classmethod
    def over(cls, rows: DataFrame) -> Index:
        terms = written(rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")), "terms")
        return cls(rows, terms, written(statistics(rows), "statistics"))

    @property
    def postings(self) -> DataFrame:
        """Postings dealt to directories by term and sorted by it, so a scan by term reads one directory's row groups."""
        if self._postings is None:
            p = exploded(self.rows).withColumn("bucket", bucket_of(F.col("term")))
            self._postings = written(p.repartition("bucket").sortWithinPartitions("bucket", "term", "host", "doc_id"), "postings", ["bucket"])
        return self._postings

    def scan(self, terms: list[str], host: str | None = None) -> DataFrame:
        """Postings of some terms, in one host where one is given: pruned by directory and pushed down by term."""
        spark = self.rows.sparkSession
        found = {r[0] for r in spark.createDataFrame([(t,) for t in terms], "term string").select(bucket_of(F.col("term"))).distinct().collect()} if terms else set()
        p = self.postings.where(F.col("bucket").isin(sorted(found)) & F.col("term").isin(list(terms)))
        return (p if host is None else p.where(F.col("host") == host)).drop("bucket")

    def reindexed(self, docs: DataFrame, removed: DataFrame | None = None) -> Index:
        """The index after documents were replaced or added (docs) or removed (doc_id): old rows of theirs go, so no term
        of an old text stays."""
        new = forward(docs)
        gone = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
        if removed is not None:
            gone = gone.union(removed.select(F.col("doc_id").cast("long")))
        return Index.over(written(self.rows.join(gone.distinct(), "doc_id", "left_anti").unionByName(new), "forward"))


_stored: dict[tuple[str, str], Index] = {}


def stored(spark: SparkSession, name: str, docs: Callable[[], DataFrame]) -> Index:
    """The index of a corpus, built once an application: tables of a name do not change within one."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _stored:
        _stored[key] = Index.of(docs())
    return _stored[key]


def postings(docs: DataFrame) -> DataFrame:
    """term, doc_id, tf and doc_len (words of title and text), without a stored index."""
    return exploded(forward(docs))


def doc_freq(post: DataFrame) -> DataFrame:
    return post.groupBy("term").agg(F.count("*").alias("df"))


def replaced_terms(old: DataFrame, new: DataFrame) -> DataFrame:
    """Per document of both: terms that only the old or only the new text has. old, new: forward rows."""
    o, n = old.select("doc_id", F.col("terms").alias("_o")), new.select("doc_id", F.col("terms").alias("_n"))
    return o.join(n, "doc_id").select("doc_id", F.array_sort(F.array_except("_o", "_n")).alias("gone"), F.array_sort(F.array_except("_n", "_o")).alias("come"))


def orphaned_terms(terms: DataFrame, post: DataFrame) -> DataFrame:
    """Dictionary entries that no posting has."""
    return terms.join(post.select("term"), "term", "left_anti")


def chunks(docs: DataFrame, size: int = 320, overlap: int = 64) -> DataFrame:
    """Windows of words: doc_id, chunk_no, text, first_word."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")
    step = size - overlap
    d = docs.select("doc_id", words.alias("_w")).where(F.size("_w") > 0)
    last = F.greatest(F.ceil((F.size("_w") - size) / step), F.lit(0)).cast("int")
    d = d.select("doc_id", "_w", F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"))
    return d.select("doc_id", "chunk_no", F.array_join(F.slice("_w", F.col("chunk_no") * step + 1, F.lit(size)), " ").alias("text"), (F.col("chunk_no") * step).alias("first_word"))


def chunk_spans(docs: DataFrame, size: int = 320, overlap: int = 64) -> DataFrame:
    """The same windows as byte spans of the text: doc_id, chunk_no, byte_offset, byte_length."""
    step = size - overlap

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                at = [m.span() for m in re.finditer(rb"[^ \t\n\r\x0b\x0c]+", (t or "").encode())]
                for k, first in enumerate(range(0, max(len(at) - overlap, 1) if at else 0, step)):
                    last = min(first + size, len(at)) - 1
                    out.append((i, k, at[first][0], at[last][1] - at[first][0]))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["doc_id", "chunk_no", "byte_offset", "byte_length"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, chunk_no int, byte_offset long, byte_length long")


def ranked_terms(rows: DataFrame, n: int) -> DataFrame:
    """The n best rows of each query by score, ties by term."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "term")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("query_id", "rank", "term", "score")
