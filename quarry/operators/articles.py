"""Articles: owners of topics, what a query is covered by, lists and pages of them, figures of the store.

Columns of an article: id, slug, base_slug, title, status, residue, prelive, vertical, quality_tier, topics, updated_at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import retrieve as V

# Similarities of a covered and of a related query, tiers by rank, statuses.
COVERED, RELATED = 0.78, 0.74
TIERS = {"thin": 1, "ok": 2, "strong": 3}
STATUSES = ["pending", "published", "held", "rejected", "tombstoned"]


def tier_rank(tier: Column) -> Column:
    out = F.lit(0)
    for name, n in TIERS.items():
        out = F.when(tier == name, n).otherwise(out)
    return out


def promoted(least: str = "ok") -> Column:
    """Published, no residue, of a tier that is at least ok."""
    floor = max(TIERS.get(least, 0), TIERS["ok"])
    return (F.col("status") == "published") & ~F.col("residue") & (tier_rank(F.col("quality_tier")) >= floor)


def owners(articles: DataFrame) -> DataFrame:
    """topic, id: the article that claims a topic, the smallest of several."""
    return articles.select("id", F.explode("topics").alias("topic")).groupBy("topic").agg(F.min("id").alias("id"))


def conflicts(articles: DataFrame, asked: DataFrame) -> DataFrame:
    """Topics that an article asks for (id, topic, place) and another one has: the first of each article."""
    own = owners(articles).select("topic", F.col("id").alias("owner"))
    j = asked.join(own, "topic").where("id <> owner")
    return j.groupBy("id").agg(F.min_by(F.struct("topic", "owner"), "place").alias("_x")).select("id", "_x.topic", "_x.owner")


def merged_lists(stored: Column, asked: Column, most: int) -> Column:
    """Stored entries, then new ones in their order as long as there is room."""
    new = F.array_except(F.array_distinct(asked), stored)
    return F.concat(stored, F.slice(new, F.lit(1), F.greatest(F.lit(most) - F.size(stored), F.lit(0))))


def dropped(stored: Column, asked: Column, most: int) -> Column:
    """How many new entries found no room."""
    return F.greatest(F.size(F.array_except(F.array_distinct(asked), stored)) - F.greatest(F.lit(most) - F.size(stored), F.lit(0)), F.lit(0))


def best_articles(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """query_id, doc_id (article), score: the article whose best vector is nearest, ties to the smaller. vectors: vec_id
    and embedding, of which several may belong to one article (article)."""
    return V.dense(queries, vectors, 1, key=F.col("article")).select("query_id", "doc_id", "score")


def verdicts(queries: DataFrame, vectors: DataFrame, articles: DataFrame, covered: float = COVERED, related: float = RELATED) -> DataFrame:
    """What each query (query_id, embedding, topic or null) is served: 'covered' by the owner of its topic if that is
    related at least (alias), else by the nearest article (embedding), 'related', or 'none'."""
    best = best_articles(queries, vectors).select("query_id", F.col("doc_id").alias("_best"), F.col("score").alias("_score"))
    claim = queries.select("query_id", "topic").join(owners(articles), "topic").select("query_id", F.col("id").alias("_owner"))
    theirs = vectors.join(claim.select(F.col("_owner").alias("article")).distinct(), "article", "left_semi")
    own = V.dense_hits(queries, theirs, 1, key=F.col("article")).select("query_id", F.col("doc_id").alias("_owner"), F.col("score").alias("_own"))
    j = queries.select("query_id").join(best, "query_id", "left").join(claim.join(own, ["query_id", "_owner"]), "query_id", "left")
    alias = F.coalesce(F.col("_own") >= related, F.lit(False))
    s = F.col("_score")
    return j.select(
        "query_id",
        F.when(alias | (s >= covered), "covered").when(s >= related, "related").otherwise("none").alias("verdict"),
        F.when(alias, "alias").when(s >= related, "embedding").alias("match"),
        F.when(alias, F.col("_owner")).when(s >= related, F.col("_best")).alias("article"),
        F.round(F.when(alias, F.col("_own")).otherwise(s), 4).alias("score"),
    )


def title_blockers(fingerprints: DataFrame, queries: DataFrame, related: float = RELATED) -> DataFrame:
    """Residues whose title fingerprint is related to a query at least: the nearest of each query."""
    return V.dense(queries, fingerprints, 1).where(F.col("score") >= related).select("query_id", F.col("doc_id").alias("article"), "score")


def listed(articles: DataFrame, status: list[str] | None = None, is_promoted: bool | None = None, vertical: str = "", updated_since: Column | None = None, least_tier: str = "ok") -> DataFrame:
    """Articles that clear every given filter; an unreadable time of update fails a bound."""
    rows = articles
    if status is not None:
        rows = rows.where(F.col("status").isin(status))
    if is_promoted is not None:
        rows = rows.where(promoted(least_tier) == is_promoted)
    if vertical:
        rows = rows.where(F.col("vertical") == vertical)
    if updated_since is not None:
        rows = rows.where(F.coalesce(F.col("updated_at") >= updated_since, F.lit(False)))
    return rows


def page(rows: DataFrame, order: str, limit: int, after: dict | None = None) -> DataFrame:
    """A page by slug (upwards), by updated_at (downwards, then id) or by readers_7d (downwards, then slug), after the
    last row of the page before."""
    keys = {"slug": [("slug", 1)], "updated_at": [("updated_at", -1), ("id", 1)], "readers_7d": [("readers_7d", -1), ("slug", 1)]}[order]
    if after:
        later, same = F.lit(False), F.lit(True)
        for name, way in keys:
            v = F.lit(after[name])
            later = later | same & (F.col(name) > v if way > 0 else F.col(name) < v)
            same = same & (F.col(name) == v)
        rows = rows.where(later)
    return rows.orderBy(*[F.asc(n) if way > 0 else F.desc(n) for n, way in keys]).limit(limit)


def figures(articles: DataFrame) -> DataFrame:
    """One row: records by status, residues by theirs, records before going live."""
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    gone = F.col("status") == "tombstoned"
    return articles.agg(*[n(F.col("status") == s).alias(s) for s in STATUSES], n(F.col("residue") & gone).alias("residues_tombstoned"), n(F.col("residue") & ~gone).alias("residues_rejected"), n(F.col("prelive")).alias("prelive"))
