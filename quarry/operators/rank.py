"""Repository ranking: merged candidates, weighted signals with their contributions, federation of sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import scalars as S

#: Weights, caps and thresholds of the ranker.
WEIGHTS = {"centrality": 0.30, "dependents": 0.20, "popularity": 0.15, "maintenance": 0.15, "quality": 0.10, "awesome_list": 0.05, "hn_mentions": 0.05}
STARS_CAP, FORKS_CAP, DEPENDENTS_CAP, HN_CAP, AWESOME_CAP, STALE_DAYS, ARCHIVED, STALE = 30_000, 5_000, 10_000, 50, 3.0, 730, 0.25, 0.5


def _known(c: Column, scaled: Column) -> Column:
    return F.when(c.isNull(), 0.5).otherwise(scaled)


def components() -> dict[str, Column]:
    """The signals in [0, 1]; unknown values are neutral."""
    c = F.col
    recency = _known(c("last_push_days_ago"), F.lit(1.0) - S.clamp(c("last_push_days_ago") / float(STALE_DAYS)))
    cadence = _known(c("release_cadence"), S.clamp(c("release_cadence") / 12.0))
    response = _known(c("issue_response_days"), F.lit(1.0) - S.clamp(c("issue_response_days") / 30.0))
    bit = lambda x: F.when(c(x), 1.0).otherwise(0.0)
    return {
        "centrality": S.clamp(F.coalesce(c("centrality"), F.lit(0.0))),
        "dependents": S.log_saturate(c("dependents_count"), DEPENDENTS_CAP),
        "popularity": S.log_saturate(c("stars"), STARS_CAP) * 0.7 + S.log_saturate(c("forks"), FORKS_CAP) * 0.3,
        "maintenance": recency * 0.4 + cadence * 0.3 + response * 0.3,
        "quality": _known(c("openssf_score"), S.clamp(c("openssf_score") / 10.0)) * 0.5 + bit("license_present") * 0.25 + bit("has_tests_heuristic") * 0.25,
        "awesome_list": S.clamp(c("awesome_list_memberships") / AWESOME_CAP),
        "hn_mentions": S.log_saturate(c("hn_mentions"), HN_CAP),
    }


def score(candidates: DataFrame) -> DataFrame:
    """``candidates`` with a contribution per signal, ``maintenance_gate``, and their sum ``score``."""
    parts = {k: v * WEIGHTS[k] for k, v in components().items()}
    gate = F.when(F.col("archived"), ARCHIVED).otherwise(1.0) * F.when(F.col("last_push_days_ago") > STALE_DAYS, STALE).otherwise(1.0)
    out = candidates.select("*", *[v.alias(f"c_{k}") for k, v in parts.items()], gate.alias("gate"))
    base = reduce(lambda a, b: a + b, [F.col(f"c_{k}") for k in parts])
    return out.withColumn("c_maintenance_gate", base * (F.col("gate") - 1.0)).withColumn("score", base * F.col("gate"))


def rank(candidates: DataFrame, *, by: str = "fitness", language: str | None = None, min_stars: int = 0, limit: int = 10, offset: int = 0) -> DataFrame:
    """Filtered, scored and ordered candidates: by fitness, stars, or last update (unknown last)."""
    rows = candidates.where(F.coalesce("stars", F.lit(0)) >= min_stars)
    if language:
        rows = rows.where(F.lower("language").contains(language.lower()))
    order = {"fitness": [F.desc("score")], "stars": [F.desc("stars")], "updated": [F.asc_nulls_last("last_push_days_ago")]}[by]
    return score(rows).orderBy(*order, "repo_url").offset(offset).limit(limit)


def merge_candidates(seeds: DataFrame) -> DataFrame:
    """One candidate per canonical address: counts by maximum, flags by OR, days and scores by minimum, cadence by first known.

    ``seeds``: (seq, repo_url, source, and the signals). ``sources`` keeps the order in which they were first seen.
    """
    most, least = F.max, F.min
    first = F.min_by("release_cadence", F.when(F.col("release_cadence").isNotNull(), F.col("seq")))
    seen = F.sort_array(F.collect_list(F.struct("seq", "source")))
    out = seeds.withColumn("url", S.canonical_repo_url(F.col("repo_url"))).groupBy("url").agg(
        least("seq").alias("seq"), most("stars").alias("stars"), most("forks").alias("forks"), most("dependents_count").alias("dependents_count"),
        most("awesome_list_memberships").alias("awesome_list_memberships"), most("hn_mentions").alias("hn_mentions"), least("last_push_days_ago").alias("last_push_days_ago"),
        least("openssf_score").alias("openssf_score"), least("issue_response_days").alias("issue_response_days"), first.alias("release_cadence"),
        F.bool_or("archived").alias("archived"), F.bool_or("license_present").alias("license_present"), F.bool_or("has_tests_heuristic").alias("has_tests_heuristic"),
        F.array_distinct(F.transform(seen, lambda x: x["source"])).alias("sources"),
    )
    return out.withColumnRenamed("url", "repo_url").orderBy("seq")


def npms_scores(rows: DataFrame, value: str) -> DataFrame:
    """``rows`` with ``npms``: the curve score of ``value`` against the minimum, maximum and mean of all rows."""
    agg = rows.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.avg(value).alias("_mean"))
    lo, hi, mean = F.col("_lo"), F.col("_hi"), F.col("_mean")
    curve = S.bezier_score(S.min_max(F.col(value), lo, hi), S.min_max(mean, lo, hi))
    return rows.join(F.broadcast(agg)).withColumn("npms", F.when(hi <= lo, 0.5).otherwise(curve)).drop("_lo", "_hi", "_mean")


def federate(local: DataFrame, remote: DataFrame, key: str = "repo") -> DataFrame:
    """Local first: one row per key (case ignored), local values before remote ones, sources united."""
    values = [c for c in local.columns if c not in (key, "sources")]
    a = local.select(F.lower(key).alias("_k"), F.col(key).alias("a"), F.col("sources").alias("sa"), *[F.col(v).alias(f"a_{v}") for v in values])
    b = remote.select(F.lower(key).alias("_k"), F.col(key).alias("b"), F.col("sources").alias("sb"), *[F.col(v).alias(f"b_{v}") for v in values])
    none = F.array().cast("array<string>")
    both = a.join(b, "_k", "full_outer")
    return both.select(F.coalesce("a", "b").alias(key), *[F.coalesce(f"a_{v}", f"b_{v}").alias(v) for v in values], F.array_union(F.coalesce("sa", none), F.coalesce("sb", none)).alias("sources"))


def backend_status(responses: DataFrame) -> DataFrame:
    """Per backend: ok, degraded or error over its probes (backend, probe, status, reason), with the first reason."""
    ok, gone, weak = (F.count_if(F.col("status") == x) for x in ("ok", "unavailable", "degraded"))
    reason = F.min_by("reason", F.when(F.col("status") != "ok", F.col("probe")))
    g = responses.groupBy("backend").agg(ok.alias("ok"), gone.alias("unavailable"), weak.alias("degraded"), F.count("*").alias("total"), reason.alias("first_reason"))
    state = F.when(F.col("unavailable") == F.col("total"), "error").when((F.col("unavailable") == 0) & (F.col("degraded") == 0), "ok").otherwise("degraded")
    return g.withColumn("state", state)


def max_normalised(rows: DataFrame, value: str, out: str) -> DataFrame:
    """``rows`` with ``value`` over its maximum; 0 everywhere if that is not positive."""
    top = rows.agg(F.max(value).alias("_top"))
    return rows.join(F.broadcast(top)).withColumn(out, F.when(F.col("_top") > 0, F.col(value) / F.nullif("_top", F.lit(0))).otherwise(0.0)).drop("_top")  # one row on the right


#: Columns that change often: the repository search knows them best. The others it only fills where they are unknown.
VOLATILE, FILLED = ["stars", "forks", "archived"], ["description", "license", "language", "url"]


def merge_live(packages: DataFrame, repos: DataFrame) -> DataFrame:
    """Candidates of a package search (repo or null, package, and the columns above, pushed_at) and of a repository search, one row each.

    A repository that is a candidate already (case of its name ignored) takes the volatile columns of the repository search, and its
    time of the last push if that is known; its other columns are filled where null or empty. Candidates without a repository stay.
    """
    a = packages.select(F.lower("repo").alias("_k"), F.lit(True).alias("a"), *[F.col(c).alias(f"a_{c}") for c in ["repo", "package", "pushed_at", *VOLATILE, *FILLED]])
    b = repos.select(F.lower("repo").alias("_k"), F.lit(True).alias("b"), *[F.col(c).alias(f"b_{c}") for c in ["repo", "pushed_at", *VOLATILE, *FILLED]])
    both = a.join(b, "_k", "full_outer")
    none = F.lit(None).cast("string")
    sources = F.concat_ws(",", F.when(F.col("a"), "npm").otherwise(none), F.when(F.col("b"), "github").otherwise(none))
    filled = lambda c: F.coalesce(F.when(F.col(f"a_{c}") != "", F.col(f"a_{c}")), F.col(f"b_{c}"))
    return both.select(
        F.coalesce("a_repo", "b_repo").alias("repo"), F.col("a_package").alias("package"), *[F.coalesce(f"b_{c}", f"a_{c}").alias(c) for c in ["pushed_at", *VOLATILE]], *[filled(c).alias(c) for c in FILLED], sources.alias("sources"),
    )


def live_search(packages: DataFrame, repos: DataFrame, as_of: Column, *, by: str = "fitness", language: str | None = None, min_stars: int = 0, limit: int = 10, offset: int = 0) -> DataFrame:
    """Repository search over two sources: merged, scored without centrality, filtered, ordered and paged; with derived columns."""
    unknown = lambda kind: F.lit(None).cast(kind)
    rows = merge_live(packages, repos).where("repo IS NOT NULL").select(
        F.concat(F.lit("https://github.com/"), "repo").alias("repo_url"), "repo", "stars", "forks", F.coalesce("archived", F.lit(False)).alias("archived"), "license", "language", "sources", S.days_since(F.col("pushed_at"), as_of).alias("last_push_days_ago"),
        F.lit(0).alias("dependents_count"), unknown("double").alias("release_cadence"), unknown("double").alias("issue_response_days"), unknown("double").alias("openssf_score"), F.lit(0).alias("awesome_list_memberships"), F.lit(0).alias("hn_mentions"),
        F.col("license").isNotNull().alias("license_present"), F.lit(False).alias("has_tests_heuristic"), F.lit(0.0).alias("centrality"),
    )
    out = rank(rows.withColumn("stars", F.coalesce("stars", F.lit(0))).withColumn("forks", F.coalesce("forks", F.lit(0))), by=by, language=language, min_stars=min_stars, limit=limit, offset=offset)
    return out.withColumns({"star_tier": S.star_tier(F.col("stars")), "license_class": S.license_class(F.col("license")), "activity": S.activity(F.col("last_push_days_ago"))})


def response_flags(responses: DataFrame) -> DataFrame:
    """(partial, has_more) over all responses (status, has_more): partial if any is not ok."""
    return responses.agg(F.coalesce(F.bool_or(F.col("status") != "ok"), F.lit(False)).alias("partial"), F.coalesce(F.bool_or("has_more"), F.lit(False)).alias("has_more"))
