"""Ranking, caps and early stops per group, as window expressions over an explicit order."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def source_priority(c: Column) -> Column:
    return F.when(c == "sitemap", 0).when(c == "rss", 1).otherwise(99)


def first_by(df: DataFrame, key: str, order: str = "ord") -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")


def top_n(df: DataFrame, group: str, n: int, *order: Column) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= n)


def capped(df: DataFrame, group: str, score: str, *order: Column) -> DataFrame:
    """df's best 10 rows of each group, with rank and what the seven best say: top (rows used), mean, high, good, cap (10, 8 or 5).

    One ranking, which is limited before it is sorted whole, and one window over what is left; df is read once."""
    ranked = top_n(df, group, 10, F.desc(score), *order)
    whole = Window.partitionBy(group)
    best = F.when(F.col("rank") <= 7, F.col(score))
    out = ranked.withColumns({"top": F.count(best).over(whole), "mean": F.avg(best).over(whole), "high": F.count_if(best >= 10).over(whole), "good": F.count_if(best >= 7).over(whole)})
    return out.withColumn("cap", F.when((F.col("mean") > 10) & (F.col("high") >= 5), 10).when((F.col("mean") >= 7) & (F.col("good") >= 3), 8).otherwise(5))


def dynamic_caps(df: DataFrame, group: str, score: str, *order: Column) -> DataFrame:
    """group, top, mean, high, good, cap: a row for each group."""
    return capped(df, group, score, *order).where("rank = 1").select(group, "top", "mean", "high", "good", "cap")


def top_by_dynamic_cap(df: DataFrame, group: str, score: str, *order: Column) -> DataFrame:
    """Rows up to their group's cap."""
    return capped(df, group, score, *order).where("rank <= cap").drop("top", "mean", "high", "good")


def before_stop(df: DataFrame, group: str, order: str, outcome: str, limits: Mapping[str, int]) -> DataFrame:
    """Rows read before any outcome has been seen as often as its limit."""
    earlier = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    going = F.lit(True)
    for name, most in limits.items():
        going = going & (F.coalesce(F.count_if(F.col(outcome) == name).over(earlier), F.lit(0)) < most)
    return df.withColumn("_going", going).where("_going").drop("_going")


def streaks(df: DataFrame, group: str, order: str, state: str) -> DataFrame:
    """Runs of equal states: group, run, state, first, polls."""
    w = Window.partitionBy(group).orderBy(order)
    change = df.withColumn("_new", F.when(F.col(state).eqNullSafe(F.lag(state).over(w)), 0).otherwise(1))
    runs = change.withColumn("run", F.sum("_new").over(w))
    return runs.groupBy(group, "run").agg(F.first(state).alias(state), F.min(order).alias("first"), F.count("*").alias("polls"))


def with_fallback(primary: DataFrame, fallback: DataFrame, group: str, least: int = 3) -> DataFrame:
    """primary, and the fallback rows of groups of which primary has fewer than `least` rows."""
    enough = primary.groupBy(group).count().where(F.col("count") >= least).select(group)
    return primary.unionByName(fallback.join(enough, group, "left_anti"))


#: Failures of one kind after which a publication is given up.
BREAKERS = {"http_401": 5, "http_403": 8, "placeholder": 5, "invalid_url": 5}


def _running(order, condition: Column) -> Column:
    """How many earlier rows hold."""
    return F.coalesce(F.count_if(condition).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def accepted(df: DataFrame, threshold: float = 1.0, probe: int = 5, tries: int = 20, buffer: int = 3, limits: Mapping[str, int] | None = None, dynamic: bool = True) -> DataFrame:
    """df's tried candidates (publication, ord, outcome, score) in the order of ord, with ok, cap and going (whether each was still tried).

    The first `probe` are always tried and set the cap; further ones are tried while fewer than cap + buffer are
    accepted and no failure has reached its limit. Windows hold at most `tries` rows of a publication."""
    limits = BREAKERS if limits is None else limits
    order = Window.partitionBy("publication").orderBy("ord")
    tried = df.withColumn("n", F.row_number().over(order)).where(F.col("n") <= tries)
    tried = tried.withColumn("ok", (F.col("outcome") == "accepted") & (F.col("score") >= threshold))
    # the probe's accepted rows are at most `probe`, so that all are among the seven best
    whole = Window.partitionBy("publication")
    best = F.when((F.col("n") <= probe) & F.col("ok"), F.col("score"))
    mean, high, good = F.avg(best).over(whole), F.count_if(best >= 10).over(whole), F.count_if(best >= 7).over(whole)
    cap = F.when((mean > 10) & (high >= 5), 10).when((mean >= 7) & (good >= 3), 8).otherwise(5)
    tried = tried.withColumn("cap", cap if dynamic else F.lit(5))
    going = _running(order, F.col("ok")) < F.col("cap") + (buffer if dynamic else 0)
    for name, most in limits.items():
        going = going & (_running(order, F.col("outcome") == name) < most)
    # once stopped, a publication stays stopped: all counts only grow
    return tried.withColumn("going", F.when(F.col("n") <= probe, True).otherwise(going))


def best_up_to_cap(kept: DataFrame) -> DataFrame:
    best = Window.partitionBy("publication").orderBy(F.desc("score"), "ord")
    return kept.withColumn("rank", F.row_number().over(best)).where("rank <= cap").select("publication", "ord", "score", "rank", "cap")


def collected(df: DataFrame, threshold: float = 1.0, probe: int = 5, tries: int = 20, buffer: int = 3, limits: Mapping[str, int] | None = None, dynamic: bool = True) -> DataFrame:
    """The best of the accepted candidates of each publication up to its cap."""
    return best_up_to_cap(accepted(df, threshold, probe, tries, buffer, limits, dynamic).where("going and ok"))


def collected_with_feeds(candidates: DataFrame, feeds: DataFrame, threshold: float = 1.0, fewest: int = 3, retries: int = 30, buffer: int = 3, limits: Mapping[str, int] | None = None, dynamic: bool = True) -> DataFrame:
    """The whole rule for a publication's candidates (publication, url, candidate_source, first_score, ord, outcome, score).

    Candidates are tried by source, then first score, then ord. A publication with fewer than `fewest` accepted ones tries
    its feeds' rows (publication, url, first_score, ord, outcome, score) whose urls were no candidates, best first,
    `retries` at most, with failures counted anew; a publication without candidates tries nothing."""
    limits = BREAKERS if limits is None else limits
    place = Window.partitionBy("publication").orderBy(source_priority(F.col("candidate_source")), F.desc("first_score"), "ord")
    tried = accepted(candidates.withColumn("given", F.col("ord")).withColumn("ord", F.row_number().over(place)), threshold, buffer=buffer, limits=limits, dynamic=dynamic)
    first = tried.where("going and ok")
    so_far = tried.groupBy("publication").agg(F.count_if(F.col("going") & F.col("ok")).alias("had"), F.max("cap").alias("cap"))
    untried = feeds.join(candidates.select("publication", "url"), ["publication", "url"], "left_anti")
    again = Window.partitionBy("publication").orderBy(F.desc("first_score"), "ord")
    extra = untried.withColumn("n", F.row_number().over(again)).where(F.col("n") <= retries).join(so_far.where(F.col("had") < fewest), "publication")
    extra = extra.withColumn("ok", (F.col("outcome") == "accepted") & (F.col("score") >= threshold))
    order = Window.partitionBy("publication").orderBy("n")
    going = F.col("had") + _running(order, F.col("ok")) < F.col("cap") + (buffer if dynamic else 0)
    for name, most in limits.items():
        going = going & (_running(order, F.col("outcome") == name) < most)
    more = extra.withColumn("going", going).where("going and ok")
    # of equal scores the earlier tried stands first
    both = first.select("publication", "url", "given", F.col("ord").cast("long").alias("ord"), "score", "cap").unionByName(more.select("publication", "url", F.col("ord").alias("given"), (F.col("n") + 1000).cast("long").alias("ord"), "score", "cap"))
    best = Window.partitionBy("publication").orderBy(F.desc("score"), "ord")
    return both.withColumn("rank", F.row_number().over(best)).where("rank <= cap").select("publication", "url", F.col("given").alias("ord"), "score", "rank", "cap")
