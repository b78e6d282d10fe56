"""Classifications as CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fetch_state(code: Column, parse_error: Column, found: Column) -> Column:
    return (
        F.when(parse_error, "parse_error").when(code.isNull(), "request_error").when((code == 200) & (found > 0), "ok").when(code == 200, "empty_or_filtered")
        .when(code.isin(401, 403), "blocked").when(code == 404, "not_found").when(code == 429, "rate_limited").when(code >= 500, "server_error").otherwise(F.concat(F.lit("http_"), code.cast("string")))
    )


def rss_state(feeds: Column, feeds_ok: Column, candidates: Column) -> Column:
    return F.when(feeds == 0, "not_configured").when((feeds_ok > 0) & (candidates > 0), "ok").when(feeds_ok > 0, "empty_or_filtered").otherwise("blocked_or_unavailable")


def overall(sitemap: Column, rss: Column) -> Column:
    fine = ("ok", "not_configured")
    return F.when(sitemap.isin(*fine) | rss.isin(*fine), "healthy").otherwise("needs_attention")


def error_class(message: Column) -> Column:
    """By a status code or its name, in that spelling; timeouts and ssl in any case."""
    has = lambda *terms: F.contains(message, F.lit(terms[0])) | F.contains(message, F.lit(terms[1]))
    low = F.lower(message)
    named = F.when(has("403", "Forbidden"), "forbidden").when(has("404", "Not Found"), "not_found").when(has("429", "Too Many"), "rate_limited")
    return named.when(F.contains(low, F.lit("timeout")), "timeout").when(F.contains(low, F.lit("ssl")), "ssl").otherwise("other")


def run_state(status: Column, conclusion: Column) -> Column:
    return F.when(status.isin("queued", "waiting", "requested", "pending"), "queued").when(status == "in_progress", "running").when((status == "completed") & (conclusion == "success"), "success").when(status == "completed", "failed").otherwise("idle")


def trend_run_state(own: Column, wanted: Column, status: Column) -> Column:
    known = F.lower(F.trim(status))
    return F.when(~own.eqNullSafe(wanted), "stale").when(known.isin("running", "complete", "failed"), known).otherwise("running")


def retry_after(elapsed_seconds: Column, cooldown: int = 1800) -> Column:
    return F.greatest(F.lit(0), F.lit(cooldown) - elapsed_seconds)


def progress(current: Column, total: Column) -> Column:
    part = F.round(F.try_divide(current * 100.0, total)).cast("int")
    return F.when(part.isNull(), 0).otherwise(F.least(F.lit(100), part))


def phase_progress(phase: Column, order: list[str]) -> Column:
    out = F.when(phase.isin("complete", "failed"), 100).when(phase == "idle", 5)
    for i, p in enumerate(order):
        out = out.when(phase == p, min(90, 10 + 25 * i))
    return out.otherwise(10)


def remaining(seconds: Column) -> Column:
    return F.when(seconds >= 60, F.format_string("%dm %ds", F.floor(seconds / 60), seconds % 60)).otherwise(F.format_string("%ds", seconds))


def keyword_band(n: Column) -> Column:
    return F.when(n == 0, "default").when(n < 5, "too_few").when(n > 25, "too_many").when(n > 15, "broad").otherwise("good")


def topic_of_list(name: Column) -> Column:
    return F.when(name.rlike("(?i)finance"), "finance").otherwise("luxury")
