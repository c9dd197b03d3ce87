"""Reports on service logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import basename, http_level, if_any, is_blank, last_component, level_tag, shorten_url, trim, truncate
from ..operators.ordered import RUN, deduplicated, last_n, ranked, records
from ..operators.pairing import stacked_pairs
from ..sources.captures import text_lines
from ..tables import once
from .report import rows, titled, together

# The grammars of headers, requests and answers.
HEADER = r"(?U)^(dbug|info|warn|fail|crit|error)\s*:\s*([^\[]+?)(?:\[\d+\])?\s*$"
REQUEST = r"(?U)Start processing HTTP request (GET|POST|PUT|DELETE|PATCH) (\S+)"
ANSWER = r"(?U)Received HTTP response headers after ([\d.]+)ms\s*-\s*(\d+)"
# Messages and sources that say nothing of a running service.
STARTUP_STARTS = [
    "Configured endpoint", "Starting bus", "Bus started", "Topic:", "Subscription ", "Endpoint Ready:", "Now listening on:", "Application started", "Content root path:",
    "Hosting environment:", "Hosting start", "Searching '", "Building...", "Using launch settings", "Google Sheet schema", "Skipping initial sync",
    "Opened physical connection", "Opened connection", "Executing batch:",
]
STARTUP_PARTS = ["Worker is disabled"]
FRAMEWORK_SOURCES = ["IdentityLoggerAdapter", "HttpClient.Refit", "LogicalHandler", "ClientHandler", "Microsoft.Hosting.Lifetime", "Npgsql"]
FRAMEWORK_STARTS = ["IDX1", "Executing batch:"]
QUIET_DEBUG = ["MassTransit", "Npgsql", "Hosting"]
HTTP_SOURCES = ["HttpClient", "LogicalHandler", "ClientHandler"]
ERRORS = ["fail", "crit", "error"]


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def log_entries(lines: DataFrame) -> DataFrame:
    """(source_id, line_no, level, source, message, continuation): a header and the lines up to the next.

    The first continuation is the message. Blank lines are dropped, and lines before the first header.
    """
    own = records(lines.where(~is_blank("line")), F.col("line").rlike(HEADER), ["source_id"], "line_no", run=RUN)
    grouped = own.groupBy("source_id", "record").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("all"))
    head = F.col("all")[0]
    rest = F.transform(F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(0))), lambda x: x["line"])
    return grouped.select("source_id", head["line_no"].alias("line_no"), F.regexp_extract(head["line"], HEADER, 1).alias("level"), trim(F.regexp_extract(head["line"], HEADER, 2)).alias("source"), rest.alias("rest")).select(
        "source_id", "line_no", "level", "source", F.coalesce(trim(F.get("rest", F.lit(0))), F.lit("")).alias("message"), F.slice("rest", 2, F.greatest(F.size("rest") - 1, F.lit(0))).alias("continuation")
    )


def route() -> Column:
    """Where an entry goes, the first that fits: startup, quiet, http, trimmed, kept, framework or debug."""
    m, s, level = F.col("message"), F.col("source"), F.col("level")
    startup = _any([m.startswith(x) for x in STARTUP_STARTS]) | _any([m.contains(x) for x in STARTUP_PARTS]) | (m.startswith("Host") & m.contains("start")) | s.contains("Npgsql")
    quiet = s.contains("IdentityLoggerAdapter") | ((level == "dbug") & _any([s.contains(x) for x in QUIET_DEBUG]))
    http = _any([s.contains(x) for x in HTTP_SOURCES]) | F.col("full").contains("HTTP request") | F.col("full").contains("HTTP response")
    framework = _any([s.contains(x) for x in FRAMEWORK_SOURCES]) | _any([m.startswith(x) for x in FRAMEWORK_STARTS])
    return (
        F.when(startup, "startup").when(quiet, "quiet").when(http, "http").when(level.isin("fail", "crit"), "trimmed").when(level.isin("warn", "error"), "kept")
        .when((level == "info") & ~framework, "kept").when(level == "info", "framework").otherwise("debug")
    )


def trimmed(continuation: Column | str, most: int = 3) -> Column:
    """Of more than three lines, the first three frames, all else, and how many frames more there were."""
    c = F.col(continuation) if isinstance(continuation, str) else continuation
    framed = lambda x: F.regexp_replace(x, r"(?U)^\s+", "").rlike(r"^(?:at |---)")
    frames = F.size(F.filter(c, framed))
    places = F.filter(F.transform(c, lambda x, i: F.when(framed(x), i)), lambda i: i.isNotNull())
    last = F.get(places, F.lit(most - 1))
    kept = F.filter(c, lambda x, i: ~framed(x) | last.isNull() | (i <= last))
    more = F.array(F.concat(F.lit(" " * 13 + "... +"), (frames - most).cast("string"), F.lit(" more frames")))
    return F.when(F.size(c) <= 3, c).when(frames > most, F.concat(kept, more)).otherwise(kept)


def http_entries(routed: DataFrame) -> DataFrame:
    """Requests with their answers, those that failed or took over a second, as entries in the place of the answer."""
    started, answered = F.col("full").rlike(REQUEST), F.col("full").rlike(ANSWER)
    got = lambda pattern, i: F.regexp_extract("full", pattern, i)
    event = F.when(started, "request").when(F.col("full").startswith("Sending HTTP request"), None).when(answered, "answer")
    events = routed.where("route = 'http'").withColumn("event", event).where("event is not null")
    asked, said = F.col("event") == "request", F.col("event") == "answer"
    pairs = stacked_pairs(events.select("source_id", "line_no", F.when(asked, got(REQUEST, 1)).alias("method"), F.when(asked, got(REQUEST, 2)).alias("url"), F.when(said, got(ANSWER, 1)).alias("duration"), F.when(said, got(ANSWER, 2)).alias("status")))
    told = pairs.where((F.col("status") != "200") | (F.col("duration").try_cast("double") > 1000))
    message = F.concat("method", F.lit(" "), shorten_url("url"), F.lit(" -> "), "status", F.lit(" ("), "duration", F.lit("ms)"))
    return told.select("source_id", "line_no", http_level("status").alias("level"), F.lit("HTTP").alias("source"), message.alias("message"), F.array().cast("array<string>").alias("continuation"))


def noise_filtered(entries: DataFrame, strict_errors: bool = False) -> DataFrame:
    """Entries worth telling. ``strict_errors``: errors stay whatever their source and words."""
    full = F.concat("message", F.lit(" "), F.array_join(F.transform("continuation", trim), " "))
    routed = entries.withColumn("full", full).withColumn("route", route())
    if strict_errors:
        routed = routed.withColumn("route", F.when(F.col("level").isin(ERRORS) & F.col("route").isin("startup", "quiet", "http"), F.when(F.col("level") == "error", "kept").otherwise("trimmed")).otherwise(F.col("route")))
    routed = once(routed.where("route in ('kept', 'trimmed', 'http')"))
    own = ["source_id", "line_no", "level", "source", "message", "continuation"]
    kept = routed.where("route in ('kept', 'trimmed')").withColumn("continuation", F.when(F.col("route") == "trimmed", trimmed("continuation")).otherwise(F.col("continuation")))
    return kept.select(*own).unionByName(http_entries(routed))


def _lines(logs: DataFrame) -> DataFrame:
    return logs if "line" in logs.columns else text_lines(logs)


def log_summary(logs: DataFrame, errors_only: bool = False, last: int = 0, strict_errors: bool = False) -> DataFrame:
    """(source_id, line_no, level, source, message, continuation, repeat_count): what a log has to say, once each.

    ``logs``: (source_id, raw), or their lines (source_id, line_no, line).

    Repeats are counted by level, source and the first hundred characters; ``last`` cuts after that.
    """
    entries = log_entries(_lines(logs))
    used = entries.where(F.col("level").isin(ERRORS)) if errors_only else noise_filtered(entries, strict_errors)
    single = deduplicated(used, ["source_id"], [F.col("level"), F.col("source"), F.substring("message", 1, 100)], "line_no", "level", "source", "message", "continuation")
    return last_n(single, ["source_id"], "line_no", last)


def service_log_report(logs: DataFrame, detail: str = "default", errors_only: bool = False, last: int = 0, strict_errors: bool = False, show_all: bool = False, roots: DataFrame | None = None) -> DataFrame:
    """The report on logs (source_id, raw), or on lines of them; ``show_all``: just the lines that are not blank.

    ``roots``: (source_id) of all logs, also of those without a line.
    """
    if show_all or detail == "raw":
        lines = last_n(_lines(logs).where(~is_blank("line")), ["source_id"], "line_no", last)
        return rows(lines, "lines", 0, F.col("line"), F.col("line_no"))
    entries = once(log_summary(logs, errors_only, last, strict_errors))
    of = lambda *levels: F.count_if(F.col("level").isin(*levels))
    counts = entries.groupBy("source_id").agg(F.count("*").alias("n"), of(*ERRORS).alias("e"), of("warn").alias("w"), of("info").alias("i"))
    sums = (logs if roots is None else roots).select("source_id").distinct().join(counts, "source_id", "left")
    file = basename("source_id")
    head = F.when(F.col("n").isNull(), F.concat(F.lit("ok log n=0 file="), file)).otherwise(F.concat(F.lit("log n="), F.col("n").cast("string"), F.lit(" file="), file, if_any(F.col("e"), "e"), if_any(F.col("w"), "w"), if_any(F.col("i"), "i")))
    ordered = ranked(entries, ["source_id"], ["line_no"])
    repeat = F.when(F.col("repeat_count") > 1, F.concat(F.lit(" (x"), F.col("repeat_count").cast("string"), F.lit(")"))).otherwise("")
    text = F.concat(F.lit("["), level_tag("level"), F.lit("] "), last_component("source"), F.lit(": "), truncate("message", 200), repeat)
    under = F.transform("continuation", lambda x: F.concat(F.lit("  "), truncate(F.regexp_replace(x, r"(?U)\s+$", ""), 200)))
    whole = F.array_join(F.concat(F.array(text), under), "\n")
    return together(rows(sums, "head", 0, head, n=F.coalesce("n", F.lit(0))), titled(ordered, "entries", 1, "---"), rows(ordered, "entries", 1, whole, F.col("rank"), F.concat_ws("|", "level", "source"), F.col("repeat_count")))
