"""The operators over the driver's tables, each with the same as DuckDB SQL.

The tables hold no tool output, so records are made of their columns by expressions that both engines share.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .functions import text as T
from .operators import ordered as O
from .operators.pairing import nested_pairs
from .operators.paths import ancestors, common_prefix, tree_rollup, without_directories
from .plans import builds, revisions, searches, service_logs
from .sources.captures import text_lines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_lines(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """(doc_id, *more, line_no, line) of documents."""
    docs = table(spark, sf_dir, "documents")
    lines = text_lines(docs.select(F.struct("doc_id", *more).alias("source_id"), F.coalesce("text", F.lit("")).alias("raw")))
    return lines.select("source_id.*", "line_no", "line")


LINES = """doc_lines as (
    select doc_id, lang, source, cast(line_no as integer) as line_no, regexp_replace(line, '\\r+$', '') as line from (
        select doc_id, lang, source, unnest(string_split(coalesce(text, ''), chr(10))) as line,
            generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as line_no
        from documents))"""

# Fixed value: an ending for each document by its number, so that paths of every kind come up.
ENDINGS = [".cs", ".md", ".log", ".json", ".png", ".g.cs", ".csproj"]


def document_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, path): a made-up path of each document."""
    ending = F.element_at(F.array(*(F.lit(e) for e in ENDINGS)), (F.col("doc_id") % len(ENDINGS) + 1).cast("int"))
    path = F.concat("lang", F.lit("/"), "source", F.when(F.col("doc_id") % 3 == 0, F.lit("/docs")).otherwise(""), F.lit("/"), F.when(F.col("doc_id") % 11 == 0, F.lit("Program")).otherwise(F.concat(F.lit("f"), F.col("doc_id").cast("string"))), ending)
    return table(spark, sf_dir, "documents").select("doc_id", "lang", path.alias("path"))


PATHS = """doc_paths as (
    select doc_id, lang, lang || '/' || source || case when doc_id % 3 = 0 then '/docs' else '' end || '/'
        || case when doc_id % 11 = 0 then 'Program' else 'f' || doc_id end
        || (['.cs', '.md', '.log', '.json', '.png', '.g.cs', '.csproj'])[cast(doc_id % 7 as integer) + 1] as path
    from documents)"""


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, host, path) of pages, the path without query and fragment."""
    url = F.col("url")
    host, rest = F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#]*)", 1), F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*/?([^?#]*)", 1)
    return table(spark, sf_dir, "pages").select("page_id", F.lower(host).alias("host"), rest.alias("path"))


PAGES = """page_paths as (
    select page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)) as host,
        regexp_extract(url, '^[a-zA-Z]+://[^/?#]*/?([^?#]*)', 1) as path
    from pages)"""

KIND = """case
    when contains(lower({p}), '/logs/') or ends_with(lower({p}), '.log') then 'logs'
    when starts_with(lower({p}), '_local/') or starts_with(lower({p}), 'docs/') or starts_with(lower({p}), '.claude/')
        or regexp_matches(lower({p}), '\\.(md|txt|adoc|rst)$') then 'docs'
    when not contains(lower({p}), '/obj/') and not contains(lower({p}), '/bin/')
        and not regexp_matches(lower({p}), '(\\.g|\\.generated|\\.designer|\\.assemblyinfo)\\.cs$')
        and regexp_matches(lower({p}), '\\.(cs|csproj|sln|props|targets|fs|vb|ts|tsx|js|jsx|mjs|cjs|json|yml|yaml|xml|sql|ps1|sh|bicep)$') then 'code'
    else 'other' end"""


@query(f"""with {LINES}, hits as (
    select source, doc_id, count(*) as n, min(line_no) as hit_line, arg_min(line, line_no) as line
    from doc_lines where contains(lower(line), 'the') group by all
), ranked as (
    select *, row_number() over (partition by source order by n desc, doc_id) as rank, trim(regexp_replace(line, '\\s+', ' ', 'g')) as one from hits
)
select source, doc_id, n, hit_line, case when length(one) <= 100 then one else left(one, 97) || '...' end as sample, rank from ranked where rank <= 5""")
def search_file_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search for a word: of each source, the five documents with most hits and the first of these as a sample."""
    hits = document_lines(spark, sf_dir, "source").where(searches.contains_text("line", "the"))
    files = hits.groupBy("source", "doc_id").agg(F.count("*").alias("n"), F.min("line_no").alias("hit_line"), F.min_by("line", "line_no").alias("line"))
    top = O.top_k(files, ["source"], [F.desc("n"), "doc_id"], 5)
    return top.select("source", "doc_id", "n", "hit_line", T.compact("line").alias("sample"), F.col("rank").cast("long").alias("rank"))


@query(f"""with {PATHS} select lang, count(*) filter (kind = 'code') as code, count(*) filter (kind = 'docs') as docs,
    count(*) filter (kind = 'logs') as logs, count(*) filter (kind = 'other') as other
from (select lang, {KIND.format(p="path")} as kind from doc_paths) group by lang""")
def search_kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = document_paths(spark, sf_dir).select("lang", T.kind_of("path").alias("kind"))
    return kinds.groupBy("lang").agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("code", "docs", "logs", "other")))


@query(f"""with {LINES}, grouped as (
    select lang, trim(line) as sample, count(*) as n, min(struct_pack(doc_id := doc_id, line_no := line_no)) as spot
    from doc_lines where regexp_matches(line, '\\S') group by all
), ranked as (select *, row_number() over (partition by lang order by n desc, spot) as rank from grouped)
select lang, sample, n, spot.doc_id as doc_id, spot.line_no as line_no, rank from ranked where rank <= 10""")
def hit_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commonest lines of each language, ties by where they are seen first."""
    lines = document_lines(spark, sf_dir, "lang").where(~T.is_blank("line")).withColumn("at", F.struct("doc_id", "line_no"))
    groups = O.first_seen_groups(lines.withColumn("sample", T.trim("line")), ["lang"], "sample", "at")
    return O.top_k(groups, ["lang"], [F.desc("n"), "first"], 10).select("lang", "sample", "n", "first.doc_id", "first.line_no", F.col("rank").cast("long").alias("rank"))


@query(f"""with {PAGES}, grouped as (
    select host, split_part(regexp_replace(path, '^[./]+', ''), '/', 1) as part, count(*) as n from page_paths group by all
), ranked as (select *, row_number() over (partition by host order by n desc, part) as rank, count(*) over (partition by host) as parts from grouped)
select host, string_agg(part || '(' || n || ')', ',' order by rank) as top, greatest(max(parts) - 3, 0) as more from ranked where rank <= 3 group by host""")
def path_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each host's three largest first directories, and how many more it has."""
    grouped = page_paths(spark, sf_dir).groupBy("host", T.top_group("path").alias("part")).agg(F.count("*").alias("n"))
    more = grouped.groupBy("host").agg(F.greatest(F.count("*") - 3, F.lit(0)).alias("more"))
    few = O.top_k(grouped, ["host"], [F.desc("n"), "part"], 3).groupBy("host").agg(F.array_sort(F.collect_list(F.struct("rank", F.concat("part", F.lit("("), F.col("n").cast("string"), F.lit(")")).alias("item")))).alias("items"))
    return few.join(more, "host").select("host", F.array_join(F.transform("items", lambda x: x["item"]), ",").alias("top"), "more")


@query("""select page_id, case when contains(url, '/api/') then substr(url, instr(url, '/api/'))
    when regexp_matches(url, '^[^:]*://[^/]*/') then regexp_extract(url, '://[^/]*(/.*)$', 1) else url end as short from pages""")
def url_shorten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.shorten_url("url").alias("short"))


@query(f"""with {PATHS}, dirs as (
    select lang, path, list_transform(string_split(path, '/')[:-2], lambda x: lower(x)) as d from doc_paths
), ends as (select lang, min(d) as a, max(d) as b, min(path) as any_path from dirs group by lang
), depths as (select *, coalesce(list_max(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[:i] = b[:i])), 0) as depth from ends)
select lang, case when depth = 0 or (depth = 1 and a[1] = '') then '' else array_to_string(string_split(any_path, '/')[:depth], '/') || '/' end as prefix from depths""")
def common_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return common_prefix(document_paths(spark, sf_dir), ["lang"])


@query(f"""with {PATHS} select doc_id, array_to_string(string_split(path, '/')[2:], '/') as stripped from doc_paths""")
def stripped_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_paths(spark, sf_dir).select("doc_id", without_directories("path", F.lit(1)).alias("stripped"))


SCORE = """10 * (length(path) - length(replace(path, '/', ''))) + length(path)
    - case when ends_with(path, '.csproj') then 20 else 0 end - case when ends_with(path, '/Program.cs') then 20 else 0 end"""


@query(f"""with {PATHS}, scored as (
    select lang, path, doc_id, cast({SCORE} as integer) as score,
        cast({SCORE} - case when ends_with(path, '/Program.cs') then 25 else 0 end as integer) as code_score from doc_paths
), ranked as (select *, row_number() over (partition by lang order by score, path, doc_id) as rank from scored)
select lang, path, doc_id, score, code_score, rank from ranked where rank <= 20""")
def file_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of each language that a listing begins with."""
    scored = document_paths(spark, sf_dir).select("lang", "path", "doc_id", T.file_score("path").alias("score"), T.file_score("path", True).alias("code_score"))
    return O.top_k(scored, ["lang"], ["score", "path", "doc_id"], 20).withColumn("rank", F.col("rank").cast("long"))


@query(f"""with {PATHS}, above as (
    select unnest(list_transform(range(0, len(string_split(path, '/'))), lambda n: array_to_string(string_split(path, '/')[:n], '/'))) as directory from doc_paths
), f as (select directory, count(*) as n_files from above group by directory
), d as (
    select directory, count(*) as n_dirs from (
        select unnest(list_transform(range(0, len(string_split(directory, '/'))), lambda n: array_to_string(string_split(directory, '/')[:n], '/'))) as directory from f where directory <> ''
    ) group by directory)
select directory, cast(case when directory = '' then 0 else len(string_split(directory, '/')) end as integer) as depth, coalesce(n_dirs, 0) as n_dirs, n_files from f left join d using (directory)""")
def directory_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_rollup(document_paths(spark, sf_dir), [])


@query("""with numbered as (
    select *, sum(case when role = 'user' then 1 else 0 end) over (partition by conv_id order by turn, role, text rows unbounded preceding) as record from conversations
)
select conv_id, cast(record as bigint) as record, min(turn) as first_turn, count(*) - 1 as continuations from numbered where record > 0 group by conv_id, record""")
def log_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of users as headers of records, other turns as what continues them."""
    turns = table(spark, sf_dir, "conversations").withColumn("at", F.struct("turn", "role", "text"))
    own = O.records(turns, F.col("role") == "user", ["conv_id"], "at")
    return own.groupBy("conv_id", "record").agg(F.min("turn").alias("first_turn"), (F.count("*") - 1).alias("continuations"))


@query("""select event_type, left(props, 100) as message, count(*) as repeat_count, min(event_id) as event_id, arg_min(user_id, event_id) as user_id
from events group by all""")
def log_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("message", F.substring("props", 1, 100))
    return O.deduplicated(events, [], [F.col("event_type"), F.col("message")], "event_id", "event_type", "message", "user_id")


@query("""select event_type, count(*) as entries from (select distinct event_type, props from events) group by event_type""")
def log_level_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many entries a level has once repeats are one."""
    events = table(spark, sf_dir, "events")
    once = O.deduplicated(events, [], [F.col("event_type"), F.col("props")], "event_id", "event_type")
    return once.groupBy("event_type").agg(F.count("*").alias("entries"))


@query("""select event_type, event_id, user_id from events qualify row_number() over (partition by event_type order by ts desc, event_id desc) <= 20""")
def log_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    return O.last_n(events, ["event_type"], "at", 20).select("event_type", "event_id", "user_id")


def event_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as log entries (event_id, level, source, message, full)."""
    level = F.element_at(F.array(*(F.lit(x) for x in ("dbug", "info", "warn", "fail", "error"))), (F.col("event_id") % 5 + 1).cast("int"))
    source = F.element_at(F.array(*(F.lit(x) for x in ("Npgsql.Command", "Acme.Api.Orders", "MassTransit.Bus", "Net.HttpClient", "Microsoft.Hosting.Lifetime"))), (F.col("user_id") % 5 + 1).cast("int"))
    message = F.when(F.col("event_type") == "view", "Executing batch: x").when(F.col("event_type") == "signup", "Host will start").otherwise(F.concat("event_type", F.lit(" "), "props"))
    entries = table(spark, sf_dir, "events").select("event_id", level.alias("level"), source.alias("source"), message.alias("message"))
    return entries.withColumn("full", F.concat("message", F.lit(" ")))


ENTRIES = """entries as (
    select event_id, (['dbug', 'info', 'warn', 'fail', 'error'])[cast(event_id % 5 as integer) + 1] as level,
        (['Npgsql.Command', 'Acme.Api.Orders', 'MassTransit.Bus', 'Net.HttpClient', 'Microsoft.Hosting.Lifetime'])[cast(user_id % 5 as integer) + 1] as source,
        case event_type when 'view' then 'Executing batch: x' when 'signup' then 'Host will start' else event_type || ' ' || props end as message
    from events)"""


@query(f"""with {ENTRIES} select event_id, case
    when starts_with(message, 'Executing batch:') or (starts_with(message, 'Host') and contains(message, 'start')) or contains(source, 'Npgsql') then 'startup'
    when level = 'dbug' and (contains(source, 'MassTransit') or contains(source, 'Hosting')) then 'quiet'
    when contains(source, 'HttpClient') then 'http'
    when level = 'fail' then 'trimmed'
    when level in ('warn', 'error') then 'kept'
    when level = 'info' and not contains(source, 'Microsoft.Hosting.Lifetime') then 'kept'
    when level = 'info' then 'framework' else 'debug' end as route from entries""")
def log_noise_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_entries(spark, sf_dir).select("event_id", service_logs.route().alias("route"))


@query(f"""with {ENTRIES} select event_id, case when level in ('fail', 'error') then 'ERR' when level = 'warn' then 'WRN' else 'INF' end || ' '
    || string_split(source, '.')[-1] as tag from entries where level in ('fail', 'crit', 'error')""")
def log_errors_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = event_entries(spark, sf_dir).where(F.col("level").isin(service_logs.ERRORS))
    return errors.select("event_id", F.concat(T.level_tag("level"), F.lit(" "), T.last_component("source")).alias("tag"))


@query("""with steps as (
    select user_id, event_id, event_type = 'view' as opens,
        sum(case when event_type = 'view' then 1 else -1 end) over (partition by user_id order by event_id rows unbounded preceding) as d
    from events where event_type in ('view', 'click')
), lifted as (
    select *, d - least(0, min(d) over (partition by user_id order by event_id rows unbounded preceding)) as level from steps
), slots as (select *, case when opens then level else level + 1 end as slot from lifted
), seen as (
    select *, lag(event_id) over w as spot, lag(opens) over w as open from slots window w as (partition by user_id, slot order by event_id))
select user_id, spot as "open", event_id as "close" from seen where not opens and open""")
def http_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks as answers, each with the user's latest view that has none yet."""
    events = table(spark, sf_dir, "events").withColumn("opens", F.col("event_type") == "view").withColumn("closes", F.col("event_type") == "click")
    return nested_pairs(events, ["user_id"], "event_id", "opens", "closes")


@query(f"""with {LINES}, sizes as (select doc_id, cast(count(*) as integer) as total from doc_lines group by doc_id
), marks as (select doc_id, line_no, total from doc_lines join sizes using (doc_id) where length(line) between 1 and 40)
select doc_id, line_no, least(greatest(line_no, coalesce(lead(line_no) over (partition by doc_id order by line_no), total + 1) - 1), total) as range_end from marks""")
def hot_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short lines as headings, each with the line before the next."""
    lines = document_lines(spark, sf_dir)
    sizes = lines.groupBy("doc_id").agg(F.count("*").cast("int").alias("total"))
    marks = lines.where(F.length("line").between(1, 40)).join(sizes, "doc_id")
    return O.with_range_end(marks, ["doc_id"]).select("doc_id", "line_no", "range_end")


@query("""with firsts as (select o_orderpriority, o_custkey, min(o_orderkey) as seen from orders group by all
), ranked as (select *, row_number() over (partition by o_orderpriority order by seen) as rank from firsts
), names as (select o_orderpriority, count(*) as n_files, string_agg(o_custkey, ', ' order by rank) filter (rank <= 3) as files from ranked group by all
), groups as (select o_orderpriority, count(*) as n, arg_min(o_orderstatus, o_orderkey) as message from orders group by all)
select '  error ' || o_orderpriority || ' (x' || n || '): ' || message || ' [' || files || case when n_files > 3 then ' +' || (n_files - 3) else '' end || ']' as line
from groups join names using (o_orderpriority)""")
def diag_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as diagnostics: by code with a count, the first message and a few files."""
    orders = table(spark, sf_dir, "orders")
    found = orders.select(F.lit("build").alias("source_id"), F.lit("error").alias("kind"), F.lit(False).alias("vulnerable"), F.col("o_orderpriority").alias("code"), F.col("o_orderstatus").alias("message"), F.col("o_custkey").cast("string").alias("file"), F.col("o_orderkey").alias("line_no"))
    return builds.diagnostic_groups(found).select(builds.group_text().alias("line"))


@query("""with c as (select l_partkey, count(*) filter (l_returnflag = 'A') as a, count(*) filter (l_returnflag = 'N') as n, count(*) filter (l_returnflag = 'R') as r, count(*) as total from lineitem group by all)
select l_partkey, total, concat_ws(', ', case when a > 0 then a || ' low' end, case when n > 0 then n || ' moderate' end, case when r > 0 then r || ' high' end) as summary from c""")
def severity_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda flag: F.count_if(F.col("l_returnflag") == flag)
    counts = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(of("A").alias("a"), of("N").alias("n"), of("R").alias("r"), F.count("*").alias("total"))
    return counts.select("l_partkey", "total", T.severity_text(F.col("a"), F.col("n"), F.col("r"), F.lit(0)).alias("summary"))


def order_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda flag: F.count_if(F.col("l_returnflag") == flag)
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_orderkey").agg(of("A").alias("additions"), of("R").alias("deletions"))


@query("""select l_orderkey, count(*) filter (l_returnflag = 'A') as additions, count(*) filter (l_returnflag = 'R') as deletions
from lineitem group by all order by additions + deletions desc, l_orderkey limit 50""")
def diff_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty files with most changes."""
    files = order_changes(spark, sf_dir).groupBy("l_orderkey").agg(F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"))
    return files.orderBy(F.desc(F.col("additions") + F.col("deletions")), "l_orderkey").limit(50)


@query("""with files as (
    select l_suppkey, l_orderkey, row_number() over (partition by l_suppkey order by count(*) filter (l_returnflag in ('A', 'R')) desc, l_orderkey) as unit
    from lineitem group by l_suppkey, l_orderkey
), changed as (
    select l_suppkey, l_orderkey, l_linenumber, l_partkey, row_number() over (partition by l_suppkey, l_orderkey order by l_linenumber, l_partkey, l_extendedprice, l_quantity) as place
    from lineitem where l_returnflag in ('A', 'R')
), every as (
    select l_suppkey, l_orderkey, unit, null as place, 0 as spot from files
    union all select l_suppkey, l_orderkey, unit, place, place as spot from changed join files using (l_suppkey, l_orderkey) where place <= 4
), running as (select *, sum(case when place is null then 0 else 1 end) over (partition by l_suppkey order by unit, spot rows unbounded preceding) as n from every
), opened as (select *, max(case when place is null then n end) over (partition by l_suppkey, unit) as before from running)
select l_suppkey, l_orderkey, cast(unit as integer) as unit, cast(place as integer) as place from opened where unit <= 6 and before < 9 and n <= 9""")
def diff_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each supplier, changes under a budget of six files and nine lines."""
    files = O.ranked(order_changes(spark, sf_dir), ["l_suppkey"], [F.desc(F.col("additions") + F.col("deletions")), "l_orderkey"], "unit").select("l_suppkey", "l_orderkey", "unit")
    changed = table(spark, sf_dir, "lineitem").where("l_returnflag in ('A', 'R')")
    few = O.top_k(changed, ["l_suppkey", "l_orderkey"], ["l_linenumber", "l_partkey", "l_extendedprice", "l_quantity"], 4, "row_in_unit").join(files, ["l_suppkey", "l_orderkey"])
    own = ["l_suppkey", "l_orderkey", "unit", "row_in_unit"]
    every = files.withColumn("row_in_unit", F.lit(None).cast("int")).unionByName(few.select(*own)).withColumn("at", F.coalesce("row_in_unit", F.lit(0)))
    return O.budgeted(every, ["l_suppkey"], ["unit", "at"], "unit", 6, 9).select("l_suppkey", "l_orderkey", "unit", F.col("row_in_unit").alias("place"))


@query("""with coded as (
    select o_orderkey, case when o_custkey % 5 = 0 then '??' else case o_orderstatus when 'O' then ' ' when 'F' then 'M' else 'A' end || case when left(o_orderpriority, 1) in ('1', '2') then 'M' else ' ' end end as xy from orders
), entries as (
    select o_orderkey, 'untracked' as section from coded where xy = '??'
    union all select o_orderkey, 'staged' from coded where xy <> '??' and left(xy, 1) <> ' '
    union all select o_orderkey, 'modified' from coded where xy <> '??' and right(xy, 1) <> ' ')
select section, 'f' || o_orderkey as path from entries""")
def status_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as lines of a short status; one may be both staged and modified."""
    x = F.when(F.col("o_orderstatus") == "O", " ").when(F.col("o_orderstatus") == "F", "M").otherwise("A")
    y = F.when(F.substring("o_orderpriority", 1, 1).isin("1", "2"), "M").otherwise(" ")
    code = F.when(F.col("o_custkey") % 5 == 0, "??").otherwise(F.concat(x, y))
    lines = table(spark, sf_dir, "orders").select(F.lit("s").alias("source_id"), F.col("o_orderkey").alias("line_no"), F.concat(code, F.lit(" f"), F.col("o_orderkey").cast("string")).alias("line"))
    head = spark.createDataFrame([("s", 0, "## main")], "source_id string, line_no long, line string")
    return revisions.status_entries(lines.unionByName(head)).select("section", "path")


@query("""select conv_id, turn, last_value(case when role = 'user' then turn end ignore nulls) over (partition by conv_id order by turn, role, text rows unbounded preceding) as asked from conversations""")
def section_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn with the user's turn that it answers."""
    turns = table(spark, sf_dir, "conversations").withColumn("at", F.struct("turn", "role", "text"))
    return O.carried(turns, F.when(F.col("role") == "user", F.col("turn")), ["conv_id"], "at", "asked").select("conv_id", "turn", "asked")


@query("""select lang, cast(sum(quality) as bigint) as passed, cast(sum(1 - quality) as bigint) as failed, cast(sum(toxic) as bigint) as skipped, count(*) as total
from documents join labels using (doc_id) group by lang""")
def test_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id").groupBy("lang").agg(F.sum("quality").alias("passed"), F.sum(1 - F.col("quality")).alias("failed"), F.sum("toxic").alias("skipped"), F.count("*").alias("total"))


@query(f"""with {LINES}, numbered as (
    select doc_id, line, row_number() over (partition by doc_id order by line_no) as r, count(*) over (partition by doc_id) as total from doc_lines)
select doc_id, cast(case when total > 5 and r > 3 then r - total + 6 else r end as integer) as rank, line from numbered where total <= 5 or r <= 3 or r > total - 2
union all select doc_id, 4, '... (' || (total - 5) || ' lines omitted)' from numbered where r = 1 and total > 5""")
def head_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = document_lines(spark, sf_dir).withColumnRenamed("doc_id", "source_id")
    return O.head_and_tail(lines).select(F.col("source_id").alias("doc_id"), "rank", "line")


@query("""select doc_id, lang, source from documents where doc_id in (select doc_id from labels)""")
def semi_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id", "left_semi")


@query("""select source, count(*) as hidden from documents where doc_id not in (select doc_id from labels) group by source""")
def anti_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").groupBy("source").agg(F.count("*").alias("hidden"))


@query("""select 1 as branch, c_nationkey as nation, count(*) as n from customer group by all union all select 2, s_nationkey, count(*) from supplier group by all""")
def ordered_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two listings one after the other, the branch telling which."""
    customers = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n"))
    suppliers = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("n"))
    return customers.select(F.lit(1).alias("branch"), "nation", "n").unionByName(suppliers.select(F.lit(2).alias("branch"), "nation", "n"))


@query("""select p_brand, count(distinct lower(p_name)) as names from part group by p_brand""")
def distinct_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.countDistinct(F.lower("p_name")).alias("names"))


@query(f"""with {LINES} select doc_id, line_no, case when length(line) > 80 then left(line, 80) || '...' else line end as short,
    case when length(one) <= 100 then one else left(one, 97) || '...' end as compact
from (select *, trim(regexp_replace(line, '\\s+', ' ', 'g')) as one from doc_lines)""")
def truncate_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = document_lines(spark, sf_dir)
    return lines.select("doc_id", "line_no", T.truncate("line", 80).alias("short"), T.compact("line").alias("compact"))


@query(f"""with {LINES} select doc_id, line_no, printf('%4d| ', line_no) || case when length(line) > 180 then left(line, 180) || '...' else line end as shown from doc_lines where line_no between 2 and 9""")
def line_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines two to nine of every document as a card shows them."""
    lines = document_lines(spark, sf_dir).where(F.col("line_no").between(2, 9))
    return lines.select("doc_id", "line_no", T.numbered("line_no", "line").alias("shown"))


@query(f"""with {LINES} select doc_id, cast(count(*) as bigint) as lines, cast(sum(length(line)) as bigint) as chars from doc_lines group by doc_id""")
def line_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_lines(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum(F.length("line").cast("long")).alias("chars"))


@query(f"""with {PATHS} select doc_id, string_split(path, '/')[-1] as name, regexp_extract(path, '(\\.[^./]+)$', 1) as ending, regexp_replace(string_split(path, '/')[-1], '\\.[^.]*$', '') as stem,
    {KIND.format(p="path")} as kind from doc_paths""")
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = document_paths(spark, sf_dir)
    return paths.select("doc_id", T.basename("path").alias("name"), T.extension("path").alias("ending"), T.stem("path").alias("stem"), T.kind_of("path").alias("kind"))


@query(f"""with {PATHS} select doc_id, unnest(list_transform(range(0, len(string_split(path, '/'))), lambda n: array_to_string(string_split(path, '/')[:n], '/'))) as directory from doc_paths""")
def path_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_paths(spark, sf_dir).select("doc_id", F.explode(ancestors("path")).alias("directory"))


@query(f"""with {LINES}, tail as (
    select doc_id, line, line_no, row_number() over (partition by doc_id order by line_no desc) as back from doc_lines where regexp_matches(line, '\\S'))
select doc_id, cast(row_number() over (partition by doc_id order by line_no) as integer) as rank, line from tail where back <= 12""")
def raw_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last twelve lines of each document that are not blank."""
    lines = document_lines(spark, sf_dir).withColumnRenamed("doc_id", "source_id")
    return O.tail_lines(lines).select(F.col("source_id").alias("doc_id"), "rank", "line")
