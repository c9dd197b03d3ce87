"""The reports over captures that are made of the driver's tables, each with the same as DuckDB SQL.

A capture is the text of a bounded run of ids, so that there are more captures, not longer ones, as tables grow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .functions import text as T
from .plans import builds, files, revisions, searches, service_logs
from .plans.report import rendered
from .queries import ENTRIES, KIND, LINES, PATHS, SCORE, document_paths, event_entries, query, table
from .registry import resolve
from .sources.captures import text_lines
from .sources.files import changed_files, decoded, included, looks_binary, searchable
from .tables import once

#: Ids in a capture.
SPAN = 500


def span(name: Column | str, number: str, by: int = SPAN) -> Column:
    """The capture of an id: a name and a run of ids."""
    return F.concat(F.col(name) if isinstance(name, str) else name, F.lit("-"), F.floor(F.col(number) / by).cast("string"))


def grouped_raw(frame: DataFrame, by: Column, line: Column, *order: str, exit_code: Column | int = 0, stderr: Column | str = "") -> DataFrame:
    """Captures of one text for each group, its lines in order; ``by`` bounds how many lines that are."""
    rows = frame.groupBy(by.alias("capture_id")).agg(F.array_sort(F.collect_list(F.struct(*order, line.alias("line")))).alias("rows"))
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return once(rows.select("capture_id", F.array(F.lit("x")).alias("command"), as_column(exit_code).cast("int").alias("exit_code"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("stdout"), as_column(stderr).alias("stderr")))


#: Paths of documents with their captures, and what is left of them without the directory that all share.
SPANNED = f"""{PATHS}, spans as (
    select lang || '-' || doc_id // {SPAN} as source_id, doc_id, path, array_to_string(string_split(path, '/')[2:], '/') as short from doc_paths)"""


@query(f"""with {SPANNED}, listed as (select * from spans where doc_id % 13 <> 4
), grouped as (select source_id, split_part(short, '/', 1) as part, count(*) as n from listed group by all
), ranked as (select *, row_number() over (partition by source_id order by n desc, part) as rank from grouped
), paths as (select source_id, short, row_number() over (partition by source_id order by doc_id) as rank, count(*) over (partition by source_id) as n from listed
), errors as (select source_id, count(*) filter (doc_id % 13 <> 4) as n, count(*) filter (doc_id % 13 = 4) as err from spans group by all)
select source_id, 0 as part, 0 as rank, 'find n=' || n || case when err > 0 then ' err=' || err else '' end as detail from errors
union all select source_id, 1, 0, 'top=' || string_agg(part || '(' || n || ')', ',' order by rank) from ranked where rank <= 3 group by source_id
union all select distinct source_id, 2, -1, 'paths:' from listed
union all select source_id, 2, rank, '  ' || short from paths where rank <= 5
union all select distinct source_id, 3, 0, '+' || (n - 5) || ' more paths' from paths where n > 5""")
def find_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report on listings of paths, in which some directories could not be entered."""
    line = F.when(F.col("doc_id") % 13 == 4, F.concat(F.lit("find: '"), "path", F.lit("': Permission denied"))).otherwise(F.col("path"))
    raw = grouped_raw(document_paths(spark, sf_dir), span("lang", "doc_id"), line, "doc_id")
    return searches.find_report(raw).select("source_id", "part", "rank", "detail")


@query(f"""with {SPANNED}, hits as (
    select source_id, doc_id, n_chars % 97 + 1 as spot, 'Run ' || n_chars % 10 as content, short from spans join documents using (doc_id)
), files as (select source_id, short, count(*) as n, row_number() over (partition by source_id order by count(*) desc, short) as rank from hits group by source_id, short
), samples as (select source_id, content, count(*) as n, min(doc_id) as first, arg_min(short || ':' || spot, doc_id) as place from hits group by all
), ranked as (select *, row_number() over (partition by source_id order by n desc, first) as rank from samples)
select source_id, 0 as part, 0 as rank, 'rg m=' || count(*) || ' f=' || count(distinct short) as detail from hits group by source_id
union all select source_id, 1, 0, 'top=' || string_agg(short || '(' || n || ')', ',' order by rank) from files where rank <= 3 group by source_id
union all select distinct source_id, 2, -1, 'samples:' from hits
union all select source_id, 2, rank, '  ' || place || ' ' || content from ranked where rank <= 3
union all select source_id, 5, 0, '+' || (count(*) - 3) || ' more files' from files group by source_id having count(*) > 3""")
def grep_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report on search hits, a hit in each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    line = F.concat("path", F.lit(":"), (F.col("n_chars") % 97 + 1).cast("string"), F.lit(":Run "), (F.col("n_chars") % 10).cast("string"))
    raw = grouped_raw(document_paths(spark, sf_dir).join(docs, "doc_id"), span("lang", "doc_id"), line, "doc_id")
    return searches.grep_report(raw, tool="rg").select("source_id", "part", "rank", "detail")


FOCUS = f"""{SPANNED}, hits as (
    select source_id, doc_id, n_chars % 97 + 1 as spot, 'Run   ' || n_chars % 10 as content, short, path from spans join documents using (doc_id)
), files as (
    select source_id, short, {KIND.format(p="short")} as kind, count(*) as n, arg_min(spot || ' ' || replace(content, '   ', ' '), spot * 100000000 + doc_id) as sample from hits group by source_id, short
)"""


@query(f"""with {FOCUS}, code as (select *, row_number() over (partition by source_id order by n desc, short) as rank from files where kind = 'code'
), counts as (select source_id, count(*) as f, sum(n) as m, count(*) filter (kind = 'code') as c, count(*) filter (kind = 'docs') as d, count(*) filter (kind = 'logs') as l, count(*) filter (kind = 'other') as o from files group by source_id)
select source_id, 0 as part, 0 as rank, 'focus m=' || m || ' f=' || f || ' code=' || c || ' docs=' || d || ' logs=' || l || case when o > 0 then ' other=' || o else '' end as detail from counts
union all select source_id, 1, 0, 'code=' || string_agg(short || '(' || n || ')', ',' order by rank) from code where rank <= 5 group by source_id
union all select distinct source_id, 3, -1, 'samples:' from code
union all select source_id, 3, rank, '  ' || short || ':' || sample from code where rank <= 3
union all select source_id, 4, 0, '+' || (f - least(c, 5)) || ' more files' from counts where f > least(c, 5)""")
def focus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report on a code search, a hit in each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    line = F.concat("path", F.lit(":"), (F.col("n_chars") % 97 + 1).cast("string"), F.lit(":Run   "), (F.col("n_chars") % 10).cast("string"))
    raw = grouped_raw(document_paths(spark, sf_dir).join(docs, "doc_id"), span("lang", "doc_id"), line, "doc_id")
    return searches.focus_report(raw).select("source_id", "part", "rank", "detail")


@query(f"""with {ENTRIES}, spans as (
    select e.event_id, v.event_type || '-' || e.event_id // {SPAN} as source_id, level, source, message from entries e join events v using (event_id)
), placed as (select *, 2 * row_number() over (partition by source_id order by event_id) - 1 as pos from spans)
select source_id, level, source, left(message, 100) as message, count(*) as repeat_count, cast(min(pos) as integer) as line_no from placed
where level in ('fail', 'error') group by source_id, level, source, left(message, 100)""")
def service_log_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs made of events: errors once each, with their repeats."""
    entries = event_entries(spark, sf_dir).join(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id")
    line = F.concat("level", F.lit(": "), "source", F.lit("[1]\n      "), "message")
    raw = grouped_raw(entries, span("event_type", "event_id"), line, "event_id").select(F.col("capture_id").alias("source_id"), F.col("stdout").alias("raw"))
    return service_logs.log_summary(raw, errors_only=True).select("source_id", "level", "source", "message", "repeat_count", "line_no")


#: Lines of a short status, a file for each order, by the capture that they are in.
STATUS = """coded as (
    select {by} as source_id, o_orderkey, case when o_custkey % 5 = 0 then '??' else case o_orderstatus when 'O' then ' ' when 'F' then 'M' else 'A' end || case when left(o_orderpriority, 1) in ('1', '2') then 'M' else ' ' end end as xy from orders
), entries as (
    select source_id, o_orderkey, 3 as place, 'u' as tag from coded where xy = '??'
    union all select source_id, o_orderkey, 1, 's' from coded where xy <> '??' and left(xy, 1) <> ' '
    union all select source_id, o_orderkey, 2, 'm' from coded where xy <> '??' and right(xy, 1) <> ' '
), status_rows as (select *, row_number() over (partition by source_id order by place, o_orderkey) as rank from entries
), status_counts as (
    select source_id, count(*) filter (tag = 's') as st, count(*) filter (tag = 'm') as mod, count(*) filter (tag = 'u') as untr
    from (select distinct source_id from coded) left join entries using (source_id) group by source_id)"""
STATUS_HEAD = "case when st + mod + untr = 0 then 'ok ' else '' end || 'status st=' || st || ' mod=' || mod || ' untr=' || untr"


def status_code() -> Column:
    """The two letters of an order's file."""
    x = F.when(F.col("o_orderstatus") == "O", " ").when(F.col("o_orderstatus") == "F", "M").otherwise("A")
    y = F.when(F.substring("o_orderpriority", 1, 1).isin("1", "2"), "M").otherwise(" ")
    return F.when(F.col("o_custkey") % 5 == 0, "??").otherwise(F.concat(x, y))


@query(f"""with {STATUS.format(by=f"o_orderpriority || '-' || o_orderkey // {SPAN}")}
select source_id, 0 as part, {STATUS_HEAD} || ' br=' || replace(source_id, ' ', '_') as detail from status_counts
union all select source_id, 1, 'top=' || string_agg(tag || ':f' || o_orderkey, ',' order by rank) from status_rows where rank <= 5 group by source_id""")
def status_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report on short statuses of orders."""
    orders = table(spark, sf_dir, "orders").withColumn("name", span("o_orderpriority", "o_orderkey"))
    lines = orders.select("name", "o_orderkey", F.concat(status_code(), F.lit(" f"), F.col("o_orderkey").cast("string")).alias("line"))
    heads = orders.select("name", F.lit(-1).cast("long").alias("o_orderkey"), F.concat(F.lit("## "), "name", F.lit("...origin/x")).alias("line")).distinct()
    raw = grouped_raw(lines.unionByName(heads), F.col("name"), F.col("line"), "o_orderkey")
    return revisions.status_report(raw).select("source_id", "part", "detail")


@query(f"""with s as (select s_nationkey || '-' || s_suppkey // {SPAN} as source_id, sum(s_suppkey % 2) as failed, sum(s_suppkey % 10) as passed, sum(s_suppkey % 3) as skipped, count(*) as p from supplier group by all)
select source_id, case when failed > 0 then 'FAIL test pass=' || passed || ' fail=' || failed else 'ok test pass=' || passed end || case when skipped > 0 then ' skip=' || skipped else '' end || ' p=' || p as detail from s""")
def test_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report on test runs, a line of totals for each supplier."""
    k = F.col("s_suppkey")
    line = F.concat(F.lit("Passed!  - Failed: "), (k % 2).cast("string"), F.lit(", Passed: "), (k % 10).cast("string"), F.lit(", Skipped: "), (k % 3).cast("string"), F.lit(", Total: "), (k % 2 + k % 10 + k % 3).cast("string"))
    raw = grouped_raw(table(spark, sf_dir, "supplier"), span(F.col("s_nationkey").cast("string"), "s_suppkey"), line, "s_suppkey")
    return builds.test_report(raw).select("source_id", "detail")


@query(f"""with lines as (select c_nationkey || '-' || c_custkey // {SPAN} as source_id, c_custkey, c_custkey % 3 as kind, 'p : warning NU190' || c_custkey % 4 || ': w' as key from customer
), warned as (select source_id, key, count(*) as n, min(c_custkey) as first from lines where kind = 1 group by all
), ranked as (select *, row_number() over (partition by source_id order by first) as rank from warned)
select source_id, 0 as part, 0 as rank, 'ok restore p=' || count(*) filter (kind = 0) || case when count(*) filter (kind = 1) > 0 then ' nu=' || count(*) filter (kind = 1) else '' end as detail from lines group by source_id
union all select distinct source_id, 3, -1, 'NuGet Vulnerabilities:' from warned
union all select source_id, 3, rank, '  ' || key || case when n > 1 then ' (x' || n || ')' else '' end from ranked where rank <= 8""")
def restore_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report on package restores, a line for each customer."""
    k = F.col("c_custkey")
    line = F.when(k % 3 == 0, "  Restored /w/p.csproj (in 1 ms).").when(k % 3 == 1, F.concat(F.lit("p : warning NU190"), (k % 4).cast("string"), F.lit(": w [/w/"), k.cast("string"), F.lit(".csproj]"))).otherwise("  Determining projects to restore...")
    raw = grouped_raw(table(spark, sf_dir, "customer"), span(F.col("c_nationkey").cast("string"), "c_custkey"), line, "c_custkey")
    return builds.restore_report(raw).select("source_id", "part", "rank", "detail")


@query(f"""with d as (select c_nationkey || '-' || c_custkey // {SPAN} as source_id, c_custkey, case when c_custkey % 2 = 0 then 'error' else 'warning' end as kind, 'CS' || c_custkey % 7 as code, 'm' || c_custkey % 5 as message, 'f' || c_custkey % 11 || '.cs' as name from customer
), names as (select source_id, kind, code, name, min(c_custkey) as seen from d group by all
), few as (select *, row_number() over (partition by source_id, kind, code order by seen) as r from names
), listed as (select source_id, kind, code, count(*) as n_files, string_agg(name, ', ' order by r) filter (r <= 3) as files, min(name) filter (r = 1) as file from few group by all
), groups as (select source_id, kind, code, count(*) as n, min(c_custkey) as first, arg_min(message, c_custkey) as message from d group by all
), ranked as (select *, row_number() over (partition by source_id, kind order by first) as rank from groups join listed using (source_id, kind, code))
select source_id, 0 as part, 0 as rank, 'ok build p=0 e=' || count(*) filter (kind = 'error') || ' w=' || count(*) filter (kind = 'warning') as detail from d group by source_id
union all select distinct source_id, 2, -2, '---' from d where kind = 'error' union all select distinct source_id, 2, -1, 'Errors:' from d where kind = 'error'
union all select distinct source_id, 3, -1, 'Warnings:' from d where kind = 'warning'
union all select source_id, case when kind = 'error' then 2 else 3 end, rank, case when n = 1 then '  ' || file || ' ' || kind || ' ' || code || ': ' || message
    else '  ' || kind || ' ' || code || ' (x' || n || '): ' || message || ' [' || files || case when n_files > 3 then ' +' || (n_files - 3) else '' end || ']' end from ranked""")
def build_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report on builds, a diagnostic for each customer."""
    k = F.col("c_custkey")
    text = lambda n: (k % n).cast("string")
    line = F.concat(F.lit("/w/lib/f"), text(11), F.lit(".cs("), k.cast("string"), F.lit(",1): "), F.when(k % 2 == 0, "error").otherwise("warning"), F.lit(" CS"), text(7), F.lit(": m"), text(5), F.lit(" [/w/lib/p.csproj]"))
    raw = grouped_raw(table(spark, sf_dir, "customer"), span(F.col("c_nationkey").cast("string"), "c_custkey"), line, "c_custkey")
    return builds.build_report(raw).select("source_id", "part", "rank", "detail")


@query(f"""with spans as (select *, o_orderpriority || '-' || o_orderkey // 5000 as source_id from orders
), ranked as (select source_id, o_orderkey, o_orderstatus, row_number() over (partition by source_id order by o_orderkey) as rank from spans)
select source_id, 1 as part, cast(rank as integer) as rank, left(md5(cast(o_orderkey as varchar)), 7) || ' ' || case when o_orderstatus = 'P' then '(no message)' else 'order ' || o_orderstatus end as detail from ranked where rank <= 50
union all select source_id, 2, 0, '... +' || (count(*) - 50) || ' more commits' from spans group by source_id having count(*) > 50""")
def commit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report on logs of commits, one for each order."""
    message = F.when(F.col("o_orderstatus") == "P", "").otherwise(F.concat(F.lit("\n    order "), "o_orderstatus"))
    line = F.concat(F.lit("commit "), F.md5(F.col("o_orderkey").cast("string").cast("binary")), F.lit("\nAuthor: A <a@example.org>\nDate:   x\n"), message)
    raw = grouped_raw(table(spark, sf_dir, "orders"), span("o_orderpriority", "o_orderkey", 5000), line, "o_orderkey")
    return revisions.log_report(raw).select("source_id", "part", "rank", "detail")


@query(f"""with {PATHS}, scored as (select lang, path, row_number() over (partition by lang order by {SCORE}, path) as rank from doc_paths
), grouped as (select lang, split_part(path, '/', 1) as part, count(*) as n from doc_paths group by all
), ranked as (select *, row_number() over (partition by lang order by n desc, part) as rank from grouped)
select lang as source_id, 0 as part, 0 as rank, 'files n=' || count(*) as detail from doc_paths group by lang
union all select lang, 1, 0, 'top=' || string_agg(part || '(' || n || ')', ',' order by rank) from ranked where rank <= 3 group by lang
union all select distinct lang, 2, -1, 'list:' from doc_paths
union all select lang, 2, rank, '  ' || path from scored where rank <= 8
union all select lang, 3, 0, '+' || (count(*) - 8) || ' more files' from doc_paths group by lang having count(*) > 8""")
def files_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report on the inventory of each language's paths."""
    return files.files_report(document_paths(spark, sf_dir).withColumnRenamed("lang", "source_id")).select("source_id", "part", "rank", "detail")


@query(f"""with {PATHS}, above as (
    select lang, len(string_split(path, '/')) - 1 <= 2 as counts, unnest(list_transform(range(0, least(len(string_split(path, '/')), 3)), lambda n: array_to_string(string_split(path, '/')[:n], '/'))) as directory from doc_paths
), f as (select lang, directory, count(*) filter (counts) as n_files from above group by all
), d as (select lang, directory, (select count(*) from f as g where g.lang = f.lang and g.directory <> f.directory and (f.directory = '' or starts_with(g.directory, f.directory || '/'))) as n_dirs, n_files from f
), nodes as (select *, row_number() over (partition by lang order by string_split(lower(directory), '/'), directory) as rank from d where directory <> '')
select lang as source_id, 0 as part, 0 as rank, 'tree d=' || n_dirs || ' f=' || n_files || ' depth=2' as detail from d where directory = ''
union all select lang, 1, 0, lang || '/' from d where directory = ''
union all select lang, 2, rank, repeat('  ', len(string_split(directory, '/'))) || string_split(directory, '/')[-1] || '/ d=' || n_dirs || ' f=' || n_files from nodes""")
def tree_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report on the directories of each language's paths."""
    return files.tree_report(document_paths(spark, sf_dir).withColumnRenamed("lang", "source_id")).select("source_id", "part", "rank", "detail")


@query(f"""with {LINES}, ended as (select *, count(*) over (partition by doc_id) as n, last_value(line) over (partition by doc_id order by line_no rows between unbounded preceding and unbounded following) as final from doc_lines
), file_lines as (select doc_id, line_no, line from ended where not (line_no = n and final = '')
), sizes as (select doc_id, count(*) as total, sum(length(line)) as chars, min(line_no) filter (regexp_matches(line, '\\S')) as start from file_lines group by doc_id
), shown as (select doc_id, line_no, printf('%4d| ', line_no) || case when length(line) > 180 then left(line, 180) || '...' else line end as text, total <= 40 and chars <= 3000 as small, start from file_lines join sizes using (doc_id))
select 'doc' || doc_id as source_id, 0 as part, 0 as rank, 'view doc' || doc_id || ' lines=' || total as detail from sizes
union all select 'doc' || doc_id, 1, line_no, text from shown where small
union all select distinct 'doc' || doc_id, 4, -1, 'preview:' from shown where not small
union all select 'doc' || doc_id, 4, line_no, '  ' || text from shown where not small and line_no >= start and line_no < start + 12""")
def file_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cards of all documents, each as a file."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("source_id"), F.coalesce("text", F.lit("")).alias("raw"))
    return files.file_card(text_lines(docs, final=False)).select("source_id", "part", "rank", "detail")


#: Differences made of orders: a file for each, changed by its items, in up to two hunks; some are new, gone or binary.
DIFF = """items as (
    select l_orderkey // 400 as g, l_orderkey as o, case when l_linenumber <= 3 then 1 else 2 end as h, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_returnflag as flag, l_orderkey % 10 = 7 as bin from lineitem
), diff_files as (
    select g, o, 'o' || o || '.cs' as name, bin, count(*) filter (flag = 'A' and not bin) as a, count(*) filter (flag = 'R' and not bin) as d, case when bin then 0 else count(distinct h) end as hunks from items group by g, o, bin
), diff_ranked as (
    select *, row_number() over (partition by g order by a + d desc, name) as rank, case when hunks > 0 then row_number() over (partition by g, hunks > 0 order by a + d desc, name) end as place from diff_files
), hunks as (select distinct g, place, o, h, name from items join diff_ranked using (g, o) where place <= 3
), units as (select *, row_number() over (partition by g order by place, h) as unit from hunks
), changed as (
    select g, o, h, case when flag = 'A' then '+' else '-' end || ' part ' || l_partkey as text, row_number() over (partition by g, o, h order by l_linenumber, l_partkey, l_quantity, l_extendedprice, flag) as spot
    from items where flag in ('A', 'R') and not bin
), every as (
    select g, unit, 0 as spot, '@@ ' || name || ' ' || case when h = 1 then (o % 50 + 1) || '-' || (o % 50 + 3) else cast(o % 50 + 20 as varchar) end as text from units
    union all select g, unit, spot, text from changed join units using (g, o, h) where spot <= 4
), running as (select *, sum(case when spot = 0 then 0 else 1 end) over (partition by g order by unit, spot rows unbounded preceding) as n from every
), opened as (select *, max(case when spot = 0 then n end) over (partition by g, unit) as before from running
), shown as (select *, row_number() over (partition by g order by unit, spot) as rank from opened where unit <= 6 and before < 18 and n <= 18
), diff_sums as (
    select g, count(*) as f, sum(a) as a, sum(d) as d, count(*) filter (bin) as bins, sum(hunks) as hunks, count(*) filter (hunks > 0) as with_hunks from diff_files group by g
), diff_rest as (
    select g, f - least(with_hunks, 3) as files, hunks - (select count(*) from shown where shown.g = diff_sums.g and spot = 0) as hunks from diff_sums
), diff_rows as (
    select g, 0 as part, 0 as rank, 'diff f=' || f || ' +' || a || ' -' || d || case when bins > 0 then ' bin=' || bins else '' end as detail from diff_sums
    union all select g, 1, 0, 'top=' || string_agg(name || '(+' || a || ' -' || d || ')' || case when o % 10 = 3 then '[*new]' when o % 10 = 5 then '[del]' when bin then '[bin]' else '' end, ',' order by rank) from diff_ranked where rank <= 3 group by g
    union all select g, 2, rank, text from shown
    union all select g, 3, 0, '+' || concat_ws(', ', case when files > 0 then files || ' files' end, case when hunks > 0 then hunks || ' hunks' end) || ' more' from diff_rest where files > 0 or hunks > 0
)"""


def order_diffs(spark: SparkSession, sf_dir: str, exit_code: Column | int = 0) -> DataFrame:
    """Captures of differences, one for each run of orders."""
    text = lambda c: c.cast("string")
    second = F.col("l_linenumber") > 3
    items = table(spark, sf_dir, "lineitem").withColumn("h", F.when(second, 2).otherwise(1))
    own = ["l_orderkey", "h", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag"]
    each = items.groupBy(F.concat(F.lit("d"), text(F.floor(F.col("l_orderkey") / 400))).alias("capture_id")).agg(F.array_sort(F.collect_list(F.struct(*own))).alias("rows"))

    def line(x: Column, i: Column) -> Column:
        """What an item adds: the heads of its file and its hunk where the item before is of another, and its own line."""
        o, before = x["l_orderkey"], F.get("rows", i - 1)
        binary, path = o % 10 == 7, F.concat(F.lit("/src/o"), text(o), F.lit(".cs"))
        kind = F.when(o % 10 == 3, "\nnew file mode 100644").when(o % 10 == 5, "\ndeleted file mode 100644").otherwise("")
        names = F.when(binary, F.concat(F.lit("\nBinary files a"), path, F.lit(" and b"), path, F.lit(" differ"))).otherwise(F.concat(F.lit("\n--- a"), path, F.lit("\n+++ b"), path))
        file_line = F.concat(F.lit("diff --git a"), path, F.lit(" b"), path, kind, F.lit("\nindex 1..2"), names)
        hunk_line = F.when(x["h"] == 1, F.concat(F.lit("@@ -1,2 +"), text(o % 50 + 1), F.lit(",3 @@ class X"))).otherwise(F.concat(F.lit("@@ -9 +"), text(o % 50 + 20), F.lit(" @@")))
        sign = F.when(x["l_returnflag"] == "A", "+").when(x["l_returnflag"] == "R", "-").otherwise(" ")
        opens_file = ~before["l_orderkey"].eqNullSafe(o)
        opens_hunk = ~binary & (opens_file | (before["h"] != x["h"]))
        return F.when(~binary | opens_file, F.concat_ws("\n", F.when(opens_file, file_line), F.when(opens_hunk, hunk_line), F.when(~binary, F.concat(sign, F.lit(" part "), text(x["l_partkey"])))))

    code = exit_code if isinstance(exit_code, Column) else F.lit(exit_code)
    return once(each.select("capture_id", F.array(F.lit("x")).alias("command"), code.cast("int").alias("exit_code"), F.array_join(F.transform("rows", line), "\n").alias("stdout"), F.lit("").alias("stderr")))


@query(f"with {DIFF} select 'd' || g as source_id, part, rank, detail from diff_rows")
def diff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report on differences."""
    return revisions.diff_report(order_diffs(spark, sf_dir)).select("source_id", "part", "rank", "detail")


@query(f"""with {DIFF}, {STATUS.format(by="o_orderkey // 400")}, both_ways as (
    select source_id as g, source_id % 7 = 3 as no_status, source_id % 7 = 5 as no_diff from status_counts
)
select 'd' || g as source_id, 0 as part, 0 as rank, 'fatal: ' || g as detail from both_ways where no_status
union all select 'd' || g, 0, 0, {STATUS_HEAD} || ' br=b' || g from both_ways join status_counts on source_id = g where not no_status and not no_diff
union all select 'd' || g, 1, 0, 'top=' || string_agg(tag || ':f' || o_orderkey, ',' order by rank) from both_ways join status_rows on source_id = g where rank <= 5 and not no_status and not no_diff group by g
union all select 'd' || g, 100, 0, 'error: ' || g from both_ways where no_diff
union all select 'd' || g, part + 100, rank, detail from both_ways join diff_rows using (g) where not no_status and not no_diff""")
def changes_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses and differences of the same runs of orders; some of either failed."""
    g = F.floor(F.col("o_orderkey") / 400)
    orders = table(spark, sf_dir, "orders").withColumn("g", g)
    lines = orders.select("g", "o_orderkey", F.concat(status_code(), F.lit(" f"), F.col("o_orderkey").cast("string")).alias("line"))
    heads = orders.select("g", F.lit(-1).cast("long").alias("o_orderkey"), F.concat(F.lit("## b"), F.col("g").cast("string")).alias("line")).distinct()
    status = grouped_raw(lines.unionByName(heads), F.concat(F.lit("d"), F.col("g").cast("string")), F.col("line"), "o_orderkey")

    def failing(frame: DataFrame, at: int, exit_code: int, said: str) -> DataFrame:
        number = F.substring("capture_id", 2, 20)
        fails = number.cast("long") % 7 == at
        return frame.withColumn("exit_code", F.when(fails, exit_code).otherwise(0)).withColumn("stdout", F.when(fails, F.concat(F.lit(said), number)).otherwise(F.col("stdout")))

    report = revisions.changes_report(failing(status, 3, 128, "fatal: "), failing(order_diffs(spark, sf_dir), 5, 1, "error: "))
    return report.select("source_id", "part", "rank", "detail")


@query(f"""with n as (select s_nationkey || '-' || s_suppkey // {SPAN} as source_id, s_nationkey, s_suppkey from supplier
), numbered as (select *, row_number() over (partition by source_id order by s_suppkey) as r, count(*) over (partition by source_id) as total from n)
select source_id, 0 as part, 0 as rank, string_agg('remote: ' || s_suppkey, chr(10) order by s_suppkey) as detail from numbered where total <= 5 group by source_id
union all select source_id, 1, case when r > 3 then r - total + 6 else r end, 'remote: ' || s_suppkey from numbered where total > 5 and (r <= 3 or r > total - 2)
union all select source_id, 1, 4, '... (' || (total - 5) || ' lines omitted)' from numbered where total > 5 and r = 1
union all select 'none-' || n_nationkey, 0, 0, case when n_nationkey % 2 = 0 then 'ok' else '' end from nation""")
def compact_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The head and tail of what another verb says, a line for each supplier; a call that says nothing is fine unless it fails."""
    told = grouped_raw(table(spark, sf_dir, "supplier"), span(F.col("s_nationkey").cast("string"), "s_suppkey"), F.concat(F.lit("remote: "), F.col("s_suppkey").cast("string")), "s_suppkey")
    silent = grouped_raw(table(spark, sf_dir, "nation"), F.concat(F.lit("none-"), F.col("n_nationkey").cast("string")), F.lit(""), "n_nationkey", exit_code=F.element_at("rows.n_nationkey", 1) % 2)
    return resolve(["git", "push"])(told.unionByName(silent)).select("source_id", "part", "rank", "detail")


@query(f"""with d as (
    select c_nationkey || '-' || c_custkey // {SPAN} as source_id, c_custkey as k, c_nationkey % 2 as failed, case when c_custkey % 4 = 1 and c_nationkey % 3 = 0 then 3 else c_custkey % 4 end as kind from customer
), sums as (
    select source_id, max(failed) as failed, count(distinct k % 5) filter (kind = 0) as p, count(*) filter (kind = 1) as e, count(*) filter (kind = 2) as nu from d group by source_id
), groups as (select source_id, 'MSB' || k % 3 as code, count(*) as n, min(k) as first, arg_min('broken ' || k % 5 || ' [/w/p.csproj]', k) as message from d where kind = 1 group by all
), ranked as (select *, row_number() over (partition by source_id order by first) as rank from groups
), weak as (
    select source_id, 'P' || k % 3 as package, '1.0.' || k % 2 as version, count(*) filter (k // 4 % 4 = 0) as l, count(*) filter (k // 4 % 4 = 1) as m, count(*) filter (k // 4 % 4 = 2) as h, count(*) filter (k // 4 % 4 = 3) as c, count(*) as total, min(k) as first
    from d where kind = 2 group by all
), weak_ranked as (select *, row_number() over (partition by source_id order by first) as rank from weak
), tail as (
    select source_id, k, case kind when 0 then '  Core' || k % 5 || ' -> /w/x.dll' when 2 then '/w/p.csproj : warning NU1903: Package ''P' || k % 3 || ''' 1.0.' || k % 2 || ' has a known ' || (['low', 'moderate', 'high', 'critical'])[k // 4 % 4 + 1] || ' severity vulnerability' else 'note ' || k end as line
    from d join sums using (source_id) where sums.failed = 1 and e = 0 qualify row_number() over (partition by source_id order by k desc) <= 12
), tail_ranked as (select *, row_number() over (partition by source_id order by k) as rank from tail)
select source_id, 0 as part, 0 as rank, case when failed = 1 then 'FAIL' else 'ok' end || ' build p=' || p || case when failed = 1 or e + nu > 0 then ' e=' || e || ' w=0' || case when nu > 0 then ' nu=' || nu else '' end else '' end as detail from sums
union all select distinct source_id, 1, -1, '--- raw tail ---' from tail union all select source_id, 1, rank, '  ' || line from tail_ranked
union all select distinct source_id, 2, -2, '---' from groups union all select distinct source_id, 2, -1, 'Errors:' from groups
union all select source_id, 2, rank, case when n = 1 then '  MSBUILD error ' || code || ': ' || message else '  error ' || code || ' (x' || n || '): ' || message || ' [MSBUILD]' end from ranked
union all select distinct source_id, 4, -1, 'NuGet Vulnerabilities:' from weak
union all select source_id, 4, rank, '  ' || package || ' ' || version || ': ' || total || ' (' || concat_ws(', ', case when l > 0 then l || ' low' end, case when m > 0 then m || ' moderate' end, case when h > 0 then h || ' high' end, case when c > 0 then c || ' critical' end) || ')' from weak_ranked""")
def build_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report on builds of which half failed: errors of tools, packages with known faults, and the end of those without a reason."""
    k = F.col("c_custkey")
    text = lambda n, of=k: (of % n).cast("string")
    severity = F.element_at(F.array(*map(F.lit, ("low", "moderate", "high", "critical"))), (F.floor(k / 4) % 4 + 1).cast("int"))
    weak = F.concat(F.lit("/w/p.csproj : warning NU1903: Package 'P"), text(3), F.lit("' 1.0."), text(2), F.lit(" has a known "), severity, F.lit(" severity vulnerability"))
    tool = F.concat(F.lit("MSBUILD : error MSB"), text(3), F.lit(": broken "), text(5), F.lit(" [/w/p.csproj]"))
    line = F.when(k % 4 == 0, F.concat(F.lit("  Core"), text(5), F.lit(" -> /w/x.dll"))).when((k % 4 == 1) & (F.col("c_nationkey") % 3 != 0), tool).when(k % 4 == 2, weak).otherwise(F.concat(F.lit("note "), k.cast("string")))
    raw = grouped_raw(table(spark, sf_dir, "customer"), span(F.col("c_nationkey").cast("string"), "c_custkey"), line, "c_custkey", exit_code=F.split("capture_id", "-")[0].cast("int") % 2)
    return builds.build_report(raw).select("source_id", "part", "rank", "detail")


@query(f"""with d as (select c_nationkey || '-' || c_custkey // {SPAN} as source_id, c_custkey as k from customer
), named as (select source_id, k, row_number() over (partition by source_id order by k) as rank, count(*) over (partition by source_id) as n from d where k % 3 = 0
), sums as (select source_id, count(*) filter (k % 3 = 1) * 4 as passed, count(*) filter (k % 3 = 1) as failed, coalesce(sum(k % 2) filter (k % 3 = 1), 0) as skipped, count(*) filter (k % 3 = 1) as p, count(*) filter (k % 3 = 0) as named from d group by source_id)
select source_id, 0 as part, 0 as rank, 'FAIL test ' || case when p = 0 and named = 0 then 'e=1' else 'pass=' || passed || ' fail=' || failed || case when skipped > 0 then ' skip=' || skipped else '' end || case when p > 0 then ' p=' || p else '' end end as detail from sums
union all select distinct source_id, 2, -2, '---' from named union all select distinct source_id, 2, -1, 'Failed:' from named
union all select source_id, 2, rank * 10, '  T' || k from named where rank <= 15
union all select source_id, 2, rank * 10 + i, '    at ' || i from named, range(1, 7) as places(i) where rank <= 15 and i <= least(k % 7, 5)
union all select distinct source_id, 2, 1000, '  ... +' || (n - 15) || ' more' from named where n > 15
union all select source_id, 1, -1, '--- raw tail ---' from sums where named = 0
union all select source_id, 1, r, '  ' || line from (
    select source_id, row_number() over (partition by source_id order by k) as r, line from (
        select source_id, k, case when k % 3 = 1 then 'Failed!  - Failed: 1, Passed: 4, Skipped: ' || k % 2 || ', Total: ' || (5 + k % 2) else 'note' end as line from d join sums using (source_id)
        where sums.named = 0 qualify row_number() over (partition by source_id order by k desc) <= 12))""")
def test_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report on test runs that failed, with the names of failed tests and the first lines of what they said."""
    k = F.col("c_custkey")
    details = F.array_join(F.transform(F.sequence(F.lit(1), k % 7), lambda i: F.concat(F.lit("    at "), i.cast("string"))), "\n")
    failed = F.concat(F.lit("  Failed T"), k.cast("string"), F.lit(" [12ms]"), F.when(k % 7 > 0, F.concat(F.lit("\n"), details)).otherwise(""), F.lit("\n"))
    totals = F.concat(F.lit("Failed!  - Failed: 1, Passed: 4, Skipped: "), (k % 2).cast("string"), F.lit(", Total: "), (k % 2 + 5).cast("string"))
    line = F.when(k % 3 == 0, failed).when(k % 3 == 1, totals).otherwise("note")
    raw = grouped_raw(table(spark, sf_dir, "customer"), span(F.col("c_nationkey").cast("string"), "c_custkey"), line, "c_custkey", exit_code=1)
    return builds.test_report(raw).select("source_id", "part", "rank", "detail")


@query(f"""with coded as (
    select o_orderpriority || '-' || o_orderkey // {SPAN} as source_id, o_orderkey, case when o_custkey % 5 = 0 then 3 when o_orderstatus = 'O' then 2 else 1 end as place from orders
), ranked as (
    select *, row_number() over (partition by source_id order by place, o_orderkey) as rank, (['staged', 'modified', 'untracked'])[place] as section, case when place = 3 then 'f' else 'modified:   f' end || o_orderkey as path from coded)
select source_id, 0 as part, 0 as rank, 'status st=' || count(*) filter (place = 1) || ' mod=' || count(*) filter (place = 2) || ' untr=' || count(*) filter (place = 3) || ' br=' || replace(source_id, ' ', '_') as detail from ranked group by source_id
union all select source_id, 1, 0, 'top=' || string_agg(left(section, 1) || ':' || path, ',' order by rank) from ranked where rank <= 12 group by source_id
union all select distinct source_id, 1 + place, -1, section || ':' from ranked
union all select source_id, 1 + place, rank, '  ' || path from ranked""")
def long_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report on long statuses of orders, with all files by section."""
    return resolve(["git", "status"], "more")(long_statuses(spark, sf_dir)).select("source_id", "part", "rank", "detail")


def long_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures of long statuses, a file for each order."""
    place = F.when(F.col("o_custkey") % 5 == 0, 3).when(F.col("o_orderstatus") == "O", 2).otherwise(1)
    orders = table(spark, sf_dir, "orders").withColumn("name", span("o_orderpriority", "o_orderkey")).withColumn("place", place)
    line = F.concat(F.when(F.col("place") == 3, "\t").otherwise("\tmodified:   "), F.lit("f"), F.col("o_orderkey").cast("string"))
    title = F.when(F.col("place") == 1, "Changes to be committed:").when(F.col("place") == 2, "\nChanges not staged for commit:").otherwise("\nUntracked files:")
    first = F.lit(-1).cast("long")
    heads = orders.select("name", "place", first.alias("o_orderkey"), F.concat(title, F.lit('\n  (use "git add")')).alias("line")).distinct()
    branch = orders.select("name", F.lit(0).alias("place"), first.alias("o_orderkey"), F.concat(F.lit("On branch "), "name", F.lit("\n")).alias("line")).distinct()
    lines = orders.select("name", "place", "o_orderkey", line.alias("line")).unionByName(heads).unionByName(branch)
    return grouped_raw(lines, F.col("name"), F.col("line"), "place", "o_orderkey")


#: Logs made of events: requests and answers, faults with frames, and what services say when they start.
SERVICE = f"""service as (
    select event_id, 'log' || event_id // {SPAN} as source_id, (['dbug', 'info', 'warn', 'fail', 'error'])[event_id % 5 + 1] as level,
        (['Acme.Api.Orders', 'Microsoft.Hosting.Lifetime', 'Npgsql.Command', 'Net.Http.HttpClient.Api.ClientHandler', 'Acme.Worker'])[user_id % 5 + 1] as source,
        event_type || ' ' || user_id % 7 as said, user_id % 3000 || '.5' as ms, (['200', '404', '500', '200'])[event_id % 4 + 1] as status from events
)"""


def event_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_id, raw) of such logs."""
    at, user = F.col("event_id"), F.col("user_id")
    of = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n % len(names) + 1).cast("int"))
    level, source = of(("dbug", "info", "warn", "fail", "error"), at), of(("Acme.Api.Orders", "Microsoft.Hosting.Lifetime", "Npgsql.Command", "Net.Http.HttpClient.Api.ClientHandler", "Acme.Worker"), user)
    request = F.concat(F.lit("Start processing HTTP request GET https://h.example/api/"), at.cast("string"))
    answer = F.concat(F.lit("Received HTTP response headers after "), (user % 3000).cast("string"), F.lit(".5ms - "), of(("200", "404", "500", "200"), at))
    message = F.when(user % 5 != 3, F.concat("event_type", F.lit(" "), (user % 7).cast("string"))).when(at % 2 == 0, request).otherwise(answer)
    frames = F.when((at % 5 == 3) & (user % 5 != 3), "\n      at A()\n      at B()\n      at C()\n      at D()\n      because\n").otherwise("")
    line = F.concat(level, F.lit(": "), source, F.lit("[1]\n      "), message, frames)
    raw = grouped_raw(table(spark, sf_dir, "events"), span(F.lit("log"), "event_id"), line, "event_id")
    return raw.select(F.regexp_replace("capture_id", "-", "").alias("source_id"), F.col("stdout").alias("raw"))


@query(f"""with {SERVICE}, routed as (
    select *, case when contains(source, 'Npgsql') then 'startup' when level = 'dbug' and contains(source, 'Hosting') then 'quiet' when contains(source, 'HttpClient') then 'http'
        when level in ('fail', 'warn', 'error') then 'kept' when level = 'info' and not contains(source, 'Lifetime') then 'kept' else 'gone' end as route from service
), steps as (
    select source_id, event_id, event_id % 2 = 0 as opens, ms, status, sum(case when event_id % 2 = 0 then 1 else -1 end) over (partition by source_id order by event_id rows unbounded preceding) as d from routed where route = 'http'
), lifted as (select *, d - least(0, min(d) over (partition by source_id order by event_id rows unbounded preceding)) as depth from steps
), slots as (select *, case when opens then depth else depth + 1 end as slot from lifted
), paired as (select *, lag(event_id) over w as request, lag(opens) over w as open from slots window w as (partition by source_id, slot order by event_id)
), entries as (
    select source_id, min(event_id) as event_id, level, source, said as message, count(*) as n, level = 'fail' as framed from routed where route = 'kept' group by source_id, level, source, said
    union all select source_id, event_id, case status[1] when '2' then 'info' when '4' then 'warn' else 'fail' end, 'HTTP', 'GET /api/' || request || ' -> ' || status || ' (' || ms || 'ms)', 1, false
    from paired where not opens and open and (status <> '200' or cast(ms as double) > 1000)
), ranked as (select *, row_number() over (partition by source_id order by event_id) as rank from entries
), sums as (select source_id, count(e.event_id) as n, count(*) filter (e.level in ('fail', 'error')) as e, count(*) filter (e.level = 'warn') as w, count(*) filter (e.level = 'info') as i from (select distinct source_id from service) left join entries as e using (source_id) group by source_id)
select source_id, 0 as part, 0 as rank, case when n = 0 then 'ok log n=0 file=' || source_id else 'log n=' || n || ' file=' || source_id || case when e > 0 then ' e=' || e else '' end || case when w > 0 then ' w=' || w else '' end || case when i > 0 then ' i=' || i else '' end end as detail from sums
union all select distinct source_id, 1, -1, '---' from entries
union all select source_id, 1, rank, case when level in ('fail', 'error') then '[ERR] ' when level = 'warn' then '[WRN] ' else '[INF] ' end || string_split(source, '.')[-1] || ': ' || message || case when n > 1 then ' (x' || n || ')' else '' end
    || case when framed then replace('~  at A()~  at B()~  at C()~  because~         ... +1 more frames', '~', chr(10) || '      ') else '' end from ranked""")
def service_log_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report on service logs: noise goes, answers are told with their requests, frames are cut."""
    return service_logs.service_log_report(event_logs(spark, sf_dir)).select("source_id", "part", "rank", "detail")


@query(f"""with {SERVICE}, lines as (
    select source_id, event_id, 0 as i, level || ': ' || source || '[1]' as line from service
    union all select source_id, event_id, 1, '      ' || case when not contains(source, 'HttpClient') then said when event_id % 2 = 0 then 'Start processing HTTP request GET https://h.example/api/' || event_id else 'Received HTTP response headers after ' || ms || 'ms - ' || status end from service
    union all select source_id, event_id, 1 + i, '      ' || (['at A()', 'at B()', 'at C()', 'at D()', 'because'])[i] from service, range(1, 6) as places(i) where level = 'fail' and not contains(source, 'HttpClient'))
select source_id, line as detail from lines qualify row_number() over (partition by source_id order by event_id desc, i desc) <= 20""")
def log_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last lines of logs as they are."""
    return service_logs.service_log_report(event_logs(spark, sf_dir), show_all=True, last=20).select("source_id", "detail")


@query(f"""with {LINES} select 'doc' || doc_id as source_id, regexp_replace(coalesce(text, ''), '\\s+$', '') || case when doc_id % 3 = 0 then '' else chr(10) || 'warning: ' || source end as detail
from documents where doc_id % 3 <> 0 union all select 'doc' || doc_id, coalesce(text, '') from documents where doc_id % 3 = 0""")
def passthrough_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that no report is for: what was said, then what was said of errors, if anything was."""
    docs = table(spark, sf_dir, "documents")
    stderr = F.when(F.col("doc_id") % 3 == 0, " \n").otherwise(F.concat(F.lit("warning: "), "source"))
    raw = docs.select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("capture_id"), F.array(F.lit("x")).alias("command"), F.lit(0).alias("exit_code"), F.col("text").alias("stdout"), stderr.alias("stderr"))
    return resolve(["x"])(raw).select("source_id", "detail")


@query(f"""with {PATHS} select distinct lang as source_id, split_part(substr(path, length(lang) + 2), '/', 1) || '/' as detail from doc_paths""")
def ls_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is directly below the directory of each language."""
    below = document_paths(spark, sf_dir).select(F.col("lang").alias("source_id"), F.expr("substring(path, length(lang) + 2)").alias("path"))
    return files.list_report(below).select("source_id", "detail")


@query(f"""with e as (
    select 'code-' || event_id // {SPAN} as source_id, event_id, row_number() over (partition by event_id // {SPAN} order by event_id) as line_no, count(*) over (partition by event_id // {SPAN}) as total,
        case when event_id % 10 = 0 then 'C' || event_id when event_id % 5 = 1 then 'M' || event_id end as name,
        case when event_id % 10 = 0 then 'public sealed class C' || event_id || ' : Base' when event_id % 5 = 1 then '    public static List<int> M' || event_id || '(int x)' else '        return ' || event_id || ';' end as line from events
), found as (select *, row_number() over (partition by source_id order by line_no) as rank, coalesce(lead(line_no) over (partition by source_id order by line_no), total + 1) - 1 as range_end from e where name is not null
), begins as (select source_id, min(line_no) as start from found group by source_id)
select distinct source_id, 0 as part, 0 as rank, 'view ' || source_id || ' lines=' || total as detail from e
union all select source_id, 2, 0, 'symbols: ' || string_agg(name || '(' || line_no || ')', ', ' order by rank) from found where rank <= 8 group by source_id
union all select distinct source_id, 3, -1, 'hot:' from found
union all select source_id, 3, rank, '  ' || line_no || '-' || range_end || ' ' || name from found where rank <= 5
union all select distinct source_id, 4, -1, 'preview:' from found
union all select source_id, 4, line_no, '  ' || printf('%4d| ', line_no) || line from e join begins using (source_id) where line_no >= start and line_no < start + 12""")
def symbol_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cards of files of code, a line for each event: symbols, where each ends, and the first lines from a symbol on."""
    at = F.col("event_id")
    line = F.when(at % 10 == 0, F.concat(F.lit("public sealed class C"), at.cast("string"), F.lit(" : Base"))).when(at % 5 == 1, F.concat(F.lit("    public static List<int> M"), at.cast("string"), F.lit("(int x)"))).otherwise(F.concat(F.lit("        return "), at.cast("string"), F.lit(";")))
    raw = grouped_raw(table(spark, sf_dir, "events"), span(F.lit("code"), "event_id"), line, "event_id").select(F.col("capture_id").alias("source_id"), F.col("stdout").alias("raw"))
    return files.file_card(text_lines(raw, final=False)).select("source_id", "part", "rank", "detail")


@query(f"""with {FOCUS}, docs as (select *, row_number() over (partition by source_id order by n desc, short) as rank from files where kind = 'docs'
), visible as (select source_id, count(*) as m from (select source_id, {KIND.format(p="path")} as kind from hits) where kind = 'docs' group by source_id
), counts as (select source_id, count(*) as f, coalesce(max(m), 0) as m from docs left join visible using (source_id) group by source_id)
select source_id, 0 as part, 0 as rank, 'focus docs m=' || m || ' f=' || f as detail from counts
union all select source_id, 1, 0, 'top=' || string_agg(short || '(' || n || ')', ',' order by rank) from docs where rank <= 5 group by source_id
union all select source_id, 4, 0, '+' || (f - 5) || ' more files' from counts where f > 5""")
def focus_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report on a search in documents alone, without samples."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    line = F.concat("path", F.lit(":"), (F.col("n_chars") % 97 + 1).cast("string"), F.lit(":Run   "), (F.col("n_chars") % 10).cast("string"))
    raw = grouped_raw(document_paths(spark, sf_dir).join(docs, "doc_id"), span("lang", "doc_id"), line, "doc_id")
    return searches.focus_report(raw, scope="docs", files_only=True).select("source_id", "part", "rank", "detail")


@query(f"""with {SPANNED}, lines as (
    select source_id, doc_id, short, doc_id % 4 as form, doc_id % 6 as said, doc_id % 9 as spot from spans
), hits as (
    select source_id, doc_id, short, case when form = 0 then spot + 1 else 0 end as hit_line, case when form = 2 then '' else 'said ' || said end as content from lines where form <> 3
), files as (select source_id, short, count(*) as n, row_number() over (partition by source_id order by count(*) desc, short) as rank from hits group by source_id, short
), samples as (select source_id, content, count(*) as n, min(doc_id) as first, arg_min(short || case when hit_line > 0 then ':' || hit_line else '' end, doc_id) as place from hits where content <> '' group by all
), ranked as (select *, row_number() over (partition by source_id order by n desc, first) as rank from samples
), sums as (select source_id, count(*) filter (form <> 3) as m, count(*) filter (form = 3) as b, count(distinct short) filter (form <> 3) as f from lines group by source_id)
select source_id, 0 as part, 0 as rank, 'grep m=' || m || ' f=' || f || case when b > 0 then ' bin=' || b else '' end as detail from sums
union all select source_id, 1, 0, 'top=' || string_agg(short || '(' || n || ')', ',' order by rank) from files where rank <= 6 group by source_id
union all select distinct source_id, 2, -1, 'samples:' from samples
union all select source_id, 2, rank, '  ' || place || ' ' || content from ranked where rank <= 6
union all select source_id, 4, 0, 'more=' || string_agg(short || '(' || n || ')', ',' order by rank) from files where rank between 7 and 12 group by source_id
union all select source_id, 5, 0, '+' || (f - 6) || ' more files' from sums where f > 6""")
def grep_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longer report on hits in all forms: with a line, without, a bare path, and notes on binary files."""
    d, text = F.col("doc_id"), lambda n: (F.col("doc_id") % n).cast("string")
    said = F.concat(F.lit(":said "), text(6))
    line = F.when(d % 4 == 0, F.concat("path", F.lit(":"), (d % 9 + 1).cast("string"), said)).when(d % 4 == 1, F.concat("path", said)).when(d % 4 == 2, F.col("path")).otherwise(F.concat(F.lit("Binary file "), "path", F.lit(" matches")))
    raw = grouped_raw(document_paths(spark, sf_dir), span("lang", "doc_id"), line, "doc_id")
    return resolve(["grep"], "more")(raw).select("source_id", "part", "rank", "detail")


@query("""select 'doc' || doc_id as source_id, case when doc_id % 2 = 0 then chr(65279) else '' end || coalesce(text, '') as raw from documents""")
def encoded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as bytes in two encodings, read back; the mark of the one stays."""
    text = F.coalesce("text", F.lit(""))
    wide = F.concat(F.unhex(F.lit("FFFE")), F.encode(text, "UTF-16LE"))
    content = F.when(F.col("doc_id") % 2 == 0, wide).otherwise(F.encode(text, "UTF-8"))
    read = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("source_id"), content.alias("content"))
    return read.select("source_id", decoded("content").alias("raw"))


@query("""select event_id, event_id % 1000 < 512 as is_binary from events""")
def binary_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents with a zero byte at some place."""
    content = F.concat(F.encode(F.repeat(F.lit("x"), (F.col("event_id") % 1000).cast("int")), "UTF-8"), F.unhex(F.lit("00")))
    return table(spark, sf_dir, "events").select("event_id", looks_binary(content).alias("is_binary"))


@query(f"""with {PATHS}, below as (
    select doc_id, case doc_id % 6 when 0 then 'Bin/' when 1 then 'docs/' when 2 then 'node_modules/' when 3 then 'src/' when 4 then 'Assets/' else '' end || path as path from doc_paths
), dirs as (select *, list_transform(string_split(path, '/')[:-2], lambda x: lower(x)) as d from below)
select doc_id, not regexp_matches(lower(path), '(\\.g|\\.generated|\\.designer|\\.assemblyinfo)\\.cs$') and not list_has_any(d, ['.git', 'bin', 'obj', 'node_modules', '.idea', '.vs', 'dist', 'coverage']) as searched,
    not list_has_any(d, ['.git', 'bin', 'obj', 'node_modules', '.idea', '.vs', 'dist', 'coverage']) as listed,
    not list_has_any(d, ['.git', 'bin', 'obj', 'node_modules', '.idea', '.vs', 'dist', 'coverage', 'docs', '_local', 'assets', 'public', 'locales', 'img', 'images', 'fonts']) and {KIND.format(p="'x/' || path")} = 'code' as is_code from dirs""")
def listing_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which paths a search looks into, which a listing has, and which one of code has."""
    first = F.element_at(F.array(*map(F.lit, ("Bin/", "docs/", "node_modules/", "src/", "Assets/", ""))), (F.col("doc_id") % 6 + 1).cast("int"))
    paths = document_paths(spark, sf_dir).select("doc_id", F.concat(first, "path").alias("path"))
    return paths.select("doc_id", searchable("path").alias("searched"), included("path").alias("listed"), included("path", code=True).alias("is_code"))


@query(f"""with {LINES} select printf('doc%09d', doc_id) as file, line_no as hit_line, line as content from doc_lines where contains(lower(line), 'the') order by file, hit_line limit 500""")
def search_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five hundred hits of a search."""
    docs = table(spark, sf_dir, "documents").select(F.format_string("doc%09d", "doc_id").alias("source_id"), F.coalesce("text", F.lit("")).alias("raw"))
    return searches.search_lines(text_lines(docs), "the", most=500)


@query(f"""with {PATHS}, named as (
    select doc_id, case doc_id % 5 when 0 then 'R  old -> ' || path when 1 then ' M ' || upper(path) when 2 then 'MM ' || path || ' ' else '?? ' || path end as line from doc_paths where doc_id % 2 = 0
), found as (select doc_id, trim(substr(line, 4)) as path from named where trim(substr(line, 4)) in (select path from doc_paths))
select arg_min(path, doc_id) as path from found group by lower(path)""")
def changed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a status, the paths that are there."""
    paths = document_paths(spark, sf_dir)
    form = F.col("doc_id") % 5
    line = F.when(form == 0, F.concat(F.lit("R  old -> "), "path")).when(form == 1, F.concat(F.lit(" M "), F.upper("path"))).when(form == 2, F.concat(F.lit("MM "), "path", F.lit(" "))).otherwise(F.concat(F.lit("?? "), "path"))
    return changed_files(paths.where("doc_id % 2 = 0").select(F.col("doc_id").alias("line_no"), line.alias("line")), paths)


@query(f"""with n as (select s_nationkey || '-' || s_suppkey // {SPAN} as source_id, s_nationkey % 3 as exit_code, s_suppkey as k, count(*) over (partition by s_nationkey || '-' || s_suppkey // {SPAN}) as total, row_number() over (partition by s_nationkey || '-' || s_suppkey // {SPAN} order by s_suppkey) as r from supplier
), told as (select source_id, exit_code, r, 's' || k as line from n where total <= 5 or r <= 3 or r > total - 2 union all select distinct source_id, exit_code, 3.5, '... (' || (total - 5) || ' lines omitted)' from n where total > 5)
select source_id, string_agg(line, chr(10) order by r) as text, cast(any_value(exit_code) as integer) as exit_code from told group by source_id""")
def rendered_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports as text, each with the exit code that its capture came with."""
    raw = grouped_raw(table(spark, sf_dir, "supplier"), span(F.col("s_nationkey").cast("string"), "s_suppkey"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")), "s_suppkey", exit_code=F.split("capture_id", "-")[0].cast("int") % 3)
    return rendered(resolve(["git", "fetch"])(raw), raw)


@query(f"""with {LINES}, sized as (select *, count(*) over (partition by doc_id) as total from doc_lines)
select 'doc' || doc_id as source_id, 0 as part, 0 as rank, 'view doc' || doc_id || ' 3-' || least(total, 7) || '/' || total as detail from sized where line_no = 1
union all select 'doc' || doc_id, 1, line_no, printf('%4d| ', line_no) || case when length(line) > 180 then left(line, 180) || '...' else line end from sized where line_no between 3 and 7""")
def view_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines three to seven of every document, as a target with a range asks for."""
    _, start, end = files.parse_target("doc:3-7", False)
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("source_id"), F.coalesce("text", F.lit("")).alias("raw"))
    return files.file_card(text_lines(docs), start=start, end=end).select("source_id", "part", "rank", "detail")


@query("""select page_id, case page_id % 4 when 0 then 'src/b' || page_id || '.cs' when 1 then 'SRC\\d\\e.cs' when 2 then 'f' || page_id || '.cs' else 'src/z.cs' end as file,
    case page_id % 3 when 0 then 'Api' || page_id when 1 then 'App.x' else '' end as project, case when page_id % 7 = 0 then 0 else page_id * (page_id % 7) end as number from pages""")
def path_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths from their source directory on, projects in brackets, and numbers that may be none."""
    k, text = F.col("page_id"), F.col("page_id").cast("string")
    path = F.when(k % 4 == 0, F.concat(F.lit("/w/src/a/src/b"), text, F.lit(".cs"))).when(k % 4 == 1, F.lit("C:\\w\\SRC\\d\\e.cs")).when(k % 4 == 2, F.concat(F.lit("/w/lib/f"), text, F.lit(".cs"))).otherwise(F.lit("lib\\x/src/z.cs"))
    project = F.when(k % 3 == 0, F.concat(F.lit("[/w/Api"), text, F.lit(".csproj]"))).when(k % 3 == 1, F.lit(" [C:\\w\\App.x.csproj] ")).otherwise("")
    number = F.when(k % 7 == 0, F.lit("x1")).otherwise((k * (k % 7)).cast("string"))
    return table(spark, sf_dir, "pages").select("page_id", T.source_path(path).alias("file"), T.project_name(project).alias("project"), T.whole_number(number).cast("long").alias("number"))


@query("""with spans as (select 'l' || o_orderkey // 5000 as source_id, o_orderkey, row_number() over (partition by o_orderkey // 5000 order by o_orderkey) as r, count(*) over (partition by o_orderkey // 5000) as n from orders)
select source_id, string_agg('abc' || o_orderkey || ' order', chr(10) order by o_orderkey) || case when max(n) > 50 then chr(10) || '... +' || (max(n) - 50) || ' more lines' else '' end as detail from spans where r <= 50 group by source_id""")
def short_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs of commits that are a line each already, cut at fifty."""
    line = F.concat(F.lit("abc"), F.col("o_orderkey").cast("string"), F.lit(" order"))
    raw = grouped_raw(table(spark, sf_dir, "orders"), F.concat(F.lit("l"), F.floor(F.col("o_orderkey") / 5000).cast("string")), line, "o_orderkey")
    return resolve(["git", "log"])(raw).select("source_id", "detail")


@query(f"""with d as (select c_nationkey || '-' || c_custkey // {SPAN} as source_id, c_custkey as k, c_custkey % 5 as kind, c_nationkey % 2 as failed from customer
), sums as (select source_id, max(failed) as failed, count(*) filter (kind = 0) as p, count(*) filter (kind = 1) as e, max(k) filter (kind = 2) as t from d group by source_id
), errors as (select source_id, k, row_number() over (partition by source_id order by k) as rank from d where kind = 1
), tail as (
    select source_id, k, row_number() over (partition by source_id order by k) as rank, line from (
        select d.source_id, k, case kind when 0 then '  Restored /w/p' || k || '.csproj (in 1 ms).' when 2 then 'Time Elapsed 00:00:' || k else 'note ' || k end as line
        from d join sums using (source_id) where sums.failed = 1 and e = 0 qualify row_number() over (partition by d.source_id order by k desc) <= 12))
select source_id, 0 as part, 0 as rank, case when failed = 1 then 'FAIL' else 'ok' end || ' restore p=' || p || case when e > 0 then ' e=' || e else '' end || case when t is not null then ' t=00:00:' || t else '' end as detail from sums
union all select distinct source_id, 1, -1, 'Errors:' from errors
union all select source_id, 1, rank, '  /w/p' || k || '.csproj : error NU1101: no package ' || k from errors where rank <= 10
union all select distinct source_id, 2, -1, '--- raw tail ---' from tail
union all select source_id, 2, rank, '  ' || line from tail""")
def restore_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report on package restores that failed, with the last time told."""
    k, text = F.col("c_custkey"), F.col("c_custkey").cast("string")
    error = F.concat(F.lit("/w/p"), text, F.lit(".csproj : error NU1101: no package "), text)
    line = F.when(k % 5 == 0, F.concat(F.lit("  Restored /w/p"), text, F.lit(".csproj (in 1 ms)."))).when(k % 5 == 1, error).when(k % 5 == 2, F.concat(F.lit("Time Elapsed 00:00:"), text)).otherwise(F.concat(F.lit("note "), text))
    raw = grouped_raw(table(spark, sf_dir, "customer"), span(F.col("c_nationkey").cast("string"), "c_custkey"), line, "c_custkey", exit_code=F.split("capture_id", "-")[0].cast("int") % 2)
    return resolve(["dotnet", "restore"])(raw).select("source_id", "part", "rank", "detail")
