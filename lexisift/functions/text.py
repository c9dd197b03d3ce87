"""Scalar functions over text, as Column expressions that stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Directories and endings by which paths are classed.
IGNORED_DIRECTORIES = [".git", "bin", "obj", "node_modules", ".idea", ".vs", "dist", "coverage"]
HIDDEN_FROM_CODE = ["docs", "_local", "assets", "public", "locales", "img", "images", "fonts", "coverage"]
CODE_ENDINGS = [
    ".cs", ".csproj", ".sln", ".props", ".targets", ".fs", ".vb", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs",
    ".json", ".yml", ".yaml", ".xml", ".sql", ".ps1", ".sh", ".bicep",
]
DOC_ENDINGS = [".md", ".txt", ".adoc", ".rst"]
GENERATED_ENDINGS = [".g.cs", ".generated.cs", ".designer.cs", ".assemblyinfo.cs"]
DOC_PREFIXES = ["_local/", "docs/", ".claude/"]


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def truncate(c: Column | str, most: int) -> Column:
    """The text, or its first ``most`` characters and three dots if it has more."""
    c = col(c)
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


def trim(c: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def rtrim(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"(?U)\s+$", "")


def is_blank(c: Column | str) -> Column:
    return ~col(c).rlike(r"(?U)\S")


def compact(c: Column | str) -> Column:
    """White space of any length as one space; over 100 characters, the first 97 and three dots."""
    one = F.regexp_replace(trim(c), r"(?U)\s+", " ")
    return F.when(F.length(one) <= 100, one).otherwise(F.concat(F.substring(one, 1, 97), F.lit("...")))


def slashes(c: Column | str) -> Column:
    return F.translate(col(c), "\\", "/")


def basename(c: Column | str) -> Column:
    return F.substring_index(slashes(c), "/", -1)


def extension(c: Column | str) -> Column:
    """The last dot of the file name and what follows; nothing for none or a final dot."""
    return F.regexp_extract(basename(c), r"(\.[^.]+)$", 1)


def stem(c: Column | str) -> Column:
    return F.regexp_replace(basename(c), r"\.[^.]*$", "")


def project_name(c: Column | str) -> Column:
    """Of a path in brackets, the file name without its ending."""
    return stem(F.regexp_replace(trim(c), r"^[\[\]]+|[\[\]]+$", ""))


def shorten_url(c: Column | str) -> Column:
    """From the first ``/api/`` on; else what follows the host, if anything does; else all of it."""
    c = col(c)
    return (
        F.when(F.instr(c, "/api/") > 0, F.regexp_extract(c, r"(?s)(/api/.*)$", 1))
        .when(c.rlike(r"(?s)^[^:]*?://[^/]*/"), F.regexp_extract(c, r"(?s)://[^/]*(/.*)$", 1))
        .otherwise(c)
    )


def last_component(c: Column | str) -> Column:
    return F.substring_index(col(c), ".", -1)


def source_path(c: Column | str) -> Column:
    """From the last ``src`` directory on, a backslash one first; else the file name."""
    c = col(c)
    back, forth = r"(?is).*\\(src\\.*)$", r"(?is).*/(src/.*)$"
    return F.when(c.rlike(back), F.regexp_extract(c, back, 1)).when(c.rlike(forth), F.regexp_extract(c, forth, 1)).otherwise(basename(c))


def top_group(c: Column | str, lone: str | None = None) -> Column:
    """The first directory. With ``lone`` that stands for a bare name; without, leading dots and slashes go and a bare name is its own group."""
    if lone is None:
        plain = F.regexp_replace(col(c), r"^[./]+", "")
        return F.substring_index(plain, "/", 1)
    plain = slashes(c)
    return F.when(F.instr(plain, "/") > 1, F.substring_index(plain, "/", 1)).otherwise(F.lit(lone))


def is_generated(path: Column | str) -> Column:
    low, name = F.lower(slashes(path)), F.lower(basename(path))
    out = low.contains("/obj/") | low.contains("/bin/")
    for e in GENERATED_ENDINGS:
        out = out | name.endswith(e)
    return out


def is_code(path: Column | str) -> Column:
    return ~is_generated(path) & F.lower(extension(path)).isin(CODE_ENDINGS)


def is_doc(path: Column | str) -> Column:
    return F.lower(extension(path)).isin(DOC_ENDINGS)


def kind_of(path: Column | str) -> Column:
    """logs, docs, code or other, the first that fits."""
    low = F.lower(slashes(path))
    docs = is_doc(path)
    for p in DOC_PREFIXES:
        docs = docs | low.startswith(p)
    return F.when(low.contains("/logs/") | low.endswith(".log"), "logs").when(docs, "docs").when(is_code(path), "code").otherwise("other")


def kind_rank(kind: Column | str, scope: str = "default") -> Column:
    """Where a kind stands in a listing of files by scope."""
    order = {"default": ["code", "other", "docs", "logs"], "all": ["code", "docs", "other", "logs"]}.get(scope, [])
    out = F.lit(0 if not order else 4)
    for i, k in enumerate(order):
        out = F.when(col(kind) == k, i).otherwise(out)
    return out


def file_score(path: Column | str, code: bool = False) -> Column:
    """How far down a listing a file belongs: deep and long paths down, well-known entry points up."""
    path = col(path)
    name = basename(path)
    low = F.lower(name)
    # What is taken off for a name.
    less = [(low == "readme.md", 30), (low.endswith(".sln"), 25), (low.endswith(".csproj"), 20), (low == "program.cs", 20), (low.startswith("index."), 12), (low.startswith("main."), 12)]
    if code:
        less += [
            (low == "program.cs", 25), (low == "startup.cs", 20), (low == "servicecollectionextensions.cs", 18), (low.endswith("endpoint.cs"), 16),
            (low.endswith("endpointextension.cs"), 14), (low.endswith("handler.cs"), 12), (name.startswith("I") & low.endswith(".cs"), 6),
        ]
    depth = F.length(slashes(path)) - F.length(F.replace(slashes(path), F.lit("/")))
    out = depth * 10 + F.length(path)
    for test, by in less:
        out = out - F.when(test, by).otherwise(0)
    return out


def branch_name(c: Column | str) -> Column:
    return F.replace(trim(F.substring_index(col(c), "...", 1)), F.lit(" "), F.lit("_"))


def level_tag(level: Column | str) -> Column:
    level = col(level)
    return F.when(level.isin("fail", "crit", "error"), "ERR").when(level == "warn", "WRN").otherwise("INF")


def http_level(status: Column | str) -> Column:
    status = col(status)
    return F.when(status.startswith("2"), "info").when(status.startswith("4"), "warn").otherwise("fail")


def numbered(line_no: Column | str, line: Column | str, indent: str = "") -> Column:
    return F.concat(F.lit(indent), F.format_string("%4d| %s", col(line_no), truncate(line, 180)))


def whole_number(c: Column | str) -> Column:
    """The integer, or 0 for what is none."""
    return F.coalesce(col(c).try_cast("int"), F.lit(0))


def severity(message: Column | str) -> Column:
    message = col(message)
    return F.when(message.contains("critical"), "critical").when(message.contains("high"), "high").when(message.contains("moderate"), "moderate").otherwise("low")


def severity_text(low: Column, moderate: Column, high: Column, critical: Column) -> Column:
    """Counts with their names, those of nothing left out."""
    some = lambda n, name: F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {name}")))
    return F.concat_ws(", ", some(low, "low"), some(moderate, "moderate"), some(high, "high"), some(critical, "critical"))


def if_any(n: Column, label: str) -> Column:
    """`` label=n``, or nothing for 0."""
    return F.when(n > 0, F.concat(F.lit(f" {label}="), n.cast("string"))).otherwise("")
