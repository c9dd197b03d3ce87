"""Commands as they are typed: built-in verbs over paths, and all others over what was captured of them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions.text import HIDDEN_FROM_CODE, IGNORED_DIRECTORIES, basename
from .plans.files import file_card, files_report, list_report, parse_target, tree_depth, tree_report
from .plans.report import rows
from .plans.revisions import changes_report
from .plans.searches import search_report
from .plans.service_logs import service_log_report
from .registry import parse_options, resolve
from .sources import store
from .sources.captures import merged, text_lines
from .sources.files import changed_files, entries, file_lines, found_lines, log_lines, path_kind

#: A report's rows, and the exit code that goes with them; none where each capture has its own.
Answer = tuple[DataFrame, int | None]


def said(spark: SparkSession, text: str, source: str = "") -> DataFrame:
    """One line as a report."""
    return rows(spark.createDataFrame([(source,)], "source_id string"), "said", 0, text)


def whole(word: str) -> int | None:
    """The integer that a word is, or none."""
    try:
        return int(word)
    except ValueError:
        return None


def value_of(words: Sequence[str], option: str) -> str | None:
    """The word after an option."""
    at = next((i for i, w in enumerate(words[:-1]) if w == option), None)
    return None if at is None else words[at + 1]


def number_of(words: Sequence[str], option: str) -> int | None:
    """The first integer after the option, 1 at least; other words after it count for nothing."""
    found = (whole(words[i + 1]) for i, w in enumerate(words[:-1]) if w == option)
    return next((max(1, n) for n in found if n is not None), None)


def plain_word(words: Sequence[str], valued: Sequence[str] = ()) -> str:
    """The first word that is neither an option nor the value of one of ``valued``; the folder at hand without one."""
    rest = iter(words)
    for word in rest:
        if not word.startswith("-"):
            return word
        if word in valued:
            next(rest, None)
    return "."


def relative(spark: SparkSession, path: str, skip: Sequence[str] = (), most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(source_id, path) of what is below a folder, directories with a slash at their end, and (source_id) of the folder.

    The source is the folder's absolute path, whose last name a tree shows.
    """
    root = spark.createDataFrame([(store.local(path) or path,)], "source_id string")
    return entries(spark, path, skip, most).select(F.lit(store.local(path) or path).alias("source_id"), "path"), root


def ls(spark: SparkSession, words: Sequence[str], detail: str, captured: DataFrame | None) -> Answer:
    path = next((w for w in reversed(words) if not w.startswith("-")), ".")
    kind = path_kind(spark, path)
    if kind is None:
        return said(spark, f"ls: {path}: no such file or directory", path), 1
    if kind == "file":
        return said(spark, path.rstrip("/").split("/")[-1], path), 0
    return list_report(relative(spark, path, most=0)[0]), 0


def view(spark: SparkSession, words: Sequence[str], detail: str, captured: DataFrame | None) -> Answer:
    target, flags = words[0], words[1:]
    detail = "raw" if detail == "raw" or "--raw" in flags else "more" if detail == "more" or "--more" in flags else detail
    path, start, end = parse_target(target, path_kind(spark, target) == "file")
    if path_kind(spark, path) != "file":
        return said(spark, f"view: {path}: file not found", path), 0
    lines = file_lines(spark, path)
    if lines.isEmpty():
        from .sources.files import looks_binary, read_bytes

        odd = read_bytes(spark, path).where(looks_binary("content")).select(F.col("path").alias("source_id"))
        name = path.rstrip("/").split("/")[-1]
        return (said(spark, f"view {name} lines=0", path) if odd.isEmpty() else rows(odd, "head", 0, F.concat(F.lit("view "), basename("source_id"), F.lit(" binary=1")))), 0
    return file_card(lines, detail, start, end, "--symbols" in flags), 0


def tree(spark: SparkSession, words: Sequence[str], detail: str, captured: DataFrame | None) -> Answer:
    path = plain_word(words)
    if path_kind(spark, path) != "directory":
        return said(spark, f"tree: {path}: no such directory", path), 0
    code, show_all, depth = "--code" in words, "--all" in words, number_of(words, "--depth")
    skip = ([] if show_all or detail == "raw" else IGNORED_DIRECTORIES) + (HIDDEN_FROM_CODE if code else [])
    below, root = relative(spark, path, skip, tree_depth(detail, depth))
    return tree_report(below, detail, code, show_all, depth, root), 0


def files(spark: SparkSession, words: Sequence[str], detail: str, captured: DataFrame | None) -> Answer:
    """``--changed``: only the paths that a captured short status names; none where it failed or is missing."""
    path = plain_word(words, ("--depth", "--top", "--ext"))
    if path_kind(spark, path) != "directory":
        return said(spark, f"files: {path}: no such directory", path), 0
    changed, code = "--changed" in words, "--code" in words
    skip = ([] if changed or detail == "raw" else IGNORED_DIRECTORIES) + (HIDDEN_FROM_CODE if code and not changed else [])
    found, root = relative(spark, path, skip)
    source = root.first()[0]
    if changed:
        ok = found.where(F.lit(False)) if captured is None else None
        if captured is not None:
            lines = text_lines(merged(captured).where("exit_code = 0"))
            ok = changed_files(lines, found).select(F.lit(source).alias("source_id"), "path")
        if ok.isEmpty():
            return said(spark, "files " + ("code " if "--code" in words else "") + "n=0" + (f" ext={ext.lstrip('.')}" if (ext := (value_of(words, "--ext") or "").strip()) else "") + " changed=1", path), 0
        found = ok
    return files_report(found, detail, code, value_of(words, "--ext"), number_of(words, "--top"), changed, root), 0


def focus(spark: SparkSession, words: Sequence[str], detail: str, captured: DataFrame | None) -> Answer:
    query, rest = words[0], words[1:]
    path, flags = plain_word(rest), {w.lower() for w in rest if w.startswith("-")}
    if not query.strip():
        return said(spark, "focus: query is required"), 1
    if path_kind(spark, path) != "directory":
        return said(spark, f"focus: {path}: no such directory", path), 1
    scope = "all" if "--all" in flags else "docs" if "--docs" in flags else "code" if flags & {"--code", "--code-only"} else "default"
    return search_report(found_lines(spark, path, query), path, detail, scope, "--files-only" in flags)


def log(spark: SparkSession, words: Sequence[str], detail: str, captured: DataFrame | None) -> Answer:
    path, flags = words[0], words[1:]
    if path_kind(spark, path) != "file":
        return said(spark, f"File not found: {path}", path), 0
    last = whole(value_of(flags, "--last") or "") or 0
    root = spark.createDataFrame([(path,)], "source_id string")
    return service_log_report(log_lines(spark, path), "raw" if detail == "raw" else "default", "--errors" in flags, last, show_all="--all" in flags, roots=root), 0


def changes(spark: SparkSession, words: Sequence[str], detail: str, captured: DataFrame | None) -> Answer:
    """From captures of a status and of a difference, told apart by their commands."""
    if captured is None:
        raise ValueError("changes are told from captures of a status and of a difference")
    of = lambda verb: captured.where(F.array_contains("command", verb)).withColumn("capture_id", F.lit("changes"))
    status, diff = of("status"), of("diff")
    codes = [next(iter(frame.select(F.coalesce("exit_code", F.lit(0))).first() or (0,))) for frame in (status, diff)]
    return changes_report(status, diff, detail), next((c for c in codes if c), 0)


Verb = Callable[[SparkSession, Sequence[str], str, DataFrame | None], Answer]
#: Verbs that read paths or several captures themselves, and how many words each needs after it, the first no option.
VERBS: dict[str, tuple[Verb, int]] = {"ls": (ls, 0), "view": (view, 1), "tree": (tree, 0), "files": (files, 0), "focus": (focus, 1), "log": (log, 1), "changes": (changes, 0)}


def answer(spark: SparkSession, args: Sequence[str], captured: DataFrame | None = None) -> Answer:
    """The report on a command line with its leading options, and its exit code.

    ``captured``: what was captured of the command, for verbs that are not built in.
    """
    detail, command = parse_options(args)
    if not command:
        raise ValueError("a command is required")
    verb, least = VERBS.get(command[0], (None, 0))
    words = command[1:]
    if verb and len(words) >= least and not (command[0] in ("view", "log") and words[0].startswith("-")):
        return verb(spark, words, detail, captured)
    if captured is None:
        raise ValueError(f"nothing was captured of {command[0]}")
    return captured.transform(resolve(command, detail)), None
