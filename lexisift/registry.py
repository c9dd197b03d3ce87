"""Which report a command's capture gets. A report is a function from captures to rows; others can be registered."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial
from typing import Protocol

from pyspark.sql import DataFrame

from .plans.builds import build_report, restore_report, test_report
from .plans.report import unchanged
from .plans.revisions import compact_report, diff_report, log_report, status_report
from .plans.searches import find_report, grep_report
from .sources.captures import merged


class Report(Protocol):
    def __call__(self, captures: DataFrame, detail: str = "default") -> DataFrame: ...


def passthrough(captures: DataFrame, detail: str = "default") -> DataFrame:
    return unchanged(merged(captures))


#: Verbs whose output is cut to its head and tail, and options of the tool that take a value.
COMPACT_VERBS = ["add", "commit", "push", "pull", "fetch", "stash", "branch", "checkout", "switch", "merge", "rebase", "reset", "tag"]
VALUE_OPTIONS = ["-c", "-C", "--git-dir", "--work-tree", "--namespace", "--super-prefix", "--config-env"]

REPORTS: dict[tuple[str, str | None], Report] = {
    ("dotnet", "build"): build_report,
    ("dotnet", "test"): test_report,
    ("dotnet", "restore"): restore_report,
    ("grep", None): partial(grep_report, tool="grep"),
    ("rg", None): partial(grep_report, tool="rg"),
    ("find", None): find_report,
    ("git", "status"): status_report,
    ("git", "log"): log_report,
    ("git", "diff"): diff_report,
    ("git", "show"): diff_report,
    **{("git", verb): compact_report for verb in COMPACT_VERBS},
}


def register(tool: str, verb: str | None, report: Report) -> None:
    REPORTS[tool, verb] = report


def verb_of(command: Sequence[str]) -> str | None:
    """The first word that is neither an option nor an option's value."""
    words = iter(command[1:])
    for word in words:
        if not word.startswith("-"):
            return word.lower()
        if command[0].lower() == "git" and word in VALUE_OPTIONS:
            next(words, None)
    return None


def resolve(command: Sequence[str], detail: str = "default") -> Callable[[DataFrame], DataFrame]:
    """The report for a command, for use with ``DataFrame.transform``; raw detail and unknown commands pass through."""
    if not command or detail == "raw":
        return passthrough
    tool = command[0].lower()
    found = REPORTS.get((tool, verb_of(command))) or REPORTS.get((tool, None)) or passthrough
    return partial(found, detail=detail)


def parse_options(args: Sequence[str]) -> tuple[str, list[str]]:
    """(detail, command): leading ``--raw`` and ``--more``; parsing stops at the first other word."""
    detail, rest = "default", list(args)
    while rest and rest[0] in ("--raw", "--more"):
        word = rest.pop(0)
        detail = "raw" if word == "--raw" or detail == "raw" else "more"
    return detail, rest
