"""Commands as they are typed."""

import pytest

from lexisift.commands import answer
from lexisift.plans.report import render
from lexisift.sources.captures import captures


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("work") / "repo"
    for name, text in {
        "README.md": "# Title\nRun it\n", "src/Program.cs": "class Program\n{\n    void Run() { }\n}\n", "src/Util.g.cs": "Run\n", "bin/x.dll": "Run", "docs/a.md": "run\n",
        "app.log": "warn: A.B[1]\n      slow\nfail: A.C[1]\n      broke\n", "data.bin": "a\x00b",
    }.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return str(root)


def told(spark, *args, captured=None):
    report, code = answer(spark, args, captured)
    return ["\n".join(r.text for r in render(report).orderBy("source_id").collect()).split("\n"), code]


def test_listings(spark, repo):
    assert told(spark, "ls", repo) == [["app.log", "bin/", "data.bin", "docs/", "README.md", "src/"], 0]
    assert told(spark, "ls", f"{repo}/app.log") == [["app.log"], 0]
    assert told(spark, "ls", f"{repo}/none") == [[f"ls: {repo}/none: no such file or directory"], 1]
    assert told(spark, "tree", repo, "--depth", "1", "--code")[0][:2] == ["tree code d=1 f=1 depth=1", "repo/"]
    assert told(spark, "--more", "tree", repo)[0][0] == "tree d=2 f=6 depth=3"
    assert told(spark, "tree", "--depth", "3")[0] == ["tree: 3: no such directory"]
    assert told(spark, "files", "--top", "2", repo) == [["files n=6", "top=root(3),src(2),docs(1)", "list:", "  README.md", "  src/Program.cs", "+4 more files"], 0]
    assert told(spark, "files", repo, "--ext", "md")[0][0] == "files n=2 ext=md" and told(spark, "files", "nowhere/x") == [["files: nowhere/x: no such directory"], 0]


def test_changed_files(spark, repo):
    status = lambda code, text: captures(spark, [("s", ["git", "status"], code, text, "")])
    text = " M src/Program.cs\n M SRC/PROGRAM.CS\nR  a -> docs/a.md\n?? docs/a.md\n"
    assert told(spark, "files", repo, "--changed", captured=status(0, text))[0] == ["files n=2 changed=1", "top=docs(1),src(1)", "list:", "  src/Program.cs", "  docs/a.md"]
    assert told(spark, "files", repo, "--changed", "--code", captured=status(1, text))[0] == ["files code n=0 changed=1"]
    assert told(spark, "files", repo, "--changed")[0] == ["files n=0 changed=1"]


def test_cards(spark, repo):
    assert told(spark, "view", f"{repo}/src/Program.cs")[0][0] == "view Program.cs lines=4"
    assert told(spark, "view", f"{repo}/src/Program.cs:2-3")[0] == ["view Program.cs 2-3/4", "   2| {", "   3|     void Run() { }"]
    assert told(spark, "view", f"{repo}/src/Program.cs", "--symbols")[0][:2] == ["view Program.cs lines=4", "symbols: Program(1)"]
    assert told(spark, "view", f"{repo}/data.bin") == [["view data.bin binary=1"], 0]
    assert told(spark, "view", f"{repo}/none") == [[f"view: {repo}/none: file not found"], 0]


def test_search(spark, repo):
    text, code = told(spark, "focus", "Run", repo)
    assert text == ["focus m=2 f=2 code=1 docs=1 logs=0", "code=src/Program.cs(1)", "samples:", "  src/Program.cs:3 void Run() { }", "+1 more files"] and code == 0
    assert told(spark, "focus", "run", repo, "--DOCS", "--files-only")[0] == ["focus docs m=2 f=2", "top=README.md(1),docs/a.md(1)"]
    assert told(spark, "focus", "zzz", repo) == [["focus m=0 f=0"], 1] and told(spark, "focus", " ", repo) == [["focus: query is required"], 1]
    assert told(spark, "focus", "x", "nowhere/x")[1] == 1
    assert [x.removeprefix(repo) for x in told(spark, "--raw", "focus", "Run", repo)[0]] == ["/README.md:2:Run it", "/src/Program.cs:3:    void Run() { }"]


def test_logs(spark, repo):
    path = f"{repo}/app.log"
    assert told(spark, "log", path)[0] == ["log n=2 file=app.log e=1 w=1", "---", "[WRN] B: slow", "[ERR] C: broke"]
    assert told(spark, "log", path, "--errors")[0][0] == "log n=1 file=app.log e=1" and told(spark, "log", path, "--last", "1")[0][2] == "[ERR] C: broke"
    assert told(spark, "log", path, "--all", "--last", "x")[0] == ["warn: A.B[1]", "      slow", "fail: A.C[1]", "      broke"] == told(spark, "--raw", "log", path)[0]
    assert told(spark, "log", f"{repo}/none") == [[f"File not found: {repo}/none"], 0]


def test_captured_commands(spark):
    both = lambda a, b: captures(spark, [("a", ["git", "status"], a, "## main\n M x\n", ""), ("b", ["git", "diff"], b, "diff --git a/x b/x\n@@ -1 +1 @@\n+y\n", "")])
    text, code = told(spark, "changes", captured=both(0, 0))
    assert text == ["status st=0 mod=1 untr=0 br=main", "top=m:x", "diff f=1 +1 -0", "top=x(+1 -0)", "@@ x 1", "+y"] and code == 0
    assert told(spark, "changes", captured=both(128, 0))[1] == 128 and told(spark, "changes", captured=both(0, 2))[1] == 2
    pushed = captures(spark, [("c", ["git", "push"], 0, "", "")])
    assert told(spark, "git", "push", captured=pushed) == [["ok"], None]
    for args in ([], ["--more"], ["git", "push"], ["changes"]):
        with pytest.raises(ValueError):
            answer(spark, args)
