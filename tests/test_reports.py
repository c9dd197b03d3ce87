"""Hand-derived reports of small captures."""

import pytest

from pyspark.sql import functions as F

from lexisift.operators import ordered
from lexisift.plans import builds, files, revisions, searches, service_logs
from lexisift.plans.report import render, rendered
from lexisift.registry import parse_options, passthrough, register, resolve, verb_of
from lexisift.sources.captures import captures, merged, text_lines


def told(spark, report, *texts, exit_code=0, **options):
    """The rendered report of each text."""
    frame = captures(spark, [(f"c{i}", ["x"], exit_code, t, "") for i, t in enumerate(texts)])
    found = {r.source_id: r.text for r in render(report(frame, **options)).collect()}
    out = [found.get(f"c{i}", "").split("\n") for i in range(len(texts))]
    return out[0] if len(texts) == 1 else out


BUILD = """  Determining projects to restore...
  Core -> /w/src/Core/bin/Debug/Core.dll
/w/src/Api/Startup.cs(10,5): error CS0103: The name 'foo' does not exist in the current context [/w/src/Api/Api.csproj]
/w/src/Api/Startup.cs(12,5): error CS0103: The name 'bar' does not exist in the current context [/w/src/Api/Api.csproj]
/w/src/Api/Api.csproj : warning NU1903: Package 'Acme.Json' 1.2.3 has a known high severity vulnerability [/w/App.sln]
Time Elapsed 00:00:02.10
"""


def test_build(spark):
    assert told(spark, builds.build_report, BUILD, exit_code=1) == [
        "FAIL build p=1 e=2 w=0 nu=1 t=00:00:02.10",
        "---",
        "Errors:",
        "  error CS0103 (x2): The name 'foo' does not exist in the current context [Startup.cs]",
        "NuGet Vulnerabilities:",
        "  Acme.Json 1.2.3: 1 (1 high)",
    ]


def test_build_variants(spark):
    bracket = "/w/src/A.cs(10,5): error CS1: no int[] here [/w/A.csproj]\r\n"
    calm = "  A -> x\n  a -> y\n  B -> z\n"
    many = "".join(f"/q/f{i}.cs(1,1): warning CS{i % 2}: m{i}\n" for i in range(8))
    one, two, three = told(spark, builds.build_report, bracket, calm, many)
    assert one == ["ok build p=0 e=1 w=0", "---", "Errors:", "  A.cs(10,5) error CS1: no int[] here [/w/A.csproj]"]
    assert two == ["ok build p=2"]
    assert three == ["ok build p=0 e=0 w=8", "Warnings:", "  warning CS0 (x4): m0 [f0.cs, f2.cs, f4.cs +1]", "  warning CS1 (x4): m1 [f1.cs, f3.cs, f5.cs +1]"]
    tail = told(spark, builds.build_report, "\n".join(f"l{i} " for i in range(20)) + "\n\n", exit_code=1)
    assert tail == ["FAIL build p=0 e=0 w=0", "--- raw tail ---", *(f"  l{i}" for i in range(8, 20))]


TESTS = """  Failed Acme.Tests.Orders.Rejects_negative [12 ms]
    Assert.Equal() Failure
    Expected: 1
    Actual:   2

Failed!  - Failed: 1, Passed: 9, Skipped: 2, Total: 12
Time Elapsed 00:00:04.30
"""


def test_tests(spark):
    assert told(spark, builds.test_report, TESTS, exit_code=1) == [
        "FAIL test pass=9 fail=1 skip=2 p=1 t=00:00:04.30", "---", "Failed:", "  Acme.Tests.Orders.Rejects_negative [12 ms]",
        "    Assert.Equal() Failure", "    Expected: 1", "    Actual:   2",
    ]
    close = "  Failed A.B [12ms]\n    1\n    2\n  x\n    3\n    4\n    5\n    6\n\n    lost\n"
    names = "".join(f"  Failed T{i}\n" for i in range(17))
    good = "Passed!  - Failed: 0, Passed: 3, Skipped: 0, Total: 3\nPassed!  - Failed: 0, Passed: 4, Skipped: 1, Total: 5\n"
    one, two, three, four = told(spark, builds.test_report, close, names, good, "nothing")
    assert one == ["FAIL test pass=0 fail=0", "---", "Failed:", "  A.B", "    1", "    2", "    3", "    4", "    5"]
    assert len(two) == 3 + 15 + 1 and two[-1] == "  ... +2 more"
    assert three == ["ok test pass=7 skip=1 p=2"] and four == ["ok test"]
    assert told(spark, builds.test_report, "boom", exit_code=1) == ["FAIL test e=1", "--- raw tail ---", "  boom"]


def test_restore(spark):
    text = """  Restored /w/src/Core/Core.csproj (in 120 ms).
/w/src/Api/Api.csproj : warning NU1903: Package 'Acme.Json' 1.2.3 has a known high severity vulnerability [/w/App.sln]
/w/src/Api/Api.csproj : warning NU1903: Package 'Acme.Json' 1.2.3 has a known high severity vulnerability [/w/Api.sln]
"""
    one, two, three = told(spark, builds.restore_report, text, "  All projects are up-to-date for restore.\n", "  Determining projects\nA : error NU1: no\n  Restored b\nTime Elapsed 1s")
    assert one == ["ok restore p=1 nu=2", "NuGet Vulnerabilities:", "  /w/src/Api/Api.csproj : warning NU1903: Package 'Acme.Json' 1.2.3 has a known high severity vulnerability (x2)"]
    assert two == ["ok restore up=1"] and three == ["ok restore p=1 e=1 t=1s", "Errors:", "  A : error NU1: no"]
    assert told(spark, builds.restore_report, "bad\n", exit_code=1) == ["FAIL restore p=0", "--- raw tail ---", "  bad"]


SHORT = "## main...origin/main [ahead 1]\nM  src/A.cs\nMM src/B.cs\n M src/C.cs\n?? notes.txt\n"
LONG = "On branch feature x\nYour branch is ahead\n\nChanges to be committed:\n  (use \"git\")\n\tnew file:   a\n\nChanges not staged for commit:\n\tmodified:   b\n\nUntracked files:\n\tc\n"


def test_status(spark):
    one, two, three = told(spark, revisions.status_report, SHORT, LONG, "\n")
    assert one == ["status st=2 mod=2 untr=1 br=main", "top=s:src/A.cs,s:src/B.cs,m:src/B.cs,m:src/C.cs,u:notes.txt"]
    assert two == ["status st=1 mod=1 untr=1 br=feature_x", "top=s:new file:   a,m:modified:   b,u:c"]
    assert three == ["ok status st=0 mod=0 untr=0"]
    more = told(spark, revisions.status_report, SHORT, detail="more")
    assert more[2:] == ["staged:", "  src/A.cs", "  src/B.cs", "modified:", "  src/B.cs", "  src/C.cs", "untracked:", "  notes.txt"]
    assert told(spark, revisions.status_report, "fatal: no", exit_code=128) == ["fatal: no"]


DIFF = """diff --git a/src/A.cs b/src/A.cs
index 111..222 100644
--- a/src/A.cs
+++ b/src/A.cs
@@ -10,3 +10,4 @@ class A
 context
-old
+new
+extra
diff --git a/logo.png b/logo.png
new file mode 100644
Binary files /dev/null and b/logo.png differ
"""


def test_diff(spark):
    assert told(spark, revisions.diff_report, DIFF) == ["diff f=2 +2 -1 bin=1", "top=A.cs(+2 -1),logo.png(+0 -0)[*new|bin]", "@@ A.cs 10-13", "-old", "+new", "+extra", "+1 files more"]
    hidden = "diff --git a/x b/x\n@@ -1 +1 @@\n--- x\n-y\n"
    wide = "".join(f"diff --git a/f{i} b/f{i}\n" + "".join(f"@@ -{j} +{j},2 @@\n" + "+l\n" * 6 for j in range(1, 4)) for i in range(4))
    one, two, three = told(spark, revisions.diff_report, hidden, wide, "  \n")
    assert one == ["diff f=1 +0 -1", "top=x(+0 -1)", "@@ x 1", "-y"] and three == ["ok diff f=0"]
    # 4 lines a hunk; the fifth hunk opens at 16 lines and is cut after two more
    assert two[2:] == sum((["@@ f0 1-2", "+l", "+l", "+l", "+l"], ["@@ f0 2-3", "+l", "+l", "+l", "+l"], ["@@ f0 3-4", "+l", "+l", "+l", "+l"], ["@@ f1 1-2", "+l", "+l", "+l", "+l"], ["@@ f1 2-3", "+l", "+l"], ["+1 files, 7 hunks more"]), [])


def test_log(spark):
    text = "commit 0123456789abcdef0123456789abcdef01234567\nAuthor: A Person <a@example.org>\nDate:   Mon Jan 1 00:00:00 2024 +0000\n\n    Fix parser\n\n    Details here\n"
    many = "".join(f"commit {i:040x}\n\n    m{i}\n" for i in range(51))
    one, two, three, four = told(spark, revisions.log_report, text, many, "abc one\ndef two\n", "\n".join(f"l{i}" for i in range(60)))
    assert one == ["0123456 Fix parser"] and three == ["abc one", "def two", ""]
    assert len(two) == 51 and two[-1] == "... +1 more commits" and four[50:] == ["... +10 more lines"]
    row = revisions.commits(text_lines(merged(captures(spark, [("c", [], 0, text, None)])))).first()
    assert (row.hash, row.author, row.date, row.message) == ("0123456", "A Person", "Mon Jan 1 00:00:00 2024 +0000", "Fix parser")


def test_head_and_tail(spark):
    one, two, three = told(spark, revisions.compact_report, "l1\nl2\n\nl3\nl4\nl5\nl6\nl7\n", "a\nb\nc\nd\ne", "")
    assert one == ["l1", "l2", "l3", "... (2 lines omitted)", "l6", "l7"] and two == ["a", "b", "c", "d", "e"] and three == ["ok"]


def test_changes(spark):
    status = captures(spark, [("a", [], 0, SHORT, ""), ("b", [], 1, "no", ""), ("c", [], 0, "", "")])
    diff = captures(spark, [("a", [], 0, DIFF, ""), ("b", [], 0, DIFF, ""), ("c", [], 0, "", "")])
    got = {r.source_id: r.text.split("\n") for r in render(revisions.changes_report(status, diff)).collect()}
    assert got["a"][0].startswith("status st=2") and got["a"][2].startswith("diff f=2") and got["b"] == ["no"] and got["c"] == ["ok status st=0 mod=0 untr=0"]


def test_grep(spark):
    text = "src/a/X.cs:3:foo();\nsrc/a/X.cs:9:foo();\nsrc/b/Y.cs:1:bar();\n"
    odd = "Binary file a/b matches\nC:\\x\\y.cs:foo\na.cs:foo:12:bar\nx/y/z\nnothing\n"
    one, two, three, four = told(spark, searches.grep_report, text, odd, "", "no hits at all")
    assert one == ["grep m=3 f=2", "top=a/X.cs(2),b/Y.cs(1)", "samples:", "  a/X.cs:3 foo();", "  b/Y.cs:1 bar();"]
    assert two[0] == "grep m=3 f=3 bin=1" and "  a.cs:foo:12 bar" in two and "  C:/x/y.cs foo" in two
    assert three == ["grep m=0 f=0"] and four == ["no hits at all"]


def test_find(spark):
    text = "./src/a.cs\n./src/b.cs\n./docs/c.md\nfind: './x': Permission denied\n"
    assert told(spark, searches.find_report, text) == ["find n=3 err=1", "top=src(2),docs(1)", "paths:", "  src/a.cs", "  src/b.cs", "  docs/c.md"]
    many = told(spark, searches.find_report, "".join(f"/r/p{i}\n" for i in range(6)))
    assert many[-1] == "+1 more paths" and many[3:8] == [f"  p{i}" for i in range(5)]


def test_focus(spark):
    text = "w/src/A.cs:4:  Run( x )\nw/src/A.cs:9:Run(y)\nw/docs/g.md:2:Run it\nw/logs/a.log:1:Run\nC:/x:1:dropped\n"
    assert told(spark, searches.focus_report, text) == ["focus m=4 f=3 code=1 docs=1 logs=1", "code=src/A.cs(2)", "samples:", "  src/A.cs:4 Run( x )", "+2 more files"]
    assert told(spark, searches.focus_report, text, scope="docs", files_only=True) == ["focus docs m=1 f=1", "top=docs/g.md(1)"]
    assert told(spark, searches.focus_report, text, detail="more")[2] == "docs=docs/g.md(1)"
    assert told(spark, searches.focus_report, "\n", exit_code=1) == ["focus m=0 f=0"]


def card(spark, text, **options):
    frame = spark.createDataFrame([("/d/t.md", text)], "source_id string, raw string")
    return [r.text for r in render(files.file_card(text_lines(frame, final=False), **options)).collect()][0].split("\n")


def test_file_card(spark):
    assert card(spark, "# Title\ntext\n## Part\ntext\n", symbols_only=True) == ["view t.md lines=4", "symbols: Title(1), Part(3)", "hot:", "  1-2 Title", "  3-4 Part"]
    assert card(spark, "a\nb\n") == ["view t.md lines=2", "   1| a", "   2| b"]
    assert len(card(spark, "x\n" * 40)) == 41 and card(spark, "\n" + "x\n" * 40)[1] == "preview:"
    assert len(card(spark, "x" * 3000)) == 2 and card(spark, "x" * 3001)[1:] == ["preview:", "     1| " + "x" * 180 + "..."]
    assert card(spark, "a\nb\nc\n", start=2, end=9) == ["view t.md 2-3/3", "   2| b", "   3| c"]
    assert card(spark, "a\nb\nc\n", start=7, end=7) == ["view t.md 7-3/3"]
    assert files.parse_target("a/b.cs:3-9", False) == ("a/b.cs", 3, 9) and files.parse_target("a:4", False) == ("a", 4, 4) and files.parse_target("a:4", True) == ("a:4", None, None)


@pytest.mark.parametrize(
    ("line", "name"),
    [("### A b ", "A b"), ("prose class foo", "foo"), ("  public static int Run(x)", "Run"), ("async def go(a):", "go"), ("export async function f(", "f"), ("const g = async (x) =>", "g"), ("plain", None)],
)
def test_symbols(spark, line, name):
    assert spark.createDataFrame([(line,)], "line string").select(files.symbol_name("line").alias("n")).first().n == name


PATHS = ["README.md", "src/Program.cs", "src/Util.cs", "docs/x.md"]


def test_inventory(spark):
    frame = spark.createDataFrame([("/r/repo", p) for p in PATHS], "source_id string, path string")
    text = lambda report: render(report).first().text.split("\n")
    assert text(files.files_report(frame)) == ["files n=4", "top=src(2),docs(1),root(1)", "list:", "  README.md", "  src/Program.cs", "  docs/x.md", "  src/Util.cs"]
    assert text(files.files_report(frame, code=True)) == ["files code n=2", "top=src(2)", "list:", "  src/Program.cs", "  src/Util.cs"]
    assert text(files.files_report(frame, ext="MD", top=1)) == ["files n=2 ext=MD", "top=docs(1),root(1)", "list:", "  README.md", "+1 more files"]
    deep = spark.createDataFrame([("/r/repo", p) for p in [*PATHS, "bin/x.dll", "src/a/b/c/d.cs", "Assets/i.png"]], "source_id string, path string")
    assert text(files.tree_report(deep)) == ["tree d=4 f=5 depth=2", "repo/", "  Assets/ d=0 f=1", "  docs/ d=0 f=1", "  src/ d=1 f=2", "    a/ d=0 f=0", "files=README.md"]
    assert text(files.tree_report(deep, code=True)) == ["tree code d=1 f=2 depth=2", "repo/", "  src/ d=0 f=2"]
    assert text(files.tree_report(deep, depth=4, show_all=True))[0] == "tree d=7 f=7 depth=4"
    assert text(files.list_report(deep)) == ["Assets/", "bin/", "docs/", "README.md", "src/"]


LOG = """info: Microsoft.Hosting.Lifetime[0]
      Now listening on: http://localhost:5000
warn: Acme.Orders.Worker[3]
      Queue is slow
warn: Acme.Orders.Worker[3]
      Queue is slow
fail: Acme.Api.Handler[1]
      Boom
      System.Exception: Boom
         at A.B()
         at A.C()
         at A.D()
         at A.E()
info: System.Net.Http.HttpClient.Default.LogicalHandler[100]
      Start processing HTTP request GET http://h:1/api/v1/items?x=1
info: System.Net.Http.HttpClient.Default.ClientHandler[101]
      Received HTTP response headers after 12.5ms - 404
"""


def service(spark, *texts, **options):
    frame = spark.createDataFrame([(f"/l/app{i}.log", t) for i, t in enumerate(texts)], "source_id string, raw string")
    found = {r.source_id: r.text for r in render(service_logs.service_log_report(frame, **options)).collect()}
    return [found[f"/l/app{i}.log"].split("\n") for i in range(len(texts))]


def test_service_log(spark):
    [got] = service(spark, LOG)
    assert [x.strip() for x in got] == [
        "log n=3 file=app0.log e=1 w=2", "---", "[WRN] Worker: Queue is slow (x2)", "[ERR] Handler: Boom", "System.Exception: Boom", "at A.B()", "at A.C()", "at A.D()", "... +1 more frames",
        "[WRN] HTTP: GET /api/v1/items?x=1 -> 404 (12.5ms)",
    ]
    assert service(spark, LOG, last=1)[0][0] == "log n=1 file=app0.log w=1"
    assert service(spark, "no header\n") == [["ok log n=0 file=app0.log"]]
    assert service(spark, "a\n\nb\n", show_all=True) == [["a", "b"]]


def http(*events):
    """S<x> starts request x, R<n> answers with n."""
    out = []
    for e in events:
        said = f"Start processing HTTP request GET http://h/{e[1:]}" if e[0] == "S" else f"Received HTTP response headers after {1500 if e[1:] == 'slow' else 5}ms - {200 if e[1:] in ('slow', 'ok') else e[1:]}"
        out += ["info: N.HttpClient[1]", f"      {said}"]
    return "\n".join(out)


def test_answers_take_the_last_request(spark):
    nested, none, fine, again, slow = service(spark, http("SA", "SB", "R404", "R500"), http("R404"), http("SA", "Rok", "R404"), http("SA", "SB", "SA", "R404"), http("SA", "Rslow"))
    assert nested[2:] == ["[WRN] HTTP: GET /B -> 404 (5ms)", "[ERR] HTTP: GET /A -> 500 (5ms)"]
    assert none == ["ok log n=0 file=app1.log"] and fine == ["ok log n=0 file=app2.log"]
    assert again[2:] == ["[WRN] HTTP: GET /B -> 404 (5ms)"] and slow[2:] == ["[INF] HTTP: GET /A -> 200 (1500ms)"]


def test_levels(spark):
    hidden = "fail: Npgsql.Command[1]\n      broke\nerror: X.Y\n      z\ndbug: A\n      b\n"
    [default], [errors], [strict] = service(spark, hidden), service(spark, hidden, errors_only=True), service(spark, hidden, strict_errors=True)
    assert default[0] == "log n=1 file=app0.log e=1" and errors[0] == strict[0] == "log n=2 file=app0.log e=2"
    marked = "\ufeffinfo: A\n      lost\nwarn: B[2] text\ninfo: C\n      kept\n"
    assert service(spark, marked)[0][2:] == ["[INF] C: kept"]


@pytest.mark.parametrize("run", [1, 3, 7, 1000])
def test_runs_of_a_long_text_join_without_a_seam(spark, run):
    """Records and carried values are the same however a text is cut into runs."""
    rows = [(s, i, "h" if i % 5 == s else "x" if i % 11 else None) for s in (0, 1, 9) for i in range(1, 60)]
    lines = spark.createDataFrame(rows, "source_id int, line_no int, line string")
    header = F.col("line") == "h"
    plain, cut = (sorted(map(tuple, ordered.records(lines, header, ["source_id"], "line_no", run=r).collect()), key=str) for r in (None, run))
    assert [c for c in plain if c[0] == 9] == [] and plain == cut
    value = F.when(header, F.struct("line_no", "line"))
    plain, cut = (sorted(map(tuple, ordered.carried(lines, value, ["source_id"], "line_no", "v", r).collect()), key=str) for r in (None, run))
    assert plain == cut


def test_white_space_and_words_of_any_script(spark):
    """No-break spaces part words, and letters of any script are letters."""
    nb = "\u00a0"
    assert told(spark, builds.build_report, f"/w/A.cs(1,2):{nb}error{nb}CS1{nb}:{nb}broke\n{nb}Core{nb}->{nb}x\nTime Elapsed{nb}1s") == ["ok build p=1 e=1 w=0 t=1s", "---", "Errors:", "  A.cs error CS1: broke"]
    assert service(spark, f"warn{nb}:{nb}A.B[1]{nb}\n      slow\n")[0][2:] == ["[WRN] B: slow"]
    assert told(spark, revisions.log_report, f"commit {nb}0123456789abcdef\n\n    m\n") == ["0123456 m"]
    assert spark.createDataFrame([("public Größe Run(x)",)], "line string").select(files.symbol_name("line").alias("n")).first().n == "Run"


def test_registry(spark):
    assert verb_of(["git", "-C", "x", "-p", "STATUS"]) == "status" and verb_of(["dotnet", "-v", "build"]) == "build" and verb_of(["git", "-c"]) is None
    assert parse_options(["--more", "git", "--raw"]) == ("more", ["git", "--raw"]) and parse_options(["--raw", "--more"])[0] == "raw"
    frame = captures(spark, [("c", ["git"], 0, "x\ny", "err\n")])
    assert render(frame.transform(resolve(["curl", "x"]))).first().text == "x\ny\nerr\n"
    assert resolve(["git", "status"], "raw") is passthrough
    failed = captures(spark, [("c", ["git", "push"], 128, "", "fatal\n"), ("d", ["git", "push"], 0, "", None)])
    assert sorted(map(tuple, rendered(failed.transform(resolve(["git", "push"])), failed).collect())) == [("c", "\nfatal\n", 128), ("d", "ok", 0)]
    register("curl", None, revisions.compact_report)
    assert resolve(["curl"]) is not passthrough


@pytest.mark.parametrize("run", [1, 2, 3, 7, 1 << 17])
def test_files_and_hunks_are_numbered_in_runs(spark, run):
    """One file's hunks may lie in many runs, and a run may hold several files."""
    import random

    from lexisift.plans.revisions import diff_lines

    draw = random.Random(3)
    rows, want = [], []
    for source in ("a", "b", "c"):
        file_no = hunk_no = 0
        for i in range(1, 60):
            line = draw.choice(["+x", "-y", "@@ -1 +1 @@", "context", "diff --git a/f b/f"] if source != "c" else ["+x", "@@ -1 +1 @@"])
            file_no, hunk_no = (file_no + 1, 0) if line.startswith("diff") else (file_no, hunk_no + line.startswith("@@"))
            rows.append((source, i, line))
            if file_no:
                want.append((source, i, file_no, hunk_no))
    lines = spark.createDataFrame(rows, "source_id string, line_no int, line string").repartition(5)
    got = diff_lines(lines, run)
    assert sorted((r.source_id, r.line_no, r.file_no, r.hunk_no) for r in got.collect()) == want


@pytest.mark.parametrize(("most", "head", "tail"), [(5, 3, 2), (4, 1, 3), (2, 1, 1), (6, 2, 2)])
def test_heads_and_tails(spark, most, head, tail):
    from lexisift.operators.ordered import head_and_tail

    sizes = range(0, 11)
    rows = [(f"s{n}", i * 3, f"l{i}") for n in sizes for i in range(n)]
    got = head_and_tail(spark.createDataFrame(rows, "source_id string, line_no int, line string"), most, head, tail)
    want = []
    for n in sizes:
        own = [f"l{i}" for i in range(n)]
        if n > most:
            own = [*own[:head], f"... ({n - head - tail} lines omitted)", *own[n - tail :]]
        want += [(f"s{n}", k + 1, x, n - head - tail if x.startswith("...") else 0) for k, x in enumerate(own)]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_written_reports_are_the_rendered_ones(spark, tmp_path):
    from urllib.parse import unquote

    from lexisift.plans.report import write_reports

    lines = "".join(f"{'warn' if i % 3 else 'fail'}: A.B{i}[1]\n      said {i}\n      at x{i}\n" for i in range(900))
    logs = spark.createDataFrame([("w/a.log", lines), ("b.log", lines[:200]), ("c.log", "")], "source_id string, raw string")
    report = service_logs.service_log_report(logs)
    held = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")  # else so few rows are one part
        write_reports(report, str(tmp_path / "out"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", held)
    got, parts = {}, {}
    for folder in (tmp_path / "out").glob("source_id=*"):
        names = sorted(folder.glob("part-*"))
        source = unquote(folder.name.partition("=")[2])
        got[source], parts[source] = "".join(p.read_text() for p in names), len(names)
    assert got == {r.source_id: r.text + "\n" for r in render(report).collect()} and parts["w/a.log"] > 1


@pytest.mark.parametrize("partitions", [1, 3, 17])
def test_ranks_in_ranges_are_ranks(spark, partitions):
    import random

    from lexisift.operators.ordered import ranked, ranked_in_ranges

    draw = random.Random(partitions)
    rows = spark.createDataFrame([(draw.choice("aab"), draw.choice([None, *range(9)]), i) for i in range(200)], "source_id string, x int, y int")
    for order in ([F.col("x"), F.col("y")], [F.desc("x"), F.col("y")]):
        want = {tuple(r) for r in ranked(rows, ["source_id"], order).collect()}
        held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
        try:
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            spark.conf.set("spark.sql.adaptive.enabled", "false")
            got = ranked_in_ranges(rows, ["source_id"], order).select("source_id", "x", "y", "rank")
            assert {tuple(r) for r in got.collect()} == want
        finally:
            for k, v in held.items():
                spark.conf.set(k, v)
    assert ranked_in_ranges(rows.limit(0), ["source_id"], [F.col("y")]).count() == 0


def _plans(monkeypatch):
    """The plans of all that reports on version control work out once."""
    seen, once = [], revisions.once
    monkeypatch.setattr(revisions, "once", lambda frame: (seen.append(frame._jdf.queryExecution().executedPlan().toString()), once(frame))[1])
    return seen


def test_commits_are_parted_where_their_text_lies(spark, monkeypatch):
    plans = _plans(monkeypatch)
    odd = "commit \n0123456 is no head\ncommit 0123456 x\r\nAuthor: A\n    Co-Authored-By: B\n    \n    first \r\n    second\ncommit  abcdef0123456789\n     \ncommit 01\n"
    texts = [odd, "commit none\n    m", "".join(f"commit {i:040x}\n\n    m{i}\n" for i in range(60))]
    one, two, three = told(spark, revisions.log_report, *texts)
    assert one == ["0123456 first", "abcdef0 (no message)"] and two == ["commit none", "    m"]
    assert len(three) == 51 and three[49:] == ["0000000 m49", "... +10 more commits"]
    assert plans and not any("Exchange" in p or "Sort" in p for p in plans)


def test_files_of_a_difference_are_parted_where_their_text_lies(spark, monkeypatch):
    plans = _plans(monkeypatch)
    odd = "lead\n@@ no\n+no\ndiff --git a/x/A.cs b/x/A.cs\r\nnew file mode 1\n--- /dev/null\n+++ b/x/A.cs\n@@ -0,0 +1,2 @@\r\n+a\r\n++b\n+++ c\n-- d\n--- e\n x\n@@ bare\n-f\ndiff --git odd\nBinary files a and b differ\ndiff --git a/C b/C\ndeleted file mode 1\n+out"
    frame = captures(spark, [("c", [], 0, odd, None), ("d", [], 0, "no difference", None), ("e", [], 0, "diff --git a/D b/D", None)])
    texts = merged(frame)
    found = revisions.diff_lines(text_lines(texts))
    names = ["source_id", "file_no", "name", "additions", "deletions", "is_binary", "is_new", "is_deleted", "hunks"]
    rows = lambda files: sorted(map(tuple, files.select(*names).collect()))
    assert rows(revisions.diff_texts(texts, 6, 4)) == rows(revisions.diff_files(found)) and len(rows(revisions.diff_texts(texts, 6, 4))) == 4
    preview = [r.detail for r in revisions.diff_report(frame).where("source_id = 'c' and section = 'preview'").orderBy("rank").collect()]
    assert preview == ["@@ A.cs 1-2", "+a", "++b", "-- d", "@@ A.cs", "-f"]
    assert "Exchange" not in plans[0] and "Sort" not in plans[0]
