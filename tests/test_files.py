from lexisift.plans.service_logs import log_summary
from lexisift.sources.files import changed_files, included, inventory, path_kind, read_lines, read_log_lines, read_logs, searchable


def test_logs_in_any_encoding(spark, tmp_path):
    text = "warn: A\n      é" + " " * 60
    for name, data in (("a.log", text.encode()), ("b.log", b"\xff\xfe" + text.encode("utf-16-le")), ("c.log", text.encode("utf-16-le"))):
        (tmp_path / name).write_bytes(data)
    got = {r.source_id.split("/")[-1]: r.raw for r in read_logs(spark, str(tmp_path)).collect()}
    assert got == {"a.log": text, "b.log": "\ufeff" + text, "c.log": text}


def test_logs_in_splits(spark, tmp_path):
    for name, n in (("a.log", 4000), ("b.log", 3)):
        (tmp_path / name).write_text("".join(f"{'warn: A.B' if i % 3 == 0 else '      said ' + str(i % 7)}{'x' * (i % 11)}\r\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        lines = read_log_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 1
        got = {(r.source_id.split("/")[-1], r.line_no): r.line for r in lines.collect()}
        whole = {(r.source_id.split("/")[-1], r.line_no): r.line for r in read_lines(spark, str(tmp_path)).collect()}
        assert got == whole and len(got) == 4003
        name = lambda frame: sorted((r.source_id.split("/")[-1], r.line_no, r.message, r.repeat_count) for r in frame.collect())
        assert name(log_summary(lines)) == name(log_summary(read_logs(spark, str(tmp_path))))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_lines_of_text_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.txt").write_bytes(b"one\r\ntwo\n\nfour")
    (tmp_path / "y.bin").write_bytes(b"one\x00two\n")
    (tmp_path / "z").write_bytes(b"e\n")
    got = sorted((r.source_id.split("/")[-1], r.line_no, r.line) for r in read_lines(spark, str(tmp_path)).collect())
    assert got == [("x.txt", 1, "one"), ("x.txt", 2, "two"), ("x.txt", 3, ""), ("x.txt", 4, "four"), ("z", 1, "e")]
    assert sorted(r.path for r in inventory(spark, str(tmp_path)).collect()) == ["a/x.txt", "y.bin", "z"]


def test_what_belongs_to_a_listing(spark):
    paths = ["a/Bin/x.cs", "docs/y.cs", "src/z.cs", "src/z.g.cs", "q.png"]
    frame = spark.createDataFrame([(p,) for p in paths], "path string")
    kept = lambda **o: [r.path for r in frame.where(included("path", **o)).collect()]
    assert [r.path for r in frame.where(searchable("path")).collect()] == ["docs/y.cs", "src/z.cs", "q.png"]
    assert kept() == paths[1:] and kept(code=True) == ["src/z.cs"] and kept(ignored=True) == paths


def test_changed_files(spark):
    lines = [" M a.cs", "MM A.cs", "R  old -> new", "??", "?? b\u00a0 "]
    status = spark.createDataFrame(list(enumerate(lines)), "line_no int, line string")
    files = spark.createDataFrame([("a.cs",), ("A.cs",), ("b",)], "path string")
    assert sorted(r.path for r in changed_files(status, files).collect()) == ["a.cs", "b"]


def test_paths_below_a_root_whose_name_comes_again(spark, tmp_path):
    root = tmp_path / "rr" / "repo"
    again = root / "x" / str(root).lstrip("/")
    again.mkdir(parents=True)
    (again / "b.cs").write_text("b")
    (root / "a b.cs").write_text("a")
    want = sorted(["a b.cs", str((again / "b.cs").relative_to(root))])
    for path in (str(root), f"{root}/", f"file://{root}"):
        assert sorted(r.path for r in inventory(spark, path).collect()) == want
    assert [path_kind(spark, str(p)) for p in (root, root / "a b.cs", root / "none")] == ["directory", "file", None]


def test_search_in_files(spark, tmp_path):
    from lexisift.plans.searches import search_lines

    (tmp_path / "a.cs").write_text("Run it\nrun\n")
    (tmp_path / "b.bin").write_bytes(b"run\x00")
    lines = read_lines(spark, str(tmp_path))
    assert [r.hit_line for r in search_lines(lines, "run").orderBy("hit_line").collect()] == [1, 2]
    assert [r.hit_line for r in search_lines(lines, "Run").collect()] == [1] and search_lines(lines, "run", most=1).count() == 1
