"""Folders and byte ranges read by tasks."""

import io
import random

import pytest

from lexisift.commands import answer
from lexisift.plans.report import render
from lexisift.sources import store
from lexisift.sources.files import entries, found_lines, inventory, log_lines, path_kind


def in_ranges(data: bytes, size: int, width: int, piece: int) -> list[bytes]:
    return [line for start in range(0, len(data), size) for line in store.lines_from(io.BytesIO(data), start, min(start + size, len(data)), width, piece)]


def whole(data: bytes, width: int) -> list[bytes]:
    """Lines by reading one unit after the other; an odd byte at the end stays with the last line."""
    out, line = [], b""
    for i in range(0, len(data), width):
        unit = data[i : i + width]
        if unit == b"\n\0"[:width]:
            out.append(line)
            line = b""
        else:
            line += unit
    return out + [line] * bool(line)


@pytest.mark.parametrize("width", [1, 2])
def test_ranges_of_any_size_give_each_line_once(width):
    draw = random.Random(width)
    for n in range(60):
        units = [b"\n\0"[:width], b"\n\0"[:width], *([b"a", b"\r", b"\0"] if width == 1 else [b"a\0", b"\x41\x0a", b"\0\x0a", b"\x0a\x0a", b"\x0a\x01"])]
        data = b"".join(draw.choice(units) for _ in range(draw.randrange(0, 40))) + b"x" * draw.choice([0, 0, 1])
        for size in (1, 2, 3, 5, 8, 1000):
            for piece in (1, 2, 3, 1 << 20):
                assert in_ranges(data, size, width, piece) == whole(data, width), (data, size, piece)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("store") / "top"
    for name, text in {
        "pkg/__init__.py": "", "top_empty.txt": "", "src/a.py": "x = 1\n", ".hidden/c.yml": "k: 1\n", "_w/.d": "", "bin/x.dll": "no", "src/bin/y.cs": "no", "sp ace/é%20.md": "# é\n", "app.log": "",
    }.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    (root / "src" / "empty" / "deep").mkdir(parents=True)
    return root


def test_folders_level_by_level(spark, folder):
    got = {r.path: (r.kind, r.length) for r in store.listing(spark, str(folder)).collect()}
    want = {str(p.relative_to(folder)): ("directory", 0) if p.is_dir() else ("file", p.stat().st_size) for p in folder.rglob("*")}
    assert got == want
    less = {r.path for r in store.listing(spark, f"file://{folder}/", ["bin"]).collect()}
    assert less == {p for p in want if "bin" not in p.split("/")}
    assert {r.path for r in store.listing(spark, str(folder), most=0).collect()} == {p for p in want if "/" not in p}
    assert {r.path for r in store.listing(spark, str(folder), most=1).collect()} == {p for p in want if p.count("/") < 2}
    assert {r.path for r in inventory(spark, str(folder)).collect()} == {p for p, (k, _) in want.items() if k == "file"}
    assert {r.path for r in entries(spark, str(folder), most=0).collect()} == {"pkg/", "top_empty.txt", "src/", ".hidden/", "_w/", "bin/", "sp ace/", "app.log"}
    assert [path_kind(spark, str(p)) for p in (folder, folder / "app.log", folder / "no")] == ["directory", "file", None]
    assert store.reachable(str(folder)) and not store.reachable("viewfs://store/in")


def told(spark, *args):
    report, code = answer(spark, args)
    return ["\n".join(r.text for r in render(report).collect()).split("\n"), code]


def test_reports_on_folders_with_empty_and_hidden_ones(spark, folder):
    assert told(spark, "ls", str(folder))[0] == ["_w/", ".hidden/", "app.log", "bin/", "pkg/", "sp ace/", "src/", "top_empty.txt"]
    tree = told(spark, "tree", str(folder))[0]
    assert tree == ["tree d=6 f=7 depth=2", "top/", "  .hidden/ d=0 f=1", "  _w/ d=0 f=1", "  pkg/ d=0 f=1", "  sp ace/ d=0 f=1", "  src/ d=1 f=1", "    empty/ d=0 f=0", "files=app.log,top_empty.txt"]
    assert told(spark, "tree", str(folder), "--all", "--depth", "3")[0][0] == "tree d=9 f=9 depth=3"
    assert told(spark, "files", str(folder))[0][:2] == ["files n=7", "top=root(2),.hidden(1),_w(1)"]
    bare = str(folder / "src" / "empty" / "deep")
    assert told(spark, "tree", bare)[0] == ["tree d=0 f=0 depth=2", "deep/"] and told(spark, "files", bare)[0] == ["files n=0"]
    assert told(spark, "log", str(folder / "app.log"))[0] == ["ok log n=0 file=app.log"]
    assert told(spark, "view", str(folder / "top_empty.txt"))[0] == ["view top_empty.txt lines=0"]


@pytest.mark.parametrize("encoding", ["utf-8", "utf-16", "utf-16-le"])
def test_logs_by_ranges(spark, tmp_path, monkeypatch, encoding):
    text = "".join(f"warn: A.B[{i}]\r\n      said é ਊ {'y' * (i % 40)}\n" for i in range(300)) + "the last"
    (tmp_path / "a.log").write_bytes(text.encode(encoding))
    want = [line.rstrip("\r") for line in text.split("\n")]
    got = []
    for size in (777, 1 << 23):
        monkeypatch.setattr(store.range_lines, "__defaults__", (False, size))
        lines = log_lines(spark, str(tmp_path / "a.log")).orderBy("line_no").collect()
        assert [r.line_no for r in lines] == list(range(1, len(want) + 1))
        got.append([r.line.removeprefix("﻿") for r in lines])
    assert got == [want, want]


@pytest.mark.parametrize("query", ["ß", "kelvin", "Run", "i̇", "x y"])
def test_search_by_ranges_finds_what_a_search_of_lines_finds(spark, tmp_path, monkeypatch, query):
    from lexisift.plans.searches import search_lines
    from lexisift.sources.files import read_lines

    lines = ["STRASSE ß", "Kelvin", "KELVIN run", "Run x Y", "İ", "no", "x y\r", "", "é Run"]
    for k in range(4):
        (tmp_path / f"f{k}.cs").write_text("\n".join(lines[i % len(lines)] * (1 + i % 2) for i in range(k, 60 + k)) + "\n" * (k % 2))
    (tmp_path / "b.bin").write_bytes(b"Run kelvin x y\0")
    (tmp_path / "g.designer.cs").write_text("Run kelvin x y ß")
    monkeypatch.setattr(store.range_hits, "__defaults__", (50,))
    got = sorted((r.file.rsplit("/", 1)[1], r.hit_line, r.content) for r in found_lines(spark, str(tmp_path), query).collect())
    plain = search_lines(read_lines(spark, str(tmp_path), "f*"), query)
    assert got == sorted((r.file.rsplit("/", 1)[1], r.hit_line, r.content) for r in plain.collect()) and got


def test_a_search_leaves_ignored_folders(spark, folder):
    assert [r.file.rsplit("/", 1)[1] for r in found_lines(spark, str(folder), "x =").collect()] == ["a.py"]
    assert found_lines(spark, str(folder), "no").isEmpty()


def test_written_files(spark, tmp_path):
    rows = spark.createDataFrame([("a/b.txt", b"x"), ("a/c/", None), ("d", None)], "path string, content binary")
    store.write_files(rows, f"file://{tmp_path}/out")
    assert {r.path: r.length for r in store.listing(spark, f"{tmp_path}/out").collect()} == {"a": 0, "a/b.txt": 1, "a/c": 0, "d": 0}
