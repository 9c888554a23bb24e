"""Folders as tables, and the closure of names over them."""

import os

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import closure
from corpusloom.sources import trees
from corpusloom.sources.tables import texts

FILES = {
    "index.html": "<img src='/assets/hero.webp'><a href=\"/assets/gone.png?x=1#y\">x</a><script>var a = '/assets/data.json'</script>",
    "css/site.css": "p{background:url(../img/p.png)} q{background:url('q.png')} r{background:url(data:image/png,x)} s{background:url(https://cdn.example/s.png)}",
    "js/app.js": "fetch('/assets/runtime.json'); new Worker('./w.js'); fetch('/assets/' + name); x = '/assets/never-loaded.png'",
    "_external/cdn.example/page.html": "<img src='/assets/foreign.png'>",
    "assets/hero.webp": "w",
    "img/p.png": "p",
}


def capture(tmp_path, files):
    for path, body in files.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(body)
    return str(tmp_path)


def test_tree_as_a_table(spark, tmp_path):
    root = capture(tmp_path, FILES)
    tree = trees.read_tree(spark, root)
    assert {r.path: (r.bytes, bytes(r.content).decode()) for r in tree.collect()} == {p: (len(b), b) for p, b in FILES.items()}
    assert tree.rdd.getNumPartitions() == 1 + len(os.listdir(root)) - 1  # the root's own files and each folder
    assert [r.path for r in tree.where(F.startswith("path", F.lit("css/"))).collect()] == ["css/site.css"]
    assert sorted(r.path for r in tree.where(F.endswith("path", F.lit(".html")) & F.contains("path", F.lit("ext"))).collect()) == ["_external/cdn.example/page.html"]
    with pytest.raises(Exception, match="no folder"):
        trees.read_tree(spark, root + "/none").collect()


def test_filters_on_the_path_open_no_other_file(spark, tmp_path):
    root = capture(tmp_path, {"a/good.txt": "x", "b/bad.txt": "y"})
    os.chmod(f"{root}/b/bad.txt", 0)
    reader = trees.TreeReader(root)
    left = list(reader.pushFilters([trees.StringStartsWith(("path",), "a/"), trees.EqualTo(("bytes",), 1)]))
    assert left == [trees.EqualTo(("bytes",), 1)]
    assert [b.column(0).to_pylist() for p in reader.partitions() for b in reader.read(p)] == [["a/good.txt"]]


def test_links_are_refused(spark, tmp_path):
    root = capture(tmp_path, {"a/b/c.txt": "x"})
    os.symlink("/etc/hostname", f"{root}/a/b/out")
    with pytest.raises(Exception, match="symbolic link"):
        trees.read_tree(spark, root).count()
    os.unlink(f"{root}/a/b/out")
    os.symlink("/etc", f"{root}/folder")
    with pytest.raises(Exception, match="symbolic link"):
        trees.read_tree(spark, root).count()


def test_written_trees_come_back(spark, tmp_path):
    rows = [(f"d{i % 3}/f{i}.txt", f"text {i}".encode()) for i in range(20)] + [("top.txt", None)]
    df = spark.createDataFrame(rows, "path string, content binary").repartition(3)
    assert trees.write_tree(df, str(tmp_path / "t")) == 21
    got = {r.path: bytes(r.content) for r in trees.read_tree(spark, str(tmp_path / "t")).collect()}
    assert got == {p: c or b"" for p, c in rows}
    for bad in ("../x", "/etc/x", "a/../../x", "."):
        with pytest.raises(Exception, match="outside the folder"):
            trees.write_tree(spark.createDataFrame([(bad, b"")], "path string, content binary"), str(tmp_path / "t"))
    assert trees.write_tree(df.limit(0), str(tmp_path / "none")) == 0


def test_closure_of_a_capture(spark, tmp_path):
    files = texts(trees.read_tree(spark, capture(tmp_path, FILES)))
    hints = spark.createDataFrame([("/assets/hinted.glb",), ("/assets/hero.webp",)], "path string")
    refs = closure.references(files, hints=hints)
    assert {(r["from"], r.source, r.resolved) for r in refs.collect()} == {
        ("index.html", "hint", "assets/hero.webp"),
        ("index.html", "hint", "assets/hinted.glb"),
        ("index.html", "static", "assets/gone.png"),
        ("index.html", "static", "assets/data.json"),
        ("css/site.css", "css-url", "img/p.png"),
        ("css/site.css", "css-url", "css/q.png"),
        ("js/app.js", "javascript-runtime-sink", "assets/runtime.json"),
        ("js/app.js", "javascript-runtime-sink", "js/w.js"),
    }
    lost = {(r.resolved, r.blocking) for r in closure.missing(refs, files).collect()}
    assert lost == {("assets/gone.png", True), ("assets/data.json", True), ("css/q.png", True), ("assets/runtime.json", False), ("js/w.js", False), ("assets/hinted.glb", False)}
    assert tuple(closure.gate(refs, files).first()) == (8, 3, 3, False)
    diagnostic = refs.where(F.col("source").isin("hint", "javascript-runtime-sink"))
    assert closure.gate(diagnostic, files).first().passed and not closure.gate(diagnostic, files, strict=True).first().passed
    assert tuple(closure.gate(refs.limit(0), files).first()) == (0, 0, 0, True)


def test_odd_names(spark):
    rows = [("a/b.html", "'/assets/x%20y.png' '/assets/%zz.png' '/assets/${n}.png' './c.css' '../../up.js' 'assets/bare.js'"), ("n.html", None)]
    refs = closure.references(spark.createDataFrame(rows, "path string, text string"))
    assert sorted(r.resolved for r in refs.collect()) == ["../up.js", "a/c.css", "assets/%zz.png", "assets/bare.js", "assets/x y.png"]


def test_pictures(spark, tmp_path):
    import struct
    import zlib

    from corpusloom.sources.tables import pictures

    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 1, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\1\2\3\4\5\6")) + chunk(b"IEND", b"")
    (tmp_path / "a.png").write_bytes(png)
    (tmp_path / "b.png").write_bytes(b"none")
    (found,) = pictures(spark, str(tmp_path)).collect()
    assert (found.height, found.width, found.channels, bytes(found.pixels)) == (1, 2, 3, bytes([3, 2, 1, 6, 5, 4]))  # blue first
