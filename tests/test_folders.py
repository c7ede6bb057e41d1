"""Folders of files as records, corpora with a state each, and results of tools."""

import os

import pytest
from quillspark.operators import results as T
from quillspark.operators.corpus import Corpus
from quillspark.sources import folders as D
from quillspark.sources import markdown as M


@pytest.fixture
def tree(tmp_path):
    def write(path, text, root="site"):
        p = tmp_path / root / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text if isinstance(text, bytes) else text.encode())

    write("content/learn/book/intro.md", "+++\ntitle = \"Intro\"\nstatus = \"hidden\"\n+++\n# One\n" + "a" * 60 + "\n## Two\n" + "é" * 60 + "\n")
    write("content/foundation/x.md", "# never\n" + "b" * 90)
    write("content/learn/empty.md", "+++\ntitle = \"E\"\n+++\n  \n")
    write("content/news/plain.md", "only a line")
    write("content/news/picture.png", b"\x89PNG")
    write("a/struct.Thing.html", "<p>x</p>", "html")
    write("src/struct.Other.html", "x", "html")
    write("b/.lock/x.html", "x", "html")
    write("all.html", "x", "html")
    write("c/index.html", "y" * (401 * 1024), "html")
    write("d/index.html", "y", "html")
    write("ui/button.rs", "//! A button.\n\n//!  Second line \nfn main() {}\n", "examples")
    write("top.rs", "fn main() {}", "examples")
    write("1/2/3/4/5/6/7/deep.rs", "x", "examples")
    write("B0002.md", "two", "errors")
    write("B0001.md", "one", "errors")
    write("b0001.md", "no", "errors")
    write("sub/B0003.md", "no", "errors")
    return str(tmp_path)


def test_website(spark, tree):
    rows = D.website_records(D.read_tree(spark, f"{tree}/site", "*.md"), "0.20.0").orderBy("full_path", "line_start").collect()
    assert [(r.full_path, r.heading, r.line_start, r.draft, r.title) for r in rows] == [
        ("book:content/learn/book/intro.md", "One", 1, True, "Intro"), ("book:content/learn/book/intro.md", "Two", 3, True, "Intro"), ("news:content/news/plain.md", None, 1, False, "plain"),
    ]
    assert rows[1].breadcrumb == ["One", "Two"] and rows[2].docs == "only a line" and rows[0].module == "content::learn::book"


def test_pages(spark, tree):
    assert sorted(r.path for r in D.html_pages(spark, f"{tree}/html").collect()) == ["a/struct.Thing.html", "d/index.html"]
    assert D.html_pages(spark, f"{tree}/nowhere").count() == 0
    assert sorted(r.path for r in D.html_pages(spark, f"file:{tree}/html").collect()) == ["a/struct.Thing.html", "d/index.html"]


def test_examples(spark, tree):
    rows = {r.file: r for r in D.example_records(D.read_tree(spark, f"{tree}/examples", "*.rs"), "examples").collect()}
    assert set(rows) == {"ui/button.rs", "top.rs"}
    b = rows["ui/button.rs"]
    assert (b.name, b.module, b.categories, b.line_count, b.description) == ("button", "ui", ["ui"], 5, "A button.\nSecond line")
    assert b.docs.startswith("A button.\nSecond line\n\n```rust\n//! A") and rows["top.rs"].module == "." and rows["top.rs"].description is None


def test_error_codes(spark, tree):
    read = lambda x: D.read_tree(spark, f"{tree}/{x}", "*.md")
    rows = D.error_code_records([read("nowhere"), read("site"), read("errors")], "core", "0.20.0").orderBy("name").collect()
    assert [(r.name, r.docs, r.full_path, r.title) for r in rows] == [("B0001", "one", "core::errors::B0001", "Error B0001"), ("B0002", "two", "core::errors::B0002", "Error B0002")]


def test_module_doc(spark):
    texts = ["//! a\n//! b\nfn", "\n//! not first", "  //! x  \n\n\n//! y\n// z\n//! w", "fn main() {}", ""]
    got = [r.d for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(M.module_doc("t").alias("d")).collect()]
    assert got == ["a\nb", "", "x\ny", "", ""]


def test_gates_and_sites(spark):
    code = "x error[B0001] warning[B0002]\n\nerror[B12]\nerror[B0001]"
    got = D.panic_sites(spark.createDataFrame([(1, code), (2, None)], "k int, t string"), "k", "t").collect()
    assert sorted((r.code, r.line) for r in got) == [("B0001", 1), ("B0001", 4), ("B0002", 1)]
    gates = '#[cfg(feature = "ui")]\n    #[custom(x)]\n    a::ui::UiPlugin,\n#[cfg(feature="audio")]\nb::AudioPlugin\n#[cfg(not(feature = "x"))]\nc::XPlugin'
    assert [(r.ord, r.requires_feature, r.plugin) for r in D.plugin_gates(spark.createDataFrame([(1, gates)], "k int, t string"), "k", "t").collect()] == [(0, "ui", "UiPlugin"), (1, "audio", "AudioPlugin")]


def test_corpora_with_states(spark, tmp_path):
    good = spark.createDataFrame([("a", "x"), ("b", "y")], "name string, docs string")
    for name in ("good", "cut"):
        good.coalesce(1).write.parquet(f"{tmp_path}/{name}/1.0")
    good.select("name").write.parquet(f"{tmp_path}/lean/1.0")
    for f in os.listdir(tmp_path / "cut/1.0"):
        if f.endswith(".parquet"):
            p = tmp_path / "cut/1.0" / f
            p.write_bytes(p.read_bytes()[:40])
            os.remove(tmp_path / f"cut/1.0/.{f}.crc")
    rows, states = D.corpora(spark, [("good", "1.0"), ("good", "2.0"), ("lean", "1.0"), ("cut", "1.0")], str(tmp_path), ["name", "docs"])
    got = {(r.corpus, r.version): (r.state, r.reason) for r in states.collect()}
    assert got["good", "1.0"] == ("read", None) and got["good", "2.0"] == ("skipped", "missing") and got["lean", "1.0"] == ("skipped", "wrong format: no docs")
    assert got["cut", "1.0"][0] == "skipped" and got["cut", "1.0"][1].startswith("unreadable")
    assert sorted((r.corpus, r.name) for r in rows.collect()) == [("good", "a"), ("good", "b")]
    none, _ = D.corpora(spark, [("x", "1")], str(tmp_path), ["name"])
    assert none.count() == 0


def test_detected_versions(spark):
    c = spark.createDataFrame([("l", "a", "0.2.0"), ("l", "b", "0.2.0"), ("l", "a", "0.2.0"), ("m", "a", "0.10.0"), ("m", "a", "0.9.0")], "source string, name string, version string")
    got = {r.source: (r.version, r.crates, r.ambiguous) for r in D.detected(c).collect()}
    assert got == {"l": ("0.2.0", "a 0.2.0, b 0.2.0", False), "m": (None, "a 0.9.0, a 0.10.0", True)}


def test_release_check_ties_and_previews_alone(spark):
    index = lambda *vers: spark.createDataFrame([("x", v, False) for v in vers], "name string, vers string, yanked boolean").coalesce(1)
    for vers in (("0.8.1", "0.8.1+b5"), ("0.8.1+b5", "0.8.1")):
        assert T.release_check(index(*vers), "x", "0.7.1").first().newest_stable == "0.8.1+b5"
    assert T.release_check(index("0.9.0-rc.1"), "x", "0.7.1").count() == 0


def test_tools(spark, tmp_path):
    rows = [(i, "rustdoc", "struct" if i < 9 else "method", f"Thing{i}" if i < 9 else f"do{i}", "" if i < 9 else "Thing1", f"m::T{i}", "m", "docs", "", None, f"h{i}") for i in range(30)]
    records = spark.createDataFrame(rows, "dense_id long, source string, kind string, name string, owner string, full_path string, module string, docs string, signature string, source_ref string, hash string")
    corpus = Corpus(spark, str(tmp_path), records, buckets=2)
    corpus.add(records, "all")
    assert [T.clamp("search", x) for x in (None, 0, 99)] == [8, 1, 20] and T.clamp("examples", 99) == 15
    found = T.search(corpus, "Thing1", None, None, "1.0", "1.0").collect()
    assert found[0].name == "Thing1" and found[0].part == "results" and found[0].owner is None and found[0].fallback is False and found[0].id == "h1"
    api = T.api(corpus, "Thing1").collect()
    assert [r.name for r in api if r.part == "results"] == ["Thing1"] and sum(r.part == "related" for r in api) == 12
    assert {r.part for r in T.api(corpus, "Thong1").collect()} == {"suggestions"}
    status = {(r.part, r.name): r.n for r in T.status(records, corpus.symbols.read()).collect()}
    assert status["total", "records"] == 30 and status["kind", "method"] == 21 and status["total", "api_records"] == 30 and status["total", "symbols"] > 30
    ids = spark.createDataFrame([("a1 _x 9z b_2,é",)], "t string").select(T.identifiers("t").alias("i")).first().i
    assert ids == ["a1", "b_2"]
