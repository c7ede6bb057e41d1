import json

import pytest

from quillspark.operators import systems as Y
from quillspark.sources import html as H
from quillspark.sources import markdown as M
from quillspark.sources import packaging as P
from quillspark.sources import records as R
from quillspark.streaming import corpus as C


def test_script_text_is_skipped(spark):
    page = "<html><title>T &amp; U</title><script>var t='</p>';</script><article><p>One<p>two <!-- no --><b>bold</b></article></html>"
    row = H.page_text(spark.createDataFrame([(1, page)], "id long, html string"), "id", "html").first()
    assert row.title == "T & U" and row.text.split() == ["One", "two", "bold"]


def test_item_page():
    page = """<pre class="item-decl">pub struct Thing</pre><div class="docblock">A thing.</div>
    <section id="impl-Thing"><h3>impl Thing</h3></section><section id="method.go"><h4 class="code-header">fn go(&amp;self)</h4></section><div class="docblock">Goes.</div>"""
    item, method = H.item_records("core/util/struct.Thing.html", page)
    assert (item["kind"], item["full_path"], item["docs"]) == ("struct", "core::util::Thing", "A thing.")
    assert (method["kind"], method["name"], method["owner"], method["docs"]) == ("method", "go", "Thing", "Goes.")


def test_front_matter(spark):
    text = '+++\ntitle = "Hi"\nweight = 3\npublic_draft = 12\n+++\nBody'
    f = spark.createDataFrame([(text,), ("plain",)], "t string").select(M.front_matter("t").alias("f")).collect()
    assert (f[0].f.title, f[0].f.weight, f[0].f.draft, f[0].f.body) == ("Hi", 3, True, "Body")
    assert (f[1].f.title, f[1].f.draft, f[1].f.body) == (None, False, "plain")


def test_malformed_line_fails(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"name":"A"}\n\n{"name":\n')
    with pytest.raises(Exception, match="malformed line"):
        R.read_ndjson(spark, str(tmp_path / "a.json")).collect()


def test_build_load_pack(spark, tmp_path):
    target = str(tmp_path / "corpus")
    for revision in (1, 2):
        P.build({"records": spark.range(5)}, target, "1.0.0", revision)
    assert P.load(spark, target)["records"].count() == 5
    assert json.loads((tmp_path / "corpus/manifest.json").read_text())["revision"] == 2
    told = P.pack(target, str(tmp_path / "b.tar.zst"))
    P.unpack(str(tmp_path / "b.tar.zst"), str(tmp_path / "again"), told)
    assert P.load(spark, str(tmp_path / "again"))["records"].count() == 5
    with pytest.raises(ValueError):
        P.unpack(str(tmp_path / "b.tar.zst"), str(tmp_path / "c"), told | {"size": 1})


def test_manifest_features():
    manifest = '[dependencies]\nengine = { workspace = true, features = ["b"] }\n[target."cfg(x)".dependencies]\nalias = { package = "other", version = "1" }'
    assert P.dependency_features(manifest, "engine", '[workspace.dependencies]\nengine = { version = "1", features = ["a"], default-features = false }') == (["a", "b"], False)
    assert P.dependency_features(manifest, "other") == ([], True)
    assert P.locked_versions('[[package]]\nname="a"\nversion="1"\n[[package]]\nname="a"\nversion="2"', "a") == ["1", "2"]


def test_signature_parser():
    code = 'fn a<T: Fn(u8) -> u8>(q: Query<(&A, Option<&mut B>), (With<C>, Without<D>)>, mut r: ResMut<E<F>>) {} // fn no(x: Res<Y>)\nfn s(&self) {}'
    assert Y.functions(code) == [("a", ["Query<(&A, Option<&mut B>), (With<C>, Without<D>)>", "ResMut<E<F>>"]), ("s", [])]
    rows = Y.accesses(code)
    assert [(r[4], r[5], r[6], r[7], r[8]) for r in rows] == [("component", "A", False, ["A", "C"], ["D"]), ("component", "B", True, ["A", "C"], ["D"]), ("resource", "E<F>", True, [], [])]


def test_stream_batches(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"name":"A"}\n{"name":"B"}\n')
    got = []
    q = C.ingest(C.read(spark, str(tmp_path / "in")), str(tmp_path / "cp"), lambda df, n: got.extend(r.name for r in df.collect()))
    q.awaitTermination(60)
    assert sorted(got) == ["A", "B"]
