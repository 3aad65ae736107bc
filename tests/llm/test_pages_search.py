import hashlib
import io
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from freshet.llm import ball_tree, html_layout, language_id, warc_zip

PAGES = "page_id long, url string, html string"


def pages():
    rng = random.Random(1)
    big = "<p>" + "same words " * 200
    rows = [(i, f"http://h{i % 3}.example.de/{i}", "".join(rng.choice("abc <>\né") for _ in range(rng.randint(0, 3000)))) for i in range(40)]
    rows += [(100 + i, f"http://x.example.fr/{i}", big) for i in range(30)] + [(200 + i, None, "tiny") for i in range(3)]
    return [*rows, (300, "http://y", None), (301, "a\r\nb", "")]


def test_archives_round_trip(spark, tmp_path):
    rows = pages()
    packages = warc_zip.write_archives(spark.createDataFrame(rows, PAGES).withColumn("payload", F.lit(1)).repartition(4), f"file://{tmp_path}/w", package_bytes=5_000)
    assert packages.count() > 4
    got = {r["page_id"]: r for r in warc_zip.read_records(warc_zip.read_index(packages)).collect()}
    assert len(got) == len(rows)
    last = max(i for i, _, t in rows if t and t.startswith("<p>same"))
    for i, _, html in rows:
        payload, r = (html or "").encode(), got[i]
        revisit = len(payload) >= 1000 and payload.startswith(b"<p>same") and i != last
        assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == (len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if revisit else "response", last if revisit else None)
        assert r["payload"] == (None if revisit else payload)
    one = warc_zip.read_records(warc_zip.read_index(packages).where("page_id = 7")).collect()
    assert len(one) == 1 and one[0]["payload"] == (rows[7][2] or "").encode()
    for uri in (r["package"] for r in packages.collect()):  # any ZIP reader can open a package
        with zipfile.ZipFile(uri.removeprefix("file://")) as z:
            assert z.testzip() is None and z.namelist() == [warc_zip.DATA, warc_zip.INDEX]


def test_archives_of_odd_tables(spark, tmp_path):
    df = spark.createDataFrame([(None, None, None), (1, "u", "x" * 2000), (1, "u", "x" * 2000)], PAGES)
    out = warc_zip.read_records(warc_zip.read_index(warc_zip.write_archives(df, f"file://{tmp_path}/a")))
    assert sorted(r["record_type"] for r in out.collect()) == ["response"] * 3
    assert warc_zip.read_index(warc_zip.write_archives(df.limit(0), f"file://{tmp_path}/b")).count() == 0


def test_archives_of_repeated_ids(spark, tmp_path):
    """Ids that repeat with equal and other payloads, the holder's too, and null ids: by rows."""
    rng = random.Random(6)
    big = [c * 1500 for c in "ABCD"]
    rows = [(rng.choice([1, 2, 3, 5, 7, 9, None]), "u", rng.choice([*big, "x", "y", None])) for _ in range(120)]
    rows += [(1, "u", "only" * 400), (1, "u", big[0]), (9, "u", big[0]), (9, "u", big[0])]
    packages = warc_zip.write_archives(spark.createDataFrame(rows, PAGES).repartition(3), f"file://{tmp_path}/r")
    want = []
    for page, _, html in rows:
        payload = (html or "").encode()
        last = max((i for i, _, t in rows if i is not None and t == html), default=None)
        refers = last if page is not None and len(payload) >= 1000 and page != last else None
        want.append((page, len(payload), hashlib.sha1(payload).hexdigest(), "response" if refers is None else "revisit", refers))
    got = warc_zip.read_records(warc_zip.read_index(packages)).collect()
    assert sorted(map(str, ((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got))) == sorted(map(str, want))
    held = {r["payload_digest"] for r in got if r["record_type"] == "response"}
    assert held == {r["payload_digest"] for r in got}  # every payload is in an archive


def test_records_are_read_by_many_tasks(spark, tmp_path):
    packages = warc_zip.write_archives(spark.createDataFrame(pages(), PAGES).repartition(4), f"file://{tmp_path}/t", package_bytes=5_000)
    index = warc_zip.spread_index(warc_zip.read_index(packages), packages, task_bytes=4_000)
    used = {r["p"] for r in index.select(F.spark_partition_id().alias("p")).distinct().collect()}
    assert packages.count() > 4 and len(used) > 4
    got = warc_zip.read_records(index).select("page_id").collect()
    assert sorted(r["page_id"] for r in got) == sorted(p[0] for p in pages())


@pytest.mark.parametrize("wide", [False, True])
def test_directory(wide):
    out = io.BytesIO()
    warc_zip.write_package(out, [("a", b"12345"), ("ü/b", b"")], force_zip64=wide)
    f = io.BytesIO(out.getvalue())
    members = warc_zip.read_directory(f)
    assert {n: m.size for n, m in members.items()} == {"a": 5, "ü/b": 0}
    at = warc_zip.data_offset(f, members["a"])
    assert out.getvalue()[at : at + 5] == b"12345"
    with zipfile.ZipFile(f) as z:
        assert z.read("a") == b"12345"


def test_foreign_packages():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("plain", "x" * 50)
        z.writestr("small", "y" * 50, zipfile.ZIP_DEFLATED)
        z.comment = b"a comment"
    members = warc_zip.read_directory(out)
    assert warc_zip.data_offset(out, members["plain"]) == 30 + 5
    with pytest.raises(warc_zip.ZipFormatError, match="compressed"):
        warc_zip.data_offset(out, members["small"])
    for broken in (b"", b"PK", out.getvalue()[:-30]):
        with pytest.raises(warc_zip.ZipFormatError):
            warc_zip.read_directory(io.BytesIO(broken))


def text(html):
    return html_layout.render(html_layout.parse(html))


@pytest.mark.parametrize("html,want", [
    ("<p>one<p>two", "one\n\ntwo"), ("a <b> b</b>  c", "a b c"), ("<div>x</div><div>y</div>", "x\ny"), ("x<br>y<br><br>z", "x\ny\n\nz"),
    ("<ul><li>a<li>b<ol><li>x<li>y</ol></ul>", "- a\n- b\n  1. x\n  2. y"), ("<ol start=3><li>a</ol>", "3. a"),
    ("<table><tr><th>Name<th>Qty<tr><td>apple<td>3</table>", "Name   Qty\napple  3"), ("<table><tr><td>漢字<td>x<tr><td>abc<td>y</table>", "漢字  x\nabc   y"),
    ("<table><tr><td>a<br>b<td>c</table>", "a  c\nb"), ("<pre> a\n  b</pre>", " a\n  b"), ("<p hidden>x<p>y", "y"), ("<span style='display: none'>x</span>y", "y"),
    ("<head><title>t</title><style>p{}</style><script>1<2</script></head>body &amp; soul", "body & soul"), ("a&nbsp;b", "a\xa0b"), ("", ""), ("<", "<"),
    ("<dl><dt>T<dd>D</dl>", "T\n  D"), ("<template>x</template><!-- c -->y", "y"),
])
def test_layout(html, want):
    assert text(html) == want


@pytest.mark.parametrize("html,want", [
    ("<body>a <svg width=1 /> b <math/> c<p>d", "a b c\n\nd"), ("<svg><path d='M0'/><g/>x<text>one</text><text>two<tspan/> three<desc>no</desc></text></svg> z", "one two three z"),
    ("<svg><title>t</title><desc>d</desc><style>s{}</style><defs><text>no</text></defs><text>yes</text></svg>", "yes"), ("<svg><foreignObject><div>in</div></foreignObject></svg>out", "in\nout"),
    ("<svg><text>a<p>b", "a\n\nb"), ("x <math><mi>y</mi><mo>=</mo><mn>2</mn><annotation>no</annotation></math> z", "x y=2 z"),
    ("a <textarea>b\n  c</textarea> d", "a b\n  c d"), ("is <select><option>x<option selected>y<option>z</select>.", "is y ."),
    ("<select><option disabled>x<optgroup label=g><option>y</optgroup></select>", "y"), ("<select multiple><option>x<option label=w>y</select>z", "x\nw\nz"), ("<div/>a", "a"),
    ("<textarea>a &lt; <b>x</b></textarea> y", "a < <b>x</b> y"), ("<p>q<textarea>open <i>end", "qopen <i>end"),
    ("<select><option></select>a", "a"), ("<datalist><option>x</datalist>a", "a"),
])
def test_layout_of_foreign_and_form_elements(html, want):
    assert text(html) == want


@pytest.mark.parametrize("html,want", [
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"), ("<table><tr><td>a<td rowspan=2>b<td>c<tr><td>d<td>e</table>", "a  b  c\nd     e"),
    ("<table><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d</table>", "a  b\n   c\n   d"), ("<table><tr><td rowspan=2 colspan=2>a<td>x<tr><td>y<tr><td>p<td>q<td>r</table>", "a     x\n      y\np  q  r"),
    ("<table><tr><td colspan=2>a long head<td>x<tr><td>p<td>q<td>r</table>", "a long head  x\np  q         r"), ("<table><tr><td colspan=9>a<tr><td>b<td>c</table>", "a\nb  c"),
    ("<div style='visibility:hidden'>x<b style='visibility: visible'>y</b>z</div>", "y"), ("<div style='display:none'>x<b style='visibility:visible'>y</b></div>z", "z"),
    ("<div hidden style='display:block'>x</div>", "x"), ("<div style='display:none;color:red;display:inline'>x</div>", "x"), ("<ul style='visibility:hidden'><li>a<li style='visibility:visible'>b</ul>", "- b"),
    ("<input type=submit value=Send><input type=hidden value=no> <input value=typed>", "Send typed"), ("<dialog>no</dialog><dialog open>yes</dialog>", "yes"), ("<progress>no</progress>a<ruby>b<rp>(</rp></ruby>", "ab"),
    ("<b><table><tr><td>x</b>y<div>z</table>", "xy\nz"), ("<ul><li>a<p>b</li><li>c</ul>", "- a\n\n  b\n\n- c"),
])
def test_layout_of_spans_and_visibility(html, want):
    assert text(html) == want


def brute_render(node, shown=True):
    """Marks and words of a small tree, from its nested (tag, style, children) tuples."""
    if isinstance(node, str):
        return [("word", node)] if shown else []
    tag, style, children = node
    if "none" in style:
        return []
    shown = "visible" in style or (shown and "hidden" not in style)
    inside = [x for c in children for x in brute_render(c, shown)]
    mark = {"div": [("line",)], "p": [("gap",)], "section": [("line",)], "h2": [("gap",)]}.get(tag, [])
    return [*mark, *inside, *mark]


def brute_layout(marks):
    lines, now, gap = [], [], False
    for m in [*marks, ("line",)]:
        if m[0] == "word":
            if not now and gap and lines:
                lines.append("")
            now.append(m[1])
            gap = False
            continue
        if now:
            lines.append(" ".join(now))
            now = []
        gap = gap or m[0] == "gap"
    return "\n".join(lines)


def test_layout_equals_brute_force_on_random_trees():
    rng = random.Random(12)

    def grow(depth, inline):
        tag = rng.choice(["span", "b"] if inline else ["div", "p", "section", "h2", "span", "b"])
        style = rng.choice(["", "", "", "", "display:none", "visibility:hidden", "visibility:visible"])
        inline = inline or tag in ("p", "h2", "span", "b")
        children = [f"w{rng.randrange(99)}" if depth == 0 or rng.random() < 0.4 else grow(depth - 1, inline) for _ in range(rng.randint(0, 4))]
        return tag, style, children

    def html(node):
        return f" {node} " if isinstance(node, str) else f"<{node[0]} style='{node[1]}'>{''.join(map(html, node[2]))}</{node[0]}>"

    for _ in range(400):
        tree = ("div", "", [grow(3, False) for _ in range(3)])
        assert text(html(tree)) == brute_layout(brute_render(tree))


def test_hostile_markup_takes_linear_time():
    import time

    n = 50_000
    for page in (
        "<b><table><tr><td>" + "<div>" * n + "</b>" * n + "x", "<p><b>" * n + "</p>" * n + "x", "<svg>" + "<g>" * n + "</svg><li>" * n + "x", "<ul>" + "<li><b>" * n + "x",
        "<blockquote>y" * n, "<table><tr><td>y" * 3000, "<table><tr><td>" + "long " * n + "<td>x" + "<tr><td>a<td>b" * 5000, "<table>" + "<tr><td colspan=1000>a<td>b" * 20_000,
        "<table>" + "<tr><td rowspan=9999>a" * 3000,
    ):
        began = time.process_time()
        out = text(page)
        assert time.process_time() - began < 12 and len(out) < 20 * len(page)


def test_deep_and_long_markup():
    assert text("<div>" * 20_000 + "x") == "x"
    assert len(text("<p>word" * 20_000).split()) == 20_000
    assert text("<table>" * 300 + "x") == "x"


def test_extract_text(spark):
    df = spark.createDataFrame([(1, "u", "<p>a"), (1, "u", "<p>a"), (None, None, None)], PAGES).withColumn("text", F.lit("x"))
    out = html_layout.extract_text(df)
    assert out.columns == ["page_id", "url", "text"] and sorted(r["text"] for r in out.collect()) == ["", "a", "a"]
    assert html_layout.extract_text(df.limit(0)).count() == 0


SAMPLES = {
    "en": "the house and the garden that they saw with their own eyes in the morning", "de": "das Haus und der Garten den sie mit eigenen Augen am Morgen sahen",
    "fr": "la maison et le jardin que nous avons vus de nos propres yeux ce matin", "es": "la casa y el jardín que vieron con sus propios ojos por la mañana",
}


def training(spark):
    rng = random.Random(3)
    rows = []
    for lang, t in SAMPLES.items():
        w = t.split()
        rows += [(" ".join(rng.choice(w) for _ in range(30)), lang) for _ in range(30)]
    return spark.createDataFrame([*rows, (None, "en"), ("x", None)], "text string, lang string")


def test_held_out_accuracy_and_fusion(spark):
    rng = random.Random(8)
    rows = []
    for i in range(200):
        lang = list(SAMPLES)[i % 4]
        w = SAMPLES[lang].split()
        rows.append((i, f"http://www.{lang}-site.example.{lang}/p", f"<html lang={lang}><body>" + " ".join(rng.choice(w) for _ in range(12))))
    rows += [(900, "http://www.de-site.example.de/q", "<body>123"), (901, None, "<html lang=fr-CA>42"), (902, "nonsense", None), (None, None, None)]
    model = language_id.fit_text_model(training(spark))
    out = language_id.identify_pages(spark.createDataFrame(rows, PAGES).withColumn("lang", F.lit("x")), model).collect()
    assert len(out) == 204
    got = {r["page_id"]: r for r in out}
    assert sum(got[i]["lang"] == list(SAMPLES)[i % 4] for i in range(200)) >= 198
    assert got[900]["lang"] == "de" and got[901]["lang"] == "fr" and got[901]["declared"] == "fr"
    assert all(r["lang"] in SAMPLES and 0 < r["confidence"] <= 1 for r in out)
    held = spark.createDataFrame([(1, SAMPLES["de"], "a"), (2, SAMPLES["es"], None), (3, None, "a"), (3, "", "a"), (None, "42", "a")], "doc_id long, text string, source string").withColumn("host", F.lit("x"))
    texts = language_id.identify_texts(held, model).collect()
    assert len(texts) == 5 and {r["doc_id"]: r["lang"] for r in texts if r["doc_id"] in (1, 2)} == {1: "de", 2: "es"}


def test_language_of_odd_tables(spark):
    df = spark.createDataFrame([(1, "u", "x")], PAGES)
    assert language_id.identify_pages(df.limit(0), language_id.fit_text_model(training(spark))).count() == 0
    assert language_id.identify_pages(df, language_id.fit_text_model(training(spark).limit(0))).first()["lang"] is None


def test_addresses():
    assert language_id.address("https://user@Blog.Example.FR:8080/x?y") == ("blog.example.fr", "example.fr", "fr")
    assert language_id.address("http://10.0.0.1/x")[2] == "" and language_id.address("no address") == ("", "", "")


def brute_top(vectors, k=20, of=20):
    out = []
    for q, v in vectors:
        if q % of == 0:
            best = sorted((-int(np.dot(v, w)), i) for i, w in vectors if i != q and len(w) == len(v))[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("shard,group", [(8192, 4096), (20, 3)])
def test_top_k_equals_brute_force(spark, shard, group):
    rng = np.random.default_rng(1)
    raw = [(i, [float(x) for x in rng.normal(0, 0.2, 8 if i % 9 else 5)]) for i in range(300)]
    raw += [(300 + i, raw[1][1]) for i in range(60)]  # one vector many times: ties
    raw += [(1000, None), (1001, [1.0, None]), (1002, [float("nan")] * 8), (1003, [float("inf")] * 8), (1020, []), (None, raw[2][1])]
    df = ball_tree.quantise(spark.createDataFrame(raw, "vec_id long, embedding array<double>"))
    got = ball_tree.top_k(df, F.col("id") % 20 == 0, 20, shard, group).collect()
    exact = [(i, np.floor(64 * np.array(v)).astype(np.int64)) for i, v in raw if i is not None and i < 1000]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == brute_top(exact)


def test_top_k_of_odd_tables(spark):
    empty = spark.createDataFrame([], "id long, v array<long>")
    assert ball_tree.top_k(empty, F.col("id") % 20 == 0).count() == 0
    few = spark.createDataFrame([(20, [1, 2]), (3, [3, 4]), (3, [3, 4]), (20, [1, 2])], "id long, v array<long>")
    assert sorted(tuple(r) for r in ball_tree.top_k(few, F.col("id") % 20 == 0, 5).collect()) == [(20, 1, 3, 11), (20, 2, 3, 11)]
    assert ball_tree.top_k(few, F.col("id") == 99, 5).count() == 0
    twice = spark.createDataFrame([(20, [5, 5]), (20, [1, 2]), (20, [9]), (3, [3, 4]), (4, [2])], "id long, v array<long>").repartition(3)
    for df in (twice, twice.orderBy("v")):  # a repeated query id: the shortest vector, then the least
        assert [tuple(r) for r in ball_tree.top_k(df, F.col("id") % 20 == 0, 5).collect()] == [(20, 1, 4, 18)]
    alike = spark.createDataFrame([(20, [1, 2]), *[(7, [3, 4])] * 200], "id long, v array<long>")
    assert ball_tree.top_k(alike, F.col("id") % 20 == 0, 300, 10, 2).count() == 200


def test_cells_are_pruned(spark):
    """Clustered vectors: few are scored, whatever the table's size, and nothing is lost."""
    rng = np.random.default_rng(5)
    shares = []
    for n in (2000, 8000):
        centres = rng.normal(0, 1000, (40, 16))
        x = (centres[np.arange(n) % 40] + rng.normal(0, 10, (n, 16))).astype(np.int64)
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<long>")
        best, waves = ball_tree._top_k(df, F.col("id") % 100 == 0, 20, 100, 4096)
        assert sorted(tuple(r) for r in best.collect()) == [r for r in brute_top(list(enumerate(x)), of=100)]
        shares.append(sum(w.agg(F.sum("scored")).first()[0] or 0 for w in waves) / (n / 100 * n))
    assert max(shares) < 0.2


def test_tree_prunes_what_cannot_matter():
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 1000, (40, 6))
    x = np.concatenate([c + rng.normal(0, 5, (50, 6)) for c in centres]).astype(np.int64)
    tree = ball_tree.build_tree(np.arange(len(x)), x, 25)
    seen, real = [], ball_tree._product
    ball_tree._product = lambda a, b: (seen.append(len(a) * len(b)), real(a, b))[1]
    try:
        ball_tree.search(tree, x[:5], np.arange(5), np.full(5, np.iinfo(np.int64).min), 10)
    finally:
        ball_tree._product = real
    assert sum(seen) < 0.3 * 5 * len(x)
