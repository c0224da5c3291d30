import pytest
from pyspark.sql import functions as F

from gleanery.operators import extract, recognition
from gleanery.sources import readers, writers


def tables(spark, html):
    return extract.scan_tables(spark.createDataFrame([("p", html)], "page_id string, html string"))


def problem(spark, html, **limits):
    return extract.validate_tables(tables(spark, html), **limits).first()["problem"]


def records(spark, html):
    got = extract.extract_tables(spark.createDataFrame([("p", html)], "page_id string, html string"))
    return [r.record for r in got.orderBy("table_idx", "row_idx").collect()]


def test_plain_table(spark):
    html = "<table><tr><th>a</th><th>b&amp;c</th></tr><tr><td>1</td><td> x\n y </td></tr><tr><td>2</td><td></td></tr></table>"
    assert records(spark, html) == [{"a": "1", "b&c": "x y"}, {"a": "2", "b&c": None}]


def test_unclosed_cells_and_rows(spark):
    html = "<p>t<table><thead><tr><th>a<th>b<tbody><tr><td>1<td>2<tr><td>3<td>4</table>after"
    assert records(spark, html) == [{"a": "1", "b": "2"}, {"a": "3", "b": "4"}]


def test_no_header_numbers_the_columns(spark):
    assert records(spark, "<table><tr><td>x<td>y</table>") == [{"0": "x", "1": "y"}]


def test_spans_are_written_out(spark):
    html = "<table><tr><th>a<th>b<th>c<tr><td rowspan=2>1<td colspan=2>2<tr><td>3<td>4</table>"
    assert records(spark, html) == [{"a": "1", "b": "2", "c": "2"}, {"a": "1", "b": "3", "c": "4"}]


def test_nested_table_is_its_own(spark):
    html = "<table><tr><th>o<tr><td>x<table><tr><th>i<tr><td>y</table></td></tr><tr><td>z</table>"
    assert records(spark, html) == [{"o": "xiy"}, {"o": "z"}, {"i": "y"}]


def test_script_and_comment_are_no_text(spark):
    html = "<!-- <table> --><table><tr><th>a<tr><td><script>var t='</td><td>';</script>1</table>"
    assert records(spark, html) == [{"a": "1"}]


@pytest.mark.parametrize(
    "html, why",
    [
        ("<table><tr><th>a<th>a<tr><td>1<td>2</table>", "duplicate column names"),
        ("<table><tr><th>a<th>b<tr><td>1<td><tr><td>2<td></table>", "empty columns"),
        ("<table><tr><th>a<tr><td>1<tr><td>x</table>", "mixed data types"),
        ("<table><tr><th>a</table>", "too few rows"),
        ("<table></table>", "too few rows"),
        ("<table><tr><th>a<tr><td>1<tr><td>2</table>", None),
    ],
)
def test_table_problems(spark, html, why):
    assert problem(spark, html) == why


def test_row_limit(spark):
    assert problem(spark, "<table><tr><th>a<tr><td>1<tr><td>2</table>", max_rows=1) == "too many rows"


def test_bad_table_is_skipped_and_page_goes_on(spark):
    assert records(spark, "<table><tr><th>a</table><table><tr><th>b<tr><td>1</table>") == [{"b": "1"}]


def test_pages_without_tables(spark):
    pages = spark.createDataFrame([("1", "<p>x"), ("2", None), ("3", "<table><tr><td>1</table>")], "page_id string, html string")
    assert sorted(r.page_id for r in extract.pages_without_tables(extract.scan_tables(pages)).collect()) == ["1", "2"]


def test_selectors(spark):
    html = """<title>T &amp; U</title><div class="main-content big">a<b>b</b><p>one<p>two<br>2<ul><li>x<li>y<ul><li>z</ul></ul></div><i id=k>v</i>"""
    pages = spark.createDataFrame([(1, html)], "page_id int, html string")
    rows = extract.extract_selectors(pages, {"t": "title", "p": "p", "li": "li", "main": ".main-content", "k": "#k"}).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r.match_idx):
        got.setdefault(r.name, []).append(r.value)
    assert got == {"t": ["T & U"], "p": ["one", "two2"], "li": ["x", "yz", "z"], "main": ["abonetwo2xyz"], "k": ["v"]}


def test_selectors_must_be_given(spark):
    pages = spark.createDataFrame([(1, "x")], "page_id int, html string")
    for bad in ({}, {"a": "."}, {"a": ""}):
        with pytest.raises(ValueError):
            extract.extract_selectors(pages, bad)


WORDS = "doc_id string, word_idx int, text string, conf double, left int, top int, width int, height int"


def test_plain_markup_needs_no_rare_path(monkeypatch):
    """Plain pages do without the standard parser's costly steps; any other page reads as it does."""
    plain = '<!doctype html><title>a &amp; b</title><!-- c --><table class="x"><tr><th colspan="2">n<tr><td>1 &lt; 2<td><b>y</b><br/></table>'
    odd = ["<p>a < b<b>c", "<td class=x>1", "<script>if (a < '</b>') 1</script><p>x", "<!-- a -- b --><p>x", "<plaintext><p>x", "<textarea><p>x</textarea><p>y", "<a href=\"1\"href='2'>z</a>"]
    selectors = {"p": "p", "b": "b", "t": "title", "cell": "td", "area": "textarea", "a": "a"}
    both = lambda page: (extract._tables_of("1", page), extract._matches_of("1", page, selectors))
    pages = [plain, *odd, *[plain + o + plain for o in odd]]
    quick = [both(p) for p in pages]
    calls = []
    step = extract._Tables.parse_starttag
    monkeypatch.setattr(extract._Tables, "parse_starttag", lambda self, i: calls.append(i) or step(self, i))
    assert extract._tables_of("1", plain) == quick[0][0] and not calls
    monkeypatch.setattr(extract._Tree, "_plain", lambda self, html: 0)
    assert [both(p) for p in pages] == quick and calls


def word(doc, i, text, conf):
    return (doc, i, text, float(conf), i, 0, 5, 5)


def test_assemble_text(spark):
    rows = [word("a", 1, "world", 90), word("a", 0, "hello", 80), word("a", 2, "", -1), word("b", 0, "", -1), word("c", 0, "x", 85)]
    got = {r.doc_id: r for r in recognition.assemble_text(spark.createDataFrame(rows, WORDS)).collect()}
    assert got["a"].text == "hello world " and got["a"].confidence == 0.85 and got["a"].word_count == 2
    assert got["b"].confidence == 0.0 and got["b"].word_count == 0
    assert [b[0] for b in got["a"].boxes] == [0, 1, 2]


def test_long_documents_come_in_parts(spark):
    rows = [word("a", i, str(i), 50 + i) for i in range(25)]
    got = recognition.assemble_text(spark.createDataFrame(rows, WORDS), part_words=10).orderBy("part").collect()
    assert " ".join(r.text for r in got) == " ".join(map(str, range(25)))
    assert {(r.confidence, r.word_count) for r in got} == {(0.62, 25)} and len(got) == 3


def test_words_meet_no_join_and_are_shuffled_as_runs(spark):
    rows = [word(d, i, f"{d}{i}", 90) for d in "ab" for i in range(50)] + [word("a", None, None, 90), word(None, 1, "y", 90), word(None, 0, "x", -1)]
    words = spark.createDataFrame(rows, WORDS).coalesce(1)
    got = recognition.assemble_text(words, part_words=20)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    keyed = words.select("doc_id", F.floor(F.col("word_idx") / 20).alias("part"), *recognition.WORD)
    assert recognition._runs(keyed).count() == 8
    mixed = recognition.assemble_text(spark.createDataFrame(rows[::-1], WORDS).repartition(5, "word_idx"), part_words=20)
    order = ["doc_id", "part"]
    assert got.orderBy(*order).collect() == mixed.orderBy(*order).collect()
    texts = {(r.doc_id, r.part): r.text for r in got.collect()}
    assert texts[None, 0] == "x y" and texts["a", 0] == " " + " ".join(f"a{i}" for i in range(20))


def test_a_long_document_is_judged_as_a_whole(spark, monkeypatch):
    """Noise in the tail alone does not cost the tail."""
    from gleanery.plans import journeys

    monkeypatch.setattr(recognition.assemble_text, "__defaults__", ("doc_id", 10))
    rows = [word("a", i, "clean words" if i < 20 else "?#?", 95) for i in range(25)] + [word("b", None, "alone", 95), word(None, 0, "nobody", 95)]
    got = journeys.recognise(spark.createDataFrame(rows, WORDS), "txt").collect()
    assert sorted(r.part for r in got if r.doc_id == "a") == [0, 1, 2]
    assert {r.body for r in got if r.doc_id != "a"} == {"alone", "nobody"}


def test_assemble_table(spark):
    cells = [("d", 0, [x * 50, y * 20, 50, 20], 0.9) for x in range(3) for y in range(2)] + [("e", 0, [0, 0, 1, 1], 1.0)]
    df = spark.createDataFrame(cells, "doc_id string, table_idx int, coordinates array<int>, confidence double")
    got = {r.doc_id: r for r in recognition.assemble_table(df).collect()}
    assert (got["d"].rows, got["d"].columns, got["d"].cells) == (2, 3, 6)
    assert not got["e"].valid


def test_table_cells_are_not_multiplied(spark):
    cells = [("d", [0, 0], 0.9), ("d", [0, 1], 1.0), ("d", [0, 1], 1.0), ("d", [None, 2], 0.8), (None, [3, None], 0.5), ("e", None, None)]
    got = recognition.assemble_table(spark.createDataFrame(cells, "doc_id string, coordinates array<int>, confidence double"), ("doc_id",))
    assert "Expand" not in got._jdf.queryExecution().executedPlan().toString()
    rows = {r.doc_id: r[1:] for r in got.collect()}
    assert rows == {"d": (3, 1, 4, 0.925, True), None: (0, 1, 1, 0.5, False), "e": (0, 0, 1, None, False)}


def test_unknown_output_format(spark):
    with pytest.raises(ValueError):
        recognition.format_ocr(spark.range(1), "xml")


def test_unknown_type_is_an_error_row(spark):
    df = spark.createDataFrame([("text", 1), ("form", 2), (None, 3)], "kind string, id int")
    out = extract.route_by_type(df, "kind", {"text": lambda d: d.select("id", F.lit("ok").alias("result"))}).collect()
    assert {r.id: r.error for r in out} == {1: None, 2: "Invalid type: form", 3: "Invalid type: null"}


def test_sidecars(spark, tmp_path):
    root = str(tmp_path / "objects")
    df = spark.createDataFrame([("a.bin", b"12", {"content_type": "x/y"}), ("sub/b.bin", b"3", {"n": "1"})], "name string, body binary, meta map<string,string>")
    assert writers.write_with_sidecar(df, "file://" + root, "name", "body", "meta") == 2
    (tmp_path / "objects" / "lonely.bin").write_bytes(b"1")
    (tmp_path / "objects" / "bad.bin").write_bytes(b"1")
    (tmp_path / "objects" / "bad.bin.meta").write_text("{oops")
    (tmp_path / "objects" / ".hidden").write_bytes(b"1")
    got = {r.name: (r.size_bytes, r.content_type) for r in readers.read_with_sidecar(spark, root).collect()}
    assert got == {"a.bin": (2, "x/y"), "sub/b.bin": (1, "application/octet-stream")}
    names = [r.name for r in readers.list_objects(spark, root, suffixes=[".BIN"], max_results=2).collect()]
    assert names == ["a.bin", "bad.bin"]
    assert readers.list_objects(spark, root, prefix="sub/", suffixes=[".bin"]).count() == 1
    with pytest.raises(ValueError):
        readers.list_batch(spark, root, [".bin"], max_files=3)


@pytest.mark.parametrize("markup", ["<b>x", "<td>x", "<li><b>x", "<table><tr><td>x", "<p><i>x"])
def test_open_elements_cost_linear_time(markup):
    """Four times the unclosed elements take about four times as long, not sixteen."""
    import time

    from gleanery.operators import extract

    def seconds(n):
        html = "<div class=q>" + markup * n
        best = 1e9
        for _ in range(3):
            start = time.perf_counter()
            extract._matches_of("p", html, {"all": ".q", "none": "h1"})
            extract._Tables().run(html)
            best = min(best, time.perf_counter() - start)
        return best

    assert seconds(8000) < 9 * seconds(2000)


def test_links_of_bad_markup(spark):
    from gleanery.operators import extract, registry

    html = "<p><a class=x href='/a?b&amp;c'>one<a href=two>2<td></a><script>'<a href=no>'</script><A HREF=\"\">"
    df = spark.createDataFrame([(1, html), (2, None), (3, ""), (None, "<a>x</a><a href=z")], "page_id long, html string")
    registry.register_table_function(spark, "links_of", extract.PageLinks, "page_id long, target string")
    df.createOrReplaceTempView("bad_pages")
    got = [tuple(r) for r in spark.sql("SELECT * FROM links_of(TABLE(SELECT page_id, html FROM bad_pages))").collect()]
    assert got == [(1, "/a?b&c"), (1, "two"), (1, "")]
