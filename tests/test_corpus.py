"""Article conversion, parser client, sinks, corpus tools and the one call."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from citeloom.operators import citations, corpus, evaluation, graph
from citeloom.run import run
from citeloom.sources import jats, parser, sinks, tei

BODY = '<article xmlns:m="http://www.w3.org/1998/Math/MathML" xmlns:xlink="http://www.w3.org/1999/xlink"><body>{}</body><back>{}</back></article>'


def tags(xml: str, body: str = "", back: str = "") -> str:
    out = jats.to_tei(BODY.format(body, back))
    return out.replace("ns0:", "").replace(' xmlns:ns0="http://www.tei-c.org/ns/1.0"', "")


def notes(back: str) -> int:
    return jats.to_tei(BODY.format("", f"<fn-group>{back}</fn-group>")).count(":note ")


def test_foot_notes():
    assert notes('<fn id="a"><p>x</p></fn>') == 1
    assert notes('<fn id="a"><p>x</p></fn><fn><p id="b">y</p></fn>') == 2
    assert notes('<fn><p id="a">x</p><p id="b">y</p><p id="c">z</p></fn>') == 3
    assert notes('<p id="a">x</p><p id="b">y</p>') == 2
    assert notes('<fn id="k"><p>x</p><p id="a">y</p></fn>') == 1
    assert notes("<p>x</p>") == 0
    assert jats.to_tei(BODY.format("", '<fn-group content-type="x"><fn id="a"><p>x</p></fn></fn-group>')).count("note") == 0


def test_sections():
    out = tags("", '<sec sec-type="methods"><title>2.1 Some <italic>title</italic></title><p>a<break/>b <xref ref-type="fig" rid="F1">1</xref></p></sec><sec><title>Plain</title></sec>', '<sec sec-type="data-availability"><title>Data</title></sec><ack><title>Thanks</title><p>all</p></ack>')
    assert '<div type="methods"><head n="2.1">Some title</head><p>a b <ref type="figure" target="#F1">1</ref></p></div>' in out
    assert "<div><head>Plain</head></div>" in out
    assert '<back><div type="availability"><head>Data</head></div><div type="acknowledgement"><head>Thanks</head><p>all</p></div></back>' in out


def test_formulas_split_paragraphs_once():
    out = tags("", '<p>before <inline-formula id="e"><m:math overflow="x" display="y"><m:mi>z</m:mi></m:math></inline-formula> between <disp-formula/> after</p>')
    assert out.count("between") == out.count("after") == out.count("before") == 1
    assert '<formula type="inline" id="e"><math display="y"><mi>z</mi></math></formula>' in out


def test_figures_tables_lists():
    table = '<table-wrap id="t"><label>Table 2</label><caption><title>Sums</title></caption><table><thead><tr><th colspan="2">h</th></tr></thead><tbody><tr><td rowspan="1">a</td></tr></tbody></table><table-wrap-foot><fn><p id="n">foot</p></fn></table-wrap-foot></table-wrap>'
    out = tags("", f'<sec>{table}<fig id="f"><label>Fig. 7b</label><caption><p>See</p></caption><graphic xlink:href="u.png"/></fig><list><list-item><label>1</label><p>x</p></list-item></list></sec>')
    assert out.index("Fig. 7b") < out.index("Table 2") and "<label>7</label>" in out and '<graphic url="u.png" />' in out
    assert '<row role="label"><cell colspan="2">h</cell></row><row><cell>a</cell></row>' in out and ">foot</note>" in out
    assert "<item>1 <p>x</p></item>" in out


def test_converted_and_repaired(spark):
    rows = spark.createDataFrame([("a", BODY.format("<p>x</p>", "")), ("b", "<broken"), ("c", None)], "doc_id string, xml string")
    got = {r.doc_id: r for r in jats.converted(rows).collect()}
    assert got["a"].error is None and got["b"].error and got["c"].error
    assert jats.repaired("<a>x \n y<b/> z<c k='1'/></a>") == '<a>x y z<c k="1" /></a>'


def test_superscripts(spark):
    text = "".join(f'Known fact {i}.<ref type="bibr" target="#b{i}">[{i}]</ref> More text {i}. ' for i in range(4))
    xml = f'<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body><div><head>Intro</head><p>{text}</p></div></body></text></TEI>'
    units, refs, _ = tei.shredded(spark.createDataFrame([("a", xml)], "doc_id string, xml string"))
    got = sorted(r.CITATION for r in citations.from_tei(units, refs).collect())
    assert got == [f"Known fact {i}. [{i}]" for i in range(4)]


def test_roman_headings_are_all_kept(spark):
    rows = [(1, i, h, None) for i, h in enumerate(["I. Introduction", "II. Methods", "Acknowledgements"])]
    got = citations.headings_selected(spark.createDataFrame(rows, "doc_id long, unit_no long, head string, n string")).orderBy("unit_no").collect()
    assert [r.title for r in got] == ["Introduction", "Methods", "Acknowledgements"]


def test_page_correction_wants_similar_contexts(spark):
    schema = "file string, id string, seq long, REFERENCE string, CITATION string, SECTION string"
    pred = spark.createDataFrame([("f", "p1", 1, "Smith 2001, p. 4", "alpha beta", "x"), ("f", "p2", 2, "Jones 2002, p. 4", "gamma delta", "x")], schema)
    truth = spark.createDataFrame([("f", "g1", 1, "Smith 2001", "totally different words", "x"), ("f", "g2", 2, "Jones 2002", "delta gamma", "y")], schema)
    assert [(r.pred_id, r.gt_id) for r in evaluation.page_corrected(pred, truth).collect()] == [("p2", "g2")]
    assert evaluation.page_corrected(pred, truth, section_threshold=70.0).count() == 0


def test_corpus_tools(spark):
    assert corpus.sorted_pdfs(["b.PDF", "a.pdf"]) == ["a.pdf", "b.PDF"]
    for wrong in (["a.txt"], []):
        with pytest.raises(ValueError):
            corpus.sorted_pdfs(wrong)
    assert [tuple(r) for r in corpus.inline_pairs(spark, "[['s', 'c'], ('', 'd')]").orderBy("pos").collect()] == [(0, "s", "c"), (1, "", "d")]
    with pytest.raises(ValueError):
        corpus.inline_pairs(spark, "[1]")
    with pytest.raises(Exception, match="invalid entry"):
        corpus.strict(spark.createDataFrame([("a", "bad")], "k string, error string")).collect()
    with pytest.raises(Exception, match="no original"):
        corpus.with_results(spark.createDataFrame([(1, "a")], "cit_id int, x string"), spark.createDataFrame([(2, "b")], "cit_id int, y string")).collect()
    done, all_ = spark.createDataFrame([("a",)], "name string"), spark.createDataFrame([("a",), ("b",)], "name string")
    assert [r.name for r in corpus.pending(all_, done).collect()] == ["b"] and corpus.pending(all_, done, force=True).count() == 2


def test_parser_client(spark):
    def transport(service, name, content, fields):
        if name == "slow":
            raise TimeoutError
        return (503, "") if name == "busy" else (200, f"{service} {content.decode()} {sorted(fields)}")

    files = spark.createDataFrame([(n, bytearray(b"x")) for n in ("a.pdf", "slow", "busy", "old")], "name string, content binary")
    done = spark.createDataFrame([("old",)], "name string")
    got = {r.name: (r.status, r.text) for r in parser.parsed(files, transport, done=done, tries=2, wait=0.0, generate_ids=True).collect()}
    assert got == {"a.pdf": (200, "processFulltextDocument x ['generateIDs']"), "slow": (408, None), "busy": (503, None)}
    with pytest.raises(ValueError):
        parser.parsed(files, transport, service="other")


def test_sinks(spark):
    cites = spark.createDataFrame([("d", i, f"cit{i}", "Methods", f"c{i}", "r", "b0" if i != 2 else None) for i in range(1, 12)], "doc_id string, cit_no long, cit_id string, SECTION string, CITATION string, REFERENCE string, target string")
    assert list(json.loads(sinks.target_json(cites).first().json)) == [f"cit{i}" for i in range(1, 12) if i != 2]
    aligned = spark.createDataFrame([("d", "Methods", "Materials"), ("d", "Methods", "Methods")], "doc_id string, section string, title string")
    assert json.loads(sinks.aligned_json(cites, aligned).first().json)["cit11"]["ALIGNED SECTION"] == ["Materials", "Methods"]
    files = spark.createDataFrame([("b", "z.json", bytearray(b"1")), ("b", "a/y.json", bytearray(b"2"))], "bundle string, rel_path string, content binary")
    with zipfile.ZipFile(io.BytesIO(bytes(sinks.bundled(files).first().zip))) as z:
        assert z.namelist() == ["a/y.json", "z.json"] and z.read("z.json") == b"1"
    edges = spark.createDataFrame([("br/1", "cites", "br/2"), ("br/1", "cites", "br/3"), ("rp/1", "denotes", "be/1")], "src string, predicate string, dst string")
    assert "<https://example.org/rp/1> <http://purl.org/spar/c4o/denotes> <https://example.org/be/1> ." in [r.value for r in graph.n_triples(edges).collect()]
    ld = [json.loads(r.value) for r in graph.json_ld(edges).collect()]
    assert {"@id": "https://example.org/br/1", "http://purl.org/spar/cito/cites": [{"@id": "https://example.org/br/2"}, {"@id": "https://example.org/br/3"}]} in ld


def test_run(spark, tmp_path):
    xml = '<article><body><sec><title>1. Methods</title><p>We cite <xref ref-type="bibr" rid="B1">A</xref> here.</p></sec></body></article>'
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.xml").write_text(xml)
    (tmp_path / "in" / "b.xml").write_text("<broken")
    (tmp_path / "in" / "c.txt").write_text("x")
    cites, listing = run(spark, str(tmp_path / "in"), str(tmp_path / "out"), kind="jats", align=True)
    assert [(r.SECTION, r.CITATION, r.REFERENCE, r.target) for r in cites.collect()] == [("Methods", "We cite A here.", "A", "B1")]
    assert sorted((r.filename[-5:], r.status) for r in listing.collect()) == [("a.xml", "success"), ("b.xml", "error"), ("c.txt", "error")]
    text = spark.read.parquet(f"{tmp_path}/out/citations").first().json
    assert json.loads(text)["cit1"]["CITATION"] == "We cite A here."
    assert spark.read.json(f"{tmp_path}/out/manifest").count() == 3
    with pytest.raises(ValueError):
        run(spark, "x", kind="pdf")
