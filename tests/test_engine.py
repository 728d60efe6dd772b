import collections
import io
import tarfile
import zipfile

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from citeloom.functions import text as T
from citeloom.functions.similarity import token_sort_ratio
from citeloom.operators import alignment, citations, classification, evaluation
from citeloom.sources import archives, tei

TEI = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body>
<div><head n="1.">1. Introduction</head><p>We follow <ref type="bibr" target="#b0">(A, 2001)</ref>. See e.g. this.<ref type="foot" target="#n1">1</ref></p></div>
<div><head n="2.">Methods</head><p>As in <ref type="bibr" target="#b1">(B, 2002)</ref> and <ref type="bibr" target="#b0">(A, 2001)</ref>.</p></div>
<note xml:id="n1"><p>Also <ref type="bibr" target="#b2">(C, 2003)</ref>.</p></note>
</body></text></TEI>"""


def col(spark, f, *values):
    names = [f"c{i}" for i in range(len(values))]
    return spark.createDataFrame([values], ", ".join(f"{n} string" for n in names)).select(f(*[F.col(n) for n in names])).first()[0]


def test_text(spark):
    assert col(spark, T.cleaned, "a  b , c ( d )") == "a b, c (d)"
    assert col(spark, T.sentences, "See e.g. Fig. 2. Then this! Done\nx") == ["See e.g. Fig. 2.", "Then this!", "Done", "x"]
    assert col(spark, T.pointers_replaced, "cit1 and cit12") == "[1] and [12]"
    assert col(spark, T.formulas_protected, "a x = 1 b y = -2.5") == "a FORMULA0 b FORMULA1"
    assert col(spark, lambda c: T.formulas_restored(T.formulas_protected(c), T.formulas(c)), "a x = 1 b y = -2.5") == "a x = 1 b y = -2.5"
    assert str(col(spark, T.publication_date, "2001-02")) == "2001-02-01"
    assert col(spark, T.title_cleaned, "* - Title") == "Title"
    with pytest.raises(ValueError):
        T.context(F.lit("a"), F.lit("b"), "X")


def test_ratio():
    assert token_sort_ratio("b a", "a b") == 100
    assert token_sort_ratio("", "") == 0
    assert abs(token_sort_ratio("abcd", "abxd") - 75) < 1e-9


def test_tei(spark):
    units, refs, errors = tei.shredded(spark.createDataFrame([("d", TEI), ("bad", "<x"), ("none", None)], "doc_id string, xml string"))
    rows = sorted(citations.from_tei(units, refs).collect(), key=lambda r: r.cit_no)
    assert [r.cit_id for r in rows] == ["cit1", "cit2", "cit3", "cit4"]
    assert {(r.SECTION, r.REFERENCE, r.target) for r in rows} == {("Introduction", "(A, 2001)", "b0"), ("Methods", "(B, 2002)", "b1"), ("Methods", "(A, 2001)", "b0"), ("Introduction", "(C, 2003)", "b2")}
    assert errors.count() == 2


def test_alignment(spark):
    rows = [(1, 0, "Results and discussion"), (1, 1, "Introductions"), (1, 2, "Zebra")]
    got = alignment.aligned(spark.createDataFrame(rows, "doc_id int, section_no int, section string")).collect()
    assert {(r.section, r.title) for r in got} == {("Results and discussion", "Results"), ("Results and discussion", "Discussion"), ("Introductions", "Introduction")}


def test_cosine_alignment_of_large_ids(spark, tmp_path):
    """As its SQL, also where a slightly better vector has a far larger id, and with a vector without length."""
    import __spark_entry__

    def at(degrees):
        return [float(np.cos(np.radians(degrees))), float(np.sin(np.radians(degrees)))]

    rows = [(0, at(0), 1), (1, at(30.001), 1), (40001, at(30), 1), (50, at(0), 2), (51, at(40), 2), (52, at(30), 2), (53, at(95), 2), (100, at(0), 3), (101, [0.0, 0.0], 3), (102, at(1), 3)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = con.execute(__spark_entry__.oracle_sql()["cosine_alignment"]).fetchall()
    got = __spark_entry__.queries()["cosine_alignment"](spark, str(tmp_path)).collect()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)
    assert {(r.title, r.section_no) for r in got} == {("0", 1), ("50", 52), ("100", 101)}


def test_metrics(spark):
    p = spark.createDataFrame([("f", 1, 1, "a"), ("f", 2, 2, "a"), ("f", 3, 3, "b")], "file string, id long, seq long, CITATION string")
    t = spark.createDataFrame([("f", 7, 1, "a"), ("f", 8, 2, "c")], "file string, id long, seq long, CITATION string")
    m = evaluation.metrics(evaluation.exact_pairs(p, t, ["CITATION"])).filter("file = 'f'").first()
    assert (m.matches, m.mismatches, m.unmatched_gt, m.precision, m.recall) == (1, 2, 1, 0.3333, 0.5)


def test_classifier(spark):
    df = spark.createDataFrame([([0.95, 0.03, 0.02],), ([0.5, 0.3, 0.2],)], "p array<double>")
    assert [r[0] for r in df.select(classification.label(F.col("p"))).collect()] == ["usesMethodIn (METHOD)", "citesForInformation (UNRELIABLE)"]
    rng = np.random.default_rng(1)
    sizes = [6, 128, 64, 32, 3]
    w = {}
    for i in range(4):
        w[f"module.fc{i + 1}.weight"], w[f"module.fc{i + 1}.bias"] = rng.normal(size=(sizes[i + 1], sizes[i])), rng.normal(size=sizes[i + 1])
    assert np.allclose(classification.MetaClassifier(w)(rng.normal(size=(5, 6))).sum(1), 1)


def test_archives():
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a/b.json", "{}")
    assert list(archives.members("x.zip", z.getvalue())) == [("a/b.json", b"{}")]
    t = io.BytesIO()
    with tarfile.open(fileobj=t, mode="w:gz") as f:
        info = tarfile.TarInfo("../up.json")
        f.addfile(info, io.BytesIO(b""))
    with pytest.raises(ValueError):
        list(archives.members("x.tar.gz", t.getvalue()))


def test_entry_point():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_tei_whole_text(spark, tmp_path):
    import __spark_entry__

    text = " ".join(f"Sentence {i} has some words." for i in range(300)) + " The last one cites"
    rows = [(1, "en", "s", text), (2, "en", "s", "a < b & c\uffff ends"), (3, "en", "s", "")]
    spark.createDataFrame(rows, "doc_id long, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = __spark_entry__.queries()["tei_extraction"](spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.REFERENCE) for r in got} == {(d, ref) for d in "123" for ref in ("(A, 2001)", "(B, 2002)")}
    assert all("The last one cites" in r.CITATION for r in got if r.doc_id == "1")


def test_eval_whole(spark, tmp_path):
    """Documents of all ids are matched; by brute force, sentence for sentence."""
    import __spark_entry__

    rows = [(d, "en" if d % 2 else "fr", "s", f"One of {d}. Two of {d % 5}. Three here. Four of {d}. Five of {d}.") for d in range(1, 14)]
    spark.createDataFrame(rows, "doc_id long, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = __spark_entry__.queries()["eval_exact_match_whole"](spark, str(tmp_path)).collect()
    truth, pred = collections.Counter(), collections.Counter()
    for d, lang, _, text in rows:
        for k, s in enumerate(x.strip(" .") for x in text.split(".") if x.strip(" .")):
            truth[lang, s.lower()] += 1
            pred[lang, s.lower() + (" x" if k % 4 == 0 else "")] += 1
    matches = sum(min(n, pred[k]) for k, n in truth.items())
    assert collections.Counter(r.kind for r in got) == {"match": matches, "unmatched_pred": 65 - matches, "unmatched_gt": 65 - matches}
    total = [r for r in __spark_entry__.queries()["eval_micro_total_whole"](spark, str(tmp_path)).collect() if r.total_gt == 65]
    assert [(r.matches, r.total_pred) for r in total] == [(matches, 65)]


def test_unlabelled_documents(spark, tmp_path):
    import __spark_entry__

    spark.createDataFrame([(d, "en", "s", "t") for d in (1, 2, 3, 4, 5, 5, None)], "doc_id long, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(2,), (3,), (9,)], "doc_id long").write.parquet(f"{tmp_path}/labels.parquet")
    got = __spark_entry__.queries()["unlabelled_documents"](spark, str(tmp_path)).collect()
    assert collections.Counter(r.doc_id for r in got) == {1: 1, 4: 1, 5: 1, None: 1}


def test_citation_entities(spark):
    import __spark_entry__

    run = __spark_entry__.queries()
    edges = run["citation_graph"](spark, "/root/testdata/sf0.001").select("src", "dst").collect()
    entities = run["citation_entities"](spark, "/root/testdata/sf0.001").collect()
    assert {x for r in edges for x in r} <= {r.uri for r in entities}
    assert {"br", "be", "section", "sentence", "rp", "ci"} == {r.kind for r in entities}


def test_section_types(spark):
    rows = [(1, "cit1", "METHODS", "a", "r", "b0"), (1, "cit2", "Zebra", "b", "r", None)]
    from citeloom.operators import graph

    entities, _ = graph.citation_graph(spark.createDataFrame(rows, "doc_id long, cit_id string, SECTION string, CITATION string, REFERENCE string, target string"))
    assert {(r.content, r.type) for r in entities.collect() if r.kind == "section"} == {("METHODS", "Methods"), ("Zebra", None)}


WORKS = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title level="a">Main</title></titleStmt><publicationStmt><date type="published" when="2020-05-04"/></publicationStmt></fileDesc></teiHeader>
<text><back><listBibl><biblStruct xml:id="b0"><analytic><title level="a">One</title><author><forename>A</forename><surname>B</surname></author></analytic>
<monogr><title level="m">Proceedings</title><editor><forename>E</forename><surname>F</surname></editor><imprint><publisher>House</publisher><date type="published" when="2001"/><biblScope unit="page" from="3" to="9"/></imprint></monogr></biblStruct>
<biblStruct xml:id="b1"><monogr><title level="m">A book</title><imprint><biblScope unit="page">12</biblScope></imprint></monogr></biblStruct><biblStruct><monogr><title level="s">Series</title></monogr></biblStruct></listBibl></back></text></TEI>"""


def test_work_graph(spark):
    from citeloom.operators import graph

    works, errors = tei.works(spark.createDataFrame([("d", WORKS), ("bad", "<x"), ("bare", "<x/>"), ("none", None)], "doc_id string, xml string"))
    assert {r.doc_id for r in errors.collect()} == {"bad", "bare", "none"}
    rows = {r.work_no: r for r in works.collect()}
    assert [rows[i].xml_id for i in range(4)] == [None, "b0", "b1", None]
    assert [(p.role, p.given, p.family) for p in rows[1].people] == [("author", "A", "B"), ("editor", "E", "F")]
    entities, edges = graph.work_graph(works)
    found = {r.uri: r for r in entities.collect()}
    edges = {(r.src, r.predicate, r.dst) for r in edges.collect()}
    assert {x for a, _, b in edges for x in (a, b)} <= set(found)
    # both roles are author, as an editor is put down as an author is
    assert collections.Counter((r.kind, r.content) for r in found.values() if r.kind in ("ar", "re", "ra")) == {("ar", "author"): 2, ("ar", "publisher"): 1, ("re", "3-9"): 1, ("re", "12"): 1, ("ra", "A B"): 1, ("ra", "E F"): 1, ("ra", "House"): 1}
    part_of = {(found[a].content, found[b].content) for a, p, b in edges if p == "partOf"}
    assert part_of == {("One", "Proceedings")}  # a book and a series without a title of their own are the works themselves
    assert {(r.kind, r.content, r.published) for r in found.values() if r.kind in ("br", "series")} == {("br", "Main", "2020-05-04"), ("br", "One", "2001-01-01"), ("br", "Proceedings", None), ("br", "A book", None), ("series", "Series", None)}
    assert sum(p == "part" for _, p, _ in edges) == 3
    # a pointer's target is the entry of that name
    cites = spark.createDataFrame([("d", "cit1", "S", "t", "r", "b1")], "doc_id string, cit_id string, SECTION string, CITATION string, REFERENCE string, target string")
    cited = [r.dst for r in graph.citation_graph(cites)[1].collect() if r.predicate == "cites"]
    assert [found[u].content for u in cited] == ["A book"]


def test_work_graph_of_nothing(spark):
    from citeloom.operators import graph

    entities, edges = graph.work_graph(tei.works(spark.createDataFrame([], "doc_id string, xml string"))[0])
    assert entities.count() == edges.count() == 0
