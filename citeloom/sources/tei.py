"""TEI articles to units and references: one pass over each tree, in document order."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TEI = "{http://www.tei-c.org/ns/1.0}"
XML_ID = "{http://www.w3.org/XML/1998/namespace}id"
FOOT = {"foot", "footnote", "endnote", "end"}
SCHEMA = "doc_id string, kind string, unit_no long, name string, head string, n string, text string, notes array<string>, target string, error string"


def _flat(node: ET.Element, keys: dict[ET.Element, str]) -> str:
    """Text of a node; citation pointers give their key, formulas a mark, other pointers their text."""
    out = [node.text or ""]
    for child in node:
        tag = child.tag.removeprefix(TEI)
        if child in keys:
            out.append(f" {keys[child]} ")
        elif tag == "formula":
            out.append("[formula]")
        else:
            out.append(_flat(child, keys))
        out.append(child.tail or "")
    return "".join(out)


def shred(xml: str) -> list[tuple]:
    """(kind, unit_no, name, head, n, text, notes, target): references, sections, notes and figures that cite."""
    root = ET.fromstring(xml)
    text = root.find(f"{TEI}text")
    if text is None:
        return []
    pick = lambda path: [r for p in text.iterfind(path) for r in p.iter(f"{TEI}ref") if r.get("type") == "bibr"]
    keys: dict[ET.Element, str] = {}
    for i, ref in enumerate([*pick(f".//{TEI}p"), *pick(f".//{TEI}note"), *pick(f".//{TEI}figure")], 1):
        keys[ref] = f"cit{i}"  # a pointer in several lists keeps its last number
    rows = [("ref", int(k[3:]), k, None, None, "".join(r.itertext()).strip(), None, (r.get("target") or "").removeprefix("#") or None) for r, k in keys.items()]
    notes = {n.get(XML_ID): n for n in text.iter(f"{TEI}note") if n.get(XML_ID) and any(r in keys for r in n.iter())}
    for i, div in enumerate(text.iter(f"{TEI}div")):
        head = div.find(f"{TEI}head")
        paragraphs = list(div.iter(f"{TEI}p"))
        own = [t for p in paragraphs for r in p.iter(f"{TEI}ref") if r.get("type") in FOOT and (t := (r.get("target") or "").removeprefix("#")) in notes]
        title = "".join(head.itertext()).strip() or None if head is not None else None
        rows.append(("div", i, None, title, head.get("n") if head is not None else None, " ".join(_flat(p, keys) for p in paragraphs), list(dict.fromkeys(own)), None))
    rows += [("note", i, name, None, None, _flat(n, keys), None, None) for i, (name, n) in enumerate(notes.items())]
    for i, figure in enumerate(f for f in text.iter(f"{TEI}figure") if any(r in keys for r in f.iter())):
        parts = [*figure.iter(f"{TEI}figDesc"), *figure.iter(f"{TEI}note")]
        rows.append(("figure", i, None, None, None, " ".join(_flat(x, keys) for x in parts), None, None))
    return rows


def shredded(tei: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """units, refs and errors of articles (doc_id, xml)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for doc_id, xml in zip(pdf["doc_id"], pdf["xml"]):
                try:
                    out += [(doc_id, *row, None) for row in shred(xml)]
                except (ET.ParseError, TypeError) as e:
                    out.append((doc_id, "error", None, None, None, None, None, None, None, str(e)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    rows = tei.select("doc_id", "xml").mapInPandas(run, SCHEMA)
    units = rows.filter(F.col("kind").isin("div", "note", "figure")).drop("error", "target")
    refs = rows.filter("kind = 'ref'").select("doc_id", F.col("name").alias("citkey"), F.col("unit_no").alias("ref_no"), F.col("text").alias("ref_text"), "target")
    return units, refs, rows.filter("kind = 'error'").select("doc_id", "error")


WORKS = (
    "doc_id string, work_no long, xml_id string, title string, journal string, series string, monograph string, date string, volume string, issue string, page_from string, "
    "page_to string, page string, doi string, arxiv string, issn array<string>, publisher string, people array<struct<role:string,given:string,family:string,orcid:string>>, error string"
)


def bibliography(xml: str) -> list[tuple]:
    """The main work (work_no 0, from fileDesc), then each entry of a list, as rows of WORKS without doc_id and error
    (P14-P19, G1, G3). Of elements that repeat the first counts, with the text before its first child; people and ISSNs are all kept."""
    root = ET.fromstring(xml)
    main = next(root.iter(f"{TEI}fileDesc"), None)
    if main is None:
        raise ValueError("no fileDesc")

    def work(no: int, node: ET.Element) -> tuple:
        all_of = lambda path: node.findall(path.replace("t:", TEI))
        def text(path: str) -> str | None:
            found = all_of(path)
            return (found[0].text or "").strip() or None if found else None

        own = ".//t:titleStmt//t:title" if no == 0 else ".//t:title"
        dates = all_of(".//t:publicationStmt/t:date[@type='published']" if no == 0 else ".//t:monogr//t:date[@type='published']")
        page = next(iter(all_of(".//t:biblScope[@unit='page']")), None)
        name = lambda x, tag: next(((e.text or "").strip() or None for e in x.iter(TEI + tag)), None)
        orcid = lambda x: next(((e.text or "").strip() or None for e in x.iter(f"{TEI}idno") if e.get("type") == "ORCID"), None)
        people = [("author", name(x, "forename"), name(x, "surname"), orcid(x)) for x in all_of(".//t:author")]
        people += [("editor", name(x, "forename"), name(x, "surname"), None) for x in all_of(".//t:monogr//t:editor")]
        issn = [e.text.strip() for kind in ("ISSN", "eISSN") for e in all_of(f".//t:monogr/t:idno[@type='{kind}']") if e.text]
        return (
            no, node.get(XML_ID) if no else None, text(f"{own}[@level='a']"), *[text(f".//t:monogr/t:title[@level='{x}']") for x in "jsm"], next((d.get("when") for d in dates if d.get("when")), None),
            text(".//t:biblScope[@unit='volume']"), text(".//t:biblScope[@unit='issue']"), *((page.get("from"), page.get("to"), (page.text or "").strip() or None) if page is not None else (None,) * 3),
            text(".//t:idno[@type='DOI']"), text(".//t:idno[@type='arXiv']"), issn, text(".//t:publicationStmt/t:publisher" if no == 0 else ".//t:monogr//t:publisher"), people,
        )

    listed = dict.fromkeys(b for lst in root.iter(f"{TEI}listBibl") for b in lst.iter(f"{TEI}biblStruct"))
    return [work(no, node) for no, node in enumerate([main, *listed])]


def works(tei: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The works that articles (doc_id, xml) are and list, and errors; an article that can't be read gives one error."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in re.split(r", (?=\w+ )", WORKS)]
        for pdf in parts:
            out = []
            for doc_id, xml in zip(pdf["doc_id"], pdf["xml"]):
                try:
                    out += [(doc_id, *row, None) for row in bibliography(xml)]
                except (ET.ParseError, TypeError, ValueError) as e:
                    out.append((doc_id, *[None] * (len(names) - 2), str(e)))
            got = pd.DataFrame(out, columns=names)
            got["people"] = [[dict(zip(("role", "given", "family", "orcid"), x)) for x in people] if people is not None else None for people in got["people"]]
            got["work_no"] = got["work_no"].astype("Int64")
            yield got

    rows = tei.select(F.col("doc_id").cast("string").alias("doc_id"), "xml").mapInPandas(run, WORKS)
    return rows.filter("error IS NULL").drop("error"), rows.filter("error IS NOT NULL").select("doc_id", "error")
