"""Journal articles in JATS to the TEI that sources.tei shreds: one rewrite of each tree, in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tei import TEI, XML_ID

MATH = "{http://www.w3.org/1998/Math/MathML}"
HREF = "{http://www.w3.org/1999/xlink}href"
NUMBERED = re.compile(r"^([0-9]+(?:\.[0-9]+)*\.?)(.*)$", re.S)
FLAT = ("italic", "bold", "sup", "sub", "underline", "strike", "sc", "thead", "tbody")
FORMULAS = {"inline-formula": "inline", "disp-formula": "display"}
REF_TYPES = {"table": "table", "bibr": "bibr", "fig": "figure"}


class Node:
    """An element under construction, to which text and children are appended in order."""

    def __init__(self, tag: str, **attributes: str | None):
        self.made = ET.Element(TEI + tag, {k: v for k, v in attributes.items() if v is not None})

    def say(self, text: str | None) -> None:
        if not text:
            return
        if len(self.made):
            self.made[-1].tail = (self.made[-1].tail or "") + text
        else:
            self.made.text = (self.made.text or "") + text

    def add(self, child: Node) -> Node:
        self.made.append(child.made)
        return child


def _squeezed(el: ET.Element | None) -> str:
    return " ".join("".join(el.itertext()).split()) if el is not None else ""


def _inside(el: ET.Element, to: Node, skip: tuple[str, ...] = ()) -> None:
    """The content of an element, without children of the given names."""
    to.say(el.text)
    for child in el:
        if child.tag not in skip:
            _put(child, to)
        to.say(child.tail)


def _put(el: ET.Element, to: Node) -> None:
    """One element, by its rule; mathematics without prefix; others as they are."""
    rule = RULES.get(el.tag)
    if rule:
        rule(el, to)
    elif isinstance(el.tag, str):
        own = {k: v for k, v in el.attrib.items() if k != "overflow"} if el.tag.startswith(MATH) else dict(el.attrib)
        node = Node(el.tag.rpartition("}")[2])
        node.made.attrib.update(own)
        _inside(el, to.add(node))


def _section(el: ET.Element, to: Node) -> None:
    kind = el.get("sec-type")
    div = to.add(Node("div", type="availability" if kind == "data-availability" else kind))
    title = el.find("title")
    if title is not None:
        text = _squeezed(title)
        number = NUMBERED.match(text)
        div.add(Node("head", n=number[1]) if number else Node("head")).say(number[2].strip() if number else text)
    _inside(el, div, ("title",))


def _acknowledgement(el: ET.Element, to: Node) -> None:
    div = to.add(Node("div", type="acknowledgement"))
    if el.find("title") is not None:
        div.add(Node("head")).say(_squeezed(el.find("title")))
    _inside(el, div, ("title",))


def _paragraph(el: ET.Element, to: Node) -> None:
    """Split at its formulas, so that no text stands twice; parts without text or children are left out."""
    parts = [Node("p")]
    parts[0].say(el.text)
    for child in el:
        if child.tag in FORMULAS:
            parts += [_formula_of(child), Node("p")]
        else:
            _put(child, parts[-1])
        parts[-1].say(child.tail)
    for part in parts:
        if len(parts) == 1 or len(part.made) or (part.made.text or "").strip() or part.made.tag == f"{TEI}formula":
            to.add(part)


def _formula_of(el: ET.Element) -> Node:
    out = Node("formula", type=FORMULAS[el.tag], id=el.get("id"))
    for math in el.iter(f"{MATH}math"):
        _put(math, out)
    return out


def _pointer(el: ET.Element, to: Node) -> None:
    kind, target = el.get("ref-type") or "", el.get("rid") or ""
    kind = "foot" if kind == "other" and target.startswith("FN") else REF_TYPES.get(kind, kind)
    _inside(el, to.add(Node("ref", type=kind, target=f"#{target}")))


def _item(el: ET.Element, to: Node) -> None:
    item = to.add(Node("item"))
    label = el.find("label")
    item.say(("".join(label.itertext()) if label is not None else "") + " ")
    for p in el.findall("p"):
        _put(p, item)


def _row(el: ET.Element, to: Node, role: str | None = None) -> None:
    row = to.add(Node("row", role=role))
    for cell in el:
        if cell.tag in ("th", "td"):
            spans = {k: v for k in ("rowspan", "colspan") if (v := cell.get(k, "")).isdigit() and int(v) > 1}
            _inside(cell, row.add(Node("cell", **spans)))


def _table(el: ET.Element, to: Node) -> None:
    table = to.add(Node("table"))
    for part in el:
        if part.tag in ("thead", "tbody"):
            for row in part.findall("tr"):
                _row(row, table, "label" if part.tag == "thead" else None)


def _figure(el: ET.Element, to: Node, kind: str | None = None) -> None:
    out = to.add(Node("figure", type=kind))
    if el.get("id"):
        out.made.set(XML_ID, el.get("id"))
    label = "".join(el.find("label").itertext()) if el.find("label") is not None else ""
    out.add(Node("head")).say(" ".join(label.split()))
    out.add(Node("label")).say(re.sub(r"^[^0-9]*([0-9]+).*$", r"\1", label))
    caption = el.find("caption")
    out.add(Node("figDesc")).say("".join(caption.itertext()) if caption is not None else "")
    for graphic in el.findall("graphic") if kind is None else ():
        out.add(Node("graphic", url=graphic.get(HREF), orientation=graphic.get("orientation"), position=graphic.get("position")))
    for table in el.findall("table") if kind else ():
        _table(table, out)
    for p in el.findall("table-wrap-foot/fn/p") if kind else ():
        note = out.add(Node("note"))
        if p.get("id"):
            note.made.set(XML_ID, p.get("id"))
        _inside(p, note)


def _notes(group: ET.Element, to: Node) -> None:
    """Foot notes: one a note of several; one a marked paragraph of a single note; one of a single marked note; else one a
    marked paragraph of the group."""
    notes = group.findall("fn")
    marked = [p for p in (notes[0] if len(notes) == 1 else group).findall("p") if p.get("id")]

    def note(name: str | None) -> Node:
        out = to.add(Node("note", type="foot"))
        if name:
            out.made.set(XML_ID, name)
        return out

    if len(notes) > 1 or (len(notes) == 1 and len(marked) < 2 and notes[0].get("id")):
        for fn in notes:
            own = note(fn.get("id") or next((p.get("id") for p in fn.findall("p") if p.get("id")), None))
            for p in fn.findall("p"):
                _put(p, own)
        return
    if len(notes) == 1 and len(marked) < 2:
        marked = [p for p in group.findall("p") if p.get("id")]
    for p in marked:
        _inside(p, note(p.get("id")).add(Node("p")))


def _list(el: ET.Element, to: Node) -> None:
    _inside(el, to.add(Node("list")))


def _link(el: ET.Element, to: Node) -> None:
    _inside(el, to.add(Node("ref", type="external", target=el.get(HREF))))


RULES: dict[str, Callable[[ET.Element, Node], None]] = {
    "sec": _section, "ack": _acknowledgement, "p": _paragraph, "xref": _pointer, "ext-link": _link, "list": _list, "list-item": _item,
    "fig": lambda el, to: None, "table-wrap": lambda el, to: None, "table": _table, "tr": _row, "break": lambda el, to: to.say(" "),
    **{tag: _inside for tag in FLAT}, **{tag: lambda el, to: to.made.append(_formula_of(el).made) for tag in FORMULAS},
}


def to_tei(xml: str) -> str:
    """The article as TEI: sections and their like first, then figures, tables and foot notes; availability and thanks at the back."""
    article = ET.fromstring(xml)
    root = Node("TEI")
    text = root.add(Node("text"))
    body, back = text.add(Node("body")), text.add(Node("back"))
    source = article.find("body")
    if source is not None:
        for el in source:
            _put(el, body)
        for el in source.iter("fig"):
            _figure(el, body)
        for el in source.iter("table-wrap"):
            _figure(el, body, "table")
    end = article.find("back")
    if end is not None:
        for group in end.iter("fn-group"):
            if not group.attrib:
                _notes(group, body)
        for el in end.iter("sec"):
            if el.get("sec-type") == "data-availability":
                _section(el, back)
        for el in end.iter("ack"):
            _acknowledgement(el, back)
    return ET.tostring(root.made, encoding="unicode", default_namespace=None)


def repaired(xml: str) -> str:
    """TEI with single blanks in its texts and without elements that have neither text, attributes nor children."""
    root = ET.fromstring(xml)

    def tidy(el: ET.Element) -> None:
        for child in list(el):
            tidy(child)
            child.tail = re.sub(r"\s+", " ", child.tail) if child.tail else child.tail
            if not len(child) and not (child.text or "").strip() and not child.attrib:
                at = list(el).index(child)
                if child.tail and at:
                    el[at - 1].tail = (el[at - 1].tail or "") + child.tail
                elif child.tail:
                    el.text = (el.text or "") + child.tail
                el.remove(child)
        el.text = re.sub(r"\s+", " ", el.text) if el.text else el.text

    tidy(root)
    return ET.tostring(root, encoding="unicode")


def converted(articles: DataFrame, change: Callable[[str], str] = to_tei) -> DataFrame:
    """doc_id, xml, error of articles (doc_id, xml); an article that can't be read has an error instead."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for doc_id, xml in zip(pdf["doc_id"], pdf["xml"]):
                try:
                    out.append((doc_id, change(xml), None))
                except (ET.ParseError, TypeError, RecursionError) as e:
                    out.append((doc_id, None, str(e)))
            yield pd.DataFrame(out, columns=["doc_id", "xml", "error"])

    return articles.select(F.col("doc_id").cast("string").alias("doc_id"), "xml").mapInPandas(run, "doc_id string, xml string, error string")


def article_keys(articles: DataFrame) -> DataFrame:
    """doc_id, doi, folder (the DOI with _ for /), pdf (the self-uri of the PDF), peer_review (has a reviewer's report) of JATS articles."""
    doi = F.expr("xpath_string(xml, '//article-meta/article-id[@pub-id-type=\"doi\"]')")
    pdf = F.expr("xpath_string(xml, '//article-meta/self-uri[@content-type=\"pdf\"]/@*[local-name()=\"href\"]')")
    report = F.expr("xpath_boolean(xml, '//sub-article[@article-type=\"reviewer-report\"]')")
    none = lambda c: F.when(c != "", c)
    return articles.select("doc_id", none(doi).alias("doi"), none(F.translate(doi, "/", "_")).alias("folder"), none(pdf).alias("pdf"), report.alias("peer_review"))
