"""Bibliographic entities and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions.text import page_range, publication_date, rhetorical_type, uri


def container_edges(works: DataFrame, work: Column, issue: Column, volume: Column, journal: Column) -> DataFrame:
    """child, parent of article - issue - volume - journal, without the levels that are missing."""
    chain = F.filter(F.array(work, issue, volume, journal), lambda x: x.isNotNull())
    steps = F.transform(F.sequence(F.lit(1), F.size(chain) - 1), lambda i: F.struct(F.get(chain, i - 1).alias("child"), F.get(chain, i).alias("parent")))
    return works.select(chain.alias("c"), steps.alias("s")).filter(F.size("c") > 1).select(F.explode("s").alias("e")).select("e.*").distinct()


def citation_graph(cites: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and edges of citation records (doc_id, cit_id, SECTION, CITATION, REFERENCE, target).

    One pointer and one citation for each record; sections and sentences once a document; the relation of a document to
    a cited work once a pair (A10).
    """
    doc = uri("br", F.col("doc_id"))
    # names of columns don't differ by case alone: "section" would replace SECTION
    rows = cites.withColumns({
        "main": doc, "be": F.when(F.col("target").isNotNull(), uri("be", F.col("doc_id"), F.col("target"))), "cited": F.when(F.col("target").isNotNull(), uri("br", F.col("doc_id"), F.col("target"))),
        "part": F.when(F.col("SECTION").isNotNull(), uri("de/section", F.col("doc_id"), F.col("SECTION"))), "sent": uri("de/sentence", F.col("doc_id"), F.col("CITATION")),
        "rp": uri("rp", F.col("doc_id"), F.col("cit_id")), "ci": uri("ci", F.col("doc_id"), F.col("cit_id")),
    })

    none = F.lit(None).cast("string")
    kinds = (("br", "main", none), ("br", "cited", none), ("be", "be", F.col("target")), ("section", "part", F.col("SECTION")), ("sentence", "sent", F.col("CITATION")), ("rp", "rp", F.col("REFERENCE")), ("ci", "ci", F.col("cit_id")))
    entities = F.array(*[F.struct(F.col(name).alias("uri"), F.lit(kind).alias("kind"), content.alias("content")) for kind, name, content in kinds])
    links = (("main", "cites", "cited"), ("be", "references", "cited"), ("part", "contains", "sent"), ("sent", "isContextOf", "rp"), ("rp", "denotes", "be"), ("ci", "hasCitingEntity", "main"), ("ci", "hasCitedEntity", "cited"))
    edges = F.array(*[F.struct(F.col(a).alias("src"), F.lit(p).alias("predicate"), F.col(b).alias("dst")) for a, p, b in links])
    entities = rows.select("doc_id", F.explode(entities).alias("x")).select("doc_id", "x.*").filter("uri IS NOT NULL").distinct()
    edges = rows.select("doc_id", F.explode(edges).alias("x")).select("doc_id", "x.*").filter("src IS NOT NULL AND dst IS NOT NULL").distinct()
    return entities.withColumn("type", F.when(F.col("kind") == "section", rhetorical_type(F.col("content")))), edges


def work_graph(works: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities (doc_id, uri, kind, content) and edges (doc_id, src, predicate, dst) of works (sources.tei.works).

    A listed work has the names that citation_graph gives to pointers' targets (J4), by its xml:id, or else its number. A work
    in a journal is an article, part of issue, volume and journal as far as they are there; one in a series or monograph is
    part of that, but a listed one without a title of its own is itself the series or monograph. An editor is put down as an
    author is, and each person is an agent of the work's own. No shuffle but that of the distinct.
    """
    doc, no = F.col("doc_id"), F.col("work_no").cast("string")
    main = F.col("work_no") == 0
    key = F.coalesce("xml_id", F.concat(F.lit("#"), no))
    own = F.when(main, uri("br", doc)).otherwise(uri("br", doc, key))
    outer = lambda kind, there: F.when(there, uri(f"br/{kind}", doc, no))
    has = lambda c: F.col(c).isNotNull()
    alone = ~main & ~has("title")
    series, monograph = has("series") & ~has("journal"), has("monograph") & ~has("journal") & ~has("series")
    rows = works.withColumns({
        "__work": own, "__be": F.when(~main, uri("be", doc, key)), "__main": uri("br", doc),
        "__issue": outer("issue", has("journal") & has("issue")), "__volume": outer("volume", has("journal") & has("volume")), "__journal": outer("journal", has("journal")),
        "__series": outer("series", series & ~alone), "__monograph": outer("monograph", monograph & ~alone),
        "__kind": F.when(has("journal"), "article").when(series & alone, "series").otherwise("br"),
        "__name": F.when(series & alone, F.col("series")).when(monograph & alone, F.col("monograph")).otherwise(F.col("title")),
        "__pages": page_range(F.col("page_from"), F.coalesce("page_to", "page_from"), F.col("page")), "__date": publication_date(F.col("date")).cast("string"),
    })
    rows = rows.withColumns({"__re": F.when(F.col("__pages").isNotNull(), uri("re", doc, no)), "__steps": F.array_compact(F.array("__work", "__issue", "__volume", "__journal", "__series", "__monograph"))})

    publisher = F.when(has("publisher"), F.array(F.struct(F.lit("publisher").alias("role"), F.col("publisher").alias("name"), F.lit(None).cast("string").alias("orcid"))))
    full = lambda p: F.when(p["given"].isNotNull() & p["family"].isNotNull(), F.concat_ws(" ", p["given"], p["family"])).otherwise(F.coalesce(p["given"], p["family"]))
    people = F.transform("people", lambda p: F.struct(F.lit("author").alias("role"), full(p).alias("name"), p["orcid"].alias("orcid")))
    agents = F.concat(F.coalesce(people, F.array().cast("array<struct<role:string,name:string,orcid:string>>")), F.coalesce(publisher, F.array().cast("array<struct<role:string,name:string,orcid:string>>")))
    rows = rows.withColumn("__agents", F.transform(agents, lambda a, i: F.struct(
        uri("ar", doc, no, i).alias("ar"), uri("ra", doc, no, i).alias("ra"), F.when(a["orcid"].isNotNull(), uri("id", F.lit("orcid"), a["orcid"])).alias("id"), a["role"].alias("role"), a["name"].alias("name"), a["orcid"].alias("orcid"))))
    rows = rows.withColumn("__ids", F.filter(F.concat(
        F.array(F.struct(F.col("__work").alias("of"), F.lit("doi").alias("kind"), F.col("doi").alias("value")), F.struct(F.col("__work").alias("of"), F.lit("arxiv").alias("kind"), F.col("arxiv").alias("value")), F.struct(F.col("__be").alias("of"), F.lit("xmlid").alias("kind"), F.when(~main, F.col("xml_id")).alias("value"))),
        F.transform(F.coalesce("issn", F.array().cast("array<string>")), lambda x: F.struct(F.col("__journal").alias("of"), F.lit("issn").alias("kind"), x.alias("value"))),
    ), lambda x: x["of"].isNotNull() & x["value"].isNotNull()))
    id_uri = lambda x: F.when(x["kind"] == "xmlid", uri("id", doc, x["value"])).otherwise(uri("id", x["kind"], x["value"]))

    entity = lambda u, kind, content: F.struct(u.alias("uri"), kind.alias("kind"), content.alias("content"))
    named = (("__be", "be", F.col("xml_id")), ("__issue", "issue", F.col("issue")), ("__volume", "volume", F.col("volume")), ("__journal", "journal", F.col("journal")), ("__series", "series", F.col("series")), ("__monograph", "br", F.col("monograph")), ("__re", "re", F.col("__pages")))
    entities = F.concat(
        F.array(entity(F.col("__work"), F.col("__kind"), F.col("__name")), *[entity(F.col(c), F.lit(kind), content) for c, kind, content in named]),
        F.transform("__agents", lambda a: entity(a["ar"], F.lit("ar"), a["role"])), F.transform("__agents", lambda a: entity(a["ra"], F.lit("ra"), a["name"])),
        F.transform("__agents", lambda a: entity(a["id"], F.lit("id"), F.concat(F.lit("orcid:"), a["orcid"]))), F.transform("__ids", lambda x: entity(id_uri(x), F.lit("id"), F.concat(x["kind"], F.lit(":"), x["value"]))),
    )
    edge = lambda a, p, b: F.struct(a.alias("src"), F.lit(p).alias("predicate"), b.alias("dst"))
    listed = F.when(~main, F.col("__main"))
    edges = F.concat(
        F.array(edge(F.col("__be"), "references", F.col("__work")), edge(listed, "part", F.col("__be")), edge(F.col("__work"), "embodiment", F.col("__re"))),
        F.transform("__steps", lambda x, i: edge(x, "partOf", F.get(F.col("__steps"), i + 1))),
        F.transform("__agents", lambda a: edge(F.col("__work"), "isDocumentContextFor", a["ar"])), F.transform("__agents", lambda a: edge(a["ar"], "isHeldBy", a["ra"])),
        F.transform("__agents", lambda a: edge(a["ra"], "hasIdentifier", a["id"])), F.transform("__ids", lambda x: edge(x["of"], "hasIdentifier", id_uri(x))),
    )
    exploded = lambda c: rows.select("doc_id", "work_no", "__date", F.explode(c).alias("x"))
    dated = F.when(F.col("x.uri").startswith("br/") & F.col("x.kind").isin("article", "br", "series") & ~F.col("x.uri").rlike("^br/[a-z]+/"), F.col("__date"))
    found = exploded(entities).select("doc_id", "x.*", dated.alias("published")).filter("uri IS NOT NULL").distinct()
    return found, exploded(edges).select("doc_id", "x.*").filter("src IS NOT NULL AND dst IS NOT NULL").distinct()


#: fixed values: the vocabulary of each predicate
VOCABULARY = {
    "cites": "http://purl.org/spar/cito/", "hasCitingEntity": "http://purl.org/spar/cito/", "hasCitedEntity": "http://purl.org/spar/cito/",
    "references": "http://purl.org/spar/biro/", "isContextOf": "http://purl.org/spar/c4o/", "denotes": "http://purl.org/spar/c4o/",
    "part": "http://purl.org/vocab/frbr/core#", "partOf": "http://purl.org/vocab/frbr/core#", "embodiment": "http://purl.org/vocab/frbr/core#",
    "hasIdentifier": "http://purl.org/spar/datacite/", "isDocumentContextFor": "http://purl.org/spar/pro/", "isHeldBy": "http://purl.org/spar/pro/",
    "contains": "http://www.essepuntato.it/2008/12/pattern#",
}


def predicate_name(predicate: Column) -> Column:
    """A predicate in its own vocabulary."""
    names = F.create_map(*[F.lit(x) for name, base in VOCABULARY.items() for x in (name, base + name)])
    return F.element_at(names, predicate)


def n_triples(edges: DataFrame, base: str = "https://example.org/") -> DataFrame:
    """value: one N-Triples line for each edge (K5)."""
    return edges.select(F.concat(F.lit(f"<{base}"), "src", F.lit("> <"), predicate_name(F.col("predicate")), F.lit(f"> <{base}"), "dst", F.lit("> .")).alias("value"))


def json_ld(edges: DataFrame, base: str = "https://example.org/") -> DataFrame:
    """value: one JSON-LD object for each subject and predicate, targets in order (K5)."""
    to = F.array_sort(F.collect_set(F.concat(F.lit(base), "dst")))
    rows = edges.groupBy("src", "predicate").agg(F.transform(to, lambda x: F.create_map(F.lit("@id"), x)).alias("to"))
    subject = F.to_json(F.struct(F.concat(F.lit(base), "src").alias("@id")))
    return rows.select(F.concat(F.regexp_replace(subject, r"\}$", ""), F.lit(',"'), predicate_name(F.col("predicate")), F.lit('":'), F.to_json("to"), F.lit("}")).alias("value"))
