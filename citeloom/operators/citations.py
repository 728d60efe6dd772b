"""From texts to citation contexts: sentences, sections, pointers, renumbering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions import fixed
from citeloom.functions import text as T
from citeloom.operators.corpus import abbreviated


def sentences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with sent_no and sentence in place of the text; blank sentences are left out but keep their numbers."""
    rest = [c for c in docs.columns if c != text]
    out = docs.select(*rest, F.posexplode(T.sentences(F.col(text))).alias("sent_no", "sentence"))
    return out.withColumn("sent_no", F.col("sent_no").cast("long")).filter(F.trim("sentence") != "")


def blocks(docs: DataFrame) -> DataFrame:
    """The lines of a text with their places (P1 on plain text)."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("block_no", "block")).withColumn("block_no", F.col("block_no").cast("long"))


def leading_pointers_moved(sents: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A run of pointers at a sentence's start goes to the sentence before, if that ends in a full stop."""
    w = Window.partitionBy(*keys).orderBy("sent_no")
    run = F.regexp_extract("sentence", r"^((?:cit\d+\s*)+)", 1)
    out = sents.withColumn("__move", (run != "") & F.coalesce(F.lag("sentence").over(w).endswith("."), F.lit(False)))
    out = out.withColumn("__taken", F.when(F.lead("__move").over(w), F.lead(F.trim(run)).over(w)))
    own = F.when(F.col("__move"), F.regexp_replace("sentence", r"^(?:cit\d+\s*)+", "")).otherwise(F.col("sentence"))
    return out.withColumn("sentence", F.concat_ws(" ", own, "__taken")).drop("__move", "__taken")


def superscript_documents(refs: DataFrame) -> DataFrame:
    """doc_id, superscript: more than half of the pointers are numbers, but for marks around them, and more than a fifth
    follow a full stop (F3)."""
    number = F.regexp_replace("ref_text", "[^a-zA-Z0-9]", "").rlike("^[0-9]+$")
    return refs.groupBy("doc_id").agg(
        ((F.count_if(number) > F.count("*") / 2) & (F.count_if("after_stop") > F.count("*") / 5)).alias("superscript")
    )


def forward_filled(units: DataFrame, order: str = "unit_no") -> DataFrame:
    """Units (doc_id, order, selected title or null, has_head) with their section (W1); headless ones before any title
    count as "Section Untitled n" (W2)."""
    w = Window.partitionBy("doc_id").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    named = units.withColumn("__n", F.sum(F.when(~F.col("has_head"), 1).otherwise(0)).over(w))
    own = F.when(~F.col("has_head"), F.concat(F.lit("Section Untitled "), F.col("__n").cast("string"))).otherwise(F.col("title"))
    return named.withColumn("__own", own).withColumn("section", F.last("__own", ignorenulls=True).over(w)).drop("__n", "__own")


def headings_selected(heads: DataFrame, order: str = "unit_no") -> DataFrame:
    """heads (doc_id, order, head, n) with selected and title.

    Where at least half of the heads carry a number attribute, those with a top-level number are sections, and a head
    without one between two numbered ones isn't; else all are. Roman numbers go from the titles like others.
    """
    per_doc = Window.partitionBy("doc_id")
    w = Window.partitionBy("doc_id").orderBy(order)
    out = heads.withColumn("__n", F.col("n").isNotNull())
    half = F.count("*").over(per_doc) / 2
    out = out.withColumn("__by_n", F.sum(F.col("__n").cast("int")).over(per_doc) >= half)
    between = F.coalesce(F.lag("__n").over(w), F.lit(False)) & F.coalesce(F.lead("__n").over(w), F.lit(False))
    chosen = F.when(F.col("__by_n"), F.when(F.col("__n"), F.col("n").rlike(r"^\d+\.?$")).otherwise(~between)).otherwise(F.lit(True))
    out = out.withColumn("selected", chosen & F.col("head").isNotNull())
    return out.withColumn("title", F.when(F.col("selected"), T.title_cleaned(T.numbering_dropped(F.col("head"))))).drop("__n", "__by_n")


def contexts(sents: DataFrame, refs: DataFrame, kind: str = "text") -> DataFrame:
    """A row for each pointer in a sentence (J1): sents (doc_id, seq, section, sentence) and refs (doc_id, citkey, ref_text, target)."""
    hits = sents.filter(F.contains("sentence", F.lit("cit"))).withColumn("citkey", F.explode(T.pointers(F.col("sentence"))))
    return hits.join(refs, ["doc_id", "citkey"])


def last_value_first_place(rows: DataFrame, keys: list[str], seq: str, value: str) -> DataFrame:
    """A key's last value at the place of its first row, as repeated writes to an ordered map leave it."""
    return rows.groupBy(*keys).agg(F.max_by(value, seq).alias(value), F.min(seq).alias("first_seq"))


def renumbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """cit_no 1.. and cit_id in order of first appearance."""
    w = Window.partitionBy("doc_id").orderBy(*order)
    return rows.withColumn("cit_no", F.row_number().over(w).cast("long")).withColumn("cit_id", F.concat(F.lit("cit"), F.col("cit_no").cast("string")))


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key (A9, W7): a least value each, so that copies are merged before they are moved."""
    rest = [c for c in rows.columns if c not in (*keys, *order)]
    least = rows.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("__least"))
    return least.select(*[F.col(c) if c in keys else F.col(f"__least.{c}") for c in rows.columns])


def superscripts_moved(sents: DataFrame, refs: DataFrame) -> DataFrame:
    """Sentences (doc_id, part, unit_no, sent_no, sentence) of articles whose pointers are superscript numbers, with pointers
    that follow a full stop put back into the sentence they belong to (F3, F4)."""
    w = Window.partitionBy("doc_id", "part", "unit_no").orderBy("sent_no")
    lead = F.regexp_extract("sentence", r"^((?:cit\d+\s*)+)", 1)
    before = F.lag("sentence").over(w)
    stop = before.endswith(".") & ~abbreviated(before, fixed.ABBREVIATIONS)
    after = sents.withColumn("__stop", F.coalesce(stop, F.lit(False))).filter("__stop").select("doc_id", F.explode(T.pointers(lead)).alias("citkey")).distinct()
    marked = refs.join(after.withColumn("after_stop", F.lit(True)), ["doc_id", "citkey"], "left").withColumn("after_stop", F.coalesce("after_stop", F.lit(False)))
    some = superscript_documents(marked).filter("superscript").select("doc_id", F.lit(True).alias("__super"))
    out = sents.join(some, "doc_id", "left")
    moved = leading_pointers_moved(out.filter("__super").drop("__super"), ("doc_id", "part", "unit_no"))
    return out.filter("__super IS NULL").drop("__super").unionByName(moved)


def from_tei(units: DataFrame, refs: DataFrame) -> DataFrame:
    """Citation records (doc_id, cit_no, cit_id, SECTION, CITATION, REFERENCE, target) of shredded articles (sources.tei)."""
    heads = units.filter("kind = 'div'")
    chosen = headings_selected(heads.filter("head IS NOT NULL").select("doc_id", "unit_no", "head", "n"))
    divs = heads.join(chosen.select("doc_id", "unit_no", "title"), ["doc_id", "unit_no"], "left").withColumn("has_head", F.col("head").isNotNull())
    divs = forward_filled(divs).select("doc_id", "unit_no", "text", "section", "notes")
    note_text = units.filter("kind = 'note'").select("doc_id", F.col("name").alias("note"), F.col("text").alias("text"))
    of_notes = divs.select("doc_id", "unit_no", "section", F.explode("notes").alias("note")).join(note_text, ["doc_id", "note"])
    figures = units.filter("kind = 'figure'").select("doc_id", "unit_no", "text", F.lit("Figure Caption").alias("section"))
    parts = divs.select("doc_id", F.lit(0).alias("part"), "unit_no", "section", "text")
    parts = parts.unionByName(of_notes.select("doc_id", F.lit(1).alias("part"), "unit_no", "section", "text")).unionByName(figures.select("doc_id", F.lit(2).alias("part"), "unit_no", "section", "text"))
    safe = parts.withColumn("text", T.cleaned(F.col("text"))).withColumn("formulas", T.formulas(F.col("text"))).withColumn("text", T.formulas_protected(F.col("text")))
    found = sentences(safe).withColumn("sentence", F.trim(T.formulas_restored(F.col("sentence"), F.col("formulas")))).drop("formulas")
    found = superscripts_moved(found, refs)
    seq = F.struct("part", "unit_no", "sent_no")
    hits = contexts(found.withColumn("seq", seq), refs)
    known = refs.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("citkey", "ref_text"))).alias("names"))
    hits = hits.join(known, "doc_id")
    cut = F.split(F.regexp_replace("sentence", r"\bcit\d+\b", T.HELD), T.HELD, -1)
    keys = T.pointers(F.col("sentence"))
    shown = F.array_join(F.transform(cut, lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.coalesce(F.element_at("names", F.get(keys, i - 1)), F.lit("")), x))), "")
    rows = hits.withColumn("CITATION", shown)
    one = rows.groupBy("doc_id", "citkey", "ref_no").agg(F.max_by(F.struct("section", "CITATION", "ref_text", "target"), "seq").alias("v"), F.min("seq").alias("first_seq"))
    out = renumbered(one, ["first_seq", "ref_no"])
    return out.select("doc_id", "cit_no", "cit_id", F.col("v.section").alias("SECTION"), F.col("v.CITATION").alias("CITATION"), F.col("v.ref_text").alias("REFERENCE"), F.col("v.target").alias("target"))
