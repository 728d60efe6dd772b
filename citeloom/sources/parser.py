"""A remote parser as a source: files go out in Arrow batches through a transport that the caller gives, answers come back as rows."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.operators import corpus

#: fixed values: the parser's services, and the form fields of its options
SERVICES = ("processFulltextDocument", "processHeaderDocument", "processReferences", "processCitationList")
FIELDS = {
    "generate_ids": "generateIDs", "consolidate_header": "consolidateHeader", "consolidate_citations": "consolidateCitations",
    "include_raw_citations": "includeRawCitations", "include_raw_affiliations": "includeRawAffiliations", "segment_sentences": "segmentSentences",
}

#: (service, name, content, form) -> (status, text); TimeoutError if there is no answer in time
Transport = Callable[[str, str, bytes, dict[str, str]], tuple[int, str]]


def form(**options: bool) -> dict[str, str]:
    """The form fields of the options that are on."""
    unknown = set(options) - set(FIELDS)
    if unknown:
        raise ValueError(f"unknown option: {min(unknown)}")
    return {FIELDS[k]: "1" for k, v in options.items() if v}


def called(transport: Transport, service: str, name: str, content: bytes, fields: dict[str, str], tries: int = 5, wait: float = 1.0) -> tuple[int, str | None]:
    """One file's answer: a busy parser (503) is asked again after growing waits, `tries` times; 408 for no answer in time."""
    for turn in range(tries):
        try:
            status, text = transport(service, name, content, fields)
        except TimeoutError:
            return 408, None
        if status != 503:
            return status, text if status == 200 else None
        if turn + 1 < tries:
            time.sleep(wait * 2**turn)
    return 503, None


def parsed(files: DataFrame, transport: Transport, service: str = SERVICES[0], done: DataFrame | None = None, force: bool = False, n: int = 10, tries: int = 5, wait: float = 1.0, **options: bool) -> DataFrame:
    """name, status, text of files (name, content), n at a time, without those that are done (name) unless forced."""
    if service not in SERVICES:
        raise ValueError(f"service must be one of {', '.join(SERVICES)}")
    fields = form(**options)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [(name, *called(transport, service, name, bytes(content), fields, tries, wait)) for name, content in zip(pdf["name"], pdf["content"])]
            yield pd.DataFrame(rows, columns=["name", "status", "text"])

    todo = files if done is None else corpus.pending(files, done, force=force)
    return todo.select("name", "content").repartition(n).mapInPandas(run, "name string, status int, text string")


def output_name(name):
    """a.pdf as a.tei.xml."""
    return F.concat(F.regexp_replace(name, r"(?i)\.(pdf|xml|txt)$", ""), F.lit(".tei.xml"))
