"""Documents to chunks: one per headed section, long sections cut at the best break; new chunks only."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CHUNK_CHARS = 3000
_HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")
#: From the best place to cut to the worst; what still does not fit is cut hard.
_BREAKS = [re.compile(p) for p in (r"\n[ \t]*\n", r"\n", r"(?<=[.!?])\s", r"\s")]


def sections(text: str) -> list[tuple[list[str], int, int]]:
    """(heading path, start, end): each section runs from its heading line to the next heading."""
    found, path, start, at, fence = [], [], 0, 0, ""
    for line in text.splitlines(keepends=True) if "\r" not in text else re.findall(r"[^\n]*\n|[^\n]+", text):
        body = line.rstrip("\r\n")
        mark = _FENCE.match(body)
        if mark:
            if not fence:
                fence = mark[1]
            elif mark[1].startswith(fence):
                fence = ""
        elif not fence and (head := _HEADING.fullmatch(body)):
            found.append(([h for _, h in path], start, at))
            depth = len(head[1])
            path = [p for p in path if p[0] < depth] + [(depth, (head[2] or "").strip())]
            start = at
        at += len(line)
    found.append(([h for _, h in path], start, len(text)))
    return [s for s in found if text[s[1] : s[2]].strip()]


def cut(text: str, start: int, end: int, limit: int = CHUNK_CHARS, level: int = 0) -> list[tuple[int, int]]:
    """Spans of at most ``limit`` characters without blank edge lines; neighbours are packed while they fit."""
    body = text[start:end]
    start, end = start + re.match(r"(?:[^\S\n]*\n)*", body).end(), start + len(body.rstrip())
    if start >= end:
        return []
    if end - start <= limit:
        return [(start, end)]
    if level == len(_BREAKS):
        return [(a, min(a + limit, end)) for a in range(start, end, limit)]
    ends = [m.end() for m in _BREAKS[level].finditer(text, start, end)] + [end]
    out, a, b = [], start, start
    for e in ends:
        if b > a and len(text[a:e].rstrip()) > limit:
            out += cut(text, a, b, limit, level + 1)
            a = b
        b = e
    return out + cut(text, a, b, limit, level + 1)


def chunk_hash(path: list[str], text: str, tag: bytes = b"chunk v1\0") -> str:
    """SHA-256 of the tag, the number of headings, and each part after its byte length."""
    parts = [p.encode() for p in (*path, text)]
    lengths = [len(p).to_bytes(8, "little") for p in parts]
    body = b"".join(n + p for n, p in zip(lengths, parts, strict=True))
    return hashlib.sha256(tag + len(path).to_bytes(8, "little") + body).hexdigest()


def chunk_documents(docs: DataFrame, limit: int = CHUNK_CHARS) -> DataFrame:
    """(doc_id, position, heading_path, start, end, text, chunk_hash); offsets in characters, null text has no chunks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                spans = [(p, a, b) for p, s, e in sections(text) for a, b in cut(text, s, e, limit)]
                rows += [(doc_id, k, p, a, b, text[a:b], chunk_hash(p, text[a:b])) for k, (p, a, b) in enumerate(spans)]
            yield pd.DataFrame(rows, columns=["doc_id", "position", "heading_path", "start", "end", "text", "chunk_hash"])

    schema = "doc_id long, position int, heading_path array<string>, start int, end int, text string, chunk_hash string"
    return docs.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL").mapInPandas(run, schema)


def new_chunks(chunks: DataFrame) -> DataFrame:
    """Add ``outcome`` to (document, version, chunk_hash): skipped where an earlier version of the document had the chunk."""
    first = F.min("version").over(W.partitionBy("document", "chunk_hash"))
    return chunks.withColumn("outcome", F.when(first < F.col("version"), "skipped").otherwise("queued"))
