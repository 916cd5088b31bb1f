"""Parent and child chunks of HTML pages, made in one pass over each page."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions import html, text
from spindrift.sources.store import PART_BYTES, parts_of

_TOKEN = regex.compile(text.TOKEN)
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def count(value: str) -> int:
    return len(_TOKEN.findall(value))


def slug(value: str) -> str:
    return re.sub(r"[\s_]+", "-", re.sub(r"[^\w\s-]", "", value.lower().strip()))


@dataclass(frozen=True)
class Limits:
    """Tokens of children and parents.  Blocks shorter than least_chars characters are no content."""

    child_least: int = 150
    child_most: int = 350
    parent_most: int = 900
    part_most: int = 1200
    least_chars: int = 20


def packed(parts: list[str], most: int) -> list[tuple[str, int]]:
    """Parts in order, joined by a blank, to texts of at most ``most`` tokens: the sum over the parts."""
    out: list[tuple[list[str], int]] = []
    for part in parts:
        n = count(part)
        if out and out[-1][1] + n <= most:
            out[-1][0].append(part)
            out[-1] = (out[-1][0], out[-1][1] + n)
        else:
            out.append(([part], n))
    return [(" ".join(own), n) for own, n in out]


SCHEMA = "kind string, chunk_id string, parent_id string, url string, content string, tokens int, headings array<string>, section_id string, part string, code string"


def _id(url: str, headings: list[str], part: str) -> str:
    return hashlib.sha256(f"{url}||{' > '.join(headings) or 'root'}::{part}".encode()).hexdigest()[:16]


def _children(blocks: list[tuple[str, str]], limits: Limits) -> list[tuple[str, int]]:
    """Child texts of a parent: code and tables stand alone; short texts wait for company, long ones are cut at sentences."""
    out: list[tuple[str, int]] = []
    waiting: list[tuple[str, int]] = []

    def flush() -> None:
        if waiting and sum(n for _, n in waiting) >= limits.child_least // 2:
            out.append(("\n\n".join(t for t, _ in waiting), sum(n for _, n in waiting)))
        waiting.clear()

    for kind, value in blocks:
        n = count(value)
        if kind in ("code", "table"):
            flush()
            out.append((value, n))
        elif n > limits.child_most:
            flush()
            out.extend(packed(_SENTENCE.split(value), limits.child_most))
        elif n >= limits.child_least:
            flush()
            out.append((value, n))
        else:
            if waiting and sum(m for _, m in waiting) + n > limits.child_most:
                flush()
            waiting.append((value, n))
    flush()
    return out


def page_chunks(url: str, page: str | None, limits: Limits, repeat_nested: bool = False) -> Iterator[tuple]:
    """Rows of SCHEMA for one page: a section that fits is one parent; a longer one is packed to several, block by block,
    and a block that no parent holds is cut at sentences."""
    for section in html.sections(page, slug, repeat_nested):
        blocks = [(k, v) for k, v in section.blocks if len(v.strip()) >= limits.least_chars]
        if not any(len(v.strip()) > limits.least_chars for _, v in blocks):
            continue
        groups: list[list[tuple[str, str]]] = [[]]
        if count("\n\n".join(v for _, v in blocks)) <= limits.parent_most:
            groups = [blocks]
        else:
            held = 0  # tokens of the last group
            for kind, value in blocks:
                whole = count(value)
                pieces = [(value, whole)] if whole <= limits.part_most else [(t, count(t)) for t, _ in packed(_SENTENCE.split(value), limits.parent_most)]
                for piece, n in pieces:
                    if groups[-1] and held + n > limits.parent_most:
                        groups.append([])
                        held = 0
                    groups[-1].append((kind, piece))
                    held += n
        section_id = section.path[-1][2] if section.path else ""
        for number, group in enumerate(g for g in groups if g):
            content = "\n\n".join(v for _, v in group)
            parent = _id(url, section.headings, str(number))
            code = "\n".join(v for k, v in group if k == "code")
            yield "parent", parent, None, url, content, count(content), section.headings, section_id, str(number), code
            for n, (child, tokens) in enumerate(_children(group, limits)):
                yield "child", f"{parent}_child_{n}", parent, url, child, tokens, section.headings, section_id, f"{number}_{n}", code


def _chunked(limits: Limits, repeat_nested: bool):
    """Pages (url, html) -> rows of SCHEMA in batches of about PART_BYTES characters."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = [pa.list_(pa.string()) if n == "headings" else pa.int32() if n == "tokens" else pa.string() for n in names]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [()] * len(names)
        return pa.record_batch([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0  # characters of rows
        for part in parts_of(batches, "html"):
            for url, page in zip(part["url"], part["html"], strict=True):
                try:
                    for row in page_chunks(url.as_py(), page.as_py(), limits, repeat_nested):
                        rows.append(row)
                        held += len(row[4]) + sum(map(len, row[6])) + len(row[9])
                        if held >= PART_BYTES:
                            yield batch(rows)
                            rows, held = [], 0
                except html.Rejected:
                    continue
        yield batch(rows)

    return run


def chunk_pages(pages: DataFrame, limits: Limits = Limits(), repeat_nested: bool = False) -> DataFrame:
    """Rows of SCHEMA with doc_type, version and code_identifiers, for pages (url, html).  A page that cannot be parsed gives
    none, nor does one without html."""
    from spindrift.functions.url import doc_type, normalize_url

    rows = pages.select(normalize_url(F.col("url")).alias("url"), "html").mapInArrow(_chunked(limits, repeat_nested), SCHEMA)
    return rows.withColumns({"heading_path": text.heading_path(F.col("headings")), "doc_type": doc_type(F.col("url")), "version": text.version(F.col("headings"), F.col("content")), "code_identifiers": text.code_identifiers(F.col("code"))}).drop("code")


def parents_without_children(rows: DataFrame) -> DataFrame:
    """Parents that no child refers to; they are searched themselves."""
    parents = rows.where("kind = 'parent'")
    return parents.join(rows.where("kind = 'child'").select(F.col("parent_id").alias("chunk_id")), "chunk_id", "left_anti")


def page_texts(pages: DataFrame) -> DataFrame:
    """(url, text, place, main) of pages (url, html): plain text, and main content with where it was found; nulls for a page
    that cannot be parsed."""

    def of(page: str | None) -> tuple:
        try:
            return (html.page_text(page), *html.main_content(page))
        except html.Rejected:
            return None, None, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts_of(batches, "html"):
            found = [of(h.as_py()) for h in part["html"]]
            yield pa.record_batch([part["url"], *(pa.array([f[n] for f in found], pa.string()) for n in range(3))], names=["url", "text", "place", "main"])

    return pages.select("url", "html").mapInArrow(run, "url string, text string, place string, main string")
