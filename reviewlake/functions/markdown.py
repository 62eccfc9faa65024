"""Document chunkers: one document in, an array of chunk structs out."""

from __future__ import annotations

import hashlib
import posixpath
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlake.functions import constants as K

MARKDOWN_CHUNKS = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("chunks", T.ArrayType(T.StructType([
        T.StructField("content", T.StringType()),
        T.StructField("heading", T.StringType()),
        T.StructField("start_line", T.IntegerType()),
    ]))),
])
PARAGRAPH_CHUNKS = T.ArrayType(T.StructType([
    T.StructField("content", T.StringType()),
    T.StructField("chunk_index", T.IntegerType()),
    T.StructField("section_start", T.BooleanType()),
    T.StructField("total_chunks", T.IntegerType()),
    T.StructField("chunk_hash", T.StringType()),
]))
_SPACE = re.compile(f"^[{K.WS}]+|[{K.WS}]+$")
_TITLE = re.compile(r"^#\s*(.*)")
_SECTION = re.compile(r"^(?:##|###)\s+(.*)")
TITLE_WINDOW = 5


def _strip(text: str) -> str:
    return _SPACE.sub("", text)


def markdown_chunks_text(path: str, text: str | None) -> tuple[str | None, list[dict]]:
    """Sections between second- and third-level headings outside code fences, and the title.

    The title is the first line among the first five that starts with ``#`` (a ``##`` line counts and
    keeps its second mark), else the file's stem.
    """
    if not text:
        return None, []
    lines = text.split("\n")
    stripped = [_strip(line) for line in lines]
    title = next((_strip(m.group(1)) for m in map(_TITLE.match, stripped[:TITLE_WINDOW]) if m), None)

    heads, fenced = [], False
    for i, line in enumerate(stripped):
        fenced ^= line.startswith("```")
        section = None if fenced else _SECTION.match(line)
        if section:
            heads.append((i, _strip(section.group(1))))
    starts = [(0, None)] + heads if not heads or heads[0][0] else heads
    ends = [i for i, _ in starts[1:]] + [len(lines)]
    chunks = [
        {"content": _strip("\n".join(lines[a:b])), "heading": heading, "start_line": a + 1}
        for (a, heading), b in zip(starts, ends)
    ]
    chunks = [c for c in chunks if c["content"]]
    if not title:
        base = posixpath.basename(path)
        title = base.replace(posixpath.splitext(base)[1], "", 1)
    return title, chunks


@F.pandas_udf(MARKDOWN_CHUNKS)
def markdown_chunks(path: pd.Series, text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([markdown_chunks_text(p, t) for p, t in zip(path, text)], columns=["title", "chunks"])


def paragraph_chunks_text(text: str | None) -> list[dict]:
    """Paragraphs packed greedily: a chunk closes when the next would pass 1000 characters, once over 100."""
    bodies, current = [], ""
    for section in re.split(f"\n[{K.WS}]*\n", text or ""):
        section = _strip(section)
        if not section:
            continue
        if len(current) + len(section) > K.PARAGRAPH_CHUNK_MAX and len(current) > K.PARAGRAPH_CHUNK_MIN:
            bodies.append(current)
            current = section
        else:
            current = f"{current}\n\n{section}" if current else section
    if current:
        bodies.append(current)
    return [
        {
            "content": body, "chunk_index": i, "section_start": i == 0, "total_chunks": len(bodies),
            "chunk_hash": hashlib.md5(body.encode()).hexdigest()[:8],
        }
        for i, body in enumerate(bodies)
    ]


@F.pandas_udf(PARAGRAPH_CHUNKS)
def paragraph_chunks(text: pd.Series) -> pd.Series:
    return pd.Series([paragraph_chunks_text(t) for t in text])
