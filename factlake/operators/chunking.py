"""Passages of documents: parents, children and extraction windows."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values, in tokens: target and most of a parent and of a child, and a child's overlap.
PARENT, PARENT_MOST, CHILD, CHILD_MOST, CHILD_OVERLAP = 800, 1200, 200, 320, 40
#: Fixed values, in characters: an extraction window and its overlap.
WINDOW, WINDOW_OVERLAP = 32_000, 2_000
_WORD = re.compile(r"[^\W_]+")


def word_tokens(text: str) -> int:
    return len(_WORD.findall(text))


def pack(parts: list[str], target: int, most: int, overlap: int, size: Callable[[str], int]) -> list[str]:
    """Fill pieces with paragraphs up to ``target``; longer paragraphs are cut at words; each piece after the first opens with the last ``overlap`` of the one before."""
    units: list[str] = []
    for part in parts:
        if size(part) <= most:
            units.append(part)
            continue
        words, held, n = part.split(), [], 0
        for word in words:
            k = max(1, size(word))
            if held and n + k > target:
                units.append(" ".join(held))
                held, n = [], 0
            held.append(word)
            n += k
        if held:
            units.append(" ".join(held))
    out: list[list[str]] = []
    n = 0
    for unit in units:
        k = size(unit)
        if out and n + k <= target:
            out[-1].append(unit)
            n += k
            continue
        tail: list[str] = []
        if out and overlap:
            got = 0
            for word in reversed(" ".join(out[-1]).split()):
                k_word = max(1, size(word))
                if got + k_word > overlap:
                    break
                tail.insert(0, word)
                got += k_word
        out.append([" ".join(tail), unit] if tail else [unit])
        n = k + (size(" ".join(tail)) if tail else 0)
    return ["\n\n".join(p) for p in out]


def cut(text: str) -> list[str]:
    return [p.strip() for p in text.split("\n\n") if p.strip()]


def chunk_documents(docs: DataFrame, size: Callable[[str], int] = word_tokens) -> DataFrame:
    """Parents and, below each, children of every whole ``docs(doc_id, title, rendered_text)``.

    A child's text is led by the title; ids are ``doc#pN`` and ``doc#N``. Null
    and blank texts have no passages. Rows are independent.
    """
    names = ["doc_id", "chunk_id", "chunk_role", "parent_chunk_id", "chunk_index", "text"]

    def rows(doc_id: str, title: str | None, text: str | None) -> Iterator[tuple]:
        n = 0
        for p, parent in enumerate(pack(cut(text or ""), PARENT, PARENT_MOST, 0, size)):
            parent_id = f"{doc_id}#p{p}"
            yield doc_id, parent_id, "parent", None, p, parent
            for child in pack(cut(parent), CHILD, CHILD_MOST, CHILD_OVERLAP, size):
                yield doc_id, f"{doc_id}#{n}", "child", parent_id, n, f"{title}\n\n{child}" if title else child
                n += 1

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [r for d in zip(*(c.to_pylist() for c in part.columns), strict=True) for r in rows(*d)]
                kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], kind) for k, kind in enumerate(kinds)], names)

    out = docs.select("doc_id", "title", "rendered_text").mapInArrow(run, "doc_id string, chunk_id string, chunk_role string, parent_chunk_id string, chunk_index int, text string")
    return out.withColumn("content_hash", F.sha2("text", 256))


def extraction_windows(docs: DataFrame) -> DataFrame:
    """Windows of whole paragraphs up to WINDOW characters with an overlap; nothing is cut off."""

    def run(batches):
        for batch in batches:
            found = [(d, k, w) for d, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for k, w in enumerate(pack(cut(text or ""), WINDOW, WINDOW, WINDOW_OVERLAP, len))]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.string())], ["doc_id", "window_index", "text"])

    return docs.select("doc_id", "rendered_text").mapInArrow(run, "doc_id string, window_index int, text string")
