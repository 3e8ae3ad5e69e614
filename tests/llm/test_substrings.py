"""Repeated word sequences against a plain loop; words whose polynomial hashes collide."""

import random
import re
from collections import Counter

import pytest

from factlake.llm import words
from factlake.llm.near_dedup import near_dedup
from factlake.llm.substring_dedup import difference_cover, plan_for, remove_repeated_words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expect(rows, n):
    texts = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(ws[k : k + n]) for ws in texts for k in range(len(ws) - n + 1))
    out = []
    for (i, _), ws in zip(rows, texts, strict=True):
        gone = [False] * len(ws)
        for k in range(len(ws) - n + 1):
            if seen[tuple(ws[k : k + n])] > 1:
                gone[k : k + n] = [True] * n
        spans, k = [], 0
        while k < len(ws):
            if gone[k]:
                start = k
                while k < len(ws) and gone[k]:
                    k += 1
                spans.append((start, k))
            k += 1
        out.append((i, len(ws), spans, " ".join(w for w, g in zip(ws, gone, strict=True) if not g)))
    return sorted(out, key=repr)


def found(df, n):
    return sorted(((r["doc_id"], r["n_words"], [tuple(s) for s in r["spans"]], r["kept"]) for r in remove_repeated_words(df, n).collect()), key=repr)


@pytest.mark.parametrize("n", [35, 6, 1])
def test_against_a_loop(docs, odd, n):
    rng = random.Random(n)
    base = [f"w{rng.randrange(3000)}" for _ in range(400)]
    rows = [*odd, (20, "a " * 36), (21, "b c " * 30), (22, " ".join(base))]
    for k in range(25):  # near copies, passages at any place, and those that end with their text
        copy = list(base)
        for _ in range(rng.randrange(6)):
            copy[rng.randrange(400)] = f"x{rng.randrange(10**6)}"
        a = rng.randrange(300)
        rows.append((100 + k, " ".join(copy)))
        rows.append((200 + k, "\n".join([f"y{rng.randrange(10**6)}" for _ in range(rng.randrange(50))] + base[a : a + 30 + rng.randrange(9)] + [f"z{rng.randrange(10**6)}"] * (k % 2))))
    assert found(docs(rows), n) == expect(rows, n)


def test_empty_table(spark):
    assert found(spark.createDataFrame([], "doc_id long, text string"), 35) == []


def test_long_text_comes_in_segments(docs, monkeypatch):
    rng = random.Random(1)
    rows = [(1, " ".join(f"w{rng.randrange(60)}" for _ in range(3000))), (2, " ".join(f"w{k % 70}" for k in range(900)))]
    monkeypatch.setattr(words, "SEGMENT", 1 << 10)
    assert found(docs(rows), 35) == expect(rows, 35)


def test_covers():
    for words_ in (1, 2, 5, 20, 35, 200):
        plan = plan_for(words_)
        cover = difference_cover(plan.period)
        assert plan.anchor >= 1 and all(any((k + d) % plan.period in cover for k in cover) for d in range(plan.period))
    assert len(difference_cover(21)) == 5


def test_words_that_collide_as_polynomials(docs):
    """Of two words of 1,024 bytes, each made by appending its swapped copy, any polynomial modulo 2**64 is the same."""
    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a
    rows = [(1, a), (2, b), (3, "x\0"), (4, "x"), (5, b)]
    got = sorted((r["doc_id"], r["component_id"]) for r in near_dedup(docs(rows), 3, 85).collect())
    assert got == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 2)]
    assert found(docs(rows), 1) == expect(rows, 1)
