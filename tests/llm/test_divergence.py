"""The audit of sources against a plain loop; the transducer against a sorted list."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from factlake.llm import divergence
from factlake.llm.divergence import build, divergence_audit, exact_shares

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def expect(rows, least, top):
    docs = [(lang or "", source or "", TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        often = Counter(t for d in own for t in set(d[2]))
        kept = sorted((t for t, n in often.items() if n >= least), key=lambda t: t.encode())
        groups = {s: Counter(t for d in own if d[1] == s for t in d[2] if often[t] >= least) for s in {d[1] for d in own}}

        def shares(counts, kept=kept):
            total = sum(counts.values()) + 5 * len(kept)
            return {t: 1 + 10**9 * (counts[t] + 5) // total for t in kept}

        q = shares(sum(groups.values(), Counter()))
        p = {s: shares(c) for s, c in groups.items()}
        for s in groups:
            pair = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in groups if o != s), key=lambda x: (x[0], x[1].encode()))
            term = sorted(((q[t] - p[s][t], t) for t in kept if groups[s][t] and p[s][t] > q[t]), key=lambda x: (x[0], x[1].encode()))[:top]
            out += [(lang, s, part, i, -v, r) for part, found in (("pair", pair), ("term", term)) for r, (v, i) in enumerate(found, 1)]
    return sorted(out)


def rows_for(rng):
    words = ["One", "one", "two2three", "Ärger", "ärger", "été", "\U0001f642", "İx", "a-b", "zz", "Zz", "\x7fq\x00r", "[k]", "`m{"] + [f"w{chr(97 + k)}{chr(97 + k * 7 % 26)}" for k in range(26)]
    rows = [(" ".join(rng.choices(words, k=rng.randrange(30))), rng.choice(["en", "de", None]), rng.choice(["a", "b", "ü", None, "c"])) for _ in range(120)]
    rows += [(None, "en", "silent"), ("", "fr", "a"), ("1 2", "fr", "b"), ("once only", "it", "x"), ("x" * 3000 + " zz", "en", "long")] + [("same same", "en", "copies")] * 9
    return rows


def result(df, *args):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in divergence_audit(df, *args).collect())


SCHEMA = "text string, lang string, source string, rank int, term string, total long"


@pytest.mark.parametrize("small", [False, True])
def test_against_a_loop(spark, monkeypatch, small):
    """``small``: shards of three terms, passes of one shard, blocks of four terms and two sources, and tasks that send on early."""
    if small:
        for name, value in {"SHARD": 3, "PASS": 1, "TERMS": 4, "SOURCES": 2, "GATHERED": 5, "CHUNK": 64}.items():
            monkeypatch.setattr(divergence, name, value)
    rng = random.Random(2)
    rows = rows_for(rng)
    if small:
        rows = rows[-70:]
    df = spark.createDataFrame([(*r, 1, "t", 2) for r in rows], SCHEMA).repartition(3)
    assert result(df, 3, 4) == expect(rows, 3, 4)


def test_without_terms_or_rows(spark):
    assert result(spark.createDataFrame([], SCHEMA)) == []
    rows = [("a b", "en", "x"), ("c", "en", "y"), (None, None, None)]
    assert result(spark.createDataFrame([(*r, 1, "t", 2) for r in rows], SCHEMA)) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]


def test_transducer():
    rng = random.Random(4)
    terms = sorted({"".join(rng.choices("abcé", k=rng.randrange(1, 7))).encode() for _ in range(400)})
    found = build(terms)
    other = [t + b"x" for t in terms[:50]] + [t[:-1] or b"q" for t in terms]
    asked = terms + other
    place = {t: k for k, t in enumerate(terms)}
    assert found.ordinals(pa.array(asked, pa.large_binary())).tolist() == [place.get(t, -1) for t in asked]
    # Minimal: as many states as there are different sets of endings.
    prefixes = {t[:k] for t in terms for k in range(len(t) + 1)}
    endings = {frozenset(t[len(p) :] for t in terms if t.startswith(p)) for p in prefixes}
    assert len(found.final) == len(endings)
    assert build([]).ordinals(pa.array([b"a"], pa.large_binary())).tolist() == [-1]


def test_exact_shares():
    over, under = [1, 5, 10**14, 7, 2**52], [3, 5, 10**15 + 7, 10**15, 2**53 - 1]
    assert exact_shares(np.array(over), np.array(under)).tolist() == [1 + 10**9 * a // b for a, b in zip(over, under, strict=True)]
