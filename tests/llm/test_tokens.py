import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from factlake.llm.byte_bpe import VOCABULARY, ByteBpe, decode_stream, digest_documents, encode_documents, read_ranks
from factlake.llm.token_counts import Counter, PretokenTree, count_edited, with_edits, with_redactions

PARTS = ["a", "b", "the", " ", "  ", "\n", "'", "'re", "'l", "l", "1", "23", "é", "漢", "!", "\t", "re", "ve", "　", " x", "aaaa", "----", "‍", "🙂", "ß", "İ", "\x1c", "\x85"]


@pytest.fixture(scope="module")
def data():
    return open(VOCABULARY, "rb").read()


@pytest.fixture(scope="module")
def library(data):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(data), special_tokens={})


def test_ids_bytes_and_offsets(data, library):
    bpe, rng = ByteBpe(data, public_tokenizers.PATTERN), random.Random(2)
    for _ in range(400):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(60)))
        ids = np.frombuffer(bpe.encode(text), "<u4").tolist()
        assert ids == library.encode_ordinary(text)
        assert bpe.decode(ids) == text.encode()
        assert "".join(decode_stream(bpe.token_bytes, ids)) == text
        split = 0
        for i, a, b in zip(ids, *bpe.offsets(ids), strict=True):
            assert bpe.token_bytes[i] in text[a:b].encode()
            split += bpe.token_bytes[i] != text[a:b].encode()
        assert bpe.n_split(np.array(ids, int), text.encode()) == split


def test_pieces_that_hold_a_token_twice(data, library, monkeypatch):
    """The library's ids where no three bytes occur twice, the rank rule elsewhere: always those of the ranks."""
    bpe, rng = ByteBpe(data, public_tokenizers.PATTERN), random.Random(12)
    tokens = [t.decode() for t in bpe.ranks if 3 <= len(t) <= 6 and t.isalpha() and t.isascii()]
    pieces = set()
    for _ in range(6000):
        own = rng.sample(tokens, 2)
        pieces.add("".join(rng.choice(own)[: rng.randrange(1, 7)] for _ in range(rng.randrange(1, 6))))
    rank = library._core_bpe.encode_single_piece
    bpe.learn(sorted(pieces))
    assert 0 < bpe.n_by_rank < len(pieces)
    for p in pieces:
        assert np.frombuffer(bpe.known[p], "<u4").tolist() == bpe.merge_by_rank(p.encode()) == rank(p.encode()), p
    text = "".join(rng.choice(PARTS) for _ in range(5000))
    monkeypatch.setattr("factlake.llm.byte_bpe.LONG", 64)
    assert np.frombuffer(bpe.encode(text), "<u4").tolist() == library.encode_ordinary(text)


def test_pieces_go_through_the_library_together(data, library):
    """Lines of one text: line feeds, odd bytes, repeats, short and long pieces keep their ids; small calls too."""
    bpe, rng = ByteBpe(data, public_tokenizers.PATTERN), random.Random(5)
    pieces = ["\n", "\r\n\n", " \n\n", "\x00", "Ċ", "ÿ\n", "", "é漢🙂", "a" * 65, "ab" * 3000, "".join(map(chr, range(33, 2500)))]
    pieces += ["".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 40))) for _ in range(300)]
    rank = library._core_bpe.encode_single_piece
    want = [rank(p.encode()) if p else [] for p in pieces]
    assert [np.frombuffer(ids, "<u4").tolist() for ids in bpe.fresh(pieces)] == want
    assert bpe.n_by_rank < len(pieces)
    assert [np.frombuffer(bpe.fresh([p])[0], "<u4").tolist() for p in pieces] == want
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(90))) for _ in range(50)] + ["", "x" * 70]
    assert [np.frombuffer(ids, "<u4").tolist() for ids in bpe.encode_all(texts)] == [library.encode_ordinary(t) for t in texts]


def test_frequent_pieces_are_encoded_once(data):
    counter = Counter(data, public_tokenizers.PATTERN)
    counter.most, asked, encode = 100, [], counter.bpe.fresh
    counter.bpe.fresh = lambda pieces: asked.extend(pieces) or encode(pieces)
    try:
        for k in range(400):
            assert counter.count([" often", f" rare{k}"]) == [len(ids) // 4 for ids in encode([" often", f" rare{k}"])]
            assert len(counter.known) + len(counter.old) <= 100
    finally:
        del counter.bpe.fresh
    assert asked.count(" often") == 1 and len(asked) == 401


def test_long_runs_take_linear_time(docs):
    rows = [(1, "a" * 600_000), (2, "x.%" * 200_000 + " me@here.org"), (3, "@" * 300_000)]
    got = {r["doc_id"]: r for r in count_edited(with_redactions(docs(rows))).collect()}
    assert [got[k]["n_edits"] for k in (1, 2, 3)] == [1, 2, 1] and all(r["n_tokens"] > 0 for r in got.values())


def test_documents(docs, odd, library):
    want = []
    for i, t in odd:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted((tuple(r)[:4] for r in digest_documents(docs(odd)).collect()), key=repr) == sorted(want, key=repr)
    for r in encode_documents(docs(odd), offsets=True).collect():
        assert len(r["ids"]) == len(r["token_start"]) == len(r["token_end"])
        assert library.decode_bytes(r["ids"]) == bytes(r["decoded"])
    assert digest_documents(docs([(1, "x")]).where("doc_id > 1")).count() == 0


def test_edits_against_whole_encoding(data, library):
    counter, rng = Counter(data, public_tokenizers.PATTERN), random.Random(4)
    encoded = whole = 0
    for turn in range(300):
        text = "".join(rng.choice(PARTS) for _ in range(rng.choice([0, 1, 5, 50, 200, 3000 if turn % 30 == 0 else 9])))
        tree = PretokenTree(text, counter)
        for _ in range(rng.randint(1, 6)):
            a = rng.randint(0, len(text))
            b = min(len(text), a + rng.choice([0, 0, 1, 3, 20]))
            new = "".join(rng.choice(PARTS) for _ in range(rng.choice([0, 1, 3, 30])))
            text = text[:a] + new + text[b:]
            tree.edit(a, b, new)
            assert tree.tokens == len(library.encode_ordinary(text))
            assert tree.nodes[1][0] == len(text)
            whole += tree.nodes[1][2]
        encoded += tree.encoded
    assert encoded < whole / 3


def test_edited_documents(spark, docs, odd, library):
    edits = spark.createDataFrame(
        [(1, 2, 0, 5, "Bye"), (1, 1, 5, 5, ", you"), (7, 1, 100, 200, None), (8, 1, 40, 60, "***"), (8, 2, None, 3, "x"), (99, 1, 0, 0, "nobody")],
        "doc_id long, seq int, start int, stop int, replacement string",
    )
    texts = {8: odd[10][1][:40] + "***" + odd[10][1][60:], 1: "Bye, you big  world again"}
    got = count_edited(with_edits(docs(odd), edits)).collect()
    assert len(got) == len(odd)
    by_id = {i: t for i, t in odd if i is not None}
    for r in got:
        if r["doc_id"] is not None:
            assert r["n_tokens"] == len(library.encode_ordinary(by_id[r["doc_id"]] or ""))
            assert r["n_tokens_edited"] == len(library.encode_ordinary(texts.get(r["doc_id"], by_id[r["doc_id"]] or "")))


def test_redaction(docs, library):
    rows = [(1, "mail ann.b@example.org or call 5551234567 now"), (2, "nothing here"), (3, None), (4, "5551234567 x@y.z")]
    got = {r["doc_id"]: r for r in count_edited(with_redactions(docs(rows))).collect()}
    source = {i: ["a", "b", "unknown"][i % 3] for i in range(5)}
    want = {1: "mail <mail> or call <number> now", 2: "nothing here", 3: "", 4: "<number> <mail>"}
    for i, t in want.items():
        assert got[i]["n_tokens_edited"] == len(library.encode_ordinary(t + f"\nSource: {source[i]}"))
    assert [got[i]["n_edits"] for i in (1, 2, 3, 4)] == [3, 1, 1, 3]
