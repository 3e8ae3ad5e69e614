import hashlib

import numpy as np
import pytest

from factlake.llm.vector_search import nearest
from factlake.llm.warc import assemble, read_archives, round_trip, write_archives
from factlake.llm.storage import scratch_folder


def brute(rows, asked, k, dim):
    def ok(v):
        return v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v) and any(v)

    good = {(i, tuple(v)) for i, v in rows if i is not None and ok(v)}
    out = {}
    for i, v in {(i, tuple(v)) for i, v in asked if i is not None and ok(v)}:
        found = {}
        for j, w in good:
            if j != i:
                found[j] = max(found.get(j, -np.inf), float(np.dot(v, w)))
        out.setdefault(i, sorted((-round(s, 9), j) for j, s in found.items())[:k])
    return out


def test_nearest(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 16))
    x[1000:2000] = x[1000] + 0.05 * rng.normal(size=(1000, 16))
    x[2000:2600] = x[2000]  # one vector many times
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(9001, None), (9002, [0.0] * 16), (9003, [float("nan")] * 16), (9004, [1.0] * 3), (9005, [None] * 16), (None, [1.0] * 16), (7, x[7].tolist())]
    vectors = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").repartition(5)
    got = nearest(vectors, vectors.where("vec_id % 20 = 0"), 20).collect()
    want = brute(rows + odd, [r for r in rows if r[0] % 20 == 0], 20, 16)
    mine = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        mine.setdefault(r["query_id"], []).append((-round(r["score"], 9), r["vec_id"]))
    assert set(mine) == set(want) and all(len(v) == 20 and v == sorted(v) for v in mine.values())
    hit = np.mean([len({j for _, j in mine[q]} & {j for _, j in want[q]}) / 20 for q in want])
    assert hit >= 0.9
    assert mine[2000] == want[2000]
    few = nearest(vectors.where("vec_id < 4"), vectors.where("vec_id = 0"), 20).collect()
    assert sorted(r["vec_id"] for r in few) == [1, 2, 3]
    assert nearest(vectors.where("vec_id < 0"), vectors, 5).count() == 0


@pytest.mark.parametrize("lengths", [{7: 1e4}, {7: 1e4, 8: 1e-4, 9: 3e6}])
def test_nearest_beside_very_long_vectors(spark, lengths):
    """More than 512 lists of unit vectors, and few vectors of other lengths."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(15000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    for i, length in lengths.items():
        x[i] *= length
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = {}
    for r in nearest(vectors, vectors.where("vec_id % 100 = 7"), 20).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q in range(7, len(x), 100):
        score = x @ x[q]
        score[q] = -np.inf
        hits += len(got.get(q, set()) & set(np.argsort(-score)[:20].tolist()))
    assert len(got) == 150 and hits >= 0.9 * 20 * 150


def recall(vectors, x, step, k=20):
    got = {}
    for r in nearest(vectors, vectors.where(f"vec_id % {step} = 0"), k).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    hits = 0
    for q in range(0, len(x), step):
        score = x @ x[q]
        score[q] = -np.inf
        hits += len({v for _, v in got[q]} & set(np.lexsort((np.arange(len(x)), -np.round(score, 9)))[:k].tolist()))
    return hits / (k * len(range(0, len(x), step))), got


def test_lists_that_are_split(spark, monkeypatch):
    """A small sample gives few first centroids; their lists are split until they are short again."""
    from factlake.llm import vector_search

    monkeypatch.setattr(vector_search, "SAMPLE", 400)
    monkeypatch.setattr(vector_search, "LIST_ROWS", 40)
    monkeypatch.setattr(vector_search, "BLOCK", 700)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 24))[rng.integers(0, 60, 8000)] + 0.4 * rng.normal(size=(8000, 24))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>, vec string, id int, cls int".split(", vec ")[0]).repartition(3)
    share, _ = recall(vectors, x.astype(np.float32).astype(float), 40)
    assert share >= 0.9


def test_ties_go_to_smaller_ids(spark):
    """Vectors of +-1 and few dimensions: most scores tie, also between different vectors."""
    rng = np.random.default_rng(4)
    x = rng.choice([-1.0, 1.0], (1500, 12))
    vectors = spark.createDataFrame([(i, v.tolist(), "clash", 1, 2.0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, cls string, id int, score double").repartition(3)
    _, got = recall(vectors, x, 100)
    for q, found in got.items():
        score = x @ x[q]
        score[q] = -np.inf
        mine = [v for _, v in sorted(found)]
        assert mine == sorted(mine, key=lambda v: (-score[v], v)) and len(mine) == 20
        # What is found is right up to the first score that lists which weren't read hold too.
        want = np.lexsort((np.arange(len(x)), -score))[:20].tolist()
        assert len(set(mine) & set(want)) >= 17


def test_warc(spark, tmp_path):
    long = "<p>ünï\r\n\r\nWARC/1.1\r\n" + "x" * 200 + "</p>"
    pages = [(1, "http://a/1", long), (2, "http://a/2", long), (3, None, long), (4, "http://a/4", "short"), (5, "http://a/5", "short"), (6, "http://a/6", None), (7, "http://a/\r\n7", ""), (None, "http://a/n", long), (1, "http://a/1", long), (None, "u", "lonely" * 40), (8, "h", "y" * 100000)]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, digest string").repartition(3)
    rows = round_trip(df).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert len(r["requests"]) == 1 and len(r["metadata"]) == 1
        kind, page = r["response"]["kind"], r["page_id"]
        if kind == "response":
            body = bytes(r["response"]["payload"])
            assert hashlib.sha256(body).hexdigest() == r["response"]["payload_sha256"] == r["response"]["digest"].removeprefix("sha256:")
            assert len(body) == r["payload_bytes"] and r["refers_to_page"] is None
            assert page is None or body.decode() in [p[2] or "" for p in pages if p[0] == page]
        else:
            assert r["refers_to_page"] == 1 and r["payload_bytes"] == len(long.encode())
    kinds = sorted((str(r["page_id"]), r["response"]["kind"]) for r in rows)
    assert kinds == sorted([("1", "response"), ("1", "response"), ("2", "revisit"), ("3", "revisit"), ("None", "revisit"), ("None", "response")] + [(str(i), "response") for i in (4, 5, 6, 7, 8)])
    assert round_trip(df.where("page_id < 0")).count() == 0


def test_files_are_seekable_and_bounded(spark, tmp_path, monkeypatch):
    """Each record is a gzip member; files end by bytes and begin with a warcinfo record; one record has over 16 MB."""
    import zlib

    from factlake.llm import storage, warc

    monkeypatch.setattr(warc, "FILE_BYTES", 3000)
    monkeypatch.setattr(storage, "HOT_ROWS", 5)
    rng = np.random.default_rng(1)
    page = lambda k: "".join(chr(c) for c in rng.integers(97, 123, 400)) if k % 3 else "one error page " * 20
    pages = [(k, f"http://a/{k}", page(k)) for k in range(60)] + [(100, "http://a/100", "é" * 9_000_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)
    path = str(tmp_path / "w")
    write_archives(df, path)
    files = sorted((tmp_path / "w").glob("*.warc.gz"))
    assert len(files) > 8 and not list((tmp_path / "w").rglob("*.txt"))
    kinds = []
    for f in files:
        data, own = f.read_bytes(), []
        while data:
            unzip = zlib.decompressobj(wbits=31)
            record = unzip.decompress(data) + unzip.flush()
            data = unzip.unused_data
            if record:
                assert record.startswith(b"WARC/1.1\r\nWARC-Type: ") and record.endswith(b"\r\n\r\n")
                own.append(record.split(b"\r\n")[1].split(b": ")[1].decode())
        assert own[0] == "warcinfo" and "warcinfo" not in own[1:]
        assert f.stat().st_size < 3000 + 2000 or len(own) <= 10  # the one with the large record
        kinds += own
    assert kinds.count("response") == 42 and kinds.count("revisit") == 19 and kinds.count("request") == kinds.count("metadata") == 61
    rows = assemble(storage.save(read_archives(spark, path))).collect()
    assert sorted(r["page_id"] for r in rows) == sorted(p[0] for p in pages)
    for r in rows:
        if r["response"]["kind"] == "revisit":
            assert r["refers_to_page"] == 0 and r["page_id"] % 3 == 0
        else:
            assert bytes(r["response"]["payload"]).decode() == dict((p[0], p[2]) for p in pages)[r["page_id"]]


def test_plain_archives_are_read(spark, tmp_path):
    block = b"HTTP/1.1 200 OK\r\n\r\nhello"
    record = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x:1>\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(record)
    row = assemble(read_archives(spark, str(tmp_path))).collect()[0]
    assert bytes(row["response"]["payload"]) == b"hello" and row["page_id"] is None


def test_all_lists_within_the_ratio_are_read():
    """Several thousand lists, of which far more than BEAM are near: the walk widens until the ratio decides."""
    from factlake.llm import vector_search as v

    rng = np.random.default_rng(12)
    centroids = rng.standard_normal((6000, 16)).astype(np.float32)
    centroids = np.c_[centroids / np.linalg.norm(centroids, axis=1)[:, None], np.zeros(6000)].astype(np.float32)
    band = v.Band(0, centroids, v.link(centroids), 1.0)
    asked = centroids[:40] + 0.3 * rng.standard_normal((40, 17)).astype(np.float32)
    row, rank, lists = v.within(band, asked, 1.6)
    dist = np.linalg.norm(asked[:, None] - centroids, axis=2)
    want = dist <= 1.6 * dist.min(axis=1)[:, None]
    assert want.sum(axis=1).max() > 2 * v.BEAM
    got = np.zeros_like(want)
    got[row, lists] = True
    assert (got & want).sum() >= 0.99 * want.sum() and got[np.arange(40), dist.argmin(axis=1)].all()
    row, _, lists = v.within(band, asked, np.inf)
    assert len(set(zip(row.tolist(), lists.tolist()))) == 40 * 6000


def test_an_infinite_ratio_is_exact(spark):
    rng = np.random.default_rng(13)
    x = rng.standard_normal((4000, 48))
    vectors = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in nearest(vectors, vectors.where("vec_id % 100 = 0"), 10, float("inf")).collect()}
    for q in range(0, 4000, 100):
        score = x @ x[q]
        score[q] = -np.inf
        assert [got[q, k + 1] for k in range(10)] == np.argsort(-score)[:10].tolist()
