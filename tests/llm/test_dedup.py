import hashlib
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from factlake.llm.exact_dedup import exact_dedup
from factlake.llm.near_dedup import least_matches, near_dedup, shared_keys
from factlake.llm.storage import save
from factlake.llm.suffix_dedup import remove_repeats

BLANK = re.compile(r"[\x20\x09-\x0D]+")


def expect_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[BLANK.sub("", t or "")].append((-len(t or ""), i is None, i or 0, i))
    out = []
    for i, t in rows:
        norm = BLANK.sub("", t or "")
        own = groups[norm]
        longest = min(g[0] for g in own)
        ids = [g[3] for g in own if g[0] == longest and g[3] is not None]
        keep = min(ids) if ids else None
        out.append((i, keep, len(own), i == keep, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_exact(docs, odd):
    got = [tuple(r) for r in exact_dedup(docs(odd)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
    assert sorted(got, key=repr) == expect_exact(odd)


def test_exact_with_colliding_digests(docs, odd):
    weak = lambda c: F.unhex(F.substring(F.sha2(c, 256), 1, 1))
    rows = odd + [(100 + k, f"text {k % 20}") for k in range(60)]
    got = [tuple(r) for r in exact_dedup(docs(rows), digest=weak).select("doc_id", "keep_id", "group_size", "kept").collect()]
    assert sorted(got, key=repr) == sorted((r[:4] for r in expect_exact(rows)), key=repr)


def test_exact_index_over_batches(docs, odd, spark, monkeypatch):
    """Rows of later batches meet those of earlier ones, through runs that were merged and runs that weren't."""
    from factlake.llm import exact_dedup as module

    monkeypatch.setattr(module, "FANOUT", 2)
    weak = lambda c: F.unhex(F.substring(F.sha2(c, 256), 1, 2))
    for digest in (module.sha256, weak):
        index, seen = module.DigestIndex(spark, digest), []
        for b in range(3):
            batch = [(i, t) for i, t in odd if (i or 0) % 3 == b] + [(100 * b + k, f"text  {k % (9 + b)}" + " " * (k % 4)) for k in range(60, 90)]
            batch += [(-(2**63), f"text {b}")]
            seen += batch
            want = expect_exact(seen)
            got = [tuple(r)[:4] for r in index.add(docs(batch)).collect()]
            assert len(got) == len(batch) and set(got) <= {w[:4] for w in want}
        assert [r.level for r in index.runs] == [1, 0]


def shingles(text, n):
    words = [w for w in BLANK.split(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1)))


def expect_near(rows, n, percent):
    sets = [(i, shingles(t, n)) for i, t in rows]
    label = {i: i for i, _ in rows}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if x and y and a is not None and b is not None and 100 * len(x & y) >= percent * len(x | y):
                lo, hi = sorted((root(a), root(b)))
                label[hi] = lo
    return sorted(((i, len(s), None if i is None else root(i), i is None or root(i) == i) for i, s in sets), key=repr)


def test_near(docs, odd):
    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    rows = list(odd)
    for k in range(80):  # one large group of near copies, from hardly to much changed
        words = list(base)
        for _ in range(rng.randrange(9)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        rows.append((200 + k, " ".join(words).upper() if k % 7 == 0 else " ".join(words)))
    rows += [(400 + k, rows[30 + k][1]) for k in range(10)]
    for n, percent in ((3, 85), (5, 80)):
        got = [tuple(r)[:4] for r in near_dedup(docs(rows), n, percent).collect()]
        assert sorted(got, key=repr) == expect_near(rows, n, percent)


def test_near_with_a_repeated_id(docs):
    a, b = (" ".join(f"{c}{k}" for k in range(60)) for c in "ab")
    for rows in ([(5, a), (5, b), (7, b + " more")], [(5, b), (5, a), (7, b + " more")]):
        got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup(docs(rows), 3, 85).collect())
        assert got == [(5, 5, True), (5, 5, True), (7, 5, False)]


def test_hot_keys_are_dealt(spark, docs, monkeypatch):
    """Everything is hot, and blocks hold few rows: the same components as by brute force."""
    from factlake.llm import near_dedup as near
    from factlake.llm import storage

    monkeypatch.setattr(storage, "HOT_ROWS", 1)
    monkeypatch.setattr(storage, "SALTS", 4)
    monkeypatch.setattr(near, "ROWS", 20)
    monkeypatch.setattr(near, "FEW", 3)
    rng = random.Random(6)
    rows = []
    for k in range(90):  # some groups around one template, so that large buckets stay open
        words = [f"t{i}" for i in range(100)] + [f"g{k % 6}x{i}" for i in range(14)]
        for _ in range(rng.randrange(6)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    got = [tuple(r)[:4] for r in near_dedup(docs(rows), 3, 85).collect()]
    assert sorted(got, key=repr) == expect_near(rows, 3, 85)


def test_words_of_long_texts(monkeypatch):
    import pyarrow as pa

    from factlake.llm import words

    texts = pa.array(["Aa bb cc " * 200, "x" * 1000 + " end", "y" * 900, None, "short one", " " * 700])
    whole = [s.tolist() for s in words.shingle_sets(texts, 3)]
    monkeypatch.setattr(words, "SEGMENT", 256)
    monkeypatch.setattr(words, "parts", lambda offsets: ((k, k + 1) for k in range(len(offsets) - 1)))
    assert [s.tolist() for s in words.shingle_sets(texts, 3)] == whole


def test_posterior_bounds_rise():
    steps = least_matches(85)
    assert all(m < n for n, m in steps) and [m for _, m in steps] == sorted(m for _, m in steps)


def expect_cut(rows, size):
    seen = defaultdict(int)
    texts = [(i, (t or "").encode()) for i, t in rows]
    for _, b in texts:
        for k in range(len(b) - size + 1):
            seen[b[k : k + size]] += 1
    out = []
    for i, b in texts:
        gone = set()
        for k in range(len(b) - size + 1):
            if seen[b[k : k + size]] > 1:
                gone.update(range(k, k + size))
        spans, k = [], 0
        for k in sorted(gone):
            if spans and spans[-1][1] == k:
                spans[-1][1] = k + 1
            else:
                spans.append([k, k + 1])
        out.append((i, len(b), str(spans), bytes(x for k, x in enumerate(b) if k not in gone)))
    return sorted(out, key=repr)


def test_suffix(docs, odd):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 9)))
    passage = " ".join(word() for _ in range(60))
    rows = list(odd)
    for k in range(25):
        own = [word() for _ in range(150)]
        at = rng.randrange(100)
        text = " ".join(own[:at]) + passage[rng.randrange(40) : rng.randrange(150, 330)] + " ".join(own[at:])
        rows.append((300 + k, text))
    rows += [(500, rows[20][1]), (501, "ab" * 300), (502, "x" * 199), (503, "x" * 199), (504, "y" * 200), (505, "y" * 200), (506, passage * 3)]
    got = [(r["doc_id"], r["n_bytes"], str([[s["start"], s["end"]] for s in r["spans"]]), bytes(r["kept"])) for r in remove_repeats(docs(rows), 200).collect()]
    assert sorted(got, key=repr) == expect_cut(rows, 200)


def test_suffix_index_over_batches(docs, spark, monkeypatch):
    """Three batches one after another, each against brute force over all so far; levels merge; long texts come in segments."""
    from factlake.llm import suffix_dedup as module

    monkeypatch.setattr(module, "SEGMENT", 500)
    monkeypatch.setattr(module, "parts", lambda offsets: ((k, k + 1) for k in range(len(offsets) - 1)))
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(2, 8)))
    passages = [" ".join(word() for _ in range(40)) for _ in range(4)]
    index, seen = module.SuffixIndex(spark, 200), []
    for b in range(3):
        batch = []
        for k in range(7):
            text = [" ".join(word() for _ in range(rng.randrange(5, 90)))]
            for _ in range(rng.randrange(4)):
                p = rng.choice(passages[: b + 2])
                text += [p[rng.randrange(30) :], " ".join(word() for _ in range(rng.randrange(60)))]
            batch.append((100 * b + k, " ".join(text)))
        batch += [(100 * b + 50, "z" * (700 + b)), (None, passages[b] * 6)]
        seen += batch
        matches = index.add(docs(batch))
        assert {"head", "prefix_hash", "doc_key", "place", "level_key", "level_place"} <= set(matches.columns) and matches.count() > 0
        assert b == 0 or matches.where("level_key is not null").count() > 0
        got = [(r["doc_id"], r["n_bytes"], str([[s["start"], s["end"]] for s in r["spans"]]), bytes(r["kept"])) for r in index.cut().collect()]
        assert sorted(got, key=repr) == expect_cut(seen, 200)
        for level in index.levels:
            order = [(r["head"], r["prefix_hash"]) for r in spark.read.parquet(level.path).coalesce(1).select("head", "prefix_hash").collect()]
            assert len(order) == len(set(order))
    assert [level.batches for level in index.levels] == [2, 1]


def test_empty_tables(docs, spark):
    none = docs([(1, "x")]).where("doc_id > 1")
    assert exact_dedup(none).count() == 0
    assert near_dedup(none).count() == 0
    assert remove_repeats(none).count() == 0


def test_keys_of_one_class_are_not_shuffled(spark):
    keys = save(spark.range(4000).selectExpr("id", "id % 7 as size", "if(id < 40, id div 4, id) * 7919 as key"))
    kept = {r.id for r in shared_keys(keys).collect()}
    assert kept >= set(range(40)) and len(kept) < 60
