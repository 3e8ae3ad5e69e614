import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from factlake.llm.language_id import identify, learn, predict
from factlake.llm.mixing import fly, mix_sources, targets
from factlake.llm.quality import isotonic, score_quality, statistics

WORDS = {"en": "the of and to in is was that for it with as his on be at by".split(), "de": "der die und das ist nicht ein ich zu mit sich auf den dass für".split()}


def speak(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", "en", "ing", "heit", "s"]) for _ in range(n))


def test_language(spark, odd):
    rng = random.Random(1)
    rows = [(i, speak(rng, lang, rng.randrange(20, 120)), lang) for i in range(400) for lang in [rng.choice(["en", "de"])]]
    rows += [(i, t, None) for i, t in odd] + [(1000, "12 34 !", "en"), (1001, "", "de"), (1002, None, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = identify(df, 0.001).collect()
    assert len(got) == len(rows)
    truth = {i: lang for i, _, lang in rows[:400]}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth and r["doc_id"] is not None]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got if r["doc_id"] is not None)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held if r["doc_id"] > 20) >= 0.97 * len([r for r in held if r["doc_id"] > 20])
    assert all(0 <= r["score"] <= 1 for r in got)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (1000, 1001, 1002)} == {"und"}
    assert all(r["rejected"] for r in got if r["lang_pred"] == "und")
    assert predict(df, []).where("lang_pred <> 'und'").count() == 0
    assert learn(df.where("lang is null")) == []
    assert identify(df.where("doc_id < 0")).count() == 0


def test_language_sizes_by_plain_zstandard(spark, monkeypatch):
    """Sizes recomputed one by one; languages in several passes; a long text keeps its margin."""
    import zstandard

    from factlake.llm import language_id

    monkeypatch.setattr(language_id, "GROUP", 2)
    rng = random.Random(2)
    alphabets = ["abcde", "fghij", "klmno", "pqrst", "uvwxy"]
    say = lambda a, n: " ".join("".join(rng.choice(a) for _ in range(rng.randrange(2, 7))) for _ in range(n))
    rows = [(k, say(alphabets[k % 5], rng.randrange(5, 80)), f"l{k % 5}") for k in range(300)] + [(900, say("abcde", 150_000), None), (902, say("abcde", 12_000), None), (901, "Zz", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = learn(df)
    assert [len(g) for g in models] == [2, 2, 1]
    got = {r["doc_id"]: r for r in predict(df, models).collect()}
    for i, text, _ in rows:
        data, sizes = language_id.bare(text), []
        for lang, content in (x for g in models for x in g):
            zipper = zstandard.ZstdCompressor(level=language_id.LEVEL, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes.append((sum(len(zipper.compress(data[k : k + (1 << 16)])) for k in range(0, len(data), 1 << 16)), lang))
        best, second = sorted(s for s, _ in sizes)[:2]
        assert (best, got[i]["lang_pred"]) in sizes and abs(got[i]["score"] - (second - best) / second) < 1e-12
    assert got[900]["score"] > 0.8 * got[902]["score"]


def test_long_texts_are_measured_alike_in_segments(monkeypatch):
    import pyarrow as pa

    from factlake.llm import quality, words

    rng = random.Random(5)
    texts = ["\n".join(speak(rng, "en", rng.randrange(1, 12)) + rng.choice([".", "", "!"]) for _ in range(60)), "x" * 900 + " y\n\n", "\n\nOne\none\n" * 50, "", None, " ", "a b"]
    column = pa.array(texts)
    whole, counts = statistics(column), words.word_counts(column)
    assert counts.tolist() == [len([w for w in re.split("[\x20\x09-\x0d]+", t or "") if w]) for t in texts]
    for size in (64, 100, 257):
        for module in (quality, words):
            monkeypatch.setattr(module, "SEGMENT", size)
        monkeypatch.setattr(words, "parts", lambda offsets, most=0: ((k, k + 1) for k in range(len(offsets) - 1)))
        assert np.allclose(statistics(column), whole) and words.word_counts(column).tolist() == counts.tolist()


def test_clashing_columns_and_odd_rows(docs, odd, spark):
    """Other columns with the names of results and of inner columns change nothing; every row comes back."""
    rows = [(i, t) for i, t in odd] + [(k, speak(random.Random(k), "en" if k % 2 else "de", 30)) for k in range(100, 160)]
    plain = docs(rows)
    clash = plain.withColumns({"score": F.lit("x"), "x": F.lit(1), "y": F.lit("y"), "found": F.lit(2), "rejected": F.lit("r"), "held_out": F.lit(3), "copies": F.lit(4), "n": F.lit(5), "rate": F.lit(6), "copy": F.lit(7)})
    labels = spark.createDataFrame([(k, k % 2, "extra") for k in range(100, 160)] + [(None, 1, "e"), (100, 0, "e"), (101, None, "e"), (102, 7, "e")], "doc_id long, quality int, x string")
    for run in (identify, lambda d: score_quality(d, labels), mix_sources):
        one, two = (sorted(map(repr, run(d).collect())) for d in (plain, clash))
        assert one == two and len(one) == len(rows)


def test_normal_equations_are_those_of_one_dense_solve(spark):
    """Partition sums against numpy on all rows at once."""
    from factlake.llm import quality

    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(300, len(quality.STATISTICS))), rng.integers(0, 2, 300)
    model = quality.Model(x.mean(axis=0), x.std(axis=0))
    train = spark.createDataFrame([(a.tolist(), int(b)) for a, b in zip(x, y, strict=True)], "x array<double>, y int").repartition(7)
    gram, moment, n = quality._normal_equations(train, model)
    z = model.lift(x)
    assert n == 300 and np.allclose(gram, z.T @ z) and np.allclose(moment, z.T @ y)


def test_mix_targets_by_sql(spark):
    """Sizes and targets recomputed by DuckDB; taken words near them; a row repeated very often."""
    import duckdb

    rng = random.Random(8)
    rows = [(k, " ".join("w" for _ in range(rng.choice([0, 3, 40, 400]))), rng.choice(["a", "b", "b", "c", "d", None])) for k in range(3000)] + [(7, "one row many times over", "c")] * 2500
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix_sources(df).collect()
    told = df.toPandas()  # noqa: F841
    sizes = duckdb.sql(r"select source, sum(len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')))::bigint as n from told group by 1 order by source nulls last").fetchall()
    weights, total = [k % 3 + 1 for k in range(len(sizes))], sum(n for _, n in sizes)
    full: set = set()
    while True:
        unit = (total - sum(3 * sizes[k][1] for k in full)) / max(1, sum(w for k, w in enumerate(weights) if k not in full))
        more = {k for k in range(len(sizes)) if k not in full and unit * weights[k] > 3 * sizes[k][1]}
        if not more:
            break
        full |= more
    want = {s: (n, 3.0 * n if k in full else unit * weights[k]) for k, (s, n) in enumerate(sizes)}
    taken = Counter()
    for r in got:
        assert r["source_size"] == want[r["source"]][0] and abs(r["target"] - want[r["source"]][1]) < 1e-6 * total
        assert r["taken"] <= 3 * r["size"] and r["taken"] % max(1, r["size"]) == 0
        taken[r["source"]] += r["taken"]
    assert len(got) == len(rows) and all(abs(taken[s] - t) <= 0.005 * t for s, (_, t) in want.items())
    assert sorted(map(tuple, mix_sources(df.repartition(9)).select("doc_id", "text_hash", "taken").collect()), key=repr) == sorted(((r["doc_id"], r["text_hash"], r["taken"]) for r in got), key=repr)


def test_flight_keeps_totals():
    rng = np.random.default_rng(3)
    for _ in range(30):
        size, pi = rng.integers(1, 500, 60).astype(float), np.full(60, rng.random())
        out = fly(pi, size, rng)
        assert ((out > 1e-9) & (out < 1 - 1e-9)).sum() <= 2
        assert abs((size * out).sum() - (size * pi).sum()) < 1e-3 and abs(out.sum() - pi.sum()) < 1e-6


def test_targets(spark):
    sizes = [("a", 100, 1), ("b", 5, 1), ("c", 0, 1), ("d", 300, 2), (None, 50, 1)]
    got = {r["source"]: (r["weight"], r["target"]) for r in targets(spark.createDataFrame(sizes, "source string, source_size long, n long")).collect()}
    assert {k: v[0] for k, v in got.items()} == {"a": 1, "b": 2, "c": 3, "d": 1, None: 2}
    # 455 words: b stops at 15, c at 0 and the null source at 150; the rest goes to a and d alike.
    assert {k: round(v[1], 6) for k, v in got.items()} == {"a": 145.0, "b": 15.0, "c": 0.0, "d": 145.0, None: 150.0}


def test_mix(docs, odd):
    rng = random.Random(2)
    rows = odd + [(100 + k, "w " * rng.choice([1, 5, 40, 300])) for k in range(3000)]
    first, again = (sorted(map(tuple, mix_sources(docs(rows)).collect()), key=repr) for _ in range(2))
    assert first == again and len(first) == len(rows)
    total, sizes, want = defaultdict(int), Counter(), {}
    for i, size, source_size, target, taken, copies, source, _ in first:
        assert 0 <= taken <= 3 * size and taken == copies * size
        total[source] += taken
        sizes[source] += size
        want[source] = (source_size, target)
    for source in want:
        assert sizes[source] == want[source][0]
        assert abs(total[source] - want[source][1]) <= 0.01 * want[source][1] + 5
    assert abs(sum(t for _, t in want.values()) - sum(sizes.values())) < 1e-3
    assert mix_sources(docs(rows).where("doc_id < 0")).count() == 0


def test_mix_of_a_very_long_document(spark):
    """A source of seven blocks with one document of a tenth of its words, beside a source of 120 blocks."""
    rng = random.Random(4)
    rows = [(k, "w " * rng.randrange(20, 80), "a") for k in range(3400)] + [(9999, "w " * 20000, "a")]
    rows += [(10000 + k, "w " * rng.randrange(1, 4), "b") for k in range(60000)]
    docs_ = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix_sources(docs_).groupBy("source").agg({"taken": "sum", "target": "max", "doc_id": "count"}).collect()
    assert {r["source"]: r["count(doc_id)"] for r in got} == {"a": 3401, "b": 60000}
    for r in got:
        assert abs(r["sum(taken)"] - r["max(target)"]) <= 0.001 * r["max(target)"], r
    # What else is in the table changes a source's draw by its target only: beside few blocks a is as near.
    beside = mix_sources(docs_.where("doc_id < 20000")).where("source = 'a'").agg({"taken": "sum", "target": "max"}).first()
    assert abs(beside["sum(taken)"] - beside["max(target)"]) <= 0.001 * beside["max(target)"]


def test_isotonic_rises():
    x, y = isotonic(np.arange(6.0), np.ones(6), np.array([0, 1, 0, 0, 1, 1.0]))
    assert (np.diff(x) > 0).all() and (np.diff(y) > 0).all()


def test_statistics_of_odd_texts(odd):
    import pyarrow as pa

    x = statistics(pa.array([t for _, t in odd], pa.string()))
    assert np.isfinite(x).all() and (x[2:5] == 0).all()


def test_quality(spark, odd):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        good = rng.random() < 0.6
        text = speak(rng, "en", 80) + "." if good else rng.choice([speak(rng, "de", 60).upper().replace(" ", "!! "), "buy " * 90, "| ".join(speak(rng, "en", 60).split())])
        rows.append((i, text))
        labels.append((i, int(good), "x"))
    rows += [(None, "a b"), (2000, None), (2001, ""), (2002, "z " * 50000), (5, rows[5][1])]
    labels += [(2000, None, "x"), (9999, 1, "x"), (7, 5, "x"), (None, 1, "x")]
    docs_ = spark.createDataFrame(rows, "doc_id long, text string")
    labels_ = spark.createDataFrame(labels, "doc_id long, quality int, text string")
    got = score_quality(docs_, labels_).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    truth = {i: q for i, q, _ in labels[:600]}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert {r["score"] for r in score_quality(docs_, labels_.where("doc_id < 0")).collect()} == {0.5}
    assert score_quality(docs_.where("doc_id < 0"), labels_).count() == 0
