import random
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from factlake.llm.byte_bpe import VOCABULARY, read_ranks
from factlake.llm.language_id import fold, learn, predict
from factlake.llm.mixing import mix_sources
from factlake.llm.storage import save, short_batches
from tests.llm.test_dedup import expect_exact, expect_near
from tests.llm.test_models import speak

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_each_stage_on_its_own_input(spark, odd):
    rng = random.Random(9)
    rows = [(i, t) for i, t in odd]
    for k in range(120):
        rows.append((1000 + k, speak(rng, rng.choice(["en", "de"]), rng.randrange(30, 200))))
    rows += [(2000 + k, rows[40 + k][1] + (" " if k % 2 else "")) for k in range(15)]
    rows += [(3000 + k, rows[70 + k][1] + " one more") for k in range(15)]
    docs = save(spark.createDataFrame([(i, t, ["en", "de", None][k % 3], ["a", "b", None][k % 3], len(t or "")) for k, (i, t) in enumerate(rows)], COLUMNS))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = [tuple(r) for r in docs.collect()], save(stage(spark, docs, ""))
        after = [tuple(r) for r in kept.collect()]
        assert kept.columns == docs.columns and set(after) <= set(before), name
        ids = sorted((r[0] for r in after), key=repr)
        if name == "language_id":
            models = learn(docs.where(fold("doc_id") != 2))
            good = docs.select(F.monotonically_increasing_id().alias("doc_id"), "text")
            good = predict(good, models, corpus_pipeline.LEAST_MARGIN).where("not rejected").count()
            assert len(after) == good and not any(r[1] in (None, "", " \n\t", "12 34 !") for r in after)
            assert (None, "alone without a name") in {r[:2] for r in after} or good < len(before) - 10
        elif name == "exact_dedup":
            want = {(i, sha) for i, _, _, keep, sha in expect_exact([r[:2] for r in before]) if keep}
            assert len(after) == len(want) and set(ids) == {i for i, _ in want}
        elif name == "near_dedup":
            assert ids == sorted((i for i, _, _, keep in expect_near([r[:2] for r in before], 5, 80) if keep), key=repr)
        else:
            copies = Counter()
            for r in mix_sources(docs).collect():
                copies[r["doc_id"]] += r["copies"]
            assert {i: ids.count(i) for i in set(ids)} == {i: n for i, n in copies.items() if n}
        docs = kept
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(open(VOCABULARY, "rb").read()), special_tokens={})
    out = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(out) == docs.count()
    for r in out:
        assert r["ids"] == library.encode_ordinary(texts[r["doc_id"]]) and r["n_tokens"] == len(r["ids"])


def test_rows_that_share_an_id_are_judged_by_their_text(spark):
    rng = random.Random(4)
    rows = [(k, speak(rng, "en", 80), "en", "a", 1) for k in range(60)]
    rows += [(100, rows[3][1] + " more", "en", "a", 1), (100, "a text that nothing else is near to at all, by any measure", "en", "a", 1), (None, rows[5][1], "en", "a", 1), (101, "12 34", "en", "a", 1), (101, rows[8][1] + " x", "en", "a", 1)]
    docs = save(spark.createDataFrame(rows, COLUMNS))
    stages = dict(corpus_pipeline.STAGES)
    kept = {tuple(r)[:2] for r in stages["near_dedup"](spark, docs, "").collect()}
    assert (100, rows[61][1]) in kept and (100, rows[60][1]) not in kept and (None, rows[5][1]) in kept
    kept = {tuple(r)[:2] for r in stages["language_id"](spark, docs, "").collect()}
    assert (101, "12 34") not in kept and (101, rows[8][1] + " x") in kept and (None, rows[5][1]) in kept


def test_stages_of_an_empty_table_with_clashing_columns(spark):
    docs = spark.createDataFrame([], COLUMNS + ", found long, rejected string, id long, size int, kept string, copies int")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0
    one = spark.createDataFrame([(1, "one short text", "en", "a", 14, 1, "r", 1, 1, "k", 1)], docs.schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, one, "")
        assert out.columns == docs.columns and out.count() == 1


def test_whole_run(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert rows.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]
    assert rows.count() > 50 and np.all([r["n_tokens"] > 0 for r in rows.select("n_tokens").collect()])


def test_repeated_rows_share_what_the_mix_takes(spark):
    """200 rows alike but for one column, beside another source: as many words as the operator takes, each row as often as any or once more."""
    rng = random.Random(6)
    text = speak(rng, "en", 40)
    rows = [(7, text, "en", "a", k % 90) for k in range(200)] + [(100 + k, speak(rng, "en", 60), "en", "b", 1) for k in range(40)] + [(7, text, "en", "b", 1)]
    docs = save(spark.createDataFrame(rows, COLUMNS).repartition(5))
    want = Counter()
    for r in mix_sources(docs).collect():
        want[r["doc_id"], r["source"]] += r["copies"]
    got = [tuple(r) for r in dict(corpus_pipeline.STAGES)["mixing"](spark, docs, "").collect()]
    have = Counter((r[0], r[3]) for r in got)
    assert have == Counter({k: n for k, n in want.items() if n}) and set(got) <= set(rows)
    times, given = Counter(r[4] for r in got if r[0] == 7 and r[3] == "a"), Counter(k % 90 for k in range(200))
    least = want[7, "a"] // 200
    assert all(least * given[k] <= times[k] <= (least + 1) * given[k] for k in given)


def test_texts_that_stay_as_they_are_are_not_shuffled(spark):
    """Only the texts of copies, near copies and rows that the mix takes otherwise than once are sent."""
    rng = random.Random(8)
    rows = [(k, speak(rng, "en", 60), "en", "ab"[k % 2], k) for k in range(200)]
    rows += [(300, rows[3][1] + " ", "en", "a", 1), (301, rows[4][1] + " more", "en", "a", 1)]
    docs = save(spark.createDataFrame(rows, COLUMNS))

    def sent(df):
        """Rows that exchanges with whole texts wrote."""
        todo, n = [df._jdf.queryExecution().executedPlan()], 0
        while todo:
            plan = todo.pop()
            name = plan.getClass().getSimpleName()
            if name == "AdaptiveSparkPlanExec":
                todo.append(plan.executedPlan())
            elif name.endswith("QueryStageExec"):
                todo.append(plan.plan())
            else:
                if name == "ShuffleExchangeExec" and "text#" in plan.output().toString():
                    n += plan.metrics().apply("shuffleRecordsWritten").value()
                todo += [plan.children().apply(k) for k in range(plan.children().size())]
        return n

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name, most, gone in (("exact_dedup", 8, 1), ("near_dedup", 4, 2)):
            out = dict(corpus_pipeline.STAGES)[name](spark, docs, "")
            assert len(out.collect()) == len(rows) - gone and sent(out) <= most, name
        copies = Counter()
        for r in mix_sources(docs).collect():
            copies[r["copies"]] += 1
        out = dict(corpus_pipeline.STAGES)["mixing"](spark, docs, "")
        assert len(out.collect()) == sum(k * n for k, n in copies.items())
        assert copies[1] > 20 and sent(out) <= sum(n for k, n in copies.items() if k > 1)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_texts_reach_workers_in_short_batches(spark):
    docs = save(spark.range(3000).coalesce(1).select(F.repeat(F.lit("word "), 1600).alias("text")))
    sizes = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long")
    default = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    try:
        short_batches(spark)
        sizes = [r.n for r in sizes.collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", default)
    assert sum(sizes) > 24_000_000 and max(sizes) < 6_000_000
