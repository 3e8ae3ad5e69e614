"""Text quality: random Fourier features, ridge normal equations, isotonic calibration."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.llm.language_id import fold
from factlake.llm.storage import read_table, save
from factlake.llm.words import BASE, BYTE_VALUE, INVERSE, SEGMENT, hash_words, mix, powers, segments, text_bytes, word_bounds

#: What is measured of a text, in this order.
STATISTICS = (
    "log_words", "word_length", "word_length_spread", "distinct_words", "distinct_pairs", "repeats_previous", "commonest_word",
    "upper", "digits", "signs", "exclamations", "pipes", "non_ascii", "entropy", "line_length", "short_lines", "repeated_lines", "ends_sentence",
)
#: Random features; width of the Gaussian kernel over standardised statistics; ridge penalty a row.
FEATURES, WIDTH, RIDGE = 192, 4.0, 1e-4
#: A document is predicted good from this score on.
CUT = 0.7
#: Steps that calibration counts scores in, between -0.5 and 1.5.
STEPS = 2048
_rng = np.random.default_rng(11)
DIRECTIONS = _rng.normal(size=(len(STATISTICS), FEATURES)) / WIDTH
PHASES = _rng.uniform(0, 2 * np.pi, FEATURES)


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256)
    out[[ord(c) for c in chars]] = 1
    return out


UPPER, DIGIT = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("0123456789")
SIGN = _class("!#$%&*+/<=>@[\\]^_`{|}~")
LETTER = UPPER + _class("abcdefghijklmnopqrstuvwxyz")
LETTER[128:] = 1


def _parts(text: np.ndarray, whole: bool):
    """(hashes, sizes, last bytes) of the words of a text's segments, some megabytes at a time."""
    for at, to in [(0, len(text))] if whole else segments(text):
        part = text[at:to]
        starts, ends = word_bounds(part, np.array([0, len(part)]))
        yield hash_words(part, starts, ends), (ends - starts).astype(float), part[ends - 1]


def _line_hashes(text: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Hash of each line between two line feeds at ``edges`` (the first is -1, the last the end), some megabytes at a time."""
    out, carry = np.zeros(len(edges), np.uint64), np.zeros(1, np.uint64)
    scale, back = np.ones(1, np.uint64), np.ones(1, np.uint64)
    start_sum, start_back = np.zeros(len(edges), np.uint64), np.ones(len(edges), np.uint64)
    for at in range(0, len(text) + 1, SEGMENT):
        part = text[at : at + SEGMENT]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(BYTE_VALUE[part] * powers(BASE, len(part)), out=sums[1:])
        inside = np.flatnonzero((edges >= at) & (edges < at + SEGMENT) & (edges <= len(text)))
        local = edges[inside] - at
        out[inside] = carry + scale * sums[local]
        after = np.flatnonzero((edges + 1 >= at) & (edges + 1 < at + SEGMENT) & (edges + 1 <= len(text)))
        local = edges[after] + 1 - at
        start_sum[after] = carry + scale * sums[local]
        start_back[after] = back * powers(INVERSE, SEGMENT + 1)[local]
        carry = carry + scale * sums[-1]
        scale, back = scale * np.uint64(pow(BASE, SEGMENT, 1 << 64)), back * np.uint64(pow(INVERSE, SEGMENT, 1 << 64))
    return (out[1:] - start_sum[:-1]) * start_back[:-1]


def statistics(column: pa.Array) -> np.ndarray:
    """One row of STATISTICS per whole text; all 0 for null, empty and blank texts.

    A text of more than SEGMENT bytes is read in segments: beside the text 8
    bytes a word and a line are held.
    """
    data, offsets = text_bytes(column)
    out = np.zeros((len(column), len(STATISTICS)))
    with np.errstate(over="ignore"):
        for i in range(len(column)):
            text = data[offsets[i] : offsets[i + 1]]
            found = list(_parts(text, len(text) <= SEGMENT)) if len(text) else []
            words, size, last = (np.concatenate(x) for x in zip(*found, strict=True)) if found else ([], [], [])
            n = len(words)
            if not n:
                continue
            counts = np.bincount(text, minlength=256) if len(text) <= SEGMENT else sum(np.bincount(text[k : k + SEGMENT], minlength=256) for k in range(0, len(text), SEGMENT))
            share = counts[counts > 0] / len(text)
            letters = max(1.0, float(counts @ LETTER))
            pairs = mix(words[:-1] * np.uint64(BASE) + words[1:])
            kinds, often = np.unique(words, return_counts=True)
            edges = np.r_[-1, np.flatnonzero(text == 10), len(text)]
            lines = (edges[1:] - edges[:-1] - 1).astype(float)
            out[i] = (
                math.log1p(n), size.mean(), size.std(), len(kinds) / n ** 0.8, len(np.unique(pairs)) / max(1, n - 1),
                (words[1:] == words[:-1]).mean() if n > 1 else 0.0, often.max() / n,
                float(counts @ UPPER) / letters, float(counts @ DIGIT) / len(text), float(counts @ SIGN) / len(text),
                counts[33] / n, counts[124] / n, counts[128:].sum() / len(text), -float((share * np.log2(share)).sum()),
                math.log1p(lines.mean()), (lines < 20).mean(), 1 - len(np.unique(_line_hashes(text, edges))) / len(lines), np.isin(last, (33, 46, 63)).mean(),
            )
    return out


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of each whole text."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                x = statistics(part.column(1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, x array<double>")


class Model:
    """Means, spreads, ridge weights and the calibrated curve; a few kilobytes."""

    def __init__(self, mean, spread):
        self.mean, self.spread = np.array(mean), np.array(spread)
        self.weights, self.curve = None, None

    def lift(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        return np.c_[np.ones(len(z)), math.sqrt(2 / FEATURES) * np.cos(z @ DIRECTIONS + PHASES)]

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.lift(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)
        return np.clip(np.interp(raw, *self.curve), 0.0, 1.0)


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(STATISTICS))


def _normal_equations(train: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray, int]:
    """Sums of z z' and z y, first within each partition, then in about the root of their number of groups."""
    shared = train.sparkSession.sparkContext.broadcast(model)
    groups = max(1, math.isqrt(train.rdd.getNumPartitions()))
    size = FEATURES + 1

    def part(batches):
        from pyspark import TaskContext

        total = np.zeros((size, size + 2))
        for batch in batches:
            z, y = shared.value.lift(_rows(batch.column(0))), batch.column(1).to_numpy().astype(float)
            total[:, :size] += z.T @ z
            total[:, size] += z.T @ y
            total[0, size + 1] += len(y)
        if total[0, size + 1]:
            group = TaskContext.get().partitionId() % groups
            yield pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([total.tobytes()])], ["g", "sums"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py()) for x in table.column("sums"))
        return pa.table({"g": table.column("g").slice(0, 1), "sums": pa.array([total.tobytes()])})

    sums = train.select("x", "y").mapInArrow(part, "g int, sums binary").groupBy("g").applyInArrow(add, "g int, sums binary")
    total = sum((np.frombuffer(r["sums"]).reshape(size, size + 2) for r in sums.collect()), np.zeros((size, size + 2)))
    return total[:, :size], total[:, size], int(total[0, size + 1])


def isotonic(position: np.ndarray, n: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: a rising curve through the pools' means."""
    pools: list[list[float]] = []
    for p, count, ones in zip(position, n, good, strict=True):
        pools.append([p * count, count, ones])
        while len(pools) > 1 and pools[-2][2] / pools[-2][1] >= pools[-1][2] / pools[-1][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[1] for p in pools]), np.array([(p[2] + 0.5 * 1e-3) / (p[1] + 1e-3) for p in pools])


def fit(labelled: DataFrame) -> Model | float:
    """Fit ``labelled(doc_id, x, y)``; rows of fold 3 calibrate, the others give the weights.

    Where a side lacks one of the labels, all rows serve both. With one label
    only, or none, the result is a constant score.
    """
    sides = {bool(r["c"]): r for r in labelled.groupBy((fold("doc_id") == 3).alias("c")).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("ones")).collect()}
    n, ones = sum(r["n"] for r in sides.values()), sum(r["ones"] for r in sides.values())
    if not n or not 0 < ones < n:
        return ones / n if n else 0.5
    split = all(s in sides and 0 < sides[s]["ones"] < sides[s]["n"] for s in (True, False)) and n >= 400
    train, rest = (labelled.where(fold("doc_id") != 3), labelled.where(fold("doc_id") == 3)) if split else (labelled, labelled)
    places = range(len(STATISTICS))
    row = train.agg(*[F.avg(F.col("x")[i]) for i in places], *[F.stddev_pop(F.col("x")[i]) for i in places]).first()
    model = Model(row[: len(places)], [s or 1.0 for s in row[len(places) :]])
    gram, moment, count = _normal_equations(train, model)
    penalty = RIDGE * count * np.eye(len(gram))
    penalty[0, 0] = 0
    model.weights = np.linalg.solve(gram + penalty, moment)
    shared = labelled.sparkSession.sparkContext.broadcast(model)

    def steps(batches):
        for batch in batches:
            raw = np.clip(shared.value.raw(_rows(batch.column(0))), -0.5, 1.5)
            yield pa.RecordBatch.from_arrays([pa.array(((raw + 0.5) / 2 * (STEPS - 1)).astype(np.int32)), batch.column(1)], ["step", "y"])

    bins = rest.select("x", "y").mapInArrow(steps, "step int, y int").groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("ones")).orderBy("step").collect()
    step, n_, good = (np.array([r[k] for r in bins], float) for k in ("step", "n", "ones"))
    model.curve = isotonic(step / (STEPS - 1) * 2 - 0.5, n_, good)
    return model


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score every whole text of ``docs`` by ``labels(doc_id, quality)`` outside fold 2.

    Returns doc_id, held_out, score (0 to 1), predicted (1 from CUT on). Null,
    empty and blank texts have statistics of 0 and are scored like others.
    Rows without a quality of 0 or 1 are no labels; repeated labels count each.
    Null ids are scored, never learned from; repeated rows are returned each.
    An empty table gives an empty result; without labels the score is 0.5.
    Other columns are ignored: only the text is an input of the score. A very
    long text is measured in segments by one task.
    """
    measured = save(measure(docs))
    known = labels.where("quality in (0, 1)").where(fold("doc_id") != 2).select("doc_id", F.col("quality").cast("int").alias("y"))
    model = fit(save(known.join(measured, "doc_id").select("doc_id", "x", "y")))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            known = shared.value
            score = np.full(batch.num_rows, known) if isinstance(known, float) else known.score(_rows(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score.astype(float))], ["doc_id", "score"])

    scored = measured.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (fold("doc_id") == 2).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
