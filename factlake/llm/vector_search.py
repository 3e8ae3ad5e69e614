"""Approximate nearest neighbours by balanced posting lists (largest inner product)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.llm.storage import first_rows, read_table, save

#: Vectors that the first centroids are fitted on at most, drawn by a hash; and of a sample in a list at most.
SAMPLE, LIST = 16384, 24
#: Vectors that a list has on average at most: beyond it the list of a first centroid is split, into SUBLISTS at most.
LIST_ROWS, SUBLISTS = 500, 512
#: Neighbouring lists that a task searches together; vectors of such a shard in one task on average.
SHARD, BLOCK = 32, 20_000
#: A vector is also put in lists up to this ratio of its nearest centroid's distance, COPIES lists at most.
NEAR_RATIO, COPIES = 1.05, 2
#: A search reads all lists up to this ratio of the nearest centroid's distance. The graph is walked with BEAM lists in
#: view, and with four times as many as long as the last of them is nearer than that.
SEARCH_RATIO, BEAM = 1.25, 512
#: Distances that a task holds at a time while it looks for lists.
DISTANCES = 1 << 22
#: Lists that a search reads in any case, before the others; spare points against rounding.
FIRST, TIES = 16, 4
#: Half-octaves of norms above and below the most frequent one that share a band; a band's sample is at least LEAST.
WIDTH, LEAST = 1, 256
#: Links of a centroid in the graph.
DEGREE = 24


def reach(ratio: float, nearest: np.ndarray) -> np.ndarray:
    """Distance up to which lists are read; all of them with an infinite ratio."""
    return nearest * ratio if np.isfinite(ratio) else nearest + np.inf


@dataclass
class Band:
    """Lists of vectors of similar norm: the first centroids, the graph over them, and the centroids they are split into.

    Lists are numbered from ``base``. ``parts[c]`` are the centroids of the
    lists of first centroid c, ``start[c]`` is the first of them. All bands
    have 2 * SAMPLE / LIST first centroids and SUBLISTS times as many lists at
    most, some 10**5 in all, so they may be broadcast.
    """

    base: int
    centroids: np.ndarray
    links: np.ndarray
    longest: float
    parts: list[np.ndarray] | None = None
    start: np.ndarray | None = None

    @property
    def n_lists(self) -> int:
        return len(self.centroids) if self.parts is None else int(self.start[-1])

    def nearest(self, rows: np.ndarray, ratio: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(lists, distances) of each row, nearest first; infinite where there are no more."""
        ids, dist = walk(rows, self.centroids, self.links, beam)
        if self.parts is None:
            return ids + self.base, dist
        out_ids, out_dist = np.zeros((len(rows), beam), int), np.full((len(rows), beam), np.inf)
        for k, row in enumerate(rows):
            # A part may be nearer than the whole, so a few more first centroids are opened than the ratio has.
            cells = ids[k, np.isfinite(dist[k]) & ((dist[k] <= reach(ratio, dist[k, 0])) | (np.arange(ids.shape[1]) < 4))]
            near = np.concatenate([self.start[c] + np.arange(len(self.parts[c])) for c in cells])
            d = np.concatenate([((self.parts[c] - row) ** 2).sum(axis=1) for c in cells])
            order = np.argsort(d, kind="stable")[:beam]
            out_ids[k, : len(order)], out_dist[k, : len(order)] = near[order], np.sqrt(d[order])
        return out_ids + self.base, out_dist


def usable(column: str) -> Column:
    """Neither null nor zero, all components there and finite."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(column).isNotNull() & ~bad & F.exists(column, lambda x: x != 0)


def log_norm(column: str) -> Column:
    """Binary logarithm of a usable vector's norm; neither large nor small components overflow."""
    most = F.array_max(F.transform(column, lambda x: F.abs(x).cast("double")))
    return F.log2(most) + F.log2(F.aggregate(column, F.lit(0.0), lambda a, x: a + (x / most) * (x / most))) / 2


def norm_bands(counts: dict[int, int]) -> dict[int, int]:
    """A band for each half-octave of norms, from ``{half-octave: vectors}``.

    A few long vectors would lift all others to nearly one point, so vectors
    are lifted to the longest of their band only. Each band is made around the
    most frequent half-octave that is left, so common norms aren't cut apart.
    """
    out: dict[int, int] = {}
    bands = 0
    for half in sorted(counts, key=lambda h: (-counts[h], h)):
        if half not in out:
            out |= {h: bands for h in range(half - WIDTH, half + WIDTH + 1) if h in counts and h not in out}
            bands += 1
    return out


def lift(vectors: np.ndarray, longest: float) -> np.ndarray:
    """One more component makes all norms equal, so the largest product is the smallest distance."""
    rest = np.sqrt(np.maximum(0.0, longest**2 - (vectors**2).sum(axis=1)))
    return np.concatenate([vectors, rest[:, None]], axis=1).astype(np.float32)


def balanced_centroids(points: np.ndarray, most: int, rng: np.random.Generator) -> np.ndarray:
    """Split clusters in two until none holds more than ``most`` points; uneven splits are cut at the median."""
    out, todo = [], [np.arange(len(points))]
    while todo:
        own = todo.pop()
        x = points[own]
        if len(own) <= most:
            out.append(x.mean(axis=0))
            continue
        two = x[rng.choice(len(own), 2, replace=False)]
        for _ in range(8):
            near = ((x - two[0]) ** 2).sum(axis=1) - ((x - two[1]) ** 2).sum(axis=1)
            side = near > 0
            if side.all() or not side.any():
                break
            two = np.stack([x[~side].mean(axis=0), x[side].mean(axis=0)])
        if not 0.2 < side.mean() < 0.8:
            side = np.zeros(len(own), bool)
            side[np.argsort(near, kind="stable")[len(own) // 2 :]] = True
        todo += [own[~side], own[side]]
    return np.array(out, np.float32)


def link(centroids: np.ndarray) -> np.ndarray:
    """The DEGREE nearest other centroids of each, half of them long links to any."""
    n = len(centroids)
    rng = np.random.default_rng(5)
    norms = (centroids**2).sum(axis=1)
    out = []
    for at in range(0, n, 1024):
        d = norms[None] - 2 * centroids[at : at + 1024] @ centroids.T
        k = min(DEGREE, n)
        near = np.argpartition(d, k - 1, axis=1)[:, :k]
        out.append(np.concatenate([near, rng.integers(0, n, (len(d), max(1, DEGREE // 4)))], axis=1))
    return np.concatenate(out)


def walk(queries: np.ndarray, centroids: np.ndarray, links: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of the graph, all queries in step: (centroids, distances) of each, nearest first."""
    n, m = len(queries), len(centroids)
    norms = (centroids**2).sum(axis=1)
    own = (queries**2).sum(axis=1)
    if beam >= m:  # all are in view
        dist = own[:, None] + norms - 2 * queries @ centroids.T
        order = np.argsort(dist, axis=1, kind="stable")
        return order, np.sqrt(np.maximum(np.take_along_axis(dist, order, axis=1), 0))

    def distance(rows: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return own[rows, None] + norms[ids] - 2 * np.einsum("nd,nkd->nk", queries[rows], centroids[ids])

    everyone = np.arange(n)
    seen = np.zeros((n, m), bool)
    ids = np.tile(np.linspace(0, m - 1, min(beam, 32)).astype(int), (n, 1))
    seen[everyone[:, None], ids] = True
    dist = distance(everyone, ids)
    open_ = np.ones_like(ids, bool)
    width = 4  # nodes that each query expands in a step
    while True:
        best = np.argsort(np.where(open_, dist, np.inf), axis=1)[:, :width]
        live = np.flatnonzero(np.take_along_axis(open_, best, axis=1).any(axis=1))
        if not len(live):
            break
        rows = live[:, None]
        grown = links[ids[rows, best[live]]].reshape(len(live), -1)
        open_[rows, best[live]] = False
        grown.sort(axis=1)
        fresh = ~seen[rows, grown]
        fresh[:, 1:] &= grown[:, 1:] != grown[:, :-1]
        seen[rows, grown] = True
        far = np.where(fresh, distance(live, grown), np.inf)
        size = min(beam, ids.shape[1] + grown.shape[1])
        new_ids, new_dist, new_open = (np.full((n, size), fill, kind) for fill, kind in ((0, int), (np.inf, dist.dtype), (False, bool)))
        keep = min(size, ids.shape[1])
        new_ids[:, :keep], new_dist[:, :keep], new_open[:, :keep] = ids[:, :keep], dist[:, :keep], open_[:, :keep]
        all_ids, all_dist, all_open = np.c_[ids[live], grown], np.c_[dist[live], far], np.c_[open_[live], fresh]
        order = np.argsort(all_dist, axis=1)[:, :size]
        new_ids[live], new_dist[live], new_open[live] = (np.take_along_axis(x, order, axis=1) for x in (all_ids, all_dist, all_open))
        ids, dist, open_ = new_ids, new_dist, new_open & np.isfinite(new_dist)
    order = np.argsort(dist, axis=1)
    return np.take_along_axis(ids, order, axis=1), np.sqrt(np.maximum(np.take_along_axis(dist, order, axis=1), 0))


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.float64)


def _own_lists(points: DataFrame, shared, ratio: float = NEAR_RATIO, most: int = COPIES) -> DataFrame:
    """``points(id, first, vec, half)`` with a list, once for each list of its band that is near enough."""

    def run(batches):
        band_of, bands = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                vectors, own = _matrix(part.column(2)), np.array([band_of[h] for h in part.column(3).to_pylist()])
                for band in np.unique(own):
                    rows = np.flatnonzero(own == band)
                    ids, dist = bands[band].nearest(lift(vectors[rows] / bands[band].longest, 1.0), ratio, 32)
                    near = (dist <= ratio * dist[:, :1]) & np.isfinite(dist)
                    near[:, 0], near[:, most:] = True, False
                    row, col = np.nonzero(near)
                    who = pa.array(rows[row])
                    yield pa.RecordBatch.from_arrays([pa.array(ids[row, col].astype(np.int32)), *(part.column(k).take(who) for k in range(3))], ["list", "id", "first", "vec"])

    return points.select("id", "first", "vec", "half").mapInArrow(run, f"list int, id long, first long, vec {points.schema['vec'].dataType.simpleString()}")


def within(band: Band, asked: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, rank, list) of all lists of a band that are within the ratio of each row's nearest, and of its FIRST nearest."""
    found, todo, beam = [], np.arange(len(asked)), BEAM
    while len(todo):
        wider = []
        for at in range(0, len(todo), max(1, DISTANCES // min(beam, band.n_lists))):
            own = todo[at : at + max(1, DISTANCES // min(beam, band.n_lists))]
            ids, dist = band.nearest(asked[own], ratio, min(beam, band.n_lists))
            near = np.isfinite(dist) & ((dist <= reach(ratio, dist[:, :1])) | (np.arange(dist.shape[1]) < FIRST))
            # Where the last list in view is within the ratio there may be more.
            more = near[:, -1] & (dist.shape[1] > FIRST) & (beam < band.n_lists)
            row, rank = np.nonzero(near & ~more[:, None])
            found.append((own[row], rank, ids[row, rank]))
            wider.append(own[more])
        todo, beam = np.concatenate(wider), beam * 4
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 3


def _probes(points: DataFrame, shared, ratio: float = SEARCH_RATIO) -> DataFrame:
    """(shard, near, far, reach, id, vec): the lists that each of ``points(id, vec)`` reads, one row for each shard of them.

    near are the query's FIRST nearest lists of a band, far the others. reach
    is the largest product that the query can have with a vector of the band.
    """

    def run(batches):
        _, bands = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                vectors = _matrix(part.column(1))
                scale = np.abs(vectors).max(axis=1)  # of any length; their further component is 0
                norm = np.linalg.norm(vectors / scale[:, None], axis=1)
                asked = np.c_[vectors / scale[:, None] / norm[:, None], np.zeros(len(vectors))].astype(np.float32)
                for band in bands:
                    row, col, lists = within(band, asked, ratio)
                    order = np.lexsort((col, lists // SHARD, row))
                    row, col, lists = row[order], col[order], lists[order]
                    cut = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (lists[1:] // SHARD != lists[:-1] // SHARD)]) if len(row) else np.zeros(0, int)
                    ends = np.r_[cut[1:], len(row)] if len(cut) else cut
                    near = [lists[a:b][col[a:b] < FIRST] for a, b in zip(cut, ends, strict=True)]
                    far = [lists[a:b][col[a:b] >= FIRST] for a, b in zip(cut, ends, strict=True)]
                    who = pa.array(row[cut])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array((lists[cut] // SHARD).astype(np.int32)), pa.array(near, pa.list_(pa.int32())), pa.array(far, pa.list_(pa.int32())),
                            pa.array((norm * scale)[row[cut]] * band.longest), part.column(0).take(who), part.column(1).take(who),
                        ],
                        ["shard", "near", "far", "reach", "id", "vec"],
                    )

    return points.select("id", "vec").mapInArrow(run, f"shard int, near array<int>, far array<int>, reach double, id long, vec {points.schema['vec'].dataType.simpleString()}")


def rounded(scores: np.ndarray) -> np.ndarray:
    """To 36 binary digits, so that equal products that were summed differently are equal."""
    digits, power = np.frexp(scores)
    return np.ldexp(np.round(digits * 2.0**36) / 2.0**36, power)


def _best(postings: DataFrame, probes: DataFrame, k: int) -> DataFrame:
    """(query, id, first, score): per shard and block the k best of the lists that each query reads, if they reach its ``least`` score.

    Ties go to the smaller ``first``, the smallest vec_id of a point.
    """

    def run(block: pa.Table, queries: pa.Table) -> pa.Table:
        names, kinds = ["query", "id", "first", "score"], [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        found = []
        if block.num_rows and queries.num_rows:
            block = block.sort_by([("list", "ascending")])
            x, lists = _matrix(block.column("vec").combine_chunks()), block.column("list").to_numpy()
            ids, first = block.column("id").to_numpy(), block.column("first").to_numpy()
            for at in range(0, queries.num_rows, 1024):
                part = queries.slice(at, 1024)
                asked, least = _matrix(part.column("vec").combine_chunks()), part.column("least").to_numpy()
                wanted = part.column("lists").combine_chunks()
                row = np.repeat(np.arange(part.num_rows), wanted.value_lengths().to_numpy())
                wanted = wanted.flatten().to_numpy()
                hits = []
                for number in np.unique(wanted):
                    lo, hi = np.searchsorted(lists, [number, number + 1])
                    if lo == hi:
                        continue
                    who = row[wanted == number]
                    scores = rounded(asked[who] @ x[lo:hi].T)
                    bound = least[who]
                    if hi - lo > k:
                        bound = np.maximum(bound, np.partition(scores, hi - lo - k, axis=1)[:, hi - lo - k])
                    r, c = np.nonzero(scores >= bound[:, None])
                    hits.append((who[r], lo + c, scores[r, c]))
                if hits:
                    who, place, score = (np.concatenate(h) for h in zip(*hits, strict=True))
                    order = np.lexsort((ids[place], first[place], -score, who))
                    who, place, score = who[order], place[order], score[order]
                    fresh = np.r_[True, (who[1:] != who[:-1]) | (ids[place[1:]] != ids[place[:-1]])] if len(who) else np.zeros(0, bool)
                    who, place, score = who[fresh], place[fresh], score[fresh]
                    rank = np.arange(len(who)) - np.searchsorted(who, who)
                    keep = rank < k
                    found.append((part.column("id").to_numpy()[who[keep]], ids[place[keep]], first[place[keep]], score[keep]))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [[], [], [], []]
        return pa.table([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names)

    both = postings.groupBy("shard", "block").cogroup(probes.groupBy("shard", "block"))
    return both.applyInArrow(run, "query long, id long, first long, score double")


def _split_lists(classes: DataFrame, shared, n: int) -> None:
    """Give the bands of ``shared`` centroids that split the lists of their first ones, in proportion to their vectors.

    Each is fitted in a task of its own on a sample of its vectors, LIST for a
    list to come, so a list has about LIST_ROWS vectors however many there are.
    """
    band_of, bands = shared.value
    own = save(_own_lists(classes, shared, 1.0, 1).select("list", "id", "vec"))
    counts = {r["list"]: r["count"] for r in own.groupBy("list").count().collect()}  # a row a first centroid
    draw = F.pmod(F.xxhash64("id", F.lit("part")), F.lit(1 << 20)) / float(1 << 20)
    rates = F.broadcast(own.sparkSession.createDataFrame([(c, min(1.0, LIST / LIST_ROWS, LIST * SUBLISTS / m)) for c, m in counts.items()], "list int, rate double"))

    def fit(table: pa.Table) -> pa.Table:
        number = table.column("list")[0].as_py()
        band = next(b for b in bands if b.base <= number < b.base + len(b.centroids))
        points = lift(_matrix(table.column("vec").combine_chunks()) / band.longest, 1.0)
        found = balanced_centroids(points, LIST, np.random.default_rng(number))
        return pa.table({"list": pa.array([number], pa.int32()), "centroids": pa.array([found.tobytes()])})

    fitted = own.join(rates, "list").where(draw < F.col("rate")).select("list", "vec").groupBy("list").applyInArrow(fit, "list int, centroids binary")
    fitted = {r["list"]: np.frombuffer(r["centroids"], np.float32).reshape(-1, bands[0].centroids.shape[1]) for r in fitted.collect()}
    base = 0
    for band in bands:
        band.parts = [fitted.get(band.base + c, band.centroids[c : c + 1]) for c in range(len(band.centroids))]
        band.start = np.cumsum([0, *map(len, band.parts)])
        band.base = base
        base += -(-band.n_lists // SHARD) * SHARD


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, ratio: float = SEARCH_RATIO) -> DataFrame:
    """The k rows of ``vectors(vec_id, embedding)`` with the largest inner product with each row of ``queries``.

    Returns query_id, rank (from 1), vec_id, score: nearest first, ties to the
    smaller vec_id, all candidates if there are fewer. A query's own vec_id is
    no candidate. Vectors that are null, zero, or hold null or non-finite
    components take no part, and neither do those of another length than the
    most common one (ties to the longer), nor null ids. Equal vectors are one
    point of the index with the smallest ids that could be asked for; rows
    that repeat an id and vector count once. Empty tables give empty results;
    other columns are ignored. Scores are summed in double precision from the
    original vectors. Vectors of similar norm form a band, which has lists of
    its own and is skipped where its longest vector can't reach a query's k-th
    score. The first centroids are fitted on SAMPLE vectors at most (and LEAST
    a rare band), those that split their lists on LIST vectors a list; every
    vector is put in the lists. A query's vector is sent once to each shard of
    SHARD neighbouring lists that it reads, not once a list. It reads all lists
    within ``ratio`` of its nearest one, however many there are; an infinite
    ratio reads every list, so the result is exact.
    """
    spark = vectors.sparkSession

    def clean(df: DataFrame) -> DataFrame:
        single = df.schema["embedding"].dataType.simpleString() == "array<float>"  # stored as it is, summed in double precision
        df = df.select("vec_id", F.col("embedding").cast("array<float>" if single else "array<double>").alias("vec"))
        return df.where(F.col("vec_id").isNotNull() & usable("vec"))

    points = clean(vectors)
    size = points.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    dim = size["dim"] if size else 0
    cls = F.concat(*[F.lpad(F.hex(h), 16, "0") for h in (F.xxhash64("vec"), F.xxhash64(F.reverse("vec")))])
    points = points.where(F.size("vec") == dim).withColumn("cls", cls)

    def smallest(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch]).sort_by([("cls", "ascending"), ("vec_id", "ascending")])
            names, ids = np.array(table.column("cls").to_pylist(), object), table.column("vec_id").to_pylist()
            cut = np.r_[0, np.flatnonzero(names[1:] != names[:-1]) + 1, len(names)] if len(names) else np.zeros(1, int)
            own = [list(dict.fromkeys(ids[a:b]))[: k + 1] for a, b in zip(cut[:-1], cut[1:], strict=True)]
            first = pa.array(cut[:-1])
            yield pa.RecordBatch.from_arrays(
                [table.column("cls").combine_chunks().take(first), table.column("vec").combine_chunks().take(first), pa.array(own, pa.list_(pa.int64()))],
                ["cls", "vec", "ids"],
            )

    classes = points.select("cls", "vec", "vec_id").mapInArrow(smallest, f"cls string, vec {points.schema['vec'].dataType.simpleString()}, ids array<long>")
    ids = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1)
    classes = classes.groupBy("cls").agg(F.first("vec").alias("vec"), ids.alias("ids"))
    classes = classes.select(F.monotonically_increasing_id().alias("id"), "cls", "vec", "ids", F.col("ids")[0].alias("first"), log_norm("vec").alias("log_norm"))
    classes = save(classes.withColumn("half", F.floor(F.col("log_norm") * 2).cast("int")))

    norms = classes.groupBy("half").agg(F.count(F.lit(1)), F.max("log_norm")).collect()  # some thousand rows at most
    band_of = norm_bands({half: count for half, count, _ in norms})
    size, longest = {b: 0 for b in band_of.values()}, {b: -np.inf for b in band_of.values()}
    for half, count, log in norms:
        size[band_of[half]] += count
        longest[band_of[half]] = max(longest[band_of[half]], log)
    n = sum(size.values())
    rates = spark.createDataFrame([(h, min(1.0, max(SAMPLE * size[b] / n, LEAST) / size[b])) for h, b in band_of.items()], "half int, rate double")
    draw = F.conv(F.substring("cls", 1, 8), 16, 10).cast("double") / 2.0**32
    drawn = classes.join(F.broadcast(rates), "half").where(draw < F.col("rate")).select("cls", "vec", "half").limit(2 * SAMPLE + 2 * LEAST * len(size)).collect()
    drawn.sort(key=lambda r: r["cls"])
    bands, base = [], 0
    for number in sorted(size):
        own = np.array([r["vec"] for r in drawn if band_of[r["half"]] == number], float).reshape(-1, dim)
        most = float(np.exp2(longest[number]))
        fitted = lift(own / most, 1.0) if len(own) else np.zeros((1, dim + 1), np.float32)
        centroids = balanced_centroids(fitted, LIST, np.random.default_rng(3))
        bands.append(Band(base, centroids, link(centroids), most))
        base += -(-len(centroids) // SHARD) * SHARD
    shared = spark.sparkContext.broadcast((band_of, bands))
    if n > LIST_ROWS * sum(len(b.centroids) for b in bands):
        _split_lists(classes, shared, n)
        shared = spark.sparkContext.broadcast((band_of, bands))

    asked = save(clean(queries).where(F.size("vec") == dim).withColumn("cls", cls).select("vec_id", "cls", "vec").distinct())
    points = asked.groupBy("cls").agg(F.first("vec").alias("vec"))
    points = save(points.select(F.monotonically_increasing_id().alias("id"), "cls", "vec"))
    tasks = max(spark.sparkContext.defaultParallelism, points.count() // 1000)
    postings = save(_own_lists(classes.repartition(max(tasks, n // 20_000), "id"), shared).withColumn("shard", F.floor(F.col("list") / SHARD).cast("int")))
    counts = postings.groupBy("shard").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / BLOCK)).cast("int").alias("blocks"))
    counts = save(counts)  # a row for SHARD lists, of which there are some 10**5 at most
    postings = postings.join(F.broadcast(counts), "shard").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    postings = postings.select("shard", "block", "list", "id", "first", "vec")
    probes = save(_probes(points.select("id", "vec").repartition(tasks, "id"), shared, ratio))
    probes = probes.join(F.broadcast(counts), "shard").withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)")))
    # The nearest lists come first; the k-th score there is what others must reach.
    lowest = F.lit(float("-inf"))
    start = probes.where("size(near) > 0").select("shard", "block", F.col("near").alias("lists"), "id", "vec", lowest.alias("least"))
    first = save(_best(postings, start, k + 1).groupBy("query", "id", "first").agg(F.max("score").alias("score")))
    least = first.groupBy("query").agg(F.try_element_at(F.reverse(F.array_sort(F.collect_list("score"))), F.lit(k + 1)).alias("least"))
    rest = probes.where("size(far) > 0").join(least.withColumnRenamed("query", "id"), "id", "left").withColumn("least", F.coalesce("least", lowest))
    rest = rest.where("reach >= least - 1e-9 * abs(least)").select("shard", "block", F.col("far").alias("lists"), "id", "vec", "least")
    found = first.unionByName(_best(postings, rest, k + 1)).groupBy("query", "id", "first").agg(F.max("score").alias("score"))
    found = first_rows(found, ["query"], [F.desc("score"), F.col("first"), F.col("id")], k + 1 + TIES)
    found = found.select("query", "id").join(classes.select("id", F.col("vec").alias("found"), "ids"), "id")
    found = found.join(points.select(F.col("id").alias("query"), "cls", "vec"), "query")
    score = F.aggregate(F.zip_with("vec", "found", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, x: a + x)
    found = found.select("cls", F.explode(F.transform("ids", lambda i: F.struct((-score).alias("far"), i.alias("vec_id")))).alias("hit"))
    best = found.groupBy("cls").agg(F.slice(F.array_sort(F.collect_list("hit")), 1, k + 1).alias("hits"))
    out = asked.select(F.col("vec_id").alias("query_id"), "cls").join(best, "cls")
    own = F.slice(F.filter("hits", lambda h: h["vec_id"] != F.col("query_id")), 1, k)
    out = out.select("query_id", F.posexplode(own).alias("rank", "hit"))
    return out.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.far")).alias("score"))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"), 20)
