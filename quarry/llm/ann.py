"""Approximate nearest neighbours by inner product, on shifted space-filling curves.

Vectors get one more coordinate that brings all to the same length, so the largest inner product is the smallest distance. Each of several
random rotations keeps a few coordinates, shifts them, and orders all vectors by their place on a Hilbert curve. Each order is cut into
ranges of about block_rows vectors, dealt out by Spark; a query visits the ranges within `reach` of its own on every curve, each gives its best,
and these merge, once per vector, by their exact inner products.

reach is measured, not fixed: for a sample of queries all vectors are searched, and reach is the least that finds `target` of their true
neighbours. Clustered vectors need one range or two; vectors without any structure need many, as no index helps with those.

The index's scales come from at most FIT_ROWS vectors; every vector is indexed. Equal vectors are one entry with the smallest ids
(no more than can be answers), so a vector with many copies fills no range. Cuts are quantiles of all keys, and ranges grow in number with the vectors,
up to MAX_RANGES a curve. A range that still has many vectors or many queries, as where near-equal vectors share a cell, is searched in parts: each
part of its vectors by each part of its queries, so no group grows with the data."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

CURVES = 8
DIMENSIONS = 6
BITS = 10
BLOCK_ROWS = 1024
FIT_ROWS = 20_000
MAX_RANGES = 16_384
QUERY_ROWS = 4096
CALIBRATION_QUERIES = 64
TARGET = 0.96
SALTS = 64
# Results order by themselves: the score with its sign turned, then the entry.
SCORED = "array<struct<down:double,entry:long>>"
_SCORED = pa.list_(pa.struct([("down", pa.float64()), ("entry", pa.int64())]))


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each row of cells (rows, dimensions; integers below 2^bits) on the Hilbert curve; dimensions * bits is at most 63.

    From the highest bit down, cells are turned into the frame of the sub-cube that they lie in; the Gray code of what remains is the place."""
    x = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    d = len(x)
    for level in range(bits - 1, 0, -1):
        top, low = np.int64(1 << level), np.int64((1 << level) - 1)
        for i in range(d):
            high = (x[i] & top) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, d):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn = np.where(x[d - 1] & np.int64(1 << level), turn ^ np.int64((1 << level) - 1), turn)
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(d):
            key = key << 1 | ((x[i] ^ turn) >> level & 1)
    return key


@dataclass
class Index:
    """What workers need to place a vector: rotations, scales, shifts."""

    longest: float
    rotations: list[np.ndarray]
    means: list[np.ndarray]
    spreads: list[np.ndarray]
    shifts: list[np.ndarray]

    def _keys(self, curve: int, lifted: np.ndarray) -> np.ndarray:
        z = (lifted @ self.rotations[curve] - self.means[curve]) / self.spreads[curve]
        u = 1 / (1 + np.exp(-1.702 * np.clip(z, -20, 20)))  # close to the normal distribution's curve: cells fill evenly
        return hilbert_keys(((u + self.shifts[curve]) / 2 * (1 << BITS)).astype(np.int64), BITS)

    def lift(self, x: np.ndarray, as_query: bool) -> np.ndarray:
        norm = np.sqrt((x * x).sum(axis=1))
        if as_query:
            return np.column_stack((x * (self.longest / norm)[:, None], np.zeros(len(x))))
        return np.column_stack((x, np.sqrt(np.maximum(self.longest**2 - norm**2, 0))))

    def keys(self, x: np.ndarray, as_query: bool) -> np.ndarray:
        """A row for each row of x: its place on each curve."""
        lifted = self.lift(x, as_query)
        return np.column_stack([self._keys(c, lifted) for c in range(len(self.rotations))])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=np.float64).reshape(len(column), -1)


def entries(vectors: DataFrame, keep: int) -> DataFrame:
    """vectors: (vec_id, embedding array<double>). One row for equal vectors: (entry: smallest id, embedding, ids: the keep smallest)."""
    few = Window.partitionBy("embedding", F.pmod("vec_id", F.lit(SALTS))).orderBy("vec_id")
    some = vectors.withColumn("place", F.row_number().over(few)).where(F.col("place") <= keep)
    return some.groupBy("embedding").agg(F.slice(F.array_sort(F.collect_list("vec_id")), 1, keep).alias("ids")).select(F.element_at("ids", 1).alias("entry"), "embedding", "ids")


def _best(queries: np.ndarray, base: np.ndarray, ids: np.ndarray, k: int) -> list[list[dict]]:
    """For each query its k best rows of base, ties to smaller ids. Scores are summed in order of the components."""
    near = queries @ base.T
    if len(ids) > k:
        edge = np.partition(near, len(ids) - k, axis=1)[:, len(ids) - k]
        q, b = np.nonzero(near >= (edge - 1e-9 * np.maximum(1, np.abs(edge)))[:, None])
    else:
        q, b = (x.ravel() for x in np.indices(near.shape))
    score = np.zeros(len(q))
    for j in range(base.shape[1]):
        score += queries[q, j] * base[b, j]
    order = np.lexsort((ids[b], -score, q))
    q, b, score = q[order], b[order], score[order]
    first = np.searchsorted(q, np.arange(len(queries)))
    out = []
    for i in range(len(queries)):
        stop = min(first[i] + k, first[i + 1] if i + 1 < len(queries) else len(q))
        out.append([{"down": -s, "entry": e} for s, e in zip(score[first[i] : stop].tolist(), ids[b[first[i] : stop]].tolist())])
    return out


def _merged(found: DataFrame, k: int, times: int) -> DataFrame:
    """(query, best): the k best of all partial results, each entry once. An entry comes at most `times` times, so the k best are among the
    first k * times."""
    by = F.slice(F.sort_array(F.flatten(F.collect_list("best"))), 1, k * times)
    return found.groupBy("query").agg(F.slice(F.array_distinct(by) if times > 1 else by, 1, k).alias("best"))


def fit_index(known: DataFrame, curves: int = CURVES, dimensions: int = DIMENSIONS, seed: int = 3) -> Index:
    """known: (entry, embedding). Scales from at most FIT_ROWS entries, picked by a hash."""
    longest = known.select(F.max(F.expr("sqrt(aggregate(embedding, 0D, (s, x) -> s + x * x))"))).first()[0]
    sample = _matrix(known.orderBy(F.xxhash64("entry"), "entry").limit(FIT_ROWS).select("embedding").toArrow().column(0).combine_chunks())
    rng = np.random.default_rng(seed)
    width = sample.shape[1] + 1
    index = Index(float(longest), [], [], [], [])
    lifted = index.lift(sample, False)
    for _ in range(curves):
        rotation = np.linalg.qr(rng.normal(size=(width, min(dimensions, width))))[0]
        flat = lifted @ rotation
        index.rotations.append(rotation)
        index.means.append(flat.mean(axis=0))
        index.spreads.append(np.maximum(flat.std(axis=0), 1e-12))
        index.shifts.append(rng.random(rotation.shape[1]) * 0.999)
    return index


def _keyed(df: DataFrame, index: Index, as_query: bool) -> DataFrame:
    """df (entry, embedding) with keys: its place on each curve."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                got = index.keys(_matrix(batch.column(1)), as_query)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got.tolist(), pa.list_(pa.int64()))], names=["entry", "embedding", "keys"])

    return df.select("entry", "embedding").mapInArrow(run, "entry long, embedding array<double>, keys array<long>")


def range_cuts(keyed: DataFrame, ranges: int) -> list[np.ndarray]:
    """For each curve the keys at which its ranges begin: quantiles of all keys, at most MAX_RANGES of them, each once."""
    if ranges < 2:
        return [np.zeros(0, np.int64)] * len(keyed.select("keys").first().keys)
    shares = [i / ranges for i in range(1, ranges)]
    quantiles = keyed.select(F.posexplode("keys").alias("curve", "key")).groupBy("curve").agg(F.percentile_approx("key", shares, 10 * ranges).alias("cuts"))
    return [np.unique(np.array(r.cuts, dtype=np.int64)) for r in sorted(quantiles.collect())]


def _placed(keyed: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    """keyed with blocks in place of keys: its range on each curve."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = np.array(batch.column(2).to_pylist(), dtype=np.int64).reshape(batch.num_rows, -1)
                got = np.column_stack([np.searchsorted(c, keys[:, i], side="right") for i, c in enumerate(cuts)])
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(got.astype(np.int32).tolist(), pa.list_(pa.int32()))], names=["entry", "embedding", "blocks"])

    return keyed.mapInArrow(run, "entry long, embedding array<double>, blocks array<int>")


def _parted(dealt: DataFrame, visits: DataFrame, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with part: the vectors and queries of a range that has many of either meet in several parts, each pair in just one. Vectors of ranges that no
    query visits are left out."""
    sizes = dealt.groupBy("curve", "block").agg(F.count(F.lit(1)).alias("n")).join(visits.groupBy("curve", "block").agg(F.count(F.lit(1)).alias("m")), ["curve", "block"])
    parts = sizes.select("curve", "block", F.ceil(F.col("n") / (2 * block_rows)).cast("int").alias("across"), F.ceil(F.col("m") / QUERY_ROWS).cast("int").alias("down"))
    visited = saved(parts)  # at most CURVES * MAX_RANGES rows

    def split(df: DataFrame, own: str, other: str, number) -> DataFrame:
        wide = df.join(F.broadcast(visited), ["curve", "block"])
        spread = wide.withColumn("mine", F.pmod(F.xxhash64("entry"), F.col(own)).cast("int")).withColumn("theirs", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        return spread.withColumn("part", number).select("entry", "embedding", "curve", "block", "part")

    return split(dealt, "across", "down", F.expr("mine * down + theirs")), split(visits, "down", "across", F.expr("theirs * down + mine"))


def measured_reach(base: DataFrame, queries: DataFrame, k: int, target: float = TARGET, rows: int = CALIBRATION_QUERIES) -> int:
    """The least reach with which target of the true neighbours of rows queries are found; base and queries: (entry, embedding, blocks)."""
    sample = queries.orderBy(F.xxhash64("entry"), "entry").limit(rows).toArrow()
    ids, matrix = sample.column("entry").to_numpy(), _matrix(sample.column("embedding").combine_chunks())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                got = _best(matrix, _matrix(batch.column(1)), batch.column(0).to_numpy(), k)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(got, _SCORED)], names=["query", "best"])

    true = _merged(base.select("entry", "embedding").mapInArrow(run, f"query long, best {SCORED}"), k, 1)
    pairs = true.select("query", F.explode("best").alias("b")).select("query", F.col("b.entry").alias("entry")).where("query <> entry")
    own = queries.select(F.col("entry").alias("query"), F.col("blocks").alias("mine")).join(F.broadcast(pairs), "query")
    gaps = own.join(base.select("entry", "blocks"), "entry").select(F.array_min(F.zip_with("mine", "blocks", lambda a, b: F.abs(a - b))).alias("gap"))
    got = np.sort(np.array([r.gap for r in gaps.collect()]))  # at most rows * k numbers
    return int(got[min(len(got) - 1, int(np.ceil(target * len(got))) - 1)]) if len(got) else 0


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, target: float = TARGET, block_rows: int = BLOCK_ROWS, **options) -> DataFrame:
    """vectors: vec_id, embedding, any more. (query_id, rank from 1, vec_id, score): for each row where is_query holds its k best others.

    Vectors that are null, zero, of another length than most, or hold null or non-finite components take no part, nor do rows with null vec_id;
    rows that repeat a vec_id and its vector count once. Ties go to the smaller vec_id."""
    values = F.transform("embedding", lambda x: x.cast("double"))
    good = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(values, lambda x: x != 0)
    clean = vectors.where("vec_id is not null and embedding is not null").where(good).select(F.col("vec_id").cast("long").alias("vec_id"), values.alias("embedding"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    widths = clean.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if widths is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    clean = clean.where(F.size("embedding") == widths.n).dropDuplicates(["vec_id", "embedding"])
    known = saved(entries(clean, k + 1))
    count = known.count()
    if not count:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = fit_index(known, **options)
    keyed = saved(_keyed(known, index, False))
    cuts = range_cuts(keyed, int(max(1, min(count // block_rows, MAX_RANGES))))
    base = saved(_placed(keyed, cuts))
    asked = saved(clean.where("asks").select("vec_id", "embedding").join(known.select("entry", "embedding"), "embedding").select(F.col("vec_id").alias("query_id"), "entry", "embedding"))
    queries = saved(_placed(_keyed(asked.select("entry", "embedding").dropDuplicates(["entry"]), index, True), cuts))
    reach = measured_reach(base, queries, k + 1, target)
    last = [len(c) for c in cuts]
    spread = F.transform("blocks", lambda b, i: F.struct(i.alias("curve"), F.sequence(F.greatest(b - reach, F.lit(0)), F.least(b + reach, F.element_at(F.array(*[F.lit(x) for x in last]), i + 1))).alias("near")))
    visits = queries.select("entry", "embedding", F.explode(spread).alias("v")).select("entry", "embedding", F.col("v.curve").alias("curve"), F.explode("v.near").alias("block"))
    dealt = base.select("entry", "embedding", F.posexplode("blocks").alias("curve", "block"))
    dealt, visits = _parted(dealt, visits, block_rows)
    top = k + 1

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("query", pa.int64()), ("best", _SCORED)])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        b, ids = _matrix(left.column("embedding").combine_chunks()), left.column("entry").to_numpy()
        order = np.argsort(ids)
        q = _matrix(right.column("embedding").combine_chunks())
        got: list = []
        for at in range(0, len(q), 1024):
            got += _best(q[at : at + 1024], b[order], ids[order], top)
        return pa.Table.from_arrays([right.column("entry").combine_chunks(), pa.array(got, _SCORED)], schema=schema)

    found = dealt.groupBy("curve", "block", "part").cogroup(visits.groupBy("curve", "block", "part")).applyInArrow(search, f"query long, best {SCORED}")
    best = saved(_merged(found, top, len(index.rotations)))
    # Each entry stands for all vectors equal to it.
    opened = best.select("query", F.explode("best").alias("b")).select("query", F.col("b.down").alias("down"), F.col("b.entry").alias("entry")).join(known.select("entry", "ids"), "entry")
    opened = opened.select("query", F.explode(F.transform("ids", lambda x: F.struct(F.col("down").alias("down"), x.alias("vec_id")))).alias("hit"))
    lists = opened.groupBy("query").agg(F.slice(F.array_sort(F.collect_list("hit")), 1, top).alias("hits"))
    answers = asked.select("query_id", F.col("entry").alias("query")).join(lists, "query")
    others = F.slice(F.filter("hits", lambda x: x.vec_id != F.col("query_id")), 1, k)
    return answers.select("query_id", F.posexplode(others).alias("at", "hit")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.down")).alias("score"))
