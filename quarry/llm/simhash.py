"""SimHash near-duplicates, found with a covering family of bit masks.

A document's fingerprint is the bitwise majority of the hashes of its word shingles. Two fingerprints within the radius
agree on all bits of at least one mask of the family, so each linked pair meets in some table: no pair is missed.

Work is per distinct fingerprint; copies only meet again when the class id is joined back. Buckets of few fingerprints are
compared pair by pair. In larger ones each fingerprint is sent to the points within half the radius of it: two fingerprints are
within the radius just if they share such a point, and a point can have no more than 65 fingerprints, so no group grows with the data.
"""

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, small_batches

SEED = 42
BITS = 64
SHINGLE_WORDS = 3
RADIUS = 2
PAIRWISE_LIMIT = 64


def fingerprint(text: str | None, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """Majority fingerprint of a text as a signed 64-bit number; zero for null and for texts without words."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(tokens) > words:
        starts, ends = starts[: len(tokens) - words + 1], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    pieces = map(joined.__getitem__, map(slice, starts.tolist(), ends.tolist()))
    return majority(np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(seed)), dtype="<u8", count=len(starts)))


def majority(hashes: np.ndarray) -> int:
    """A signed 64-bit number whose bits are those set in over half of hashes; zero for none."""
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 4096):
        part = np.ascontiguousarray(hashes[at : at + 4096]).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def _fingerprint_batches(words: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [fingerprint(x.as_py(), words, seed) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.int64())], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, fp long), a row for each input row."""
    return small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(_fingerprint_batches(words, seed), "doc_id long, fp long")


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """2^(radius+1) - 1 masks such that any two words that differ in at most radius bits agree on all bits of some mask.

    Bit i gets a nonzero vector phi(i) of radius+1 bits; mask v holds the bits whose phi has odd overlap with v. Some v is
    orthogonal to the at most radius vectors of the differing bits, so its mask holds none of those bits."""
    kinds = 2 ** (radius + 1) - 1
    phi = [1 + i % kinds for i in range(bits)]
    return [sum(1 << i for i in range(bits) if bin(phi[i] & v).count("1") % 2) for v in range(1, kinds + 1)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def links(nodes: DataFrame, radius: int = RADIUS, pairwise_limit: int = PAIRWISE_LIMIT) -> DataFrame:
    """nodes: (node, fp), fp distinct. Edges (a, b), a > b, whose closure joins all fingerprints within the radius."""
    if radius % 2:
        raise ValueError("points between two fingerprints need an even radius")
    masks = covering_masks(radius)
    tables = nodes.select("node", "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("v", "key"))
    sizes = tables.groupBy("v", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = saved(tables.join(sizes, ["v", "key"]))
    few = met.where(F.col("n") <= pairwise_limit)
    left, right = few.select("v", "key", F.col("node").alias("a"), F.col("fp").alias("fa")), few.select("v", "key", F.col("node").alias("b"), F.col("fp").alias("fb"))
    near = F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= radius
    pairs = left.join(right, ["v", "key"]).where((F.col("a") > F.col("b")) & near).select("a", "b")

    # Beyond the limit: all points within ceil(radius / 2) changes of the bits outside the mask.
    changes = [[0] + [_signed(sum(1 << i for i in c)) for k in range(1, (radius + 1) // 2 + 1) for c in combinations([i for i in range(BITS) if not m >> i & 1], k)] for m in masks]
    flips = F.element_at(F.array(*[F.array(*[F.lit(x) for x in c]) for c in changes]), F.col("v") + 1)
    points = met.where(F.col("n") > pairwise_limit).select("node", "fp", F.explode(flips).alias("x")).select("node", F.col("fp").bitwiseXOR(F.col("x")).alias("point")).distinct()
    first = points.groupBy("point").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").select("point", "b")
    stars = points.join(first, "point").where(F.col("node") > F.col("b")).select(F.col("node").alias("a"), "b")
    return pairs.unionByName(stars).distinct()


def components(edges: DataFrame, max_rounds: int = 60, parts: int | None = None) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of edges (a, b). Alternates large-star and small-star rounds, each saved.

    Sides of joins grow with the edges, so they are merged by sort and none goes through the driver. parts: no table has more partitions between its shuffles."""

    def few(e: DataFrame) -> DataFrame:
        return e if parts is None else e.coalesce(parts)

    def star(e: DataFrame) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return few(few(both.join(least.hint("merge"), "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))).distinct())

    def small(e: DataFrame) -> DataFrame:  # every edge has a > b
        least = e.groupBy("a").agg(F.min("b").alias("m"))
        joined = e.join(least.hint("merge"), "a")
        return few(few(joined.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))).distinct())

    def unsettled(e: DataFrame) -> int:
        """Nodes that keep e from being one star around the smallest node of each class: with several smaller neighbours, or with one and larger ones too."""
        sides = e.select(F.col("a").alias("u"), F.lit(1).alias("less"), F.lit(0).alias("more")).unionByName(e.select(F.col("b").alias("u"), F.lit(0).alias("less"), F.lit(1).alias("more")))
        return sides.groupBy("u").agg(F.sum("less").alias("less"), F.sum("more").alias("more")).where("less > 1 or less = 1 and more > 0").count()

    now = saved(few(edges))
    for _ in range(max_rounds):
        if not unsettled(now):
            break
        now = saved(small(star(now)))
    else:
        if unsettled(now):
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, words: int = SHINGLE_WORDS, seed: int = SEED, pairwise_limit: int = PAIRWISE_LIMIT) -> DataFrame:
    """docs: doc_id, text, any more. (doc_id, fp long, component_id), a row for each input row.

    Null and empty texts have fingerprint zero and link like any other. A null doc_id is never a component_id: such a row gets the
    smallest id of its class, null if the class has none. Repeated rows give repeated rows."""
    own = saved(fingerprints(docs, words, seed))
    nodes = saved(own.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")))
    roots = components(links(nodes, radius, pairwise_limit))
    classes = nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return own.join(classes, "fp", "left").select("doc_id", "fp", "component_id")
