"""Exact join of texts by the Jaccard similarity of their word shingles, as a join in a metric space.

The Jaccard distance, one minus the similarity, is a metric, but unlike texts are all at distance one from each other: pivots can't part them. So the space is first cut into
the neighbourhoods of rare shingles: of its shingles, rarest first, each set takes as many as it could miss in a linked set and one more, so every linked pair shares
a neighbourhood. What is rare is told by one count of shingles over all documents, of which the most frequent FREQUENT are sent to each task; the count only orders,
so it decides the work and never the result. Pairs of a neighbourhood must also fit by size, by place of the shared shingle and by the parities of their sets (below).

First each set is held against the first of its neighbourhoods, which joins most classes. Neighbourhoods of more than DIRECT sets outside their largest class draw pivots, which are measured against
all members that can be within twice the linking distance. Members within the linking distance of a pivot go to the nearest, its Voronoi region. By the triangle inequality whatever links with one of them is within
twice that distance of the pivot: so many boundary sets are repeated there, as a window. Pairs of a region's home and its window are compared if their distances from the pivot differ by at most the linking distance.
Pivots leave, as all that they link with is known, and what is near no pivot is joined recursively, or directly if few have left. Regions of one class are done. Direct comparisons make rows only of pairs of different
classes that pass the bounds. So the recursion ends, is exact, and has no limit beyond which pairs are left out.

Copies are one set from the start; links within a class aren't looked for, as the result is classes.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import release, saved, small_batches, swept
from .simhash import components, majority

SEED = 42
# Odd, and one less is twice an odd number: words that change places change the polynomial. Multiplying by it and shifting loses nothing.
FACTOR = np.uint64(0x9E3779B97F4A7C17)
KEPT_WORDS = 200_000
WORDS, NUMERATOR, DENOMINATOR = 4, 85, 100
# Shingles that go to every task with their frequency: 9 bytes each.
FREQUENT = 1 << 18
# Regions of so many sets are compared pair by pair.
DIRECT = 32
PIVOTS = 8
PARITIES = 8
# Of the pairs of a crowded region so many are tried first, as most of its links join what is joined already.
THIN = 16
# Pairs that one copy of a set is joined with.
PAIRS_A_COPY = 64
# Sets whose regions and pairs one task takes; a small table in as many partitions as the session has would be mostly empty files.
SETS_A_PART = 1 << 14
LEAST_PARTS = 8
# Keys that go to every task together, to pick texts where they are read; more of them are joined by a shuffle.
BROADCAST_IDS = 1 << 20


class _Words(dict):
    """Hashes of words, each made once, of at most KEPT_WORDS words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return found


_WORDS = _Words()


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the runs of words; a shorter text is one run, a text without words has none. A run's hash is a polynomial of its words' hashes, mixed."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.empty(0, dtype="<u8")
    each = np.fromiter(map(_WORDS.__getitem__, tokens), dtype="<u8", count=len(tokens))
    length = min(words, len(tokens))
    last = len(tokens) - length + 1
    runs = np.full(last, length, dtype="<u8")
    for i in range(length):
        runs *= FACTOR
        runs += each[i : i + last]
    runs ^= runs >> np.uint64(32)
    runs *= FACTOR
    runs ^= runs >> np.uint64(29)
    return np.unique(runs)


def prefix_length(size: int, numerator: int, denominator: int) -> int:
    """So many shingles of a set, the first in any common order, hold one of each linked set."""
    return size - -(-numerator * size // denominator) + 1


def rarest_first(own: np.ndarray, frequent: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """own in order of frequency (that of shingles which aren't frequent is 0), then of hash."""
    if not len(frequent):
        return own
    short = _short(own)
    at = np.minimum(np.searchsorted(frequent, short), len(frequent) - 1)
    return own[np.lexsort((own, np.where(frequent[at] == short, ranks[at], 0)))]


def parities(own: np.ndarray) -> np.ndarray:
    """PARITIES words of bits, each the parity of the shingles that fall on it: two sets differ in at least as many shingles as their parities in bits."""
    odd = np.bincount((own >> np.uint64(40)).astype(np.int64) % (64 * PARITIES), minlength=64 * PARITIES) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _short(keys: np.ndarray) -> np.ndarray:
    """What shingles are counted by: 40 bits, as the count only orders them."""
    return keys >> np.uint64(24)


def _first(words: int, numerator: int, denominator: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                own = shingles(x.as_py(), words)
                yield pa.RecordBatch.from_arrays([pa.array(_short(own[: prefix_length(len(own), numerator, denominator) if len(own) else 0]).view(np.int64))], names=["key"])
        release()

    return run


def frequencies(docs: DataFrame, words: int, numerator: int, denominator: int) -> tuple[np.ndarray, np.ndarray]:
    """At most FREQUENT of the shingles that are first by hash in some text, those that are so most often, sorted; and the ranks of their frequencies."""
    counts = small_batches(docs).select("text").mapInArrow(_first(words, numerator, denominator), "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 2")
    counts = saved(counts.select("key", F.floor(4 * F.log2("n")).cast("int").alias("rank")))
    kept, least = 0, None
    for row in counts.groupBy("rank").count().orderBy(F.desc("rank")).collect():  # ranks are some hundreds at most
        kept += row["count"]
        if kept > FREQUENT:
            break
        least = row["rank"]
    if least is None:
        return np.empty(0, "<u8"), np.empty(0, np.uint8)
    found = counts.where(F.col("rank") >= least).toArrow()
    keys = found.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], found.column("rank").to_numpy()[order].astype(np.uint8)


def _sketches(words: int, numerator: int, denominator: int, frequent: np.ndarray, ranks: np.ndarray, prints: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, sizes, bits, fps, keys = [], [], [], [], []
            for x in batch.column(2):
                own = shingles(x.as_py(), words)
                digests.append(xxhash.xxh128_digest(own.tobytes()))
                sizes.append(len(own))
                bits.append(parities(own))
                fps.append(majority(own) if prints else None)
                keys.append(rarest_first(own, frequent, ranks)[: prefix_length(len(own), numerator, denominator) if len(own) else 0].view(np.int64))
            columns = [*batch.columns[:2], pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), pa.array(bits, pa.list_(pa.int64())), pa.array(fps, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "source", "digest", "size", "bits", "fp", "keys"])
        release()

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sets, done = [], [], set()
            for node, digest, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if node not in done:
                    own = shingles(text.as_py(), words).tobytes()
                    if xxhash.xxh128_digest(own) == digest:
                        done.add(node)
                        nodes.append(node)
                        sets.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], names=["node", "hashes"])
        release()

    return run


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = []
        for x, y in zip(batch.column(2), batch.column(3)):
            p, q = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
            n.append((len(p), len(q), len(np.intersect1d(p, q, assume_unique=True))))
        counts = [pa.array([c[i] for c in n], pa.int32()) for i in range(3)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *counts], names=["a", "b", "size_a", "size_b", "common"])


class Join:
    """The classes of a table of texts. rows: row (anything, given back), text. Texts are read three times and never stored or shuffled whole, but those in pairs
    beyond BROADCAST_IDS of them."""

    def __init__(self, rows: DataFrame, words: int = WORDS, numerator: int = NUMERATOR, denominator: int = DENOMINATOR, direct: int = DIRECT, prints: bool = False):
        """prints: whether sets get a SimHash fingerprint, fp."""
        self.words, self.numerator, self.denominator, self.direct, self.eps = words, numerator, denominator, direct, 1 - numerator / denominator
        self.rows = rows.select("row", F.xxhash64("text").alias("source"), "text")
        sketch = _sketches(words, numerator, denominator, *frequencies(rows, words, numerator, denominator), prints)
        self.own = saved(small_batches(self.rows).mapInArrow(sketch, f"row {rows.schema['row'].dataType.simpleString()}, source long, digest binary, size int, bits array<long>, fp long, keys array<long>"))
        picked = [F.first(c).alias(c) for c in ("source", "size", "bits", "fp", "keys")]
        nodes = saved(self.own.where("size > 0").groupBy("digest").agg(*picked)).withColumn("node", F.monotonically_increasing_id())
        self.parts = max(LEAST_PARTS, -(-nodes.count() // SETS_A_PART))
        self.nodes = self._few(nodes)
        self.sets: DataFrame | None = None

    def _few(self, df: DataFrame) -> DataFrame:
        """df in no more partitions than its number of sets is worth."""
        return df.coalesce(self.parts)

    def _saved(self, df: DataFrame) -> DataFrame:
        return saved(self._few(df))

    def _fits(self, a: str, b: str, numerator: int) -> Column:
        return F.least(a, b) * self.denominator >= F.greatest(a, b) * numerator

    def _reaches(self, common: Column, a: str, b: str, numerator: int) -> Column:
        return common * (numerator + self.denominator) >= (F.col(a) + F.col(b)) * numerator

    def _bounded(self) -> Column:
        """For a pair with size and at (place of the shared shingle) of a and b: sizes fit, and enough shingles follow the shared one if it is their first."""
        behind = F.least(F.col("size_a") - F.col("at_a"), F.col("size_b") - F.col("at_b"))
        return self._fits("size_a", "size_b", self.numerator) & self._reaches(behind, "size_a", "size_b", self.numerator)

    def _even(self, numerator: int) -> Column:
        """For a pair with size and bits of a and b: their parities are near enough for that similarity."""
        differ = sum((F.bit_count(F.get("bits_a", i).bitwiseXOR(F.get("bits_b", i))) for i in range(PARITIES)), F.lit(0))
        return self._reaches((F.col("size_a") + F.col("size_b") - differ) / 2, "size_a", "size_b", numerator)

    def neighbourhoods(self) -> DataFrame:
        """(region, node, size, at, n): sets by shared rare shingle, those that are alone there left out."""
        keyed = self.nodes.select("node", "size", F.posexplode("keys").alias("at", "region"))
        counted = keyed.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("region")))
        return self._saved(counted.where("n > 1").select("region", "node", "size", "at", "n"))

    def _stars(self, members: DataFrame) -> DataFrame:
        """Distinct pairs (a, b) of the first set of each region and every other that the bounds let through."""
        least = members.groupBy("region").agg(F.min(F.struct("node", "size", "at")).alias("least"))
        met = members.join(least.hint("merge"), "region").where("node > least.node")
        met = met.select(F.col("node").alias("a"), F.col("least.node").alias("b"), F.col("size").alias("size_a"), F.col("least.size").alias("size_b"), F.col("at").alias("at_a"), F.col("least.at").alias("at_b"))
        pairs = self._few(met.where(self._bounded()).select("a", "b", "size_a", "size_b")).distinct()
        for side in "ab":
            pairs = self._few(pairs).join(self.nodes.select(F.col("node").alias(side), F.col("bits").alias(f"bits_{side}")).hint("merge"), side)
        return pairs.where(self._even(self.numerator)).select("a", "b")

    def _with_sets(self, pairs: DataFrame) -> DataFrame:
        """pairs with the sets of both sides. Sets that stand in many pairs are repeated, so that no key is larger than the others; a pair carries one set through one shuffle."""
        dealt = {}
        for side in "ab":
            copies = pairs.groupBy(F.col(side).alias("node")).agg(F.ceil(F.count(F.lit(1)) / PAIRS_A_COPY).cast("int").alias("copies"))
            dealt[side] = self.sets.join(copies.hint("merge"), "node").withColumn(f"salt_{side}", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).select(F.col("node").alias(side), f"salt_{side}", F.col("hashes").alias(f"hashes_{side}"))
            pairs = pairs.join(copies.where("copies > 1").withColumnRenamed("node", side).hint("merge"), side, "left")
            pairs = self._few(pairs).withColumn(f"salt_{side}", F.coalesce(F.pmod(F.xxhash64("a", "b"), F.col("copies")), F.lit(0)).cast("int")).drop("copies")
        pairs = self._saved(pairs)
        with_a = self._few(pairs.join(self._few(dealt["a"]).hint("merge"), ["a", "salt_a"]))
        return with_a.join(self._few(dealt["b"]).hint("merge"), ["b", "salt_b"]).select("a", "b", "hashes_a", "hashes_b")

    def measured(self, pairs: DataFrame) -> DataFrame:
        """(a, b, distance, linked) of pairs of sets."""
        pairs = self._saved(pairs)
        self.sets = self._gathered(self._few(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))).distinct())
        both = small_batches(self._few(self._with_sets(pairs)))
        found = both.mapInArrow(_common, "a long, b long, size_a int, size_b int, common int")
        distance = 1 - F.col("common") / (F.col("size_a") + F.col("size_b") - F.col("common"))
        return self._saved(found.select("a", "b", distance.alias("distance"), self._reaches(F.col("common"), "size_a", "size_b", self.numerator).alias("linked")))

    def _gathered(self, needed: DataFrame) -> DataFrame:
        """(node, hashes) of the given nodes, from their texts, picked by hash where they are read; a text of equal hash and another set is passed over."""
        picked = self._saved(self.nodes.select("node", "digest", "source").join(self._few(needed).hint("merge"), "node", "left_semi"))
        few = picked.count() <= BROADCAST_IDS
        texts = self.rows.select("source", "text").join(F.broadcast(picked) if few else picked, "source").select("node", "digest", "text")
        return self._saved(small_batches(texts).mapInArrow(_sets(self.words), "node long, hashes binary").groupBy("node").agg(F.first("hashes").alias("hashes")))

    def _mixed(self, members: DataFrame, roots: DataFrame) -> DataFrame:
        """members (region, node, ...) of regions of several classes, with root, their class, n, the region's size, largest, its class with most members, and outside, how many aren't of it."""
        own = self._few(members.drop("root", "n", "largest", "outside").join(roots.hint("merge"), "node", "left")).withColumn("root", F.coalesce("root", "node"))
        by_class = self._few(own.groupBy("region", "root").agg(F.count(F.lit(1)).alias("m")))
        most = by_class.groupBy("region").agg(F.max_by("root", F.struct("m", "root")).alias("largest"), F.count(F.lit(1)).alias("classes"), F.sum("m").alias("n"), (F.sum("m") - F.max("m")).alias("outside")).where("classes > 1")
        return own.join(most.drop("classes").hint("merge"), "region")

    def _sketched(self, members: DataFrame) -> DataFrame:
        return self._few(members.join(self.nodes.select("node", "bits").hint("merge"), "node"))

    def _direct(self, members: DataFrame, thin: int = 1) -> DataFrame:
        """Distinct pairs (a, b), a > b, of different classes in a region that the bounds let through, one of both at home. thin: only one of so many pairs, those whose hashes agree."""
        own = self._sketched(members.select("region", "node", "size", "at", "root", "distance", "home")).withColumn("part", F.pmod(F.xxhash64("node"), F.lit(thin)))
        left, right = (own.select("region", "part", *[F.col(c).alias(f"{c}_{side}") for c in own.columns if c not in ("region", "part")]) for side in "ab")
        apart = (F.col("root_a") != F.col("root_b")) & (F.col("home_a") | F.col("home_b")) & (F.abs(F.col("distance_a") - F.col("distance_b")) <= self.eps + 1e-9)
        met = left.join(right.hint("merge"), ["region", "part"]).where((F.col("node_a") > F.col("node_b")) & apart & self._bounded() & self._even(self.numerator))
        return self._few(met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))).distinct()

    def _to_pivots(self, members: DataFrame, drawn: DataFrame) -> DataFrame:
        """Pairs (a, b) of members and the pivots (region, pivot) of their region that can be within twice the linking distance."""
        loose = 2 * self.numerator - self.denominator
        far = self._sketched(self._few(self.nodes.select("node", "size").join(drawn.select(F.col("pivot").alias("node"), "region").hint("merge"), "node"))).select("region", *[F.col(c).alias(f"{c}_b") for c in ("node", "size", "bits")])
        own = self._sketched(members.select("region", "node", "size")).select("region", *[F.col(c).alias(f"{c}_a") for c in ("node", "size", "bits")])
        met = own.join(far.hint("merge"), "region").where((F.col("node_a") != F.col("node_b")) & self._fits("size_a", "size_b", loose) & self._even(loose))
        return self._few(met.select(F.greatest("node_a", "node_b").alias("a"), F.least("node_a", "node_b").alias("b"))).distinct()

    def _divided(self, members: DataFrame, drawn: DataFrame, seen: DataFrame) -> DataFrame:
        """members of regions, given their pivots (region, pivot) and the measured distances, as the Voronoi regions of those that are within the linking distance of their region's nearest pivot, each with its window: all
        within twice that distance; and what no pivot is near to, as the old region, which is divided again if a quarter of it has left. Pivots are left out, as all that they link with is known.

        Regions that share members draw the same pivots, and a pivot has one Voronoi region for all of them: a set that shares twenty rare shingles with a pivot is near it once. So what is within
        twice the linking distance needs no look at regions, only what is within the distance itself, to tell which pivot is the nearest of which region."""
        both = seen.select(F.col("a").alias("node"), F.col("b").alias("pivot"), "distance").unionByName(seen.select(F.col("b").alias("node"), F.col("a").alias("pivot"), "distance"))
        both = self._saved(both.where(F.col("distance") <= 2 * self.eps + 1e-9).join(self._few(drawn.select("pivot").distinct()).hint("merge"), "pivot", "left_semi"))
        rest = self._few(members.join(drawn.withColumnRenamed("pivot", "node").hint("merge"), ["region", "node"], "left_anti").select("region", "node", "size", "at", "n"))
        near = self._few(rest.select("region", "node").join(both.where(F.col("distance") <= self.eps + 1e-9).hint("merge"), "node"))
        near = self._few(near.join(drawn.hint("merge"), ["region", "pivot"], "left_semi"))
        nearest = self._saved(near.groupBy("region", "node").agg(F.min(F.struct("distance", "pivot")).alias("nearest")))
        homes = self._few(nearest.select("node", "nearest.pivot").distinct()).withColumn("home", F.lit(True))
        parts = self._few(both.join(homes.hint("merge"), ["node", "pivot"], "left"))
        parts = self._few(parts.join(self.nodes.select("node", "size").hint("merge"), "node"))  # in any of the regions the shared shingle can be their first
        parts = parts.withColumns({"region": F.xxhash64(F.lit("pivot"), "pivot"), "at": F.lit(0), "home": F.coalesce("home", F.lit(False)), "divided": F.lit(False)})
        gone = self._few(nearest.groupBy("region").agg(F.count(F.lit(1)).alias("gone")))
        left = self._few(rest.join(nearest.select("region", "node").hint("merge"), ["region", "node"], "left_anti")).join(gone.hint("merge"), "region", "left")
        left = left.withColumns({"distance": F.lit(0.0), "home": F.lit(True), "divided": F.coalesce(F.col("gone") * 4 >= F.col("n"), F.lit(False))})
        columns = ["region", "node", "size", "at", "distance", "home", "divided"]
        return parts.select(*columns).unionByName(left.select(*columns))

    def roots(self) -> DataFrame:
        """(node, root) of all sets that are linked with another."""
        regions, members, roots = self.neighbourhoods(), None, None
        pairs = self._stars(regions)
        rest = regions.where("n > 2").withColumns({"distance": F.lit(0.0), "home": F.lit(True), "divided": F.lit(True)})
        while True:
            if members is not None:
                slot = F.pmod(F.xxhash64("node"), F.lit(PIVOTS))
                drawn = self._saved(members.where("root <> largest").groupBy("region", slot.alias("slot")).agg(F.min("node").alias("pivot")).select("region", "pivot"))
                pairs = self._few(pairs.unionByName(self._to_pivots(members, drawn)).unionByName(self._direct(members, THIN))).distinct()
            seen = self.measured(pairs)
            swept(self.rows.sparkSession)
            edges = seen.where("linked").select("a", "b")
            if roots is not None:
                edges = edges.unionByName(roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
            roots = self._saved(components(edges, parts=self.parts))
            if members is not None:
                rest = self._divided(members, drawn, seen)
            if rest is None:
                return roots
            swept(self.rows.sparkSession)
            mixed = self._saved(self._mixed(rest, roots))
            again = F.col("divided") & (F.col("n") > self.direct) & (F.col("outside") > self.direct)
            pairs, members, rest = self._saved(self._direct(mixed.where(~again))), mixed.where(again), None
            if members.isEmpty():
                members = None
                if pairs.isEmpty():
                    return roots

    def classes(self) -> DataFrame:
        """(row, n_shingles, root): rows of one class have one root; rows without words have none."""
        named = self.nodes.select("digest", "node").join(self.roots().hint("merge"), "node", "left").select("digest", F.coalesce("root", "node").alias("root"))
        return self.own.join(named.hint("merge"), "digest", "left").select("row", F.col("size").cast("long").alias("n_shingles"), "root")


def near_copies(docs: DataFrame, words: int = WORDS, numerator: int = NUMERATOR, denominator: int = DENOMINATOR, direct: int = DIRECT) -> DataFrame:
    """docs: doc_id, text, any more. (doc_id, n_shingles, component_id), a row for each input row: the smallest id that links of similarity numerator / denominator or more reach.

    Null and empty texts and texts without words have no shingles and are linked with nothing, not with each other either. A null doc_id is never a component_id: such
    a row gets the smallest id of its class, null if there is none. Rows that repeat an id are rows by themselves. An empty table gives no rows."""
    own = saved(Join(docs.select(F.col("doc_id").cast("long").alias("row"), "text"), words, numerator, denominator, direct).classes())
    least = own.where("root is not null").groupBy("root").agg(F.min("row").alias("least"))
    component = F.when(F.col("root").isNull(), F.col("row")).otherwise(F.col("least"))
    return own.join(least.hint("merge"), "root", "left").select(F.col("row").alias("doc_id"), "n_shingles", component.alias("component_id"))


ORACLE_SQL = """
WITH RECURSIVE rows AS (SELECT row_number() OVER () AS k, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
words AS (SELECT k, doc_id, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w FROM rows),
sets AS (
  SELECT k, doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END)) AS s FROM words),
nodes AS (SELECT s, len(s) AS n, min(doc_id) AS first, row_number() OVER () AS node FROM sets WHERE len(s) > 0 GROUP BY s),
items AS (SELECT node, n, unnest(s) AS x FROM nodes),
shared AS (SELECT x FROM items GROUP BY x HAVING count(*) > 1),
common AS (SELECT a.node AS a, b.node AS b, a.n AS na, b.n AS nb, count(*) AS c FROM (SELECT * FROM items SEMI JOIN shared USING (x)) a JOIN (SELECT * FROM items SEMI JOIN shared USING (x)) b ON a.x = b.x AND a.node <> b.node AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY ALL),
links AS (SELECT a, b FROM common WHERE 100 * c >= 85 * (na + nb - c)),
reached(node, other) AS (SELECT node, node FROM nodes UNION SELECT r.node, l.b FROM reached r JOIN links l ON r.other = l.a),
classes AS (SELECT r.node, min(n.first) AS least FROM reached r JOIN nodes n ON r.other = n.node GROUP BY r.node)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, CASE WHEN len(s.s) = 0 THEN s.doc_id ELSE c.least END AS component_id
FROM sets s LEFT JOIN nodes n ON s.s = n.s AND len(s.s) > 0 LEFT JOIN classes c ON n.node = c.node
"""
