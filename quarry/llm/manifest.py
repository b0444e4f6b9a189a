"""Merkle manifest of a table of documents: a digest for each row, a tree of digests for each language, one root, and a proof for each row.

The trees are worked off by time-forward processing. A node's label is (tree, level, place); it is hashed once all its children's digests have been
delivered to it, in order of labels, so what waits for a node is always next in a queue that is sorted by label. Between blocks of 2^BLOCK_LEVELS consecutive nodes that
queue is Spark's shuffle, which orders and spills outside memory; within a block it is a heap of at most 2^BLOCK_LEVELS messages. A sweep upwards delivers digests
to parents, block by block and round by round; the reversed sweep delivers to each block the path from its top to the root, and from there to its leaves.
Rounds are the logarithm of the rows by 2^BLOCK_LEVELS. No group has more than 2^BLOCK_LEVELS rows, whatever the size of a language.
"""

import hashlib
import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import placed, saved

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
BLOCK_LEVELS = 10
TAMPER_MOD = 7
# What a node is combined with: nothing, a sibling before it, a sibling behind it.
ALONE, BEFORE, BEHIND = b"\0", b"\1", b"\2"
DIGEST = 32


def digest_of(fields: list[Column]) -> Column:
    """sha256 of the fields in a row: `-` for null, else the bytes of its text, a colon and the text."""
    one = lambda c: F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))
    return F.unhex(F.sha2(F.concat(*[one(c.cast("string")) for c in fields]), 256))


def leaves(docs: DataFrame, tamper_mod: int = TAMPER_MOD) -> DataFrame:
    """(doc_id, lang, digest, tampered) of each row; tampered, the digest with n_chars one larger, is null where nothing is changed."""
    own = {c: F.col(c) for c in FIELDS}
    changed = own | {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % tamper_mod == 0) & F.col("n_chars").isNotNull()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", digest_of(list(own.values())).alias("digest"), F.when(hit, digest_of(list(changed.values()))).alias("tampered"))


def combined(*digests: bytes) -> bytes:
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def levels_of(total: int) -> int:
    return min(BLOCK_LEVELS, max(0, total - 1).bit_length())


def swept_up(digests: dict[int, bytes], levels: int) -> list[dict[int, bytes]]:
    """Digests by place, for each level of a block. The heap holds messages (level and place of the parent, place of the child, digest)."""
    by_level: list[dict[int, bytes]] = [digests] + [{} for _ in range(levels)]
    queue = [(1, p >> 1, p, d) for p, d in digests.items()] if levels else []
    heapq.heapify(queue)
    while queue:
        level, place, _, first = heapq.heappop(queue)
        got = [first]
        while queue and queue[0][:2] == (level, place):
            got.append(heapq.heappop(queue)[3])
        by_level[level][place] = combined(*got)
        if level < levels:
            heapq.heappush(queue, (level + 1, place >> 1, place, by_level[level][place]))
    return by_level


def swept_down(by_level: list[dict[int, bytes]], path: bytes) -> dict[int, bytes]:
    """The path of each leaf of a block, given the path of its top. A path is, from below, ALONE, or BEFORE or BEHIND with the sibling's digest, for each level."""
    paths = {p: path for p in by_level[-1]}
    for at in range(len(by_level) - 2, -1, -1):
        nodes, above, paths = by_level[at], paths, {}
        for p in sorted(nodes, reverse=True):
            sibling = nodes.get(p ^ 1)
            step = ALONE if sibling is None else (BEFORE if p & 1 else BEHIND) + sibling
            paths[p] = step + above[p >> 1]
    return paths


def steps(path: bytes):
    """(kind, digest or None) of each level of a path."""
    at = 0
    while at < len(path):
        kind, at = path[at : at + 1], at + 1
        if kind == ALONE:
            yield kind, None
        else:
            yield kind, path[at : at + DIGEST]
            at += DIGEST


def folded(digest: bytes, path: bytes) -> bytes:
    """The root that a leaf's digest and its path give."""
    for kind, sibling in steps(path):
        digest = combined(digest) if kind == ALONE else combined(sibling, digest) if kind == BEFORE else combined(digest, sibling)
    return digest


def _block(table: pa.Table) -> tuple[dict[int, bytes], int]:
    return dict(zip(table.column("place").to_pylist(), table.column("digest").to_pylist())), levels_of(table.column("total")[0].as_py())


def _tops(key, table):
    digests, levels = _block(table)
    top = swept_up(digests, levels)[-1]
    total = -(-table.column("total")[0].as_py() >> levels)
    return pa.table({"tree": pa.array([key[0].as_py()] * len(top), pa.int64()), "place": pa.array(list(top), pa.int64()), "digest": pa.array(list(top.values()), pa.binary()), "total": pa.array([total] * len(top), pa.int64())})


def _paths(key, nodes, tops):
    digests, levels = _block(nodes)
    got = swept_down(swept_up(digests, levels), tops.column("path")[0].as_py())
    return pa.table({"tree": pa.array([key[0].as_py()] * len(got), pa.int64()), "place": pa.array(list(got), pa.int64()), "path": pa.array(list(got.values()), pa.binary()), "subroot": pa.array(tops.column("subroot").to_pylist() * len(got), pa.binary())})


def _proofs(key, nodes, tops):
    digests, levels = _block(nodes)
    paths = swept_down(swept_up(digests, levels), tops.column("path")[0].as_py())
    proofs, roots = [], []
    for place, own, changed in zip(nodes.column("place").to_pylist(), nodes.column("digest").to_pylist(), nodes.column("tampered").to_pylist()):
        proofs.append(combined(*[s for _, s in steps(paths[place]) if s is not None]).hex())
        roots.append(folded(own if changed is None else changed, paths[place]).hex())
    columns = [nodes.column("doc_id"), pa.array([d.hex() for d in nodes.column("digest").to_pylist()]), pa.array([tops.column("subroot")[0].as_py().hex()] * len(nodes)), pa.array(proofs), pa.array(roots)]
    return pa.table(columns, names=["doc_id", "leaf", "subroot", "proof_sha256", "folded_root"])


def _in_blocks(nodes: DataFrame):
    """By tree and block; the nodes of trees that are one node already are blocks of one."""
    return nodes.withColumn("block", F.shiftright("place", BLOCK_LEVELS)).groupBy("tree", "block")


def _rounds(nodes: DataFrame) -> list[DataFrame]:
    """nodes: (tree, place, digest, total). The tables of each round upwards; in the last each tree is one node."""
    rounds = [nodes]
    left = nodes.agg(F.max("total")).first()[0] or 0
    while left > 1:
        rounds.append(saved(_in_blocks(rounds[-1].select("tree", "place", "digest", "total")).applyInArrow(_tops, "tree long, place long, digest binary, total long")))
        left = -(-left >> BLOCK_LEVELS)
    return rounds


def _delivered(rounds: list[DataFrame], tops: DataFrame, function, schema: str) -> DataFrame:
    """The reversed sweep: tops (tree, place, path, subroot) of the last round's nodes, down to the first round, where function makes the rows."""
    for at in range(max(0, len(rounds) - 2), -1, -1):  # the place of a node of one round is the block of the round below
        above = tops.withColumnRenamed("place", "block").groupBy("tree", "block")
        last = at == 0
        made = _in_blocks(rounds[at]).cogroup(above).applyInArrow(function if last else _paths, schema if last else "tree long, place long, path binary, subroot binary")
        tops = made if last else saved(made)
    return tops


def manifest(docs: DataFrame, tamper_mod: int = TAMPER_MOD) -> DataFrame:
    """docs: doc_id, source, lang, n_chars, text, any more. A row for each input row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Null values are hashed as `-`; a null language is a tree of its own, the first. Rows without doc_id come first in their tree and aren't tampered with; rows that repeat an
    id come in order of their digests, and equal rows are equal leaves. An empty table gives no rows. A row whose only sibling-free way leads to the root has a proof
    of no digests. Extra columns play no part."""
    own = placed(leaves(docs, tamper_mod), ["lang"], ["doc_id", "digest"])
    langs = placed(own.select("lang").distinct(), [], ["lang"]).select(F.col("lang").alias("of"), F.col("place").alias("tree"))
    nodes = saved(own.join(langs, F.col("lang").eqNullSafe(F.col("of"))).select("tree", "place", "total", "doc_id", "digest", "tampered"))
    rounds = _rounds(nodes)
    subroots = rounds[-1].select("tree", "digest")
    trees = subroots.count()
    upper = _rounds(saved(subroots.select(F.lit(-1).cast("long").alias("tree"), F.col("tree").alias("place"), "digest", F.lit(trees).cast("long").alias("total"))))
    root = upper[-1].select("digest").first()
    top = upper[-1].select("tree", F.lit(0).cast("long").alias("place"), F.lit(b"").alias("path"), F.col("digest").alias("subroot"))
    ways = _delivered(upper, top, _paths, "tree long, place long, path binary, subroot binary").select(F.col("place").alias("tree"), "path")
    tops = ways.join(subroots, "tree").select("tree", F.lit(0).cast("long").alias("place"), "path", F.col("digest").alias("subroot"))
    rows = _delivered(rounds, tops, _proofs, "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string")
    named = F.lit(root[0].hex() if root else None).cast("string")
    return rows.select("doc_id", "leaf", "subroot", named.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == named).alias("verified"))


ORACLE_SQL = """
WITH RECURSIVE crc AS (
  SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
texts AS (SELECT *, CAST(doc_id AS VARCHAR) AS d, CAST(n_chars AS VARCHAR) AS n, CAST(n_chars + 1 AS VARCHAR) AS more FROM documents),
fields AS (
  SELECT doc_id, lang,
    coalesce(octet_length(encode(d)) || ':' || d, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS before,
    coalesce(octet_length(encode(n)) || ':' || n, '-') AS n, coalesce(octet_length(encode(more)) || ':' || more, '-') AS more, coalesce(octet_length(encode(text)) || ':' || text, '-') AS after,
    xor(list_reduce([4294967295] || list_transform(range(1, len(d) + 1), lambda i: CAST(ord(d[i]) AS BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 7 = 0 AS hit
  FROM texts CROSS JOIN crc),
leaves AS (SELECT doc_id, lang, sha256(before || n || after) AS leaf, CASE WHEN hit THEN sha256(before || more || after) ELSE sha256(before || n || after) END AS given FROM fields),
places AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM leaves),
up(lang, level, nodes) AS (
  SELECT lang, 0, list(leaf ORDER BY place) FROM places GROUP BY lang
  UNION ALL
  SELECT lang, level + 1, list_transform(range(0, (len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], ''))) FROM up WHERE len(nodes) > 1),
subroots AS (SELECT lang, nodes[1] AS subroot, level AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM up WHERE len(nodes) = 1),
top(level, nodes) AS (
  SELECT 0, list(subroot ORDER BY tree) FROM subroots
  UNION ALL
  SELECT level + 1, list_transform(range(0, (len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], ''))) FROM top WHERE len(nodes) > 1),
ways AS (
  SELECT p.doc_id, p.leaf, p.place, u.level, p.place >> u.level AS pos, u.nodes[xor(p.place >> u.level, 1) + 1] AS sibling FROM places p JOIN up u ON p.lang IS NOT DISTINCT FROM u.lang WHERE len(u.nodes) > 1
  UNION ALL
  SELECT p.doc_id, p.leaf, p.place, s.height + t.level, s.tree >> t.level, t.nodes[xor(s.tree >> t.level, 1) + 1]
  FROM places p JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang JOIN top t ON len(t.nodes) > 1),
proofs AS (
  SELECT doc_id, leaf, place, list({'pos': pos, 'sibling': sibling} ORDER BY level) AS way, sha256(coalesce(string_agg(sibling, '' ORDER BY level), '')) AS proof_sha256 FROM ways GROUP BY doc_id, leaf, place),
folds(doc_id, leaf, place, i, digest) AS (
  SELECT doc_id, leaf, place, 0, given FROM places
  UNION ALL
  SELECT f.doc_id, f.leaf, f.place, i + 1, sha256(CASE WHEN way[i + 1].pos & 1 = 1 THEN coalesce(way[i + 1].sibling, '') || digest ELSE digest || coalesce(way[i + 1].sibling, '') END)
  FROM folds f JOIN proofs p ON f.doc_id IS NOT DISTINCT FROM p.doc_id AND f.leaf = p.leaf AND f.place = p.place WHERE i < len(way)),
ends AS (SELECT doc_id, leaf, place, arg_max(digest, i) AS folded_root FROM folds GROUP BY doc_id, leaf, place),
root AS (SELECT nodes[1] AS root FROM top WHERE len(nodes) = 1)
SELECT p.doc_id, p.leaf, s.subroot, r.root, coalesce(w.proof_sha256, sha256('')) AS proof_sha256, l.folded_root, l.folded_root = r.root AS verified
FROM places p JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang JOIN ends l ON p.doc_id IS NOT DISTINCT FROM l.doc_id AND p.leaf = l.leaf AND p.place = l.place
LEFT JOIN proofs w ON p.doc_id IS NOT DISTINCT FROM w.doc_id AND p.leaf = w.leaf AND p.place = w.place CROSS JOIN root r
"""
