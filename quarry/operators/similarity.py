"""Fingerprints, hashed embeddings, near pairs and best matches of chunks.

Chunks with equal fingerprint sets are first brought down to one. Pairs come from an inverted index of each set's rarest fingerprints: two sets of n and m
fingerprints with Jaccard similarity t share one of the n - ceil(t n) + 1 rarest of the one with the m - ceil(t m) + 1 rarest of the other, so none is missed, and a
fingerprint that very many chunks share pairs nobody who has rarer ones."""

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import col, feature_hash, token_stream, words
from ..tables import saved, written
from .structure import sources, token_shape


def _minima(k: int, window: int):
    """Lists of tokens to lists of fingerprints, a batch at a time: a k-gram is hashed once, and the least of each window is taken over numbers."""

    def run(tokens: pa.Array) -> pa.Array:
        words, ends, out = tokens.values.to_pylist(), tokens.offsets.to_pylist(), []
        for start, end, there in zip(ends, ends[1:], tokens.is_valid().to_pylist()):
            own = words[start:end] if there else []
            if len(own) < k:
                out.append([])
                continue
            digests = b"".join([hashlib.md5(" ".join(own[i : i + k]).encode()).digest()[:8] for i in range(len(own) - k + 1)])
            hashes = np.frombuffer(digests, ">u8").astype(np.uint64)
            least = np.lib.stride_tricks.sliding_window_view(hashes, window).min(axis=1) if len(hashes) > window else hashes.min(keepdims=True)
            out.append([f"{x:016x}" for x in np.unique(least).tolist()])
        return pa.array(out, pa.list_(pa.string()))

    return F.arrow_udf(run, "array<string>")


def winnowed(source, k: int = 12, window: int = 8, tokens=token_stream) -> Column:
    """Distinct minima over windows of hashed k-grams of the token stream (or what tokens gives for a text), sorted; the least hash of a short text, none where there is no k-gram. Texts become tokens in expressions;
    only tokens go to Python, in batches."""
    return _minima(k, window)(tokens(source))


def chunks(files: DataFrame, k: int = 12, window: int = 8) -> DataFrame:
    """files (repo_id, path, text) as chunks with fingerprints; chunks with none are left out."""
    tokens = files.select("repo_id", "path", winnowed("text", k, window).alias("fingerprints"))
    return tokens.where(F.size("fingerprints") > 0)


def jaccard(a, b) -> Column:
    both = F.size(F.array_union(col(a), col(b)))
    return F.when((F.size(col(a)) > 0) & (F.size(col(b)) > 0), F.size(F.array_intersect(col(a), col(b))) / both).otherwise(0.0)


def containment(a, b) -> Column:
    return F.when(F.size(col(a)) > 0, F.size(F.array_intersect(col(a), col(b))) / F.size(col(a))).otherwise(0.0)


def build_chunks(found: DataFrame, lines: DataFrame, files: DataFrame, least_lines: int = 5, least_words: int = 40) -> DataFrame:
    """found: entities, files (repo_id, path, category): (repo_id, id, path, symbol, start_line, end_line, signature, fingerprints, source) of the functions of source and test
    files of at least least_lines lines. Those with fewer than two fingerprints and fewer than least_words words are left out."""
    scope = files.where(F.col("category").isin("candidate_code", "test_code")).select("repo_id", "path")
    eligible = found.where("kind <> 'class'").where(F.col("end_line") - F.col("start_line") + 1 >= least_lines).join(scope, ["repo_id", "path"], "left_semi")
    shaped = sources(eligible, lines).withColumns({"fingerprints": winnowed("source", tokens=token_shape), "signature": F.md5(F.array_join(F.slice(token_shape("source"), 1, 400), "|").cast("binary"))})
    n = F.size(F.filter(F.split("source", r"\s+"), lambda w: w != ""))
    kept = shaped.where((F.size("fingerprints") >= 2) | (n >= least_words))
    return kept.select("repo_id", F.concat_ws(":", "path", F.col("start_line").cast("string"), "symbol").alias("id"), "path", "symbol", "start_line", "end_line", "signature", "fingerprints", "source")


def corpus_of(chunked: DataFrame, repositories: DataFrame) -> DataFrame:
    """chunked with the names of their repositories (repo_id, full_name): what other repositories are compared with."""
    return chunked.join(repositories, "repo_id").select("repo_id", "full_name", "id", "signature", "fingerprints")


def _prefixes(sets: DataFrame, group: list[str], least: float) -> DataFrame:
    """sets (group, id, fingerprints): a row for each of a set's rarest fingerprints, as many as two sets of similarity `least` can't both do without."""
    spread = sets.select(*group, "id", F.size("fingerprints").alias("n"), F.explode("fingerprints").alias("f"))
    common = spread.groupBy(*group, "f").agg(F.count(F.lit(1)).alias("df"))
    place = F.row_number().over(Window.partitionBy(*group, "id").orderBy("df", "f"))
    need = F.col("n") - F.ceil(least * F.col("n") - 1e-9) + 1
    return spread.join(common, [*group, "f"]).withColumn("place", place).where(F.col("place") <= need).select(*group, "id", "n", "f")


def near_duplicates(chunked: DataFrame, least: float = 0.55) -> tuple[DataFrame, DataFrame]:
    """(pairs, members) within repositories: pairs (repo_id, a, b, similarity) of distinct fingerprint sets, named by their first
    path; members (repo_id, path, id): which set each chunk has. Chunks with one id are equal in all fingerprints."""
    chunked = saved(chunked)
    key = F.md5(F.array_join("fingerprints", ",").cast("binary"))
    sets = saved(chunked.withColumn("key", key).groupBy("repo_id", "key").agg(F.min("path").alias("id"), F.any_value("fingerprints").alias("fingerprints")))
    members = chunked.select("repo_id", "path", key.alias("key")).join(sets.select("repo_id", "key", "id"), ["repo_id", "key"]).select("repo_id", "path", "id")
    rare = _prefixes(sets.select("repo_id", "id", "fingerprints"), ["repo_id"], least)
    a, b = rare.select("repo_id", "f", F.col("id").alias("a"), F.col("n").alias("na")), rare.select("repo_id", "f", F.col("id").alias("b"), F.col("n").alias("nb"))
    fits = (F.col("a") < F.col("b")) & (F.col("na") >= least * F.col("nb")) & (F.col("nb") >= least * F.col("na"))
    candidates = a.join(b, ["repo_id", "f"]).where(fits).select("repo_id", "a", "b").distinct()
    side = lambda x: sets.select("repo_id", F.col("id").alias(x), F.col("fingerprints").alias(f"f{x}"))
    scored = candidates.join(side("a"), ["repo_id", "a"]).join(side("b"), ["repo_id", "b"]).withColumn("similarity", jaccard("fa", "fb"))
    return scored.where(F.col("similarity") >= least).select("repo_id", "a", "b", "similarity"), members


def dense_embedding(docs: DataFrame, dims: int = 256) -> DataFrame:
    """hash_embedding() of docs (id, text) as one array a document: (id, embedding); a text without words has zeros."""
    entries = hash_embedding(docs, dims).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("dim").cast("int"), "value"))).alias("m"))
    full = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.try_element_at("m", i.cast("int")), F.lit(0.0)))
    return docs.select("id").distinct().join(entries, "id", "left").select("id", full.alias("embedding"))


def _closest(least: float, nearest: bool, cells: int = 1 << 22):
    """(left, right) to (n, m): rows (n, repo_id, embedding) of left and (m, taken, embedding) of right with an inner product of at least `least`, or within that those nearest to a row of
    left; none where taken is repo_id. Products are made in slices of `cells` numbers, and rounding errors are left to the caller's measure."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, columns = [], []
        if left.num_rows and right.num_rows:
            a, b = (x.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(x.num_rows, -1) for x in (left, right))
            codes: dict[str, int] = {}
            repo = np.array([codes.setdefault(x, len(codes)) for x in left.column("repo_id").to_pylist()])
            taken = np.array([codes.get(x, -1) for x in right.column("taken").to_pylist()])
            step = max(1, cells // len(b))
            for at in range(0, len(a), step):
                near = a[at : at + step] @ b.T
                near[repo[at : at + step, None] == taken[None, :]] = -np.inf
                low = np.maximum(near.max(axis=1), least) if nearest else np.full(len(near), least)
                i, j = np.nonzero(near >= low[:, None] - 1e-9)
                rows.append(i + at)
                columns.append(j)
        none = [np.zeros(0, dtype=np.int64)]
        return pa.table({"n": left.column("n").take(pa.array(np.concatenate(rows or none))), "m": right.column("m").take(pa.array(np.concatenate(columns or none)))})

    return run


def near_in_meaning(own: DataFrame, other: DataFrame, least: float = 0.6, nearest: bool = False, block: int = 1 << 14) -> DataFrame:
    """own, other (repo_id, id, embedding of length one or zero): (repo_id, id, matched_repo, matched_id, cosine): for each entry of own, of each different vector in other with a cosine of at least `least` the
    first entry of another repository; with `nearest` at least all that are as near as the nearest. Zero vectors are near nothing.

    Exact: vectors are dealt into blocks of about `block`, 32 MB at 256 dimensions, and each pair of blocks is a task's product of matrices. Only pairs that are near become rows. Work grows with the square
    of the different vectors; copies meet only where results are handed back."""
    real = F.exists("embedding", lambda x: x != 0)
    a = written(own.where(real).select("repo_id", "embedding").distinct().withColumn("n", F.monotonically_increasing_id()))
    first = other.where(real).groupBy("embedding").agg(F.min(F.struct(F.col("repo_id").alias("matched_repo"), F.col("id").alias("matched_id"))).alias("one"))
    second = other.join(first, "embedding").where(F.col("repo_id") != F.col("one.matched_repo")).groupBy("embedding").agg(F.min(F.struct(F.col("repo_id").alias("matched_repo"), F.col("id").alias("matched_id"))).alias("two"))
    b = written(first.join(second, "embedding", "left").withColumn("m", F.monotonically_increasing_id()))
    parts = max(1, -(-max(a.count(), b.count()) // block))
    every, at = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))), lambda c: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
    left = a.select(at("n").alias("i"), every.alias("j"), "n", "repo_id", "embedding").select((F.col("i") * parts + F.col("j")).alias("cell"), "n", "repo_id", "embedding")
    right = b.select(every.alias("i"), at("m").alias("j"), "m", F.when(F.col("two").isNull(), F.col("one.matched_repo")).alias("taken"), "embedding").select((F.col("i") * parts + F.col("j")).alias("cell"), "m", "taken", "embedding")
    pairs = written(left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(_closest(least, nearest), "n long, m long"))
    cosine = F.aggregate(F.zip_with("embedding", "other", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    near = pairs.join(a, "n").join(b.withColumnRenamed("embedding", "other"), "m").withColumn("cosine", cosine).where(F.col("cosine") >= least).drop("other", "n", "m")
    met = own.join(near, ["repo_id", "embedding"]).withColumn("chosen", F.when(F.col("one.matched_repo") != F.col("repo_id"), F.col("one")).otherwise(F.col("two"))).where("chosen is not null")
    return met.select("repo_id", "id", "chosen.matched_repo", "chosen.matched_id", "cosine")


def corpus_matches(chunked: DataFrame, corpus: DataFrame, least: float = 0.45) -> DataFrame:
    """chunked, corpus (repo_id, id, signature, fingerprints, embedding): for each chunk its best entry of another repository, by the larger of Jaccard, 0.9 of containment, 0.7 for
    the same signature and 0.75 of the embeddings' cosine, if at least `least`; ties to the smaller (repository, id). (repo_id, id, matched_repo, matched_id, similarity). Embeddings may be absent.

    A match is near in meaning, shares the signature, or has a containment of at least least / 0.9 or a Jaccard similarity of at least least. For the third it shares one of the chunk's n - ceil(n least / 0.9) + 1 rarest
    fingerprints; for the last, where containment is lower, one of the n - ceil(n least) + 1 rarest, and has at most n (0.1 + least) / 0.9 itself. So only these are looked up."""
    own = written(chunked.select("repo_id", "id", "signature", "fingerprints"))
    other = corpus.select(F.col("repo_id").alias("matched_repo"), F.col("id").alias("matched_id"), F.col("signature").alias("matched_signature"), F.col("fingerprints").alias("matched_fingerprints"))
    known = other.select("matched_repo", "matched_id", F.size("matched_fingerprints").alias("m"), F.explode("matched_fingerprints").alias("f"))
    common = known.groupBy("f").agg(F.count(F.lit(1)).alias("df"))
    spread = own.select("repo_id", "id", F.size("fingerprints").alias("n"), F.explode("fingerprints").alias("f")).join(common, "f", "left")
    place = F.row_number().over(Window.partitionBy("repo_id", "id").orderBy(F.coalesce("df", F.lit(0)), "f"))
    need = lambda share: F.col("n") - F.ceil(F.col("n") * share - 1e-9) + 1
    rare = spread.withColumn("place", place).where(F.col("place") <= need(least)).where("df is not null")
    fits = (F.col("place") <= need(least / 0.9)) | (F.col("m") <= F.col("n") * (0.1 + least) / 0.9 + 1e-9)
    by_print = rare.select("repo_id", "id", "f", "n", "place").join(known, "f").where("repo_id <> matched_repo").where(fits).select("repo_id", "id", "matched_repo", "matched_id")
    # All entries of one signature score alike by it, so the first of another repository stands for them; ties go to it anyhow.
    firsts = other.groupBy("matched_signature").agg(F.min(F.struct("matched_repo", "matched_id")).alias("one"))
    second = other.join(firsts.select("matched_signature", F.col("one.matched_repo").alias("taken")), "matched_signature").where("matched_repo <> taken").groupBy("matched_signature").agg(F.min(F.struct("matched_repo", "matched_id")).alias("two"))
    pairs = own.select("repo_id", "id", F.col("signature").alias("matched_signature")).join(firsts.join(second, "matched_signature", "left"), "matched_signature")
    chosen = F.when(F.col("one.matched_repo") != F.col("repo_id"), F.col("one")).otherwise(F.col("two"))
    by_shape = pairs.withColumn("m", chosen).where("m is not null").select("repo_id", "id", "m.matched_repo", "m.matched_id")
    meant = None
    if "embedding" in chunked.columns and "embedding" in corpus.columns:
        vectors = lambda df: df.select(F.col("repo_id").cast("string"), F.col("id").cast("string"), "embedding")
        meant = written(near_in_meaning(vectors(chunked), vectors(corpus), least / 0.75, nearest=True))
    candidates = by_print.unionByName(by_shape)
    if meant is not None:
        candidates = candidates.unionByName(meant.drop("cosine"))
    candidates = candidates.distinct()
    both = candidates.join(own, ["repo_id", "id"]).join(other, ["matched_repo", "matched_id"])
    score = F.greatest(jaccard("fingerprints", "matched_fingerprints"), 0.9 * containment("fingerprints", "matched_fingerprints"), F.when(F.col("signature") == F.col("matched_signature"), 0.7).otherwise(0.0))
    if meant is not None:
        both = both.join(meant, ["repo_id", "id", "matched_repo", "matched_id"], "left")
        score = F.greatest(score, 0.75 * F.coalesce("cosine", F.lit(0.0)))
    best = both.withColumn("similarity", score).where(F.col("similarity") >= least).groupBy("repo_id", "id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "matched_repo", "matched_id")).alias("m"))
    return best.select("repo_id", "id", "m.matched_repo", "m.matched_id", (-F.col("m.s")).alias("similarity"))


def similarity_summary(chunked: DataFrame, internal: DataFrame, members: DataFrame, external: DataFrame, corpus_size: int) -> DataFrame:
    """chunked (repo_id, id), internal pairs and members as of near_duplicates(), external as of corpus_matches(): one row a repository with the shares of chunks that have a near
    duplicate inside and a match outside, the closest match, and a confidence: 0.75 with a corpus, else 0.45."""
    sizes = members.groupBy("repo_id", "id").agg(F.count(F.lit(1)).alias("n"))
    paired = internal.select("repo_id", F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("paired", F.lit(True))
    doubled = sizes.join(paired, ["repo_id", "id"], "left").where("paired or n > 1").groupBy("repo_id").agg(F.sum("n").alias("duplicated"))
    outside = external.groupBy("repo_id").agg(F.count(F.lit(1)).alias("matched"), F.max("similarity").alias("max_external"))
    n = chunked.groupBy("repo_id").agg(F.count(F.lit(1)).alias("chunks"))
    wide = n.join(doubled, "repo_id", "left").join(outside, "repo_id", "left").fillna(0, ["duplicated", "matched"])
    return wide.select("repo_id", "chunks", (F.col("duplicated") / F.col("chunks")).alias("internal_ratio"), (F.col("matched") / F.col("chunks")).alias("external_ratio"), "max_external", F.lit(0.75 if corpus_size else 0.45).alias("confidence"))


def sparse_cosine(a, b) -> Column:
    """Cosine of two maps from key to number; 0 where either is empty or zero."""
    x, y = col(a), col(b)
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda s, v: s + v)
    dot = total(F.transform(F.map_entries(x), lambda e: e.value.cast("double") * F.coalesce(F.try_element_at(y, e.key).cast("double"), F.lit(0.0))))
    norm = lambda m: F.sqrt(total(F.transform(F.map_values(m), lambda v: v.cast("double") * v.cast("double"))))
    return F.when(norm(x) * norm(y) > 0, dot / (norm(x) * norm(y))).otherwise(0.0)


def hash_embedding(docs: DataFrame, dims: int = 256) -> DataFrame:
    """docs (id, text) as (id, dim, value): words and pairs of words, (1 + ln count) * sign summed by hashed index, to length one."""
    w = words("text")
    pairs = F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    counted = docs.select("id", F.explode(F.concat(w, pairs)).alias("feature")).groupBy("id", "feature").agg(F.count(F.lit(1)).alias("n"))
    index, sign = feature_hash("feature", dims)
    raw = counted.groupBy("id", index.alias("dim")).agg(F.sum((1 + F.log(F.col("n").cast("double"))) * sign).alias("v"))
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("id")))
    return raw.withColumn("value", F.when(norm > 0, F.col("v") / norm).otherwise(0.0)).select("id", "dim", "value")


def top_similar(queries: DataFrame, vectors: DataFrame, k: int = 5, block: int = 1024, most: int = 1 << 15) -> DataFrame:
    """queries, vectors: (id, repo_id, embedding). (query_id, place, id, similarity): for each query the k nearest by cosine among vectors of other repositories; ties to the
    smaller id. Zero vectors are near nothing: similarity 0.

    The queries are a stated set, which is dealt by hash into passes of about `most`, whatever their number: only one pass's queries, 64 MB at 256 dimensions, are ever sent to tasks together. Each batch of vectors
    meets them in blocks as products of matrices and keeps k a query."""
    numbered = saved(queries.select(F.col("id").cast("long"), F.col("repo_id").cast("string"), F.transform("embedding", lambda x: x.cast("double")).alias("e")))
    passes = max(1, -(-numbered.count() // most))
    found = [_scanned(numbered.where(F.pmod(F.xxhash64("id"), F.lit(passes)) == i), vectors, k, block) for i in range(passes)]
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 12)), "id"))
    return reduce(DataFrame.unionByName, found).withColumn("place", place).where(F.col("place") <= k)


def _scanned(numbered: DataFrame, vectors: DataFrame, k: int, block: int) -> DataFrame:
    """(query_id, id, similarity): of each batch of vectors the k nearest to each of the queries, which a caller bounds."""
    schema = "query_id long, id long, similarity double"
    asked = numbered.toArrow()
    ids, repos = np.array(asked.column("id").to_pylist(), dtype=np.int64), np.array([str(x) for x in asked.column("repo_id").to_pylist()])
    matrix = np.array(asked.column("e").to_pylist(), dtype=np.float64).reshape(len(ids), -1)
    matrix = matrix / np.maximum(np.linalg.norm(matrix, axis=1), 1e-300)[:, None] if len(ids) else matrix

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not len(ids):
                continue
            own, places = np.array(batch.column(0).to_pylist(), dtype=np.int64), np.array([str(x) for x in batch.column(1).to_pylist()])
            order = np.argsort(own, kind="stable")
            own, places = own[order], places[order]
            base = np.array(batch.column(2).to_pylist(), dtype=np.float64).reshape(len(own), -1)[order]
            base = base / np.maximum(np.linalg.norm(base, axis=1), 1e-300)[:, None]
            for at in range(0, len(ids), block):
                near = np.where(repos[at : at + block, None] == places[None, :], -np.inf, matrix[at : at + block] @ base.T)
                top = np.argsort(-near, axis=1, kind="stable")[:, :k]
                score = np.take_along_axis(near, top, axis=1)
                real = np.isfinite(score)
                q = np.broadcast_to(ids[at : at + block, None], top.shape)[real]
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(own[top[real]]), pa.array(score[real])], names=["query_id", "id", "similarity"])

    return vectors.select(F.col("id").cast("long"), F.col("repo_id").cast("string"), F.transform("embedding", lambda x: x.cast("double")).alias("e")).mapInArrow(search, schema)
