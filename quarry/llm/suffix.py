"""Removal of passages that stand in an earlier document, by merged Burrows-Wheeler transforms.

A byte goes if a string of `span` bytes that covers it also starts in a document with a smaller doc_id. A string of that length has a minimiser, the
least hash of its k-byte pieces, wherever it stands; so strings are dealt out by minimiser, and all places of a string meet in one bucket.

1. Documents are packed into batches of a few megabytes (saved, compressed).
2. Batches send each minimiser once; buckets tell which stand in several documents, and which in very many.
3. Batches send the stretches of text around minimisers that stand in several documents, each text once with its places. Where a minimiser
   stands in very many, each string goes by its own hash instead, so a common phrase doesn't gather its contexts in one bucket.
4. A bucket builds the transforms of shards of its texts, merges them, and takes from the merged order the classes of strings that share
   `span` bytes, and the first document of each. Texts none of whose strings can stand in another text (by hash) needn't be merged.
5. The spans return to their batches, where bytes are removed.

Nothing is capped or sampled; a hash only decides what is compared, bytes decide what is equal. Buckets grow in number with the input."""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bwt
from .common import release, saved, small_batches
from .textfeatures import BASE, UNBASE, _powers, chunks, mixed

SPAN = 50
PIECE = 20
BATCH_BYTES = 4 << 20
STEP_BYTES = 1 << 19  # at most, unless one document is longer: fewer than 2^16 documents of `span` bytes
BUCKET_BYTES = 4 << 20
COMMON = 2000
LONGEST_RUN = 100
SHARD_BYTES = 1 << 18
NO_ID = 2**63 - 1


def _zip(data: bytes, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data)


def _unzip(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


# -- 1: batches


def batches_of(docs: DataFrame, size: int = BATCH_BYTES, carry: tuple[str, ...] = ()) -> DataFrame:
    """(batch, ids, lengths, data, carried): documents in order of doc_id within a batch; a null doc_id comes last and is later than any other.

    carried holds, for each document, the columns named by carry as strings."""

    def pack(rows: list[tuple[int, bytes, list]], name: str) -> pa.RecordBatch:
        rows.sort(key=lambda r: r[0])
        ids, lengths, carried = [[r[0] for r in rows]], [[len(r[1]) for r in rows]], [[r[2] for r in rows]]
        columns = [pa.array([name]), pa.array(ids, pa.list_(pa.int64())), pa.array(lengths, pa.list_(pa.int32())), pa.array([_zip(b"".join(r[1] for r in rows), 6)], pa.binary()), pa.array(carried, pa.list_(pa.list_(pa.string())))]
        return pa.RecordBatch.from_arrays(columns, names=["batch", "ids", "lengths", "data", "carried"])

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, rows, held = TaskContext.get().partitionId(), 0, [], 0
        for batch in arrow:
            for doc_id, text, *more in zip(*batch.columns):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                rows.append((NO_ID if doc_id.as_py() is None else doc_id.as_py(), data, [x.as_py() for x in more]))
                held += len(data) + 64
                if held >= size:
                    yield pack(rows, f"{part}-{number}")
                    number, rows, held = number + 1, [], 0
        if rows:
            yield pack(rows, f"{part}-{number}")

    given = docs.select(F.col("doc_id").cast("long"), "text", *[F.col(c).cast("string").alias(f"carried_{i}") for i, c in enumerate(carry)])
    return small_batches(given).mapInArrow(run, "batch string, ids array<long>, lengths array<int>, data binary, carried array<array<string>>")


class Batch:
    def __init__(self, row: dict):
        self.name = row["batch"]
        self.ids = np.array(row["ids"], dtype=np.int64)
        self.lengths = np.array(row["lengths"], dtype=np.int64)
        self.data = np.frombuffer(_unzip(row["data"]), dtype=np.uint8)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def steps(self, span: int):
        """(place, lengths): documents of about STEP_BYTES together, from that place on. A longer document comes in stretches, each followed by the
        next span - 1 bytes, so that each of its strings is within one stretch."""
        at, held, lengths = 0, 0, []
        for start, n in zip(self.starts.tolist(), self.lengths.tolist()):
            if lengths and held + n > STEP_BYTES:
                yield at, np.array(lengths, np.int64)
                held, lengths = 0, []
            if n > STEP_BYTES + span:
                for a in range(0, n - span + 1, STEP_BYTES):
                    yield start + a, np.array([min(STEP_BYTES + span - 1, n - a)], np.int64)
                continue
            if not lengths:
                at = start
            lengths.append(n)
            held += n
        if lengths:
            yield at, np.array(lengths, np.int64)


# -- 2: minimisers


def runs(data: np.ndarray, lengths: np.ndarray, span: int, piece: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Strings of span bytes within texts: (start, count, minimiser) of the runs of strings that share a minimiser, and the prefix sums of data."""
    n = len(data)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(BASE, max(n, 1))[:n])))
    nothing = np.zeros(0, np.int64)
    if n < span:
        return nothing, nothing, np.zeros(0, np.uint64), sums
    least = mixed((sums[piece:] - sums[:-piece]) * _powers(UNBASE, n)[: n - piece + 1])
    width, size = span - piece + 1, 1
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < width:
        least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
    ends = np.cumsum(lengths)
    long = lengths >= span
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, (ends - lengths)[long], 1)
    np.add.at(change, (ends - span + 1)[long], -1)
    inside = np.cumsum(change)[: n - span + 1] > 0
    edge = np.concatenate(([True], (least[1:] != least[:-1]) | (inside[1:] != inside[:-1])))
    if span == 1 or not long.all():  # texts may touch only if strings leave no gap between them
        edge[(ends - lengths)[long]] = True
    at = np.flatnonzero(edge)
    count = np.concatenate((at[1:], [len(inside)])) - at
    kept = inside[at]
    return at[kept], count[kept], least[at[kept]], sums


def _window_hash(sums: np.ndarray, at: np.ndarray, span: int) -> np.ndarray:
    return mixed((sums[at + span] - sums[at]) * _powers(UNBASE, len(sums))[at])


def _unique_minimisers(batch: Batch, span: int, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """(minimiser shortened to 48 bits, in how many documents of the batch), in order."""
    parts = [np.zeros(0, np.uint64)]
    for lo, lengths in batch.steps(span):
        start, _, value, _ = runs(batch.data[lo : lo + lengths.sum()], lengths, span, piece)
        doc = np.unique(np.searchsorted(np.cumsum(lengths), start, side="right"), return_inverse=True)[1].astype(np.uint64)
        value = value >> np.uint64(16)
        key = np.unique(value << np.uint64(16) | doc)  # a step has fewer than 2^16 documents long enough for a string
        parts.append(key >> np.uint64(16))
    return np.unique(np.concatenate(parts), return_counts=True)


def _by_bucket(values: np.ndarray, buckets: int):
    """(bucket, places) of values, places in order."""
    bucket = (mixed(values + np.uint64(1)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    names, first = np.unique(bucket[order], return_index=True)
    for name, part in zip(names.tolist(), np.split(order, first[1:])):
        yield name, part


def _pack40(v: np.ndarray) -> bytes:
    """The low 40 bits: within a bucket that is enough, as buckets grow in number with the input. Two that agree in them count as one, which only sends more."""
    return np.ascontiguousarray(v.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _unpack40(data: bytes) -> np.ndarray:
    raw = np.zeros((len(data) // 5, 8), np.uint8)
    raw[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return raw.view("<u8").ravel().astype(np.uint64)


def repeated(batches: DataFrame, buckets: int, span: int, piece: int, common: int) -> DataFrame:
    """(batch, codes): for each bucket, 0, 1 or 2 for each of the batch's minimisers there: of one document, of several, of more than common."""

    def send(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in arrow:
            for i in range(rows.num_rows):
                batch = Batch(rows.slice(i, 1).to_pylist()[0])
                values, counts = _unique_minimisers(batch, span, piece)
                counts = np.minimum(counts, 255).astype(np.uint8)
                got = [(b, _pack40(values[at]), _zip(counts[at].tobytes())) for b, at in _by_bucket(values, buckets)]
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([batch.name] * len(got)), pa.array([g[1] for g in got], pa.binary()), pa.array([g[2] for g in got], pa.binary())], names=["bucket", "batch", "vals", "counts"])

    def tell(table: pa.Table) -> pa.Table:
        values = [_unpack40(v) for v in table.column("vals").to_pylist()]
        counts = np.concatenate([np.frombuffer(_unzip(c), np.uint8) for c in table.column("counts").to_pylist()]).astype(np.int64)
        every, place = np.unique(np.concatenate(values), return_inverse=True)
        total = np.bincount(place, weights=counts, minlength=len(every))
        code = np.where(total > common, 2, np.where(total > 1, 1, 0)).astype(np.uint8)[place]
        release()
        codes = [_zip(c.tobytes()) for c in np.split(code, np.cumsum([len(v) for v in values])[:-1])]
        return pa.Table.from_arrays([table.column("batch"), table.column("bucket"), pa.array(codes, pa.binary())], names=["batch", "bucket", "codes"])

    sent = batches.mapInArrow(send, "bucket long, batch string, vals binary, counts binary")
    told = sent.groupBy("bucket").applyInArrow(tell, "batch string, bucket long, codes binary")
    return told.groupBy("batch").agg(F.collect_list(F.struct("bucket", "codes")).alias("codes"))


# -- 3: stretches


def stretches(batches: DataFrame, codes: DataFrame, buckets: int, span: int, piece: int) -> DataFrame:
    """(bucket, batch, data, local): texts of the batch around repeated minimisers, each once, with its places in the first document of the batch that
    has it. Its places in the batch's other documents go whatever other batches hold, so these are settled here: local, on one row of each batch, has
    their spans. A text that stands in every document is thus one entry a batch, however many documents there are."""

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in arrow:
            for i in range(rows.num_rows):
                row = rows.slice(i, 1).to_pylist()[0]
                batch = Batch(row)
                values, _ = _unique_minimisers(batch, span, piece)
                code = np.zeros(len(values), np.uint8)
                told = {c["bucket"]: c["codes"] for c in row["codes"]}
                for b, at in _by_bucket(values, buckets):
                    code[at] = np.frombuffer(_unzip(told[b]), np.uint8)
                at, count, key = [], [], []
                for lo, lengths in batch.steps(span):
                    start, n, value, sums = runs(batch.data[lo : lo + lengths.sum()], lengths, span, piece)
                    if not len(start):
                        continue
                    value = value >> np.uint64(16)
                    c = code[np.searchsorted(values, value)]
                    some, many = c == 1, c == 2
                    pieces = -(-n[some] // LONGEST_RUN)
                    step = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                    at.append(np.repeat(start[some], pieces) + step * LONGEST_RUN + lo)
                    count.append(np.minimum(np.repeat(n[some], pieces) - step * LONGEST_RUN, LONGEST_RUN))
                    key.append(np.repeat(value[some], pieces))
                    single = np.repeat(start[many], n[many]) + np.arange(n[many].sum()) - np.repeat(np.cumsum(n[many]) - n[many], n[many])
                    at.append(single + lo)
                    count.append(np.ones(len(single), np.int64))
                    key.append(_window_hash(sums, single, span) >> np.uint64(16))
                if not at:
                    continue
                at, count, key = np.concatenate(at), np.concatenate(count), np.concatenate(key)
                if not len(at):
                    continue
                doc = np.searchsorted(batch.starts + batch.lengths, at, side="right")
                whole = batch.data.tobytes()
                got, gone = [], np.zeros(len(at), bool)
                for b, part in _by_bucket(key, buckets):
                    names: dict[bytes, int] = {}
                    own = np.array([names.setdefault(whole[s : s + w], len(names)) for s, w in zip(at[part].tolist(), (count[part] + span - 1).tolist())])
                    first = np.full(len(names), NO_ID, dtype=np.int64)
                    np.minimum.at(first, own, batch.ids[doc[part]])
                    later = batch.ids[doc[part]] > first[own]
                    gone[part[later]] = True
                    part, own = part[~later], own[~later]
                    docs, local = np.unique(doc[part], return_inverse=True)
                    fields = [np.array([len(names), len(part), len(docs)], "<i8"), np.array([len(t) for t in names], "<u2"), batch.ids[docs].astype("<i8"), docs.astype("<u4")]
                    fields += [np.array(own, "<u4"), local.astype("<u4"), (at[part] - batch.starts[doc[part]]).astype("<u4")]
                    got.append((b, _zip(b"".join([f.tobytes() for f in fields] + list(names)), 5)))
                settled: list = [None] * len(got)
                settled[at[0] % len(got)] = _union(at[gone], at[gone] + count[gone] + span - 1)
                yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([batch.name] * len(got)), pa.array([g[1] for g in got], pa.binary()), pa.array(settled, pa.binary())], names=["bucket", "batch", "data", "local"])
        release()

    joined = batches.join(codes, "batch")
    return joined.select("batch", "ids", "lengths", "data", "codes").mapInArrow(run, "bucket long, batch string, data binary, local binary")


def _union(begin: np.ndarray, end: np.ndarray) -> bytes | None:
    """Spans of a batch's bytes, joined where they overlap, as spans_of() packs them; none for no spans."""
    if not len(begin):
        return None
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.concatenate(([True], begin[1:] > reach[:-1])))
    fields = np.zeros(len(new)), begin[new], reach[np.concatenate((new[1:] - 1, [len(reach) - 1]))]
    return _zip(b"".join(f.astype("<u4").tobytes() for f in fields))


def _opened(data: bytes):
    """(texts, occurrence's text, its document's id, its document's number in the batch, its place there)."""
    raw, at = _unzip(data), 24
    texts, places, docs = np.frombuffer(raw, "<i8", 3).tolist()

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(raw, kind, n, at)
        at += out.nbytes
        return out

    lengths, ids, numbers = take("<u2", texts), take("<i8", docs), take("<u4", docs)
    own, local, start = take("<u4", places), take("<u4", places), take("<u4", places)
    stops = (at + np.cumsum(lengths.astype(np.int64))).tolist()
    return [raw[a:b] for a, b in zip([at, *stops[:-1]], stops)], own.astype(np.int64), ids[local], numbers[local], start.astype(np.int64)


# -- 4: classes


def first_documents(texts: list[bytes], first: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """texts: distinct; first: the first document of each. (offsets, least): for each string of span bytes of each text, in order, the first
    document of any text that holds it. offsets: where each text's strings begin."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    count = lengths - span + 1
    offsets = np.cumsum(count) - count
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), count)
    hashes = np.empty(len(owner), np.uint64)
    for i, j in chunks(texts):  # a hash doesn't depend on what stands before its string
        data = np.frombuffer(b"".join(texts[i:j]), np.uint8)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(BASE, len(data)))))
        lo, hi = offsets[i], offsets[j - 1] + count[j - 1]
        hashes[lo:hi] = _window_hash(sums, np.arange(hi - lo) + (owner[lo:hi].astype(np.int64) - i) * (span - 1), span)
    order = np.argsort(hashes)
    hashes, owner = hashes[order], owner[order]
    del order
    meets = (hashes[1:] == hashes[:-1]) & (owner[1:] != owner[:-1])
    candidates = np.unique(np.concatenate((owner[1:][meets], owner[:-1][meets])))
    del hashes, owner, meets
    least = np.repeat(first, count)
    if not len(candidates):
        return offsets, least
    # The merged transforms of shards of the texts that may share a string. UTF-8 has no byte 255: it stands for byte 0, which ends texts.
    chosen = sorted((texts[i].replace(b"\0", b"\xff"), i) for i in candidates.tolist())
    shards = max(1, min(250, sum(len(t) for t, _ in chosen) // SHARD_BYTES))
    parts = [chosen[s::shards] for s in range(shards)]
    built = [bwt.transform([t for t, _ in part]) for part in parts]
    shard, row, classes = bwt.merge(built, span)
    place = np.empty(len(row), np.int64)  # of each merged row in all texts' strings, or -1
    for s, (part, (places, _)) in enumerate(zip(parts, built)):
        sizes = np.array([len(t) + 1 for t, _ in part])
        inner = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        whole = inner + span <= np.repeat(sizes - 1, sizes)
        string = np.where(whole, inner + np.repeat(offsets[[i for _, i in part]], sizes), -1)
        mine = shard == s
        place[mine] = string[places[row[mine]]]
    real = place >= 0
    place, classes = place[real], classes[real]
    begin = np.flatnonzero(np.concatenate(([True], classes[1:] != classes[:-1])))
    best = np.minimum.reduceat(least[place], begin)
    least[place] = np.repeat(best, np.diff(np.concatenate((begin, [len(place)]))))
    return offsets, least


def spans_of(sent: DataFrame, span: int) -> DataFrame:
    """(batch, spans): for each bucket, the stretches of bytes to remove, as document's number in the batch, begin and end there; and those that
    the batch itself settled, counted from the batch's first byte, as if all in its first document."""

    def run(table: pa.Table) -> pa.Table:
        names: dict[bytes, int] = {}
        parts = []
        settled = table.select(["batch", "local"]).filter(pc.is_valid(table.column("local")))
        for data in table.column("data").to_pylist():
            texts, own, ids, numbers, start = _opened(data)
            here = np.array([names.setdefault(t, len(names)) for t in texts], dtype=np.int64)
            parts.append((here[own], ids, numbers, start))
        texts = list(names)
        first = np.full(len(texts), NO_ID, dtype=np.int64)
        for own, ids, _, _ in parts:
            np.minimum.at(first, own, ids)
        offsets, least = first_documents(texts, first, span)
        counts = np.array([len(t) for t in texts], dtype=np.int64) - span + 1
        names_out, out = settled.column("batch").to_pylist(), settled.column("local").to_pylist()
        for name, (own, ids, numbers, start) in zip(table.column("batch").to_pylist(), parts):
            n = counts[own]
            row = np.repeat(np.arange(len(own)), n)
            inner = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            gone = least[np.repeat(offsets[own], n) + inner] < ids[row]
            lead = gone & np.concatenate(([True], ~gone[:-1] | (row[1:] != row[:-1])))
            tail = gone & np.concatenate((~gone[1:] | (row[1:] != row[:-1]), [True]))
            a, b = np.flatnonzero(lead), np.flatnonzero(tail)
            if len(a):
                fields = [numbers[row[a]].astype("<u4"), (start[row[a]] + inner[a]).astype("<u4"), (start[row[b]] + inner[b] + span).astype("<u4")]
                names_out.append(name)
                out.append(_zip(b"".join(f.tobytes() for f in fields)))
        del least, parts, names, texts
        release()
        return pa.Table.from_arrays([pa.array(names_out, pa.string()), pa.array(out, pa.binary())], names=["batch", "spans"])

    return sent.groupBy("bucket").applyInArrow(run, "batch string, spans binary").groupBy("batch").agg(F.collect_list("spans").alias("spans"))


# -- 5: removal


def removed(batches: DataFrame, spans: DataFrame, with_text: bool, decoded: bool = False) -> DataFrame:
    """A row for each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept and carried. kept is binary or, decoded, a string without the
    parts of characters at cuts: decoded here, as a second Python function on these rows would have workers of its own, which outlive it."""
    kinds = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (f", kept {'string' if decoded else 'binary'}, carried array<string>" if with_text else "")

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in arrow:
            for i in range(rows.num_rows):
                row = rows.slice(i, 1).to_pylist()[0]
                batch = Batch(row)
                change = np.zeros(len(batch.data) + 1, np.int32)
                for part in row["spans"] or []:
                    doc, a, b = np.frombuffer(_unzip(part), "<u4").reshape(3, -1).astype(np.int64)
                    np.add.at(change, batch.starts[doc] + a, 1)
                    np.subtract.at(change, batch.starts[doc] + b, 1)
                gone = np.cumsum(change, dtype=np.int32)[:-1] > 0
                del change
                parts = [gone[a : a + n] for a, n in zip(batch.starts.tolist(), batch.lengths.tolist())]
                lost, begun = [int(np.count_nonzero(p)) for p in parts], [int(p[:1].sum()) + int(np.count_nonzero(p[1:] & ~p[:-1])) if p.any() else 0 for p in parts]
                kept = [batch.data[a : a + len(p)][~p].tobytes() for a, p in zip(batch.starts.tolist(), parts)]
                digests = [hashlib.sha256(k).hexdigest() for k in kept]
                if decoded:
                    kept = [k.decode("utf-8", "ignore") for k in kept]
                columns = [
                    pa.array([None if x == NO_ID else x for x in batch.ids.tolist()], pa.int64()),
                    pa.array(batch.lengths),
                    pa.array(lost, pa.int64()),
                    pa.array(begun, pa.int64()),
                    pa.array(digests, pa.string()),
                ] + ([pa.array(kept, pa.string() if decoded else pa.binary()), pa.array(row["carried"], pa.list_(pa.string()))] if with_text else [])
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in kinds.split(", ")])
        release()

    given = ["batch", "ids", "lengths", "data", "spans"] + ["carried"] * with_text
    return batches.join(spans, "batch", "left").select(*given).mapInArrow(run, kinds)


def dedup(docs: DataFrame, span: int = SPAN, piece: int = PIECE, common: int = COMMON, with_text: bool = False, carry: tuple[str, ...] = (), decoded: bool = False) -> DataFrame:
    """docs: doc_id, text, any more. A row for each input row; see removed(). A null text is empty. Rows with one doc_id are one document for
    each other: neither removes from the other. A row with null doc_id loses what any other document holds, and takes from none. Texts of any length
    are read whole, in stretches of STEP_BYTES; carry names columns whatever else docs has."""
    batches = saved(batches_of(docs, carry=carry))
    size = batches.select(F.coalesce(F.sum(F.expr("aggregate(lengths, 0L, (s, x) -> s + x)")), F.lit(0))).first()[0]
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES)
    codes = repeated(batches, buckets, span, piece, common)
    spans = spans_of(stretches(batches, codes, buckets, span, piece), span)
    return removed(batches, spans, with_text, decoded)
