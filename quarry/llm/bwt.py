"""Burrows-Wheeler transforms of collections of short texts, and their merge.

Merging never sorts suffixes again. The interleave says from which shard each row of the merged order comes. Row j of shard s has the
symbol that precedes its suffix; sorting the interleave stably by those symbols turns an order by h symbols into one by h + 1. Neighbouring rows
are in one class while their symbols and the classes they come from agree, so after d rounds classes are the suffixes that share d symbols.

Symbols are bytes; END closes each text and isn't a byte of any text (callers map it away)."""

import numpy as np

END = 0


def transform(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(places, symbols) of a shard: its suffixes in order, as places in the texts joined with an END after each, and the symbol before
    each (END's is the last of its own text; a text's first has END). texts must be sorted and distinct: then equal rows keep one order throughout."""
    data = np.frombuffer(bytes([END]).join(texts) + bytes([END]), dtype=np.uint8)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(lengths + 1) - 1
    n, m = len(data), len(texts)
    rank = data.astype(np.int64) + m
    rank[ends] = np.arange(m)  # each END is a symbol of its own
    width, step = m + 256, 1
    if width**4 < 2**62:
        padded = np.concatenate((rank, np.zeros(3, np.int64)))
        rank, step = ((padded[:n] * width + padded[1 : n + 1]) * width + padded[2 : n + 2]) * width + padded[3 : n + 3], 4
    order = np.argsort(rank, kind="stable")
    while True:
        new = np.concatenate(([0], np.cumsum(rank[order][1:] != rank[order][:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            break
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1 if step < n else 0
        rank = rank * (n + 1) + after
        order = np.argsort(rank, kind="stable")
        step *= 2
    before = np.arange(n) - 1
    before[np.concatenate(([0], ends[:-1] + 1))] = ends
    return order, data[before[order]]


def merge(shards: list[tuple[np.ndarray, np.ndarray]], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shard, row, class) of each row of the merged order: rows of a class share their first depth symbols (ENDs count as equal)."""
    if len(shards) > 65535:
        raise ValueError("too many shards in one merge")
    sizes = [len(s[1]) for s in shards]
    symbols = np.concatenate([s[1] for s in shards])
    interleave = np.repeat(np.arange(len(shards), dtype=np.uint8 if len(shards) < 256 else np.uint16), sizes)
    classes = np.zeros(len(interleave), dtype=np.int32)
    now = np.empty_like(symbols)
    for _ in range(depth):
        now[np.argsort(interleave, kind="stable")] = symbols
        by = np.argsort(now, kind="stable")
        interleave, symbol, of = interleave[by], now[by], classes[by]
        parted = (symbol[1:] != symbol[:-1]) | (of[1:] != of[:-1])
        classes = np.concatenate((np.zeros(1, np.int32), np.cumsum(parted, dtype=np.int32)))
    row = np.empty(len(interleave), dtype=np.int64)
    row[np.argsort(interleave, kind="stable")] = np.concatenate([np.arange(k) for k in sizes])
    return interleave, row, classes
