"""Media columns as progressive JPEG.

A payload of 64-byte units is stored without loss as the quantised coefficients of 8 x 8 blocks (quantisers of one; a byte less 128 is a
coefficient, in zigzag order), six units to a 4:2:0 unit: four of luma and two of chroma. Scans, in this order: DC without its last bit; coefficients 1 to 5
without their last bit; 6 to 63; the last bit of DC; the last bits of 1 to 5 (spectral selection and successive approximation).

The reader takes any such file of one to three components with Huffman tables: it adds the scans up in coefficient arrays, inverts the
transform, repeats chroma to full size and gives RGB. Restart intervals of all files of a batch with the same kind of scan are decoded side by
side: a step of numpy reads one symbol of each interval. A file without restart markers is a single lane, slow but right.

All arithmetic is on whole numbers (held exactly in doubles for the transform), so equal files give equal tensors in any batch."""

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

UNIT = 64
RESTART = 4
WIDE = 16
TALLEST = 4095
CHUNK_BYTES = 1 << 20
BAND = 5
# Lanes that are written or read side by side, and the bytes of a scan that are read at once.
SLICE_LANES = 2048
SLICE_BYTES = 1 << 20
# Blocks that are transformed at once.
SLICE_BLOCKS = 8192

# Huffman tables by rule: (class, id) -> {symbol: code length}. Symbols are run * 16 + size.
LENGTHS = {
    (0, 0): {s: 4 for s in range(12)},
    (1, 0): {r * 16 + s: 3 if r == 0 and 2 <= s <= 7 else 10 for r in range(16) for s in range(9)},
    (1, 1): {r * 16 + s: 1 if r == s == 0 else 6 for r in range(16) for s in range(2)},
}


def zigzag() -> np.ndarray:
    """Natural place (row * 8 + column) of each zigzag place: along diagonals, turning at each end."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([r * 8 + c for r, c in cells])


ZIGZAG = zigzag()


def codes_of(lengths: dict[int, int]) -> tuple[list[int], list[int], dict[int, tuple[int, int]]]:
    """(how many codes of each length 1-16, symbols in order, symbol -> (code, length)): canonical codes."""
    ordered = sorted(lengths, key=lambda s: (lengths[s], s))
    counts = [sum(n == k for n in lengths.values()) for k in range(1, 17)]
    return counts, ordered, assigned(counts, ordered)


def assigned(counts: list[int], ordered: list[int]) -> dict[int, tuple[int, int]]:
    out, code, at = {}, 0, 0
    for n, many in enumerate(counts, 1):
        for _ in range(many):
            out[ordered[at]] = (code, n)
            code, at = code + 1, at + 1
        code <<= 1
    return out


def lookup(table: dict[int, tuple[int, int]]) -> np.ndarray:
    """For each 16 bits ahead: symbol * 32 + code length, zero where no code fits."""
    out = np.zeros(1 << 16, np.int64)
    for symbol, (code, n) in table.items():
        out[code << (16 - n) : (code + 1) << (16 - n)] = symbol * 32 + n
    return out


_WRITE = {}
for _key, _lengths in LENGTHS.items():
    _codes = np.zeros((256, 2), np.int64)
    for _s, _cn in codes_of(_lengths)[2].items():
        _codes[_s] = _cn
    _WRITE[_key] = _codes


def _size(v: np.ndarray) -> np.ndarray:
    """Bits of a magnitude."""
    return np.frexp(np.abs(v).astype(np.float64))[1]


def _within(counts: np.ndarray) -> np.ndarray:
    """0 .. n - 1 for each n of counts."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


# -- writing


def _bits(value: np.ndarray, size: np.ndarray, lane: np.ndarray, lanes: int, last: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, end of each lane): tokens of each lane in order, filled up with ones, bytes of 255 stuffed, a restart marker after each lane
    that isn't the last of its scan. last, number: for each lane, whether it is, and its number in the scan."""
    total = np.bincount(lane, weights=size, minlength=lanes).astype(np.int64)
    fill = -total % 8
    first = np.cumsum(total + fill) - total - fill
    ahead = np.cumsum(size) - size
    begins = np.searchsorted(lane, np.arange(lanes))
    padded = np.concatenate((ahead, [size.sum()]))
    place = first[lane] + ahead - padded[begins][lane]
    place, value, size = np.concatenate((place, first + total)), np.concatenate((value, (1 << fill) - 1)), np.concatenate((size, fill))
    words = int((total + fill).sum()) // 32 + 2
    wide = value.astype(np.uint64) << (64 - (place & 31) - size).astype(np.uint64)
    at = place >> 5
    data = np.bincount(at, weights=(wide >> np.uint64(32)).astype(np.float64), minlength=words + 1)[: words + 1]
    data[1:] += np.bincount(at, weights=(wide & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=words + 1)[:words]
    raw = data.astype(np.uint32).astype(">u4").view(np.uint8)[: int((total + fill).sum()) // 8]
    ends = np.cumsum(total + fill) // 8
    full = raw == 255
    marks = np.where(last, 0, 2)
    of = np.repeat(np.arange(lanes), (total + fill) // 8)
    before = np.cumsum(marks) - marks
    where = np.arange(len(raw)) + np.cumsum(full) - full + before[of]
    stuffed = np.concatenate(([0], np.cumsum(full)))[ends]
    stop = ends + stuffed + before
    out = np.zeros(len(raw) + int(full.sum()) + int(marks.sum()), np.uint8)
    out[where] = raw
    out[stop[~last]] = 255
    out[stop[~last] + 1] = 0xD0 + number[~last] % 8
    return out, stop + marks


def _signed_bits(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(v >= 0, v, v + (1 << size) - 1)


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([255, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _scan_header(parts: list[tuple[int, int, int]], first: int, last: int, high: int, low: int) -> bytes:
    return _segment(0xDA, bytes([len(parts)]) + b"".join(bytes([c, d << 4 | a]) for c, d, a in parts) + bytes([first, last, high << 4 | low]))


_TABLES = b"".join(_segment(0xC4, bytes([c << 4 | i]) + bytes(codes_of(n)[0]) + bytes(codes_of(n)[1])) for (c, i), n in LENGTHS.items())


def write(payloads: list[bytes]) -> list[bytes]:
    """A file for each payload, whose length is a multiple of UNIT (and above zero)."""
    units = np.array([len(p) // UNIT for p in payloads])
    mcus = -(-units // 6)
    rows = np.maximum(1, -(-mcus // np.maximum(WIDE, -(-mcus // TALLEST))))
    wide = -(-mcus // rows)
    cells = wide * rows
    n = len(payloads)
    data = np.zeros((int(cells.sum()) * 6, UNIT), np.int16)
    at = np.repeat((np.cumsum(cells) - cells) * 6, units) + _within(units)
    data[at] = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, UNIT).astype(np.int16) - 128
    data = data.reshape(-1, 6, UNIT)
    # raster order of luma blocks within each picture
    m = _within(cells)
    w = np.repeat(wide, cells)
    start = np.repeat((np.cumsum(cells) - cells) * 4, cells)
    luma = np.empty((len(data) * 4, UNIT), np.int16)
    for j in range(4):
        luma[start + (2 * (m // w) + j // 2) * 2 * w + 2 * (m % w) + j % 2] = data[:, j]
    planes, blocks = [luma, data[:, 4], data[:, 5]], [cells * 4, cells, cells]
    pieces: list[list[bytes]] = [[_segment(0xFE, int(u).to_bytes(8, "big"))] for u in units]

    def lanes_of(counts: np.ndarray):
        per = -(-counts // RESTART)
        number = _within(per)
        return per, number, number == np.repeat(per, per) - 1, np.repeat(np.cumsum(per) - per, counts) + _within(counts) // RESTART

    def add(header: bytes, counts: np.ndarray, tokens) -> None:
        """A scan of every file. tokens(first, last): (value, bits, block) of the blocks in between; lanes are whole bytes, so runs of lanes follow one another."""
        per, number, last, lane = lanes_of(counts)
        lanes = int(per.sum())
        begin = np.concatenate(([0], np.cumsum(np.bincount(lane, minlength=lanes))))
        parts, stops, held = [], [], 0
        for i in range(0, lanes, SLICE_LANES):
            j = min(i + SLICE_LANES, lanes)
            value, size, block = tokens(int(begin[i]), int(begin[j]))
            out, stop = _bits(value, size, lane[block] - i, j - i, last[i:j], number[i:j])
            parts.append(out.tobytes())
            stops.append(stop + held)
            held += len(out)
        whole, ends = b"".join(parts), np.concatenate(stops)[np.cumsum(per) - 1].tolist()
        for k, (a, b) in enumerate(zip([0, *ends[:-1]], ends)):
            pieces[k] += [header, whole[a:b]]

    every = [(1, 0, 0), (2, 0, 0), (3, 0, 0)]
    lane = lanes_of(cells)[3]
    dc = data[:, :, 0].astype(np.int64) >> 1
    fresh = np.concatenate(([True], lane[1:] != lane[:-1]))
    before = np.zeros_like(dc)
    before[:, 1:4] = dc[:, :3]
    for j, k in ((0, 3), (4, 4), (5, 5)):
        before[1:, j] = dc[:-1, k]
        before[fresh, j] = 0
    diff = (dc - before).ravel()
    size = _size(diff)
    code = _WRITE[0, 0][size]
    value, width = code[:, 0] << size | _signed_bits(diff, size), code[:, 1] + size
    add(_scan_header(every, 0, 0, 0, 1), cells, lambda a, b: (value[a * 6 : b * 6], width[a * 6 : b * 6], np.repeat(np.arange(a, b), 6)))

    def band(plane: np.ndarray, first: int, last: int, low: int):
        v = plane[:, first : last + 1].astype(np.int64)
        v = np.sign(v) * (np.abs(v) >> low)
        b, k = np.nonzero(v)
        v = v[b, k]
        prior = np.where(np.concatenate(([True], b[1:] != b[:-1])), -1, np.concatenate(([-1], k[:-1])))
        run, size = k - prior - 1, _size(v)
        code = _WRITE[1, 0][(run % 16) * 16 + size]
        skips = run // 16  # runs of 16 zeros
        tail = np.full(len(plane), -1)
        tail[b] = k  # the last of a block wins
        open_ = np.flatnonzero(tail < last - first)
        skip, stop = _WRITE[1, 0][0xF0], _WRITE[1, 0][0]
        key = np.concatenate((np.repeat(b * 192 + k * 2, skips), b * 192 + k * 2 + 1, open_ * 192 + 191))
        value = np.concatenate((np.full(skips.sum(), skip[0]), code[:, 0] << size | _signed_bits(v, size), np.full(len(open_), stop[0])))
        width = np.concatenate((np.full(skips.sum(), skip[1]), code[:, 1] + size, np.full(len(open_), stop[1])))
        order = np.argsort(key, kind="stable")
        return value[order], width[order], key[order] // 192

    def last_bits(plane: np.ndarray):
        # A symbol for each coefficient that becomes nonzero now, then the bits of those that were; at the end of a block the rest.
        v = plane[:, 1 : BAND + 1].astype(np.int64)
        size = np.abs(v)
        old, new = size > 1, size == 1
        block, k = np.nonzero(old | new)
        is_new, zero = new[block, k], ~old & ~new
        zeros_before = np.cumsum(np.concatenate((np.zeros((len(v), 1), int), zero), axis=1), axis=1)
        following = np.full((len(v), BAND + 1), BAND)
        for j in range(BAND - 1, -1, -1):
            following[:, j] = np.where(new[:, j], j, following[:, j + 1])
        earlier = np.full((len(v), BAND + 1), 0)
        for j in range(1, BAND + 1):
            earlier[:, j] = np.where(new[:, j - 1], j, earlier[:, j - 1])
        nb, nk = block[is_new], k[is_new]
        run = zeros_before[nb, nk] - zeros_before[nb, earlier[nb, nk]]
        code = _WRITE[1, 1][run * 16 + 1]
        ob, ok = block[~is_new], k[~is_new]
        left = (following[:, 0] < BAND)
        after_last = earlier[:, BAND]
        rest = (after_last < BAND)  # coefficients remain after the last new one, or there was none
        ends = np.flatnonzero(rest | ~left)
        stop = _WRITE[1, 1][0]
        key = np.concatenate((nb * 64 + nk * 8, ob * 64 + following[ob, ok] * 8 + 1 + ok, ends * 64 + BAND * 8))
        value = np.concatenate((code[:, 0] << 1 | (v[nb, nk] > 0), size[ob, ok] & 1, np.full(len(ends), stop[0])))
        width = np.concatenate((code[:, 1] + 1, np.ones(len(ob), int), np.full(len(ends), stop[1])))
        order = np.argsort(key, kind="stable")
        return value[order], width[order], key[order] // 64

    def within(how, plane: np.ndarray, *args):
        def tokens(a: int, b: int):
            value, size, block = how(plane[a:b], *args)
            return value, size, block + a

        return tokens

    for first, last, low in ((1, BAND, 1), (BAND + 1, 63, 0)):
        for c in range(3):
            add(_scan_header([(c + 1, 0, 0)], first, last, 0, low), blocks[c], within(band, planes[c], first, last, low))
    bit = (data[:, :, 0] & 1).astype(np.int64).ravel()
    add(_scan_header(every, 0, 0, 1, 0), cells, lambda a, b: (bit[a * 6 : b * 6], np.ones((b - a) * 6, np.int64), np.repeat(np.arange(a, b), 6)))
    for c in range(3):
        add(_scan_header([(c + 1, 0, 1)], 1, BAND, 1, 0), blocks[c], within(last_bits, planes[c]))
    out = []
    for i in range(n):
        frame = _segment(0xC2, bytes([8]) + int(rows[i] * 16).to_bytes(2, "big") + int(wide[i] * 16).to_bytes(2, "big") + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
        head = b"\xff\xd8" + pieces[i][0] + _segment(0xDB, bytes([0]) + bytes([1] * 64)) + frame + _TABLES + _segment(0xDD, RESTART.to_bytes(2, "big"))
        out.append(head + b"".join(pieces[i][1:]) + b"\xff\xd9")
    return out


# -- reading


@dataclass
class Component:
    name: int
    across: int
    down: int
    quantiser: int
    wide: int = 0  # blocks that scans of this component alone cover
    high: int = 0
    stride: int = 0  # blocks held in a row
    rows: int = 0
    base: int = 0  # first block in the batch's array


@dataclass
class Picture:
    width: int = 0
    height: int = 0
    units: int = -1  # of the comment, else -1
    parts: list[Component] = field(default_factory=list)
    quantisers: dict[int, np.ndarray] = field(default_factory=dict)
    mcus: tuple[int, int] = (0, 0)


@dataclass
class Scan:
    picture: int
    data: np.ndarray
    parts: list[Component]
    restart: int
    skip: int = 0  # lanes before data, and lanes in it (all: -1)
    lanes: int = -1


def _slices(scans: list[Scan]):
    """Runs of scans of about SLICE_BYTES; a longer scan is parted at its restart markers."""
    got, held = [], 0
    for scan in scans:
        parts = [scan]
        if len(scan.data) > SLICE_BYTES and scan.restart:
            full = np.flatnonzero(scan.data[:-1] == 255)
            marks = full[(scan.data[full + 1] >= 0xD0) & (scan.data[full + 1] <= 0xD7)]
            cuts = np.searchsorted(marks, np.arange(SLICE_BYTES, len(scan.data), SLICE_BYTES))
            cuts = np.unique(cuts[cuts < len(marks)])
            begins, firsts = [0, *(marks[cuts] + 2).tolist()], [0, *(cuts + 1).tolist()]
            ends, stops = [*marks[cuts].tolist(), len(scan.data)], [*firsts[1:], len(marks) + 1]
            parts = [Scan(scan.picture, scan.data[a:b], scan.parts, scan.restart, i, j - i) for a, b, i, j in zip(begins, ends, firsts, stops)]
        for part in parts:
            if got and held + len(part.data) > SLICE_BYTES:
                yield got
                got, held = [], 0
            got.append(part)
            held += len(part.data)
    if got:
        yield got


def _parse(data: bytes, marks: list[int], raw: np.ndarray, index: int, base: int, groups: dict) -> tuple[Picture, int]:
    """Read one file's segments; its scans go to groups, in order of kinds of scan. base: first free block of the batch."""
    picture, restart, tables, at, order = Picture(), 0, {}, 2, 0
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    where = 0
    while True:
        while data[at] == 255 and data[at + 1] == 255:
            at += 1
        marker = data[at + 1]
        if marker == 0xD9:
            return picture, base
        size = data[at + 2] << 8 | data[at + 3]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xFE and len(body) == 8:
            picture.units = int.from_bytes(body, "big")
        elif marker == 0xDB:
            i = 0
            while i < len(body):
                wide, name = body[i] >> 4, body[i] & 15
                step = 128 if wide else 64
                picture.quantisers[name] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, i + 1).astype(np.float64)
                i += 1 + step
        elif marker == 0xDD:
            restart = body[0] << 8 | body[1]
        elif marker == 0xC4:
            i = 0
            while i < len(body):
                counts = body[i + 1 : i + 17]
                n = sum(counts)
                tables[body[i] >> 4, body[i] & 15] = (counts, body[i + 17 : i + 17 + n])
                i += 17 + n
        elif marker == 0xC2:
            picture.height, picture.width = body[1] << 8 | body[2], body[3] << 8 | body[4]
            picture.parts = [Component(body[6 + 3 * c], body[7 + 3 * c] >> 4, body[7 + 3 * c] & 15, body[8 + 3 * c]) for c in range(body[5])]
            most_across, most_down = max(p.across for p in picture.parts), max(p.down for p in picture.parts)
            picture.mcus = (-(-picture.width // (8 * most_across)), -(-picture.height // (8 * most_down)))
            for p in picture.parts:
                p.wide, p.high = -(-(-(-picture.width * p.across // most_across)) // 8), -(-(-(-picture.height * p.down // most_down)) // 8)
                p.stride, p.rows, p.base = picture.mcus[0] * p.across, picture.mcus[1] * p.down, base
                base += p.stride * p.rows
        elif marker in (0xC0, 0xC1, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF):
            raise ValueError("only progressive Huffman files are read")
        elif marker == 0xDA:
            n = body[0]
            names = {p.name: p for p in picture.parts}
            parts = [names[body[1 + 2 * c]] for c in range(n)]
            first, last, shift = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n]
            used = tuple(tables.get((0, body[2 + 2 * c] >> 4) if first == 0 else (1, body[2 + 2 * c] & 15)) for c in range(n))
            while marks[where] < at:
                where += 1
            end = marks[where]
            layout = tuple((p.across, p.down) for p in parts) if n > 1 else ()
            groups.setdefault((order, first, last, shift >> 4, shift & 15, used, layout), []).append(Scan(index, raw[at:end], parts, restart))
            order += 1
            at = end


def _lanes(scans: list[Scan], pictures: list[Picture]):
    """(64 bits ahead of each byte, first bit of each lane, scan of each lane, first MCU, MCUs)."""
    data = np.concatenate([s.data for s in scans] + [np.zeros(16, np.uint8)])
    lengths = np.array([len(s.data) for s in scans])
    counts = np.array([s.parts[0].wide * s.parts[0].high if len(s.parts) == 1 else pictures[s.picture].mcus[0] * pictures[s.picture].mcus[1] for s in scans])
    full = np.flatnonzero(data[:-1] == 255)
    after = data[full + 1]
    marks = full[(after >= 0xD0) & (after <= 0xD7)]
    drop = np.zeros(len(data), bool)
    drop[full[after == 0] + 1] = True
    drop[marks] = True
    drop[marks + 1] = True
    place = np.cumsum(~drop) - ~drop  # of each byte once the dropped are gone
    firsts = np.concatenate((np.cumsum(lengths) - lengths, marks + 2))
    firsts.sort(kind="stable")
    restart = np.array([s.restart or n for s, n in zip(scans, counts)])
    every, skip, lanes = -(-counts // np.maximum(restart, 1)), np.array([s.skip for s in scans]), np.array([s.lanes for s in scans])
    per = np.where(lanes < 0, every, lanes)
    if per.sum() != len(firsts) or (skip + per > every).any():
        raise ValueError("restart markers don't fit the frame")
    of = np.repeat(np.arange(len(scans)), per)
    number = _within(per) + skip[of]
    raw = data[~drop].astype(np.uint64)
    ahead = np.zeros(len(raw), np.uint64)
    for j in range(8):
        ahead[: len(raw) - j] |= raw[j:] << np.uint64(56 - 8 * j)
    return ahead, place[firsts] * 8, of, number * restart[of], np.minimum(restart[of], counts[of] - number * restart[of])


def _peek(ahead: np.ndarray, bit: np.ndarray) -> np.ndarray:
    return ahead[bit >> 3] << (bit & 7).astype(np.uint64)


def _extended(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(v < (1 << np.maximum(size - 1, 0)), v - (1 << size) + 1, v)


def _take(word: np.ndarray, used: np.ndarray, size: np.ndarray) -> np.ndarray:
    """size bits after the first used bits of word; zero bits are zero."""
    v = ((word << used.astype(np.uint64)) >> np.uint64(1)) >> (63 - size).astype(np.uint64)
    return v.astype(np.int64)


def _block_of(parts: list[list], of: np.ndarray, mcu: np.ndarray, c: int, j: int, scans: list[Scan], wide: np.ndarray) -> np.ndarray:
    base, stride = parts[c]
    across = scans[0].parts[c].across
    down = scans[0].parts[c].down
    return base[of] + (mcu // wide[of] * down + j // across) * stride[of] + mcu % wide[of] * across + j % across


def _read_group(key: tuple, scans: list[Scan], pictures: list[Picture], coefficients: np.ndarray) -> None:
    _, first, last, high, low, used, layout = key
    ahead, bit, of, start, count = _lanes(scans, pictures)
    flat = coefficients.reshape(-1)
    tables = [lookup(assigned(list(t[0]), list(t[1]))) if t else None for t in used]
    if first == 0:
        # DC, interleaved or not: the blocks of an MCU come in a fixed order, so lanes stay in step.
        parts = [[np.array([s.parts[c].base for s in scans]), np.array([s.parts[c].stride for s in scans])] for c in range(len(scans[0].parts))]
        single = len(scans[0].parts) == 1
        wide = np.array([s.parts[0].wide if single else pictures[s.picture].mcus[0] for s in scans])
        plan = [(0, 0)] if single else [(c, j) for c, (a, d) in enumerate(layout) for j in range(a * d)]
        predicted = np.zeros((len(parts), len(bit)), np.int64)
        live = np.arange(len(bit))
        step = 0
        while len(live):
            for c, j in plan:
                mcu = start[live] + step
                block = parts[c][0][of[live]] + mcu // wide[of[live]] * parts[c][1][of[live]] + mcu % wide[of[live]] if single else _block_of(parts, of[live], mcu, c, j, scans, wide)
                word = _peek(ahead, bit[live])
                if high:
                    flat[block * 64] |= ((word >> np.uint64(63)).astype(np.int64) << low).astype(flat.dtype)
                    bit[live] += 1
                    continue
                entry = tables[c][(word >> np.uint64(48)).astype(np.int64)]
                n, size = entry & 31, entry >> 5
                predicted[c, live] += _extended(_take(word, n, size), size)
                flat[block * 64] = predicted[c, live] << low
                bit[live] += n + size
            step += 1
            live = live[count[live] > step]
        return
    part = [s.parts[0] for s in scans]
    base, stride, wide = (np.array([getattr(p, x) for p in part])[of] for x in ("base", "stride", "wide"))
    table = tables[0]
    live, done, k = np.arange(len(bit)), np.zeros(len(bit), np.int64), np.full(len(bit), first)

    def where(lanes: np.ndarray, blocks: np.ndarray, places: np.ndarray) -> np.ndarray:
        at = start[lanes] + blocks
        return (base[lanes] + at // wide[lanes] * stride[lanes] + at % wide[lanes]) * 64 + places

    if not high:
        # State of the live lanes, kept together: bits, blocks done, next coefficient.
        b, d, q, total = bit, done, k, count
        even = all(p.wide == p.stride for p in part)
        block0 = (base + start) * 64
        while len(live):
            word = _peek(ahead, b)
            entry = table[(word >> np.uint64(48)).astype(np.int64)]
            n, symbol = entry & 31, entry >> 5
            run, size = symbol >> 4, symbol & 15
            stop = (size == 0) & (run < 15)
            extra = np.where(stop, run, size)
            v = _take(word, n, extra)
            b = b + n + extra
            q = q + run
            put = np.flatnonzero(size)
            at = block0[put] + d[put] * 64 + q[put] if even else where(live[put], d[put], q[put])
            flat[at] = _extended(v[put], size[put]) << low
            q = q + 1
            over = q > last
            d = np.where(stop, d + (1 << run) + v, d + over)
            q = np.where(stop | over, first, q)
            keep = d < total
            if not keep.all():
                live, b, d, q, total, block0 = live[keep], b[keep], d[keep], q[keep], total[keep], block0[keep]
        return
    # Refinement. mode 0: read a symbol; 1: pass `zeros` zero coefficients, then set one; 2: to the end of `blocks` blocks only bits of nonzero ones.
    mode, zeros, value, blocks = (np.zeros(len(bit), np.int64) for _ in range(4))
    while len(live):
        ask = live[mode[live] == 0]
        if len(ask):
            word = _peek(ahead, bit[ask])
            entry = table[(word >> np.uint64(48)).astype(np.int64)]
            n, symbol = entry & 31, entry >> 5
            run, size = symbol >> 4, symbol & 15
            stop = (size == 0) & (run < 15)
            extra = np.where(stop, run, size)
            v = _take(word, n, extra)
            bit[ask] += n + extra
            mode[ask], zeros[ask] = np.where(stop, 2, 1), run
            value[ask] = np.where(size == 1, np.where(v == 1, 1, -1) << low, 0)
            blocks[ask] = (1 << run) + v
        at = where(live, done[live], k[live])
        held = flat[at].astype(np.int64)
        old = held != 0
        lane = live[old]
        more = (_peek(ahead, bit[lane]) >> np.uint64(63)).astype(np.int64) << low
        flat[at[old]] = held[old] + np.sign(held[old]) * more
        bit[lane] += 1
        lane, spot = live[~old & (mode[live] == 1)], at[~old & (mode[live] == 1)]
        here = zeros[lane] == 0
        flat[spot[here]] = value[lane[here]]
        mode[lane[here]] = 0
        zeros[lane] -= 1
        k[live] += 1
        over = live[k[live] > last]
        k[over] = first
        done[over] += 1
        run_out = over[mode[over] == 2]
        blocks[run_out] -= 1
        mode[run_out[blocks[run_out] == 0]] = 0
        mode[over[mode[over] == 1]] = 0
        live = live[done[live] < count[live]]


def basis() -> np.ndarray:
    """The inverse transform's matrix times 4096, in whole numbers: with it all sums stay exact in doubles."""
    x, u = np.arange(8)[:, None], np.arange(8)[None, :]
    return np.round(4096 * np.where(u == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * x + 1) * u * np.pi / 16))


_BASIS = basis()


def _samples(blocks: np.ndarray, quantiser: np.ndarray) -> np.ndarray:
    """(n, 64) coefficients in zigzag order to (n, 8, 8) samples of 0 to 255."""
    square = np.empty(blocks.shape)  # doubles
    square[:, ZIGZAG] = blocks * quantiser
    square = square.reshape(-1, 8, 8)
    out = (square.reshape(-1, 8) @ _BASIS.T).reshape(-1, 8, 8).transpose(0, 2, 1)
    out = (np.ascontiguousarray(out).reshape(-1, 8) @ _BASIS.T).reshape(-1, 8, 8).transpose(0, 2, 1)
    return np.clip(np.floor(out / 4096**2 + 128.5), 0, 255).astype(np.uint8)


def read(files: list[bytes]) -> list[tuple[Picture, list[np.ndarray], np.ndarray]]:
    """For each file its picture, its coefficients by component (blocks in raster order, zigzag order within) and its (height, width, 3) RGB tensor."""
    joined = np.frombuffer(b"".join(files), np.uint8)
    after = np.concatenate((joined[1:], [0]))
    marks = np.flatnonzero((joined == 255) & (after != 0) & (after != 255) & ((after < 0xD0) | (after > 0xD7)))
    starts = np.cumsum([len(f) for f in files]) - [len(f) for f in files]
    bounds = np.searchsorted(marks, [*starts, len(joined)])
    pictures, groups, base = [], {}, 0
    for i, data in enumerate(files):
        own = (marks[bounds[i] : bounds[i + 1]] - starts[i]).tolist()
        picture, base = _parse(data, own, joined[starts[i] : starts[i] + len(data)], i, base, groups)
        pictures.append(picture)
    coefficients = np.zeros((base, 64), np.int16)
    for key in sorted(groups, key=lambda g: g[0]):
        for scans in _slices(groups[key]):
            _read_group(key, scans, pictures, coefficients)
    if not files:
        return []
    quantiser = {}
    for picture in pictures:
        for p in picture.parts:
            quantiser.setdefault(picture.quantisers[p.quantiser].tobytes(), []).append((p.base, p.base + p.stride * p.rows))
    samples = np.empty((base, 8, 8), np.uint8)
    for q, ranges in quantiser.items():
        for first, last in [(0, base)] if len(quantiser) == 1 else ranges:
            for a in range(first, last, SLICE_BLOCKS):
                b = min(a + SLICE_BLOCKS, last)
                samples[a:b] = _samples(coefficients[a:b], np.frombuffer(q))
    out = []
    for picture in pictures:
        planes, own = [], []
        across, down = max(p.across for p in picture.parts), max(p.down for p in picture.parts)
        for p in picture.parts:
            own.append(coefficients[p.base : p.base + p.stride * p.rows])
            plane = samples[p.base : p.base + p.stride * p.rows].reshape(p.rows, p.stride, 8, 8).transpose(0, 2, 1, 3).reshape(p.rows * 8, p.stride * 8)
            if (across, down) != (p.across, p.down):
                plane = plane.repeat(down // p.down, axis=0).repeat(across // p.across, axis=1)
            planes.append(plane[: picture.height, : picture.width])
        rgb = np.empty((picture.height, picture.width, 3), np.uint8)
        step = max(1, SLICE_BLOCKS * 64 // max(1, picture.width))
        for at in range(0, picture.height, step):
            rgb[at : at + step] = _coloured([p[at : at + step].astype(np.int32) for p in planes])
        out.append((picture, own, rgb))
    return out


def _coloured(planes: list[np.ndarray]) -> np.ndarray:
    y = planes[0]
    colours = (y, y, y)
    if len(planes) == 3:
        blue, red = planes[1] - 128, planes[2] - 128
        colours = (y + ((91881 * red + 32768) >> 16), y - ((22554 * blue + 46802 * red + 32768) >> 16), y + ((116130 * blue + 32768) >> 16))
    return np.clip(np.stack(colours, axis=-1), 0, 255)


def payload_of(picture: Picture, coefficients: list[np.ndarray]) -> bytes:
    """The payload that write() stored."""
    wide, rows = picture.mcus
    m = np.arange(wide * rows)
    data = np.empty((wide * rows, 6, UNIT), np.uint8)
    for j in range(4):
        data[:, j] = coefficients[0][(2 * (m // wide) + j // 2) * 2 * wide + 2 * (m % wide) + j % 2] + 128
    data[:, 4], data[:, 5] = coefficients[1] + 128, coefficients[2] + 128
    return data.reshape(-1, UNIT)[: picture.units].tobytes()


# -- columns


def payload(text: str | None) -> tuple[bytes, int]:
    """(text as UTF-8 with zero bytes up to a positive multiple of UNIT, its length without them); null is empty."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + bytes(-len(data) % UNIT if data else UNIT), len(data)


def _chunks(column: pa.Array):
    got, held = [], 0
    for x in column:
        got.append(payload(x.as_py()))
        held += len(got[-1][0])
        if held >= CHUNK_BYTES:
            yield got
            got, held = [], 0
    if got:
        yield got


def feature(rgb: np.ndarray) -> str:
    """Size, mean of each channel, and checksum of the tensor."""
    means = rgb.reshape(-1, 3).sum(axis=0, dtype=np.int64) / (rgb.shape[0] * rgb.shape[1])
    return f"{rgb.shape[1]}x{rgb.shape[0]} " + " ".join(f"{m:.4f}" for m in means) + f" {zlib.crc32(np.ascontiguousarray(rgb)):08x}"


def to_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media binary): each text's payload as a progressive JPEG file. Null is empty text; a row for each input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for got in _chunks(batch.column(1)):
                files = write([p for p, _ in got])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(got)), pa.array([n for _, n in got], pa.int64()), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media"])
                at += len(got)

    return small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def to_tensors(media: DataFrame) -> DataFrame:
    """media (doc_id, media) with height, width, rgb (binary, height x width x 3 bytes) and reason: why there is no tensor (a null, or a file that
    isn't such a JPEG), else null. A row for each input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a tensor is some times its file: one at a time
                data, rgb, reason = batch.column(1)[i].as_py(), None, None
                if data is None:
                    reason = "null"
                else:
                    try:
                        rgb = read([data])[0][2]
                    except (ValueError, IndexError, KeyError, TypeError) as e:
                        reason = str(e) or "not a readable file"
                shape = (None, None) if rgb is None else rgb.shape[:2]
                columns = [pa.array([shape[0]], pa.int32()), pa.array([shape[1]], pa.int32()), pa.array([None if rgb is None else rgb.tobytes()], pa.binary()), pa.array([reason], pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), *columns], names=["doc_id", "height", "width", "rgb", "reason"])

    return small_batches(media).select(F.col("doc_id").cast("long"), "media").mapInArrow(run, "doc_id long, height int, width int, rgb binary, reason string")


DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digests(docs: DataFrame) -> DataFrame:
    """For each row of docs (doc_id, text): what to_media() stores, read back, and the feature of its tensor, without leaving the task.

    Null and empty texts are one unit of zero bytes. Texts of any length are stored whole, in memory of about 30 times the text's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for got in _chunks(batch.column(1)):
                files = write([p for p, _ in got])
                rows = []
                for (_, n), data, (picture, coefficients, rgb) in zip(got, files, read(files)):
                    back = payload_of(picture, coefficients)
                    rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature(rgb)))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(got)), *columns], names=[x.split()[0] for x in DIGESTS.split(", ")])
                at += len(got)

    return small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, DIGESTS)
