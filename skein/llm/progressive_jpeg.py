"""Progressive JPEG in numpy: entropy coding of scans, inverse transform, chroma upsampling.

The decoder accumulates spectral-selection and successive-approximation scans into coefficient
arrays. It reads all restart intervals of all images that share a scan's parameters side by
side: each interval is a lane with a bit position of its own, and each step decodes one symbol
in every lane. An image without restart markers is a single lane.

The encoder writes coefficient arrays as progressive scans (DC first and refined, a low band
whole, a high band first and refined), with a restart marker after every MCU.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property, lru_cache

import numpy as np

SIZE = 64
#: Fixed values of the format: row-major place of each coefficient in zigzag order.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))
#: Scans that the encoder writes: first and last coefficient, high and low bit of the approximation.
SCANS = ((0, 0, 0, 1), (0, 0, 1, 0), (1, 5, 0, 0), (6, 63, 0, 1), (6, 63, 1, 0))
#: Blocks of an MCU with halved chroma: 4 of Y, then Cb, Cr.
MCU = 6
MOST_COLUMNS = 4095
#: The transform in whole numbers, so that sums in doubles are exact and don't depend on their order.
TRANSFORM_BITS = 13


# --- Huffman tables ---


def _table(short: dict[int, list[int]]) -> tuple[bytes, list[int]]:
    """Counts of codes by length 1 to 16, and symbols by code."""
    counts = bytes(len(short.get(n, ())) for n in range(1, 17))
    return counts, [s for n in sorted(short) for s in short[n]]


#: Codes for sizes 0 to 11 have 4 bits.
DC_TABLE = _table({4: list(range(12))})
#: Sizes 1 to 10 without zeros before, and the end of the block, have 4 bits; the others have 10.
AC_TABLE = _table({4: [0, *range(1, 11)], 10: [r << 4 for r in range(1, 16)] + [r << 4 | s for r in range(1, 16) for s in range(1, 11)]})


@lru_cache(256)
def _codes(counts: bytes, symbols: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Code and its length, by symbol."""
    code, at, codes, lengths = 0, 0, np.zeros(256, np.int64), np.zeros(256, np.int64)
    for n, count in enumerate(counts, 1):
        for _ in range(count):
            codes[symbols[at]], lengths[symbols[at]] = code, n
            code, at = code + 1, at + 1
        code <<= 1
    return codes, lengths


@lru_cache(256)
def _lookup(counts: bytes, symbols: tuple[int, ...]) -> np.ndarray:
    """By the next 16 bits: 256 * the code's length + symbol."""
    codes, lengths = _codes(counts, symbols)
    out = np.zeros(1 << 16, np.int64)
    for s in symbols:
        n = int(lengths[s])
        lo = int(codes[s]) << (16 - n)
        out[lo : lo + (1 << (16 - n))] = n << 8 | s
    return out


def bit_size(v: np.ndarray) -> np.ndarray:
    """Bits of the absolute value."""
    return np.frexp(np.abs(v).astype(np.float64))[1].astype(np.int64)


# --- encoder ---


def mcu_columns(mcus: np.ndarray | int) -> np.ndarray | int:
    return np.minimum(mcus, MOST_COLUMNS)


def _raster(columns: int, rows: int) -> dict[int, np.ndarray]:
    """By component, the block index (6 * MCU + unit) of its blocks, row by row."""
    r, c = np.divmod(np.arange(4 * columns * rows), 2 * columns)
    mcu = np.arange(columns * rows) * MCU
    return {0: (r // 2 * columns + c // 2) * MCU + r % 2 * 2 + c % 2, 1: mcu + 4, 2: mcu + 5}


@lru_cache(4096)
def _small_raster(columns: int) -> dict[int, np.ndarray]:
    return _raster(columns, 1)


def raster(columns: int, rows: int) -> dict[int, np.ndarray]:
    return _small_raster(columns) if rows == 1 and columns <= 256 else _raster(columns, rows)


@dataclass
class Bits:
    """Values with their lengths (at most 32), each of a lane; lanes in order."""

    lane: np.ndarray
    value: np.ndarray
    length: np.ndarray


def _value_bits(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(v < 0, v + (1 << size) - 1, v)


def _dc_bits(v: np.ndarray, high: int, low: int) -> Bits:
    """v: lanes * blocks of a lane."""
    lane = np.repeat(np.arange(len(v)), v.shape[1])
    if high:
        return Bits(lane, (v.ravel() >> low) & 1, np.ones(v.size, np.int64))
    diff = np.diff(v >> low, axis=1, prepend=0).ravel()
    size = bit_size(diff)
    codes, lengths = _codes(DC_TABLE[0], tuple(DC_TABLE[1]))
    return Bits(lane, codes[size] << size | _value_bits(diff, size), lengths[size] + size)


def _ac_first_bits(v: np.ndarray, low: int) -> Bits:
    """v: lanes * band, a block in each lane."""
    codes, lengths = _codes(AC_TABLE[0], tuple(AC_TABLE[1]))
    v = np.sign(v) * (np.abs(v) >> low)
    lane, k = np.nonzero(v)
    value = v[lane, k]
    same = np.diff(lane, prepend=-1) == 0
    run = k - np.where(same, np.concatenate([[-1], k[:-1]])[: len(k)], -1) - 1
    size = bit_size(value)
    symbol = (run & 15) << 4 | size
    item = Bits(lane, codes[symbol] << size | _value_bits(value, size), lengths[symbol] + size)
    key = (lane * SIZE + k) * 8 + 7
    far = np.flatnonzero(run > 15)
    zeros = np.repeat(far, run[far] >> 4)
    short = np.flatnonzero(v[:, -1] == 0)
    if len(zeros) or len(short):
        one = lambda lanes, s: Bits(lanes, np.full(len(lanes), codes[s]), np.full(len(lanes), lengths[s]))
        parts = [item, one(lane[zeros], 0xF0), one(short, 0)]
        order = np.argsort(np.concatenate([key, key[zeros] - 1, short * SIZE * 8 + SIZE * 8 - 1]), kind="stable")
        item = Bits(*(np.concatenate([getattr(p, n) for p in parts])[order] for n in ("lane", "value", "length")))
    return item


def _ac_refine_bits(v: np.ndarray, low: int) -> Bits:
    """Lanes in which every coefficient is known already hold the end mark and correction bits;
    the few others are written one by one."""
    codes, lengths = _codes(AC_TABLE[0], tuple(AC_TABLE[1]))
    size = np.abs(v) >> low
    known = size > 1
    plain = known.all(axis=1)
    lanes = np.flatnonzero(plain)
    width = v.shape[1]
    cuts = [0, *range(16, width, 20), width]
    weights = np.zeros((width, len(cuts) - 1))
    length = np.diff(cuts)
    for i in range(len(length)):
        weights[cuts[i] : cuts[i + 1], i] = 2.0 ** np.arange(length[i] - 1, -1, -1)
    value = ((size[lanes] & 1) @ weights).astype(np.int64)  # whole numbers below 2 ** 20
    value[:, 0] |= codes[0] << length[0]
    length[0] += lengths[0]
    item = Bits(np.repeat(lanes, len(length)), value.ravel(), np.tile(length, len(lanes)))
    others = np.flatnonzero(~plain)
    if not len(others):
        return item
    out: list[tuple[int, int, int]] = []
    for lane in others.tolist():
        own, sign = size[lane].tolist(), v[lane].tolist()
        last = max((k for k, x in enumerate(own) if x == 1), default=-1)
        run, corrections = 0, []
        for k, x in enumerate(own):
            if x > 1:
                corrections.append((lane, x & 1, 1))
            elif x == 0:
                run += 1
                if run == 16 and k < last:
                    out += [(lane, int(codes[0xF0]), int(lengths[0xF0])), *corrections]
                    run, corrections = 0, []
            else:
                s = run << 4 | 1
                out += [(lane, int(codes[s]), int(lengths[s])), (lane, int(sign[k] > 0), 1), *corrections]
                run, corrections = 0, []
        if run or corrections:
            out += [(lane, int(codes[0]), int(lengths[0])), *corrections]
    more = np.array(out, np.int64).reshape(-1, 3)
    lane = np.concatenate([item.lane, more[:, 0]])
    order = np.argsort(lane, kind="stable")
    return Bits(lane[order], np.concatenate([item.value, more[:, 1]])[order], np.concatenate([item.length, more[:, 2]])[order])


def _pack(item: Bits, lanes: int, first_of_image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes of all images, and where each image's begin.

    Lanes are padded with ones to whole bytes; FF gets a zero byte; between the lanes of an
    image stand restart markers, numbered by turns from 0 to 7.
    """
    per_lane = np.bincount(item.lane, item.length, lanes).astype(np.int64)
    size = (per_lane + 7) // 8
    start = np.concatenate([[0], np.cumsum(size)])
    pad = size * 8 - per_lane
    before = np.cumsum(item.length) - item.length
    lane_before = np.concatenate([[0], np.cumsum(per_lane)])
    bit = before - lane_before[item.lane] + start[item.lane] * 8
    total = int(start[-1])
    value = item.value << (40 - item.length - (bit & 7))
    at = bit >> 3
    most = int((item.length + (bit & 7)).max(initial=0))
    raw = np.zeros(total + 8)
    for j in range((most + 7) // 8):
        raw += np.bincount(at + j, (value >> (32 - 8 * j)) & 255, total + 8)
    raw = raw[:total].astype(np.uint8)
    some = np.flatnonzero(size)
    raw[start[some + 1] - 1] |= ((1 << pad[some]) - 1).astype(np.uint8)
    is_first = np.zeros(lanes + 1, bool)
    is_first[first_of_image] = True
    marks = np.cumsum(~is_first[:lanes]) * 2  # bytes of markers up to a lane
    full = raw == 255
    lane_of = np.repeat(np.arange(lanes), size)
    stuffed = np.cumsum(full)
    place = np.arange(total) + (stuffed - full) + marks[lane_of]
    out = np.zeros(total + (int(stuffed[-1]) if total else 0) + (int(marks[-1]) if lanes else 0), np.uint8)
    out[place] = raw
    so_far = np.concatenate([[0], stuffed])
    begin = start[:lanes] + so_far[start[:lanes]] + marks
    later = np.flatnonzero(~is_first[:lanes])
    image_first = first_of_image[np.cumsum(is_first[:lanes]) - 1]
    out[begin[later] - 2] = 0xFF
    out[begin[later] - 1] = 0xD0 + ((later - image_first[later] - 1) & 7)
    return out, np.concatenate([begin[first_of_image], [len(out)]])


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _head(columns: int, rows: int, comment: bytes) -> bytes:
    table = lambda kind, t: bytes([kind]) + t[0] + bytes(t[1])
    frame = bytes([8]) + (16 * rows).to_bytes(2, "big") + (16 * columns).to_bytes(2, "big") + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    return b"\xff\xd8" + _segment(0xFE, comment) + _segment(0xDB, bytes([0]) + bytes([1] * 64)) + _segment(0xC2, frame) + _segment(0xC4, table(0x00, DC_TABLE) + table(0x10, AC_TABLE)) + _segment(0xDD, (1).to_bytes(2, "big"))


def encode(blocks: np.ndarray, mcus: np.ndarray, comments: list[bytes]) -> list[bytes]:
    """Images from coefficients in zigzag order, six blocks an MCU, MCUs of all images in turn.

    mcus: of each image; rows that aren't full are for the caller to fill up.
    """
    columns = mcu_columns(mcus)
    rows = mcus // columns
    first = np.concatenate([[0], np.cumsum(mcus)])
    by_component: dict[int, np.ndarray] = {}
    grids = [raster(int(c), int(r)) for c, r in zip(columns, rows)]
    for component in range(3):
        by_component[component] = np.concatenate([g[component] + MCU * f for g, f in zip(grids, first)]) if grids else np.zeros(0, np.int64)
    parts: list[tuple[bytes, np.ndarray, np.ndarray]] = []
    for lo, hi, high, low in SCANS:
        spec = bytes([lo, hi, high << 4 | low])
        if not lo:
            v = blocks[:, 0].astype(np.int64).reshape(-1, MCU)
            # the prediction of a component starts anew in each interval
            per = [_dc_bits(v[:, u], high, low) for u in (slice(0, 4), slice(4, 5), slice(5, 6))]
            width = [4, 1, 1]
            item = Bits(*(np.concatenate([getattr(p, n).reshape(len(v), w) for p, w in zip(per, width)], axis=1).ravel() for n in ("lane", "value", "length")))
            parts.append((_segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0]) + spec), *_pack(item, len(v), first[:-1])))
            continue
        for component in range(3):
            v = blocks[by_component[component], lo : hi + 1].astype(np.int64)
            item = _ac_refine_bits(v, low) if high else _ac_first_bits(v, low)
            parts.append((_segment(0xDA, bytes([1, component + 1, 0]) + spec), *_pack(item, len(v), first[:-1] * (4 if component == 0 else 1))))
    out = []
    for i, comment in enumerate(comments):
        scans = b"".join(head + body[at[i] : at[i + 1]].tobytes() for head, body, at in parts)
        out.append(_head(int(columns[i]), int(rows[i]), comment) + scans + b"\xff\xd9")
    return out


# --- decoder ---


@dataclass
class Scan:
    components: tuple[int, ...]
    lo: int
    hi: int
    high: int
    low: int
    dc: tuple[tuple[bytes, tuple[int, ...]] | None, ...]
    ac: tuple[bytes, tuple[int, ...]] | None
    interval: int
    data: bytes

    @cached_property
    def kind(self) -> tuple:
        return (self.lo, self.hi, self.high, self.low, self.dc, self.ac, len(self.components) if not self.lo else 1)


@dataclass
class Image:
    width: int = 0
    height: int = 0
    sampling: list[tuple[int, int]] = field(default_factory=list)
    tables: list[int] = field(default_factory=list)
    quantisers: dict[int, np.ndarray] = field(default_factory=dict)
    scans: list[Scan] = field(default_factory=list)
    comment: bytes = b""
    first_block: int = 0

    @cached_property
    def mcu_shape(self) -> tuple[int, int]:
        h, v = (max(s[i] for s in self.sampling) for i in (0, 1))
        return -(-self.height // (8 * v)), -(-self.width // (8 * h))

    @cached_property
    def units(self) -> list[tuple[int, int, int]]:
        """Component, row and column in the MCU, in the order of interleaving."""
        return [(c, y, x) for c, (h, v) in enumerate(self.sampling) for y in range(v) for x in range(h)]

    @cached_property
    def n_blocks(self) -> int:
        return self.mcu_shape[0] * self.mcu_shape[1] * len(self.units)

    def slots(self, components: tuple[int, ...]) -> np.ndarray:
        """Blocks in the order of a scan: by MCU, or row by row for a single component."""
        rows, columns = self.mcu_shape
        n = len(self.units)
        if len(components) > 1:
            own = [i for i, u in enumerate(self.units) if u[0] in components]
            return (np.arange(rows * columns)[:, None] * n + np.array(own)).ravel()
        if self.sampling == [(2, 2), (1, 1), (1, 1)] and self.width % 16 == 0 and self.height % 16 == 0:
            return raster(columns, rows)[components[0]]
        c = components[0]
        h, v = self.sampling[c]
        top = [max(s[i] for s in self.sampling) for i in (0, 1)]
        across, down = -(-(-(-self.width * h // top[0])) // 8), -(-(-(-self.height * v // top[1])) // 8)
        y, x = np.divmod(np.arange(across * down), across)
        at = self.units.index((c, 0, 0))
        return (y // v * columns + x // h) * n + at + y % v * h + x % h


def _markers(data: bytes) -> list[int]:
    """Where markers stand that end a scan's data."""
    raw = np.frombuffer(data, np.uint8)
    at = np.flatnonzero(raw[:-1] == 255)
    after = raw[at + 1]
    return at[(after != 0) & (after != 255) & ((after < 0xD0) | (after > 0xD7))].tolist()


@lru_cache(256)
def _quantisers(body: bytes) -> dict[int, np.ndarray]:
    out = {}
    while body:
        wide = body[0] >> 4
        out[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else "u1").astype(np.int64)
        body = body[65 + 64 * wide :]
    return out


@lru_cache(256)
def _huffman(body: bytes) -> dict[int, tuple[bytes, tuple[int, ...]]]:
    out = {}
    while body:
        n = sum(body[1:17])
        out[body[0]] = (body[1:17], tuple(body[17 : 17 + n]))
        body = body[17 + n :]
    return out


#: Fixed values of the format: frames other than progressive with Huffman codes.
OTHER_FRAMES = frozenset({0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)})


def parse(data: bytes) -> Image:
    """Headers and scans of one file."""
    image, at = Image(), 2
    huffman: dict[int, tuple[bytes, tuple[int, ...]]] = {}
    interval, ids = 0, []
    markers, size = _markers(data), len(data)
    while at < size:
        marker = data[at + 1]
        if marker == 0xD9:
            break
        if marker == 0xFF:
            at += 1
            continue
        n = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + n]
        at += 2 + n
        if marker == 0xC2:
            image.height, image.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            ids = [body[6 + 3 * i] for i in range(body[5])]
            image.sampling = [(body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15) for i in range(body[5])]
            if len(ids) == 1:
                image.sampling = [(1, 1)]
            image.tables = [body[8 + 3 * i] for i in range(body[5])]
        elif marker in OTHER_FRAMES:
            raise ValueError("not a progressive Huffman-coded JPEG")
        elif marker == 0xDB:
            image.quantisers |= _quantisers(body)
        elif marker == 0xC4:
            huffman |= _huffman(body)
        elif marker == 0xDD:
            interval = int.from_bytes(body, "big")
        elif marker == 0xFE:
            image.comment = body
        elif marker == 0xDA:
            k = body[0]
            own = [(ids.index(body[1 + 2 * i]), body[2 + 2 * i]) for i in range(k)]
            lo, hi, approx = body[1 + 2 * k :]
            end = next((m for m in markers if m >= at), size)
            image.scans.append(Scan(tuple(c for c, _ in own), lo, hi, approx >> 4, approx & 15, tuple(huffman.get(t >> 4) if not lo and not approx >> 4 else None for _, t in own), huffman.get(16 | own[0][1] & 15) if lo else None, interval, data[at:end]))
            at = end
    return image


class Lanes:
    """Restart intervals of the scans of some images, each with a bit position."""

    def __init__(self, images: list[Image], scans: list[Scan]) -> None:
        raw = np.frombuffer(b"".join(s.data for s in scans) + bytes(16), np.uint8)
        ends = np.cumsum([len(s.data) for s in scans])
        total = int(ends[-1])
        full = np.flatnonzero(raw[:total] == 255)
        after = raw[full + 1]
        marks = full[(after >= 0xD0) & (after <= 0xD7)]
        keep = np.ones(len(raw), bool)
        keep[full[after == 0] + 1] = False
        keep[marks], keep[marks + 1] = False, False
        data = raw[keep].astype(np.uint32)
        place = np.cumsum(keep) - keep
        starts = np.sort(np.concatenate([marks + 2, [0], ends[:-1]]).astype(np.int64))
        self.pos = place[starts] * 8
        n = len(data)
        data = np.concatenate([data, np.zeros(4, np.uint32)])
        pair = data[:-1] << np.uint32(8) | data[1:]
        self.window = pair[:n] << np.uint32(16) | pair[2 : n + 2]  # the next 4 bytes
        image_of = np.searchsorted(ends, starts, side="right")
        number = np.arange(len(starts)) - np.searchsorted(starts, np.concatenate([[0], ends[:-1]]))[image_of]
        slots, at, count, first = [], 0, [], []
        per_mcu = [sum(u[0] in s.components for u in im.units) if len(s.components) > 1 else 1 for im, s in zip(images, scans)]
        for im, s in zip(images, scans):
            own = im.slots(s.components) + im.first_block
            slots.append(own)
            first.append(at)
            at += len(own)
            count.append(len(own))
        self.slots = np.concatenate(slots)
        every = np.array([(s.interval or 1 << 40) * p for s, p in zip(scans, per_mcu)])[image_of]
        begin = number * np.minimum(every, 1 << 40)
        self.first = np.array(first)[image_of] + begin
        self.count = np.minimum(every, np.array(count)[image_of] - begin)
        self.per_mcu = per_mcu[0]
        self.unit = np.array([c for i, c in enumerate([u[0] for u in images[0].units]) if c in scans[0].components]) if len(scans[0].components) > 1 else np.zeros(1, int)

    def next_16(self, pos: np.ndarray) -> np.ndarray:
        return (self.window[pos >> 3] << (pos & 7).astype(np.uint32)) >> np.uint32(16)

    def take(self, lanes: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The next bits of each lane, as many as size says (at most 16)."""
        pos = self.pos[lanes]
        self.pos[lanes] = pos + size
        return self.next_16(pos).astype(np.int64) >> (16 - size)

    def one(self, lanes: np.ndarray) -> np.ndarray:
        """The next bit of each lane."""
        pos = self.pos[lanes]
        self.pos[lanes] = pos + 1
        return (self.window[pos >> 3] >> (31 - (pos & 7)).astype(np.uint32) & np.uint32(1)).astype(np.int64)

    def symbol(self, lanes: np.ndarray, table: np.ndarray) -> np.ndarray:
        pos = self.pos[lanes]
        got = table[self.next_16(pos)]
        self.pos[lanes] = pos + (got >> 8)
        return got & 255


def _signed(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(bits < (1 << size >> 1), bits - (1 << size) + 1, bits)


def _read_dc(c: np.ndarray, lanes: Lanes, scan: Scan) -> None:
    tables = [_lookup(*t) if t else None for t in scan.dc]
    before = np.zeros((len(lanes.pos), 4), np.int64)
    for j in range(int(lanes.count.max(initial=0))):
        own = np.flatnonzero(lanes.count > j)
        slot = lanes.slots[lanes.first[own] + j]
        if scan.high:
            c[slot, 0] |= lanes.one(own) << scan.low
            continue
        u = int(lanes.unit[j % lanes.per_mcu])
        size = lanes.symbol(own, tables[scan.components.index(u)] if len(tables) > 1 else tables[0])
        before[own, u] += _signed(lanes.take(own, size), size)
        c[slot, 0] = before[own, u] << scan.low


def _read_ac_first(c: np.ndarray, lanes: Lanes, scan: Scan) -> None:
    table = _lookup(*scan.ac)
    skip = np.zeros(len(lanes.pos), np.int64)  # blocks that end at once
    for j in range(int(lanes.count.max(initial=0))):
        live = np.flatnonzero(lanes.count > j)
        skipped = skip[live] > 0
        skip[live[skipped]] -= 1
        live = live[~skipped]
        slot, k = lanes.slots[lanes.first[live] + j], np.full(len(live), scan.lo)
        while len(live):
            s = lanes.symbol(live, table)
            run, size = s >> 4, s & 15
            zero = size == 0
            if zero.any():
                ends = zero & (run < 15)
                at = live[ends]
                skip[at] = (1 << run[ends]) - 1 + lanes.take(at, run[ends])
                k = k + run
                go = ~zero
                c[slot[go], k[go]] = _signed(lanes.take(live[go], size[go]), size[go]) << scan.low
                k += 1
                stay = ~ends & (k <= scan.hi)
            else:
                k += run
                c[slot, k] = _signed(lanes.take(live, size), size) << scan.low
                k += 1
                stay = k <= scan.hi
            if not stay.all():
                live, slot, k = live[stay], slot[stay], k[stay]


def _read_ac_refine(c: np.ndarray, lanes: Lanes, scan: Scan) -> None:
    table, bit = _lookup(*scan.ac), 1 << scan.low
    skip = np.zeros(len(lanes.pos), np.int64)  # blocks, this one included, without new values
    for j in range(int(lanes.count.max(initial=0))):
        live = np.flatnonzero(lanes.count > j)
        slot = lanes.slots[lanes.first[live] + j]
        ending = skip[live] > 0
        left = np.full(len(live), -1)  # zeros to pass before the next new value; -1: read a symbol
        new = np.zeros(len(live), np.int64)
        for k in range(scan.lo, scan.hi + 1):
            need = np.flatnonzero(~ending & (left < 0))
            if len(need):
                s = lanes.symbol(live[need], table)
                run, size = s >> 4, s & 15
                ends = (size == 0) & (run < 15)
                at = need[ends]
                skip[live[at]] = (1 << run[ends]) + lanes.take(live[at], run[ends])
                ending[at] = True
                one = need[size == 1]
                new[need] = 0
                new[one] = np.where(lanes.one(live[one]), bit, -bit)
                left[need] = run
            now = c[slot, k]
            known = now != 0
            if known.all():
                c[slot, k] = now + np.sign(now) * (lanes.one(live) << scan.low)
                continue
            own = np.flatnonzero(known)
            c[slot[own], k] += (np.sign(now[own]) * (lanes.one(live[own]) << scan.low)).astype(c.dtype)
            free = np.flatnonzero(~known & ~ending)
            here = free[left[free] == 0]
            c[slot[here], k] = new[here]
            left[free] -= 1
        skip[live[ending]] -= 1


def coefficients(images: list[Image]) -> np.ndarray:
    """Blocks of all images in turn, 64 coefficients each in zigzag order, after all scans."""
    total = 0
    for image in images:
        image.first_block = total
        total += image.n_blocks
    c = np.zeros((total, SIZE), np.int32)
    at = [0] * len(images)
    while waiting := [i for i, im in enumerate(images) if at[i] < len(im.scans)]:
        kind = images[waiting[0]].scans[at[waiting[0]]].kind
        own: list[Image] = []
        scans: list[Scan] = []
        for i in waiting:
            seen: set[tuple[int, ...]] = set()
            while at[i] < len(images[i].scans) and (s := images[i].scans[at[i]]).kind == kind and s.components not in seen:
                seen.add(s.components)
                own.append(images[i])
                scans.append(s)
                at[i] += 1
                if not s.lo:
                    break
        for part in _alike(own, scans):
            lanes = Lanes([own[i] for i in part], [scans[i] for i in part])
            (_read_dc if not scans[0].lo else _read_ac_refine if scans[0].high else _read_ac_first)(c, lanes, scans[part[0]])
    return c


def _alike(images: list[Image], scans: list[Scan]) -> list[list[int]]:
    """Scans of several components are read together only where the MCUs have the same units."""
    by: dict[tuple, list[int]] = {}
    for i, (im, s) in enumerate(zip(images, scans)):
        by.setdefault((s.components, tuple(im.sampling)) if not s.lo else (), []).append(i)
    return list(by.values())


def _transform() -> np.ndarray:
    """Whole-number matrix from zigzag coefficients to the 64 samples of a block, row by row."""
    x = np.arange(8)
    basis = np.cos((2 * x[:, None] + 1) * x[None, :] * np.pi / 16) / 2
    basis[:, 0] /= np.sqrt(2)
    both = np.einsum("yv,xu->vuyx", basis, basis).reshape(64, 64)
    return np.round(both[ZIGZAG] * (1 << TRANSFORM_BITS))


TRANSFORM = _transform()


def samples(c: np.ndarray, quantiser: np.ndarray | None = None) -> np.ndarray:
    """Blocks of 64 samples from 0 to 255."""
    f = c.astype(np.float64) if quantiser is None else c * quantiser.astype(np.float64)
    s = np.floor(f @ TRANSFORM / (1 << TRANSFORM_BITS) + 128.5)
    return np.clip(s, 0, 255).astype(np.uint8)


def to_rgb(y: np.ndarray, cb: np.ndarray, cr: np.ndarray) -> np.ndarray:
    """Full-resolution colour from planes of equal shape, in whole numbers."""
    y, cb, cr = y.astype(np.int32) << 16, cb.astype(np.int32) - 128, cr.astype(np.int32) - 128
    half = 1 << 15
    r = (y + 91881 * cr + half) >> 16
    g = (y - 22554 * cb - 46802 * cr + half) >> 16
    b = (y + 116130 * cb + half) >> 16
    return np.clip(np.stack([r, g, b], axis=-1), 0, 255).astype(np.uint8)


def mcu_rgb(s: np.ndarray) -> np.ndarray:
    """Colour of MCUs of six blocks: [n, 16, 16, 3]; each chroma sample covers four pixels."""
    s = s.reshape(-1, MCU, 8, 8)
    y = s[:, :4].reshape(-1, 2, 2, 8, 8).transpose(0, 1, 3, 2, 4).reshape(-1, 16, 16)
    up = lambda p: p.repeat(2, axis=1).repeat(2, axis=2)
    return to_rgb(y, up(s[:, 4]), up(s[:, 5]))


def rgb(image: Image, c: np.ndarray) -> np.ndarray:
    """The tensor [height, width, 3] of one image from its coefficients."""
    rows, columns = image.mcu_shape
    n, top = len(image.units), [max(s[i] for s in image.sampling) for i in (0, 1)]
    blocks = c[image.first_block : image.first_block + image.n_blocks].reshape(rows, columns, n, SIZE)
    planes = []
    for k, (h, v) in enumerate(image.sampling):
        at = image.units.index((k, 0, 0))
        s = samples(blocks[:, :, at : at + h * v].reshape(-1, SIZE), image.quantisers.get(image.tables[k]))
        plane = s.reshape(rows, columns, v, h, 8, 8).transpose(0, 2, 4, 1, 3, 5).reshape(rows * v * 8, columns * h * 8)
        planes.append(plane.repeat(top[1] // v, axis=0).repeat(top[0] // h, axis=1)[: image.height, : image.width])
    if len(planes) == 1:
        return np.repeat(planes[0][:, :, None], 3, axis=2)
    return to_rgb(*planes)


def decode(files: list[bytes]) -> list[np.ndarray]:
    """RGB tensors of progressive JPEG files."""
    images = [parse(f) for f in files]
    c = coefficients(images)
    return [rgb(im, c) for im in images]
