"""FLAC media columns: lossless 8-bit mono streams, written and read in numpy.

The encoder cuts the samples into blocks, tries fixed predictors of order 0 to 4
and a linear predictor from the autocorrelation, codes the residual in Rice
partitions, and writes a seek table with a point for each frame. The decoder
reads the frames that the seek table names, or else one frame after the other:
it checks the header's CRC-8 and the frame's CRC-16, decodes the Rice residual,
applies the fixed or linear predictor, and gives PCM blocks with their sample
offsets. The frames of many documents are coded side by side, one array element
each, so the steps over a block's samples are array operations.

Only mono streams of at most 8 bits are read; others raise an error. A stored
byte b is the sample b - 128.

Defined results: null bytes or text count as empty; an empty payload is one
block of 64 zero bytes after padding, or a stream without frames if padding is
off; repeated rows are coded each; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

BLOCK, RATE = 4096, 8000
MAX_FIXED, LPC_ORDER, LPC_PRECISION, LPC_SHIFT, MAX_PARTITIONS = 4, 4, 12, 9, 3
#: Samples that are coded side by side.
CELLS = 1 << 21


def _crc_table(poly: int, bits: int, width: int) -> np.ndarray:
    """CRC of each value of `width` bits, for a register of `bits` bits."""
    reg = np.arange(1 << width, dtype=np.uint32) << np.uint32(bits - width)
    top, mask = np.uint32(1 << bits - 1), np.uint32((1 << bits) - 1)
    for _ in range(width):
        reg = np.where(reg & top, (reg << np.uint32(1)) ^ np.uint32(poly), reg << np.uint32(1)) & mask
    return reg


CRC8 = _crc_table(0x07, 8, 8).tolist()
CRC16 = _crc_table(0x8005, 16, 16).astype(np.uint16)


def crc8(data: bytes) -> int:
    crc = 0
    for b in data:
        crc = CRC8[crc ^ b]
    return crc


def crc16(rows: np.ndarray) -> np.ndarray:
    """CRC-16 of each row of bytes; rows are aligned to the right, as zeros in front do not change it."""
    if rows.shape[1] % 2:
        rows = np.hstack([np.zeros((len(rows), 1), np.uint8), rows])
    words = np.ascontiguousarray(rows).view(">u2").T.astype(np.uint16)
    crc = np.zeros(rows.shape[0], np.uint16)
    for word in words:
        crc = CRC16[crc ^ word]
    return crc


def _right_aligned(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    width = int((ends - starts).max(initial=0))
    at = ends[:, None] - width + np.arange(width)
    return np.where(at >= starts[:, None], buf[np.maximum(at, 0)], 0).astype(np.uint8)


# Encoding -------------------------------------------------------------------


def _linear_predictors(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Quantised coefficients of order LPC_ORDER for each row, by Levinson's recursion; rows are zero beyond n."""
    x = x.astype(np.float64)
    r = np.stack([(x[:, : x.shape[1] - j] * x[:, j:]).sum(axis=1) if x.shape[1] > j else np.zeros(len(x)) for j in range(LPC_ORDER + 1)], axis=1)
    a, err = np.zeros((len(x), LPC_ORDER)), r[:, 0] * (1 + 1e-9) + 1e-9
    for i in range(LPC_ORDER):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(axis=1)) / err
        new = a.copy()
        new[:, i] = k
        new[:, :i] = a[:, :i] - k[:, None] * a[:, :i][:, ::-1]
        a, err = new, np.maximum(err * (1 - k * k), 1e-9)
    limit = (1 << LPC_PRECISION - 1) - 1
    return np.clip(np.rint(a * (1 << LPC_SHIFT)), -limit, limit).astype(np.int32)


def _frame_header(n: int, number: int) -> bytes:
    code, tail = (0b1100, b"") if n == BLOCK else (0b0111, (n - 1).to_bytes(2, "big"))
    head = bytes([0xFF, 0xF8, code << 4 | 0b0100, 0b0000_0010]) + chr(number).encode("utf-8", "surrogatepass") + tail
    return head + bytes([crc8(head)])


def encode_frames(blocks: list[bytes], numbers: list[int]) -> list[bytes]:
    """A FLAC frame for each block of at most BLOCK bytes; numbers are the frames' places in their streams."""
    lanes, n = len(blocks), np.array([len(b) for b in blocks])
    width = int(n.max())
    column, inside = np.arange(width), np.arange(width) < n[:, None]
    x = np.zeros((lanes, width), np.int32)
    x[inside] = np.frombuffer(b"".join(blocks), np.uint8).astype(np.int32) - 128
    best, cost, order = x.copy(), np.abs(x).sum(axis=1, dtype=np.int64).astype(np.float64), np.zeros(lanes, np.int64)
    linear, res = np.zeros(lanes, bool), x
    for o in range(1, MAX_FIXED + 1):
        res = np.diff(res, axis=1, prepend=0)
        size = np.where(inside & (column >= o), np.abs(res), 0).sum(axis=1, dtype=np.int64)
        better = (size < cost) & (n > o)
        best[better], cost[better], order[better] = res[better], size[better], o
    q = _linear_predictors(x, n)
    sums = np.zeros((lanes, width), np.int32)
    for j in range(min(LPC_ORDER, width - 1)):
        sums[:, j + 1 :] += q[:, j : j + 1] * x[:, : width - j - 1]
    res = x - (sums >> LPC_SHIFT)
    size = np.where(inside & (column >= LPC_ORDER), np.abs(res), 0).sum(axis=1, dtype=np.int64) + 2 * LPC_PRECISION
    better = (size < cost) & (n > 2 * LPC_ORDER)
    best[better], order[better], linear[better] = res[better], LPC_ORDER, True
    constant = (np.where(inside, x, x[:, :1]) == x[:, :1]).all(axis=1)

    parts = np.where(n % (1 << MAX_PARTITIONS) == 0, np.minimum(MAX_PARTITIONS, np.log2(np.maximum(n // 64, 1)).astype(np.int64)), 0)
    coded = inside & (column >= order[:, None]) & ~constant[:, None]
    lane, at = np.nonzero(coded)
    r = best[lane, at].astype(np.int64)
    u = (r << 1) ^ (r >> 63)
    first = np.concatenate([[0], np.cumsum(1 << parts)])[:-1]
    part = first[lane] + at // (n >> parts)[lane]
    n_parts = int((1 << parts).sum())
    mean = np.bincount(part, u, n_parts) / np.maximum(np.bincount(part, minlength=n_parts), 1)
    k_of = np.clip(np.rint(np.log2(0.69 * mean + 0.1)), 0, 14).astype(np.int64)
    k = k_of[part]
    bits = (u >> k) + 1 + k
    opens = np.diff(part, prepend=-1) != 0  # a partition's first code comes after its parameter of four bits
    bits += 4 * opens
    ends = np.cumsum(bits)
    body = np.bincount(lane, bits, lanes).astype(np.int64)
    raw = (body > 8 * n) & ~constant

    heads: list[np.ndarray] = []
    for i, (count, o) in enumerate(zip(n.tolist(), order.tolist(), strict=True)):
        data, value, size = _frame_header(count, numbers[i]), 0, 0
        if constant[i]:
            data += b"\0" + blocks[i][:1].translate(_SIGN)
        elif raw[i]:
            data += b"\2" + blocks[i].translate(_SIGN)
        else:
            data += bytes([(0b100000 | o - 1 if linear[i] else 0b001000 | o) << 1]) + blocks[i][:o].translate(_SIGN)
            if linear[i]:
                value, size = LPC_PRECISION - 1 << 5 | LPC_SHIFT, 9
                for c in q[i].tolist():
                    value, size = value << LPC_PRECISION | c & (1 << LPC_PRECISION) - 1, size + LPC_PRECISION
            value, size = value << 6 | int(parts[i]), size + 6
        whole = (int.from_bytes(data, "big") << size | value) << -size % 8
        heads.append(np.unpackbits(np.frombuffer(whole.to_bytes(len(data) + (size + 7) // 8, "big"), np.uint8))[: 8 * len(data) + size])
    head = np.array([len(h) for h in heads])
    body[raw | constant] = 0
    n_bytes = -(-(head + body) // 8) + 2
    start = np.concatenate([[0], np.cumsum(n_bytes)])
    out = np.zeros(8 * int(start[-1]), np.uint8)
    for s, h in zip((8 * start[:-1]).tolist(), heads, strict=True):
        out[s : s + len(h)] = h
    if len(lane):
        lane_first = np.concatenate([[True], lane[1:] != lane[:-1]])
        base = np.zeros(lanes, np.int64)
        base[lane[lane_first]] = ends[lane_first] - bits[lane_first]
        pos = 8 * start[lane] + head[lane] + ends - bits - base[lane]
        use = ~raw[lane]
        shown = opens & use
        for b in range(4):
            out[pos[shown] + b] = k[shown] >> 3 - b & 1
        pos, u, k = (pos + 4 * opens)[use], u[use], k[use]
        pos += u >> k
        out[pos] = 1
        for b in range(int(k.max(initial=0))):
            has = k > b
            out[(pos + k - b)[has]] = u[has] >> b & 1
    data = np.packbits(out)
    crc = crc16(_right_aligned(data, start[:-1], start[1:] - 2))
    data[start[1:] - 2], data[start[1:] - 1] = crc >> 8, crc & 255
    return [data[a:b].tobytes() for a, b in zip(start, start[1:])]


_SIGN = bytes(b ^ 128 for b in range(256))


def encode_streams(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload, with stream information and seek table."""
    frames = [(i, j, p[j * BLOCK : (j + 1) * BLOCK]) for i, p in enumerate(payloads) for j in range(-(-len(p) // BLOCK))]
    frames.sort(key=lambda f: -len(f[2]))
    coded: list[list[bytes]] = [[b""] * -(-len(p) // BLOCK) for p in payloads]
    at = 0
    while at < len(frames):
        some = frames[at : at + max(1, CELLS // len(frames[at][2]))]
        for (i, j, _), data in zip(some, encode_frames([f[2] for f in some], [f[1] for f in some]), strict=True):
            coded[i][j] = data
        at += len(some)
    out = []
    for p, own in zip(payloads, coded, strict=True):
        sizes = [len(f) for f in own] or [0]
        info = BLOCK.to_bytes(2, "big") * 2 + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
        info += (RATE << 44 | 7 << 36 | len(p)).to_bytes(8, "big") + hashlib.md5(p.translate(_SIGN)).digest()
        offset, points = 0, []
        for j, f in enumerate(own):
            points.append((j * BLOCK).to_bytes(8, "big") + offset.to_bytes(8, "big") + min(BLOCK, len(p) - j * BLOCK).to_bytes(2, "big"))
            offset += len(f)
        table = b"".join(points)
        out.append(b"fLaC" + bytes([0]) + (34).to_bytes(3, "big") + info + bytes([0x83]) + len(table).to_bytes(3, "big") + table + b"".join(own))
    return out


# Decoding -------------------------------------------------------------------


class _Bits:
    """Reads numbers of some bits from a place in a buffer."""

    def __init__(self, data: bytes, at: int) -> None:
        self.data, self.at = data, 8 * at

    def read(self, n: int, signed: bool = False) -> int:
        a, b = self.at >> 3, (self.at + n + 7) >> 3
        if b > len(self.data):
            raise ValueError("a frame is cut off")
        value = int.from_bytes(self.data[a:b], "big") >> (8 * b - self.at - n) & (1 << n) - 1
        self.at += n
        return value - (1 << n) if signed and n and value >> n - 1 else value


@dataclass
class _Frame:
    """What a frame says before its residual; bit is where that begins."""

    start: int
    n: int = 0
    number: int = 0
    kind: str = ""
    order: int = 0
    parts: int = 0
    param: int = 4
    shift: int = 0
    coefs: list[int] = field(default_factory=list)
    warm: list[int] = field(default_factory=list)
    bit: int = 0


#: Block sizes by their code in a frame header.
BLOCK_SIZES = {1: 192, 2: 576, 3: 1152, 4: 2304, 5: 4608} | {8 + i: 256 << i for i in range(8)}


def _read_head(data: bytes, start: int) -> _Frame:
    f, bits = _Frame(start), _Bits(data, start)
    if bits.read(15) != 0b111111111111100:
        raise ValueError("no frame here")
    bits.read(1)
    size, rate, channels, depth = bits.read(4), bits.read(4), bits.read(4), bits.read(3)
    bits.read(1)
    if channels or depth not in (0, 1):
        raise ValueError("only mono streams of 8 bits are read")
    lead = bits.read(8)
    more = 8 - (lead ^ 0xFF).bit_length()  # bytes of the number, 0 if just this one
    f.number = lead & (0x7F >> more) if more else lead
    for _ in range(max(0, more - 1)):
        f.number = f.number << 6 | bits.read(8) & 0x3F
    f.n = bits.read(8) + 1 if size == 6 else bits.read(16) + 1 if size == 7 else BLOCK_SIZES[size]
    bits.read({12: 8, 13: 16, 14: 16}.get(rate, 0))
    at = bits.at >> 3
    if crc8(data[start:at]) != bits.read(8):
        raise ValueError("a frame header's checksum is wrong")
    kind = bits.read(8)
    if kind & 1 or kind >> 7:
        raise ValueError("wasted bits are not read")
    kind >>= 1
    if kind < 2:
        f.kind = ("constant", "raw")[kind]
        f.bit = bits.at
        return f
    f.kind, f.order = ("linear", (kind & 31) + 1) if kind & 32 else ("fixed", kind & 7)
    f.warm = [bits.read(8, True) for _ in range(f.order)]
    if f.kind == "linear":
        precision, f.shift = bits.read(4) + 1, bits.read(5)
        f.coefs = [bits.read(precision, True) for _ in range(f.order)]
    f.param = 4 + bits.read(2)
    f.parts = bits.read(4)
    f.bit = bits.at
    return f


def _residuals(buf: np.ndarray, frames: list[_Frame]) -> tuple[np.ndarray, np.ndarray]:
    """Residuals (samples x frames) and where each frame's residual ends, for frames by falling number of residuals."""
    bits = np.unpackbits(buf)
    ones = np.flatnonzero(bits).astype(np.int64)
    next_one = np.repeat(ones, np.diff(ones, prepend=-1))
    wide = np.concatenate([buf, np.zeros(8, np.uint8)]).astype(np.uint64)
    window = sum(wide[j : len(buf) + j] << np.uint64(32 - 8 * j) for j in range(5)).astype(np.int64)  # 40 bits from each byte

    def take(pos: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        return window[pos >> 3] >> (40 - (pos & 7) - n) & ((1 << n) - 1)

    count = np.array([f.n - f.order for f in frames])
    pos, param = np.array([f.bit for f in frames]), np.array([f.param for f in frames])
    step = np.array([f.n >> f.parts for f in frames])
    turn, k = np.zeros(len(frames), np.int64), np.zeros(len(frames), np.int64)
    after = step - np.array([f.order for f in frames])  # where the next partition begins
    plain = np.zeros(len(frames), np.int64)  # bits of unpacked residuals, or 0
    out = np.zeros((int(count.max(initial=0)), len(frames)), np.int64)
    active = np.searchsorted(-count, -np.arange(len(out)), side="left")
    for i in range(len(out)):
        m = active[i]
        at = np.flatnonzero(turn[:m] == i)
        while len(at):
            k[at] = take(pos[at], param[at])
            pos[at] += param[at]
            turn[at] = after[at]
            after[at] += step[at]
            escape = k[at] == (1 << param[at]) - 1
            plain[at] = 0
            if escape.any():
                own = at[escape]
                plain[own] = take(pos[own], 5) + 64  # 64 marks them, so that 0 bits are told from none
                pos[own] += 5
            at = at[turn[at] == i]
        p, kk = pos[:m], k[:m]
        if plain[:m].any():
            raw = np.flatnonzero(plain[:m])
            n = plain[raw] - 64
            value = take(p[raw], n)
            value = np.where((n > 0) & (value >> np.maximum(n - 1, 0) & 1 == 1), value - (1 << n), value)
            rice = np.flatnonzero(plain[:m] == 0)
            z = next_one[p[rice]]
            u = (z - p[rice] << kk[rice]) | take(z + 1, kk[rice])
            out[i, rice] = (u >> 1) ^ -(u & 1)
            out[i, raw] = value
            p[rice], p[raw] = z + 1 + kk[rice], p[raw] + n
            continue
        z = next_one[p]
        q = z - p
        z += 1
        u = (q << kk) | take(z, kk)
        out[i, :m] = (u >> 1) ^ -(u & 1)
        np.add(z, kk, out=p)
    return out, pos


def decode_frames(buf: np.ndarray, starts: list[int]) -> tuple[list[np.ndarray], list[int], list[int]]:
    """Samples, frame numbers and ends of the frames at these places; raises if a checksum is wrong."""
    data = buf.tobytes()
    frames = [_read_head(data, s) for s in starts]
    samples: list[np.ndarray] = [np.empty(0)] * len(frames)
    ends = np.zeros(len(frames), np.int64)
    signed = buf.view(np.int8)
    for i, f in enumerate(frames):
        if f.kind == "constant":
            samples[i], ends[i] = np.full(f.n, signed[f.bit >> 3], np.int64), (f.bit >> 3) + 1
        elif f.kind == "raw":
            samples[i], ends[i] = signed[f.bit >> 3 : (f.bit >> 3) + f.n].astype(np.int64), (f.bit >> 3) + f.n
    coded = sorted((i for i, f in enumerate(frames) if f.kind in ("fixed", "linear")), key=lambda i: frames[i].order - frames[i].n)
    if coded:
        own = [frames[i] for i in coded]
        res, stop = _residuals(buf, own)
        ends[coded] = -(-stop // 8)
        x = np.zeros((max(f.n for f in own), len(own)), np.int64)
        for order, kind in sorted({(f.order, f.kind) for f in own}):
            at = np.array([j for j, f in enumerate(own) if (f.order, f.kind) == (order, kind)])
            length = max(own[j].n for j in at) - order
            level = res[:length, at]
            if kind == "fixed":
                warm = np.array([own[j].warm for j in at], np.int64).reshape(len(at), order).T
                for d in range(order, 0, -1):  # from differences of order d to those of order d - 1
                    first = np.diff(warm, n=d - 1, axis=0)[order - d]
                    level = np.vstack([first, first + np.cumsum(level, axis=0)])
                    if d > 1:  # keep only what begins at sample `order`, the rest follows from the warm-up
                        level = level[1:]
                y = np.vstack([warm[:-1], level]) if order else level
            else:
                y = np.zeros((length + order, len(at)), np.int64)
                y[:order] = np.array([own[j].warm for j in at], np.int64).T
                coefs, shift = np.array([own[j].coefs[::-1] for j in at], np.int64).T.copy(), np.array([own[j].shift for j in at])
                for i in range(length):
                    y[order + i] = level[i] + ((coefs * y[i : i + order]).sum(axis=0) >> shift)
            x[: len(y), at] = y
        for j, i in enumerate(coded):
            samples[i] = x[: frames[i].n, j]
    if len(frames):
        begin = np.array(starts)
        if crc16(_right_aligned(buf, begin, ends + 2)).any():
            raise ValueError("a frame's checksum is wrong")
    return samples, [f.number for f in frames], (ends + 2).tolist()


@dataclass
class Stream:
    """A stream's total samples, MD5 of all samples, seek points (byte offset by frame) and where frames begin."""

    total: int
    md5: bytes
    points: list[int]
    start: int


def read_metadata(data: bytes) -> Stream:
    if data[:4] != b"fLaC":
        raise ValueError("no FLAC stream")
    out, at, last = Stream(0, b"", [], 0), 4, False
    while not last:
        last, kind, n = bool(data[at] & 128), data[at] & 127, int.from_bytes(data[at + 1 : at + 4], "big")
        body, at = data[at + 4 : at + 4 + n], at + 4 + n
        if kind == 0:
            packed = int.from_bytes(body[10:18], "big")
            if (packed >> 36 & 31) != 7 or packed >> 41 & 7:
                raise ValueError("only mono streams of 8 bits are read")
            out.total, out.md5 = packed & (1 << 36) - 1, body[18:34]
        elif kind == 3:
            places = [body[i : i + 18] for i in range(0, n, 18)]
            out.points = [int.from_bytes(p[8:16], "big") for p in places if p[:8] != b"\xff" * 8]
    out.start = at
    return out


def decode_streams(streams: list[bytes]) -> list[list[tuple[int, bytes]]]:
    """For each stream its PCM blocks, (sample offset, bytes), after all checks."""
    heads = [read_metadata(s) for s in streams]
    blocks: list[list[tuple[int, int, bytes]]] = [[] for _ in streams]
    # (stream, frame's place); of a stream without seek points just the next one.
    todo = [(i, h.start + p) for i, h in enumerate(heads) for p in (h.points or [0] * (h.start < len(streams[i])))]
    while todo:
        todo.sort(key=lambda t: -len(streams[t[0]]))
        some, size = [], 0
        while todo and (not some or size < CELLS):
            some.append(todo.pop())
            size += BLOCK if len(streams[some[-1][0]]) > BLOCK else len(streams[some[-1][0]])
        used = sorted({i for i, _ in some})
        base = dict(zip(used, np.concatenate([[0], np.cumsum([len(streams[i]) for i in used])])[:-1].tolist(), strict=True))
        buf = np.frombuffer(b"".join(streams[i] for i in used), np.uint8)
        found = decode_frames(buf, [base[i] + p for i, p in some])
        for (i, p), x, number, end in zip(some, *found, strict=True):
            blocks[i].append((p, number, (x + 128).astype(np.uint8).tobytes()))
            if not heads[i].points and end - base[i] < len(streams[i]):
                todo.append((i, end - base[i]))
    out = []
    for head, own in zip(heads, blocks, strict=True):
        own.sort()
        offsets = np.concatenate([[0], np.cumsum([len(b) for _, _, b in own])]).astype(np.int64).tolist()
        md5 = hashlib.md5()
        for _, _, b in own:
            md5.update(b.translate(_SIGN))
        if offsets[-1] != head.total or md5.digest() != head.md5:
            raise ValueError("the samples are not those of the stream information")
        out.append([(o, b) for o, (_, _, b) in zip(offsets, own, strict=False)])
    return out


# Columns --------------------------------------------------------------------


def _some(values: list[bytes], limit: int = 8 << 20) -> Iterator[list[bytes]]:
    """Runs of values of limited total size."""
    run, size = [], 0
    for v in values:
        if run and size + len(v) > limit:
            yield run
            run, size = [], 0
        run.append(v)
        size += len(v)
    if run:
        yield run


def pad(data: bytes, unit: int = 64) -> bytes:
    """data and zero bytes up to a positive multiple of unit."""
    return data.ljust(max(unit, -(-len(data) // unit) * unit), b"\0")


def encode_media(df: DataFrame, payload_col: str = "payload", media_col: str = "media") -> DataFrame:
    """df with the FLAC stream of a binary column."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, payload_col):
                values = [v or b"" for v in part[payload_col].to_pylist()]
                yield part.append_column(media_col, pa.array(encode_streams(values), pa.binary()))

    return df.mapInArrow(of, StructType([*df.schema.fields, StructField(media_col, BinaryType())]))


def _slices(batch: pa.RecordBatch, column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    at = 0
    for run in _some([v or b"" for v in batch[column].to_pylist()], limit):
        yield batch.slice(at, len(run))
        at += len(run)


def media_blocks(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """doc_id, block, sample_offset, n_samples and pcm of every block of the streams of a column."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, media_col):
                place, rows = [], []
                for i, blocks in enumerate(decode_streams([v for v in part[media_col].to_pylist() if v is not None])):
                    place += [i] * len(blocks)
                    rows += [(j, offset, len(pcm), pcm) for j, (offset, pcm) in enumerate(blocks)]
                ids = part.filter(part[media_col].is_valid())[id_col]
                columns = [pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
                yield pa.record_batch([ids.take(pa.array(place, pa.int64())), *columns], ["doc_id", "block", "sample_offset", "n_samples", "pcm"])

    own = df.select(F.col(id_col).cast("long").alias(id_col), media_col)
    return own.mapInArrow(of, "doc_id long, block long, sample_offset long, n_samples long, pcm binary")


def signal_features(pcm: bytes, n_blocks: int) -> str:
    """Blocks, peak, sum of samples and zero crossings, in that order."""
    x = np.frombuffer(pcm, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero(np.diff(np.signbit(x))))
    return f"blocks={n_blocks};peak={int(np.abs(x).max(initial=0))};sum={int(x.sum())};crossings={crossings}"


REPORT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as a FLAC stream, read the stream back, and report on what was read; one pass without a shuffle."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, "_text"):
                texts = [v or b"" for v in part["_text"].to_pylist()]
                media = encode_streams([pad(t) for t in texts])
                rows = []
                for text, stored, blocks in zip(texts, media, decode_streams(media), strict=True):
                    pcm = b"".join(b for _, b in blocks)
                    rows.append((len(text), len(pcm), hashlib.sha256(pcm).hexdigest(), zlib.crc32(pcm[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), signal_features(pcm, len(blocks))))
                names = [c.split()[0] for c in REPORT.split(", ")]
                kinds = [pa.string() if c.endswith("string") else pa.int64() for c in REPORT.split(", ")[1:]]
                yield pa.record_batch([part["doc_id"], *[pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)]], names)

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("_text"))
    return own.mapInArrow(of, REPORT)
