"""Media columns: motion-JPEG in AVI, written without loss, read back through its index, cut into timed shots.

A payload is stored as 8-bit grey samples, FRAME of them (24 x 24) to a frame, FPS frames a second. Frames are lossless
JPEG (ITU T.81 process 14: SOF3, predictor 1, Huffman-coded differences), each one on its own, so that every frame is
an intra frame and its samples come back exactly. The AVI holds one video stream, a `movi` list of `00dc` chunks and
an `idx1` index; readers find frames through the index only. Videos from elsewhere may hold baseline frames (SOF0: DCT,
8 bits, one or three components, restart intervals), of which the first component, the luma, is decoded; every such
frame must bring its own Huffman tables.

Shots are cut where the histogram of a frame differs from the last one's by more than is usual lately: above the mean
of the last RECENT differences in this video by SIGMA standard deviations, and above LEAST of FRAME samples. All arithmetic on
differences is on integers, so equal videos give equal cuts wherever they are processed.

A null text is an empty payload, and an empty payload is one frame of padding. A null media value gives nulls, and no
clips; bytes that are not such an AVI are an error that names the fault. Repeated rows give repeated results. Other
columns are not read. Rows are handled in runs of a few MB, so that one very long text is the most that a task holds.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, utf8

SIDE = 24
FRAME = SIDE * SIDE
PAD = 255
FPS = 25
RECENT, SIGMA, LEAST, BINS = 8, 2, 115, 16
RUN = 2 << 20

# Lossless JPEG: nine categories of differences between 8-bit samples, each with a code of four bits.
CODE_BITS, CATEGORIES = 4, 9
_DHT = bytes([0xFF, 0xC4]) + struct.pack(">H", 19 + CATEGORIES) + bytes([0, 0, 0, 0, CATEGORIES] + [0] * 12 + list(range(CATEGORIES)))
_SOF3 = bytes([0xFF, 0xC3]) + struct.pack(">HBHHB", 11, 8, SIDE, SIDE, 1) + bytes([1, 0x11, 0])
_SOS = bytes([0xFF, 0xDA]) + struct.pack(">HB", 8, 1) + bytes([1, 0, 1, 0, 0])
JPEG_HEAD = b"\xff\xd8" + _DHT + _SOF3 + _SOS
JPEG_END = b"\xff\xd9"


def _codes() -> tuple[np.ndarray, np.ndarray]:
    """For each difference + 255: its code with extra bits, and their number."""
    d = np.arange(-255, 256)
    cat = np.array([int(abs(x)).bit_length() for x in d])
    extra = np.where(d >= 0, d, d - 1) & ((1 << cat) - 1)
    return ((cat << cat) | extra).astype(np.uint64), (CODE_BITS + cat).astype(np.uint64)


CODE, LENGTH = _codes()


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """Lossless JPEG of each frame of samples (n, SIDE, SIDE)."""
    n = len(samples)
    s = samples.astype(np.int16)
    d = np.empty_like(s)
    d[:, :, 1:] = s[:, :, 1:] - s[:, :, :-1]
    d[:, 1:, 0] = s[:, 1:, 0] - s[:, :-1, 0]
    d[:, 0, 0] = s[:, 0, 0] - 128
    d = d.reshape(n, FRAME) + 255
    code, bits = CODE[d], LENGTH[d]
    for _ in range(2):  # two, then four samples to a word of at most 48 bits
        code, bits = (code[:, ::2] << bits[:, 1::2]) | code[:, 1::2], bits[:, ::2] + bits[:, 1::2]
    upto = np.cumsum(bits, axis=1)
    n_bytes = ((upto[:, -1] + np.uint64(7)) >> np.uint64(3)).astype(np.int64)
    start = np.cumsum(n_bytes) - n_bytes
    at = start[:, None].astype(np.uint64) * np.uint64(8) + upto - bits
    word = code << (np.uint64(56) - bits - (at & np.uint64(7)))
    first = (at >> np.uint64(3)).astype(np.int64)
    total = int(n_bytes.sum())
    out = np.zeros(total + 8)
    for k in range(7):
        out += np.bincount((first + k).ravel(), ((word >> np.uint64(48 - 8 * k)) & np.uint64(255)).ravel().astype(np.float64), total + 8)
    out = out[:total].astype(np.uint8)
    spare = (n_bytes.astype(np.uint64) * np.uint64(8) - upto[:, -1]).astype(np.int64)
    out[start + n_bytes - 1] |= ((1 << spare) - 1).astype(np.uint8)  # scans are filled up with ones
    full = out == 255
    grown = np.repeat(out, 1 + full)
    grown[np.flatnonzero(full) + np.cumsum(full)[full]] = 0  # a zero follows each 0xFF
    ends = start + n_bytes + np.concatenate([[0], np.cumsum(full)])[start + n_bytes]
    data, begins = grown.tobytes(), np.concatenate([[0], ends[:-1]])
    return [JPEG_HEAD + data[a:b] + JPEG_END for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(frames: list[bytes]) -> bytes:
    """An AVI 1.0 file of one motion-JPEG stream, with an index."""
    n, most = len(frames), max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, n, 0, 1, most, SIDE, SIDE, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, FPS, 0, n, most, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    strf = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
    strl = _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + strl)
    sizes = [len(f) for f in frames]
    at, index = 4, []
    for size in sizes:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, size))
        at += 8 + size + (size & 1)
    movi = _chunk(b"LIST", b"movi" + b"".join([_chunk(b"00dc", f) for f in frames]))
    return _chunk(b"RIFF", b"AVI " + hdrl + movi + _chunk(b"idx1", b"".join(index)))


def read_index(avi: bytes) -> list[tuple[int, int]]:
    """(offset, size) of every frame, from the RIFF structure and its idx1 chunk."""
    if avi[:4] != b"RIFF" or avi[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, end, movi, index = 12, min(len(avi), 8 + struct.unpack_from("<I", avi, 4)[0]), None, None
    while at + 8 <= end:
        name, size = avi[at : at + 4], struct.unpack_from("<I", avi, at + 4)[0]
        if name == b"LIST" and avi[at + 8 : at + 12] == b"movi":
            movi = at + 8
        elif name == b"idx1":
            index = avi[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    if movi is None or index is None:
        raise ValueError("AVI without movi list or idx1 index")
    rows = [r for r in struct.iter_unpack("<4sIII", index) if r[0][2:] in (b"dc", b"db")]
    # Offsets count from the movi list or, in some writers' files, from the start of the file.
    base = movi if not rows or avi[movi + rows[0][2] : movi + rows[0][2] + 4] == rows[0][0] else 0
    return [(base + off + 8, size) for _, _, off, size in rows]


def parse_head(jpeg: bytes) -> tuple[int, int, int, np.ndarray, int]:
    """(height, width, scan offset, table, its bits) of a lossless frame; the table maps bits to (length << 16) + difference."""
    at, shape, table, bits = 2, None, None, 0
    if jpeg[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    while at + 4 <= len(jpeg):
        marker, size = jpeg[at + 1], struct.unpack_from(">H", jpeg, at + 2)[0]
        body = jpeg[at + 4 : at + 2 + size]
        if marker == 0xC3:
            precision, h, w, parts = struct.unpack_from(">BHHB", body)
            if precision != 8 or parts != 1:
                raise ValueError("only 8-bit frames of one component are read")
            shape = (h, w)
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not a lossless JPEG frame")
        elif marker == 0xC4:
            counts, symbols, code, k = body[1:17], body[17:], 0, 0
            found = []
            for length, count in enumerate(counts, 1):
                for _ in range(count):
                    found.append((code, length, symbols[k]))
                    code, k = code + 1, k + 1
                code <<= 1
            bits = max(length + cat for _, length, cat in found)
            if bits > 16:
                raise ValueError("codes of over 16 bits")
            table = np.zeros(1 << bits, np.int32)
            for code, length, cat in found:
                extra = np.arange(1 << cat)
                diff = np.where(extra < (1 << cat) >> 1, extra - (1 << cat) + 1, extra)
                span = 1 << (bits - length - cat)
                a = code << (bits - length)
                table[a : a + (span << cat)] = np.repeat(((length + cat) << 16) + diff + 512, span)
        elif marker == 0xDA:
            if shape is None or table is None or body[3] != 1:
                raise ValueError("frame without header or table, or with another predictor")
            return *shape, at + 2 + size, table, bits
        at += 2 + size
    raise ValueError("JPEG frame without a scan")


def _zigzag() -> np.ndarray:
    """Places (row * 8 + column) of a block's coefficients in the order they are coded."""
    order = sorted(((i, j) for i in range(8) for j in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))
    return np.array([8 * i + j for i, j in order])


ZIGZAG = _zigzag()
#: Rows are the cosines of the eight frequencies.
COSINES = np.cos(np.outer(np.arange(8), 2 * np.arange(8) + 1) * np.pi / 16) * np.sqrt(np.where(np.arange(8) == 0, 1, 2) / 8)[:, None]


def _segments(jpeg: bytes):
    """(marker, body, what follows) of a JPEG's marker segments up to its first scan."""
    if jpeg[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    at = 2
    while at + 4 <= len(jpeg):
        if jpeg[at] != 0xFF:
            raise ValueError("JPEG frame without a marker where one is due")
        size = struct.unpack_from(">H", jpeg, at + 2)[0]
        yield jpeg[at + 1], jpeg[at + 4 : at + 2 + size], at + 2 + size
        if jpeg[at + 1] == 0xDA:
            return
        at += 2 + size
    raise ValueError("JPEG frame without a scan")


def _huffman(body: bytes) -> dict[int, dict[tuple[int, int], int]]:
    """Tables of a DHT segment: by class and number, from (length, code) to symbol."""
    out, at = {}, 0
    while at < len(body):
        counts, k, code, table = body[at + 1 : at + 17], at + 17, 0, {}
        for length, count in enumerate(counts, 1):
            for _ in range(count):
                table[length, code] = body[k]
                code, k = code + 1, k + 1
            code <<= 1
        out[body[at]] = table
        at = k
    return out


def _coefficients(data: bytes, plan: list[tuple[int, dict, dict]], last: dict[int, int], n: int) -> list[list[np.ndarray]]:
    """The blocks of n minimum coded units of one restart interval, by place in the plan of (component, DC table, AC table)."""
    data = data.replace(b"\xff\x00", b"\xff")
    value, have, at = 0, 0, 0

    def bits(k: int) -> int:
        nonlocal value, have, at
        while have < k:
            value, have, at = (value << 8) | (data[at] if at < len(data) else 0), have + 8, at + 1
        have -= k
        got, value = value >> have, value & ((1 << have) - 1)
        return got

    def symbol(table: dict) -> int:
        code = 0
        for length in range(1, 17):
            code = (code << 1) | bits(1)
            if (length, code) in table:
                return table[length, code]
        raise ValueError("damaged JPEG scan")

    def signed(k: int) -> int:
        v = bits(k) if k else 0
        return v if not k or v >> (k - 1) else v - (1 << k) + 1

    out: list[list[np.ndarray]] = [[] for _ in plan]
    for _ in range(n):
        if at > len(data) + 8:
            raise ValueError("JPEG scan ends too soon")
        for slot, (component, dc, ac) in enumerate(plan):
            block = np.zeros(64)
            last[component] += signed(symbol(dc))
            block[0], k = last[component], 1
            while k < 64:
                run, size = divmod(symbol(ac), 16)
                if not size and run != 15:
                    break
                k += run
                if size and k < 64:
                    block[ZIGZAG[k]] = signed(size)
                k += 1
            out[slot].append(block)
    return out


def decode_baseline(jpeg: bytes) -> np.ndarray:
    """Luma samples (height, width) of a baseline DCT frame."""
    quant, tables, parts, every = {}, {}, [], 0
    for marker, body, after in _segments(jpeg):
        if marker == 0xDB:
            at = 0
            while at < len(body):
                if body[at] >> 4:
                    raise ValueError("only 8-bit quantisation tables are read")
                quant[body[at]] = np.frombuffer(body, np.uint8, 64, at + 1).astype(float)
                at += 65
        elif marker == 0xC0:
            precision, h, w, count = struct.unpack_from(">BHHB", body)
            if precision != 8 or count not in (1, 3) or not h or not w:
                raise ValueError("only 8-bit frames of one or three components are read")
            parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(count)]
        elif 0xC0 < marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("neither a lossless nor a baseline JPEG frame")
        elif marker == 0xC4:
            tables |= _huffman(body)
        elif marker == 0xDD:
            every = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            if not parts or body[0] != len(parts):
                raise ValueError("only scans of all components are read")
            use = {body[1 + 2 * k]: body[2 + 2 * k] for k in range(body[0])}
            start = after
    if len(parts) == 1:
        parts = [(parts[0][0], 1, 1, parts[0][3])]
    wide, high = max(p[1] for p in parts), max(p[2] for p in parts)
    across, down = -(-w // (8 * wide)), -(-h // (8 * high))
    try:
        plan = [(c, tables[use[c] >> 4], tables[0x10 | use[c] & 15]) for c, ph, pv, _ in parts for _ in range(ph * pv)]
    except KeyError:
        raise ValueError("JPEG frame without its Huffman tables") from None
    pieces, at = [], start
    for m in re.finditer(b"\xff[\xd0-\xd9]", jpeg[start:]):
        pieces.append(jpeg[at : start + m.start()])
        at = start + m.end()
        if m.group()[1] >= 0xD8:
            break
    total, blocks = across * down, [[] for _ in plan]
    for k, piece in enumerate(pieces):
        n = min(every, total - k * every) if every else total
        for own, more in zip(blocks, _coefficients(piece, plan, dict.fromkeys(use, 0), n), strict=True):
            own += more
    if len(blocks[0]) < total:
        raise ValueError("JPEG scan ends too soon")
    _, ph, pv, q = parts[0]
    scale = np.zeros(64)
    scale[ZIGZAG] = quant[q]
    f = np.stack([np.stack(b) for b in blocks[: ph * pv]], 1) * scale
    pixels = np.clip(np.round(COSINES.T @ f.reshape(-1, 8, 8) @ COSINES + 128), 0, 255)
    grid = pixels.reshape(down, across, pv, ph, 8, 8).transpose(0, 2, 4, 1, 3, 5)
    luma = grid.reshape(down * pv * 8, across * ph * 8)
    # Where other components are sampled more densely, the luma is spread to the frame's size.
    luma = luma.repeat(high // pv, 0).repeat(wide // ph, 1)
    return luma[:h, :w].astype(np.uint8)


def is_lossless(jpeg: bytes) -> bool:
    return jpeg.startswith(JPEG_HEAD) or any(marker == 0xC3 for marker, _, _ in _segments(jpeg))


def decode_frames(jpegs: list[bytes]) -> np.ndarray:
    """Samples (n, height, width) of frames of one size; lossless frames that share one header advance together."""
    if not jpegs:
        return np.zeros((0, SIDE, SIDE), np.uint8)
    if not is_lossless(jpegs[0]):
        return np.stack([decode_frames([j])[0] if is_lossless(j) else decode_baseline(j) for j in jpegs])
    h, w, skip, table, bits = parse_head(jpegs[0])
    head = jpegs[0][:skip]
    if not all(j.startswith(head) for j in jpegs):
        return np.concatenate([decode_frames([j]) for j in jpegs])  # of one size, or a ValueError
    scans = [j[skip:-2] for j in jpegs]
    size = np.fromiter(map(len, scans), np.int64, len(scans))
    data = np.frombuffer(b"".join(scans), np.uint8)
    stuffed = np.zeros(len(data), bool)
    stuffed[1:] = (data[:-1] == 255) & (data[1:] == 0)
    start = np.cumsum(size) - size
    if stuffed.any():
        start = start - np.concatenate([[0], np.cumsum(stuffed)])[start]
        data = data[~stuffed]
    b = np.zeros(len(data) + 3, np.int32)
    b[: len(data)] = data
    window = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    window = np.append(window, np.zeros(4, np.int32))
    at, limit = start * 8, (len(window) - 1) * 8
    diff = np.empty((h * w, len(jpegs)), np.int32)
    mask, shift = (1 << bits) - 1, 24 - bits
    for k in range(h * w):
        hit = table[(window[at >> 3] >> (shift - (at & 7))) & mask]
        diff[k] = hit
        at += hit >> 16
        np.minimum(at, limit, out=at)
    d = ((diff & 0xFFFF) - 512).T.reshape(len(jpegs), h, w)
    d[:, 0, 0] += 128
    d[:, :, 0] = np.cumsum(d[:, :, 0], axis=1)
    return (np.cumsum(d, axis=2) & 255).astype(np.uint8)


def shot_starts(samples: np.ndarray, video: np.ndarray) -> np.ndarray:
    """For frames in order, of videos in order: whether each one begins a shot."""
    n = len(samples)
    if not n:
        return np.zeros(0, bool)
    cell = (samples.reshape(n, -1) >> 4).astype(np.int64) + np.arange(n)[:, None] * BINS
    hist = np.bincount(cell.ravel(), minlength=n * BINS).reshape(n, BINS)
    first = np.concatenate([[True], video[1:] != video[:-1]])
    d = np.concatenate([[0], np.abs(hist[1:] - hist[:-1]).sum(1) // 2])
    d[first] = 0
    begin = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    low = np.maximum(begin + 1, np.arange(n) - RECENT)  # the first frame of a video has no difference
    s, q = np.concatenate([[0], np.cumsum(d)]), np.concatenate([[0], np.cumsum(d * d)])
    m = np.maximum(0, np.arange(n) - low)
    low = np.minimum(low, np.arange(n))
    total, squares = s[np.arange(n)] - s[low], q[np.arange(n)] - q[low]
    above = m * d - total
    usual = (above <= 0) | (above**2 <= SIGMA**2 * (m * squares - total**2))
    least = LEAST * (samples[0].size) // FRAME
    return first | ((d >= least) & ((m == 0) | ~usual))


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): every whole text as the bytes of an AVI file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, bounds = utf8(b.column(1))
            for i, j in slices(bounds, RUN):
                size = np.diff(bounds[i : j + 1])
                frames = np.maximum(1, -(-size // FRAME))
                at = np.cumsum(frames) - frames
                padded = np.full(int(frames.sum()) * FRAME, PAD, np.uint8)
                part = data[bounds[i] : bounds[j]]
                padded[np.arange(len(part)) + np.repeat(at * FRAME - (bounds[i:j] - bounds[i]), size)] = part
                coded = encode_frames(padded.reshape(-1, SIDE, SIDE))
                media = [write_avi(coded[a : a + k]) for a, k in zip(at.tolist(), frames.tolist(), strict=True)]
                yield pa.record_batch([b.column(0).slice(i, j - i), pa.array(size, pa.int64()), pa.array(media, pa.binary())], names=["id", "n_bytes", "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, n_bytes long, media binary")


def _decoded(media: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Samples of all videos' frames, each video's number of frames, and where shots begin."""
    jpegs, count = [], []
    for m in media:
        index = read_index(m)
        count.append(len(index))
        jpegs += [m[a : a + n] for a, n in index]
    samples = decode_frames(jpegs)
    count = np.array(count, np.int64)
    return samples, count, shot_starts(samples, np.repeat(np.arange(len(count)), count))


def _cuts(media: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Each video's number of frames, and where shots begin; videos may differ in size."""
    try:
        _, count, cuts = _decoded(media)
        return count, cuts
    except ValueError:
        # Videos of several sizes; a damaged one raises its own error here.
        each = [_decoded([m]) for m in media]
        return np.concatenate([e[1] for e in each]), np.concatenate([e[2] for e in each])


def _runs(column: pa.Array) -> Iterator[tuple[int, list[bytes | None]]]:
    start, got, size = 0, [], 0
    for i, m in enumerate(column):
        m = m.as_py()
        if got and size + len(m or b"") > RUN:
            yield start, got
            start, got, size = i, [], 0
        got.append(m)
        size += len(m or b"")
    if got:
        yield start, got


def _ms(frame: int) -> int:
    return frame * 1000 // FPS


def facts(media: DataFrame) -> DataFrame:
    """What each stored video holds, from its decoded samples; one row for each row of (id, n_bytes, media)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, part in _runs(b.column(2)):
                samples, count, cuts = _decoded([m for m in part if m is not None])
                flat, at, k, rows = samples.reshape(-1), 0, 0, []
                for m in part:
                    if m is None:
                        rows.append((None,) * 6)
                        continue
                    n = int(count[k])
                    own = flat[at * FRAME : (at + n) * FRAME].tobytes()
                    begins = np.flatnonzero(cuts[at : at + n]).tolist()
                    clips = ",".join(f"{_ms(a)}-{_ms(z)}" for a, z in zip(begins, [*begins[1:], n], strict=True))
                    rows.append((len(own), hashlib.sha256(own).hexdigest(), zlib.crc32(own[-32:]), len(m), hashlib.sha256(m).hexdigest(), f"frames={n};shots={len(begins)};clips={clips}"))
                    at, k = at + n, k + 1
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
                yield pa.record_batch([b.column(0).slice(start, len(part)), b.column(1).slice(start, len(part)), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], names=["id", "n_bytes", *names])

    kind = media.schema["id"].dataType.simpleString()
    return media.select("id", "n_bytes", "media").mapInArrow(run, f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def clips(media: DataFrame) -> DataFrame:
    """(id, clip, start_ms, end_ms, frames): a row for each shot of each stored video."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, part in _runs(b.column(1)):
                have = [i for i, m in enumerate(part) if m is not None]
                count, cuts = _cuts([part[i] for i in have])
                begins, ends = np.flatnonzero(cuts), np.append(np.flatnonzero(cuts)[1:], len(cuts))
                at = np.cumsum(count) - count
                video = np.searchsorted(at, begins, "right") - 1 if len(begins) else np.zeros(0, np.int64)
                first = np.searchsorted(video, np.arange(len(count)))
                ids = b.column(0).take(pa.array(start + np.array(have, np.int64)[video] if len(have) else np.zeros(0, np.int64)))
                a, z = begins - at[video], ends - at[video]
                yield pa.record_batch([ids, pa.array(np.arange(len(video)) - first[video]), pa.array(a * 1000 // FPS), pa.array(z * 1000 // FPS), pa.array(z - a)], names=["id", "clip", "start_ms", "end_ms", "frames"])

    kind = media.schema["id"].dataType.simpleString()
    return media.select("id", "media").mapInArrow(run, f"id {kind}, clip long, start_ms long, end_ms long, frames long")
