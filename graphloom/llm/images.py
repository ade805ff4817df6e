"""Grey images as arrays: portable maps and PNG, local corners and binary descriptors."""

from __future__ import annotations

import struct
import zlib

import numpy as np

STEP = 2 ** (-1 / 8)  # from one scale to the next
LEAST_SIDE = 44  # of the smallest scale
RADIUS = 12
MARGIN = 6
BITS = 256
TELLING_BYTES = 12
CORNER_AREA = 900  # a scale gives a corner for so many of its pixels, whatever its size
LEAST_CORNERS = 4
MOST_APART = 64
PNG_MAGIC = b"\x89PNG\r\n\x1a\n"


def encode_png(grey: np.ndarray) -> bytes:
    h, w = grey.shape
    rows = np.concatenate((np.zeros((h, 1), np.uint8), grey.astype(np.uint8)), axis=1).tobytes()
    chunks = ((b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)), (b"IDAT", zlib.compress(rows, 1)), (b"IEND", b""))
    return PNG_MAGIC + b"".join(struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d)) for k, d in chunks)


def decode(data: bytes | None) -> np.ndarray | None:
    """A grey image from PNG or 8-bit PGM/PPM bytes; None for anything else, damaged files included."""
    try:
        if data and data.startswith(PNG_MAGIC):
            return _decode_png(data)
        if data and data[:2] in (b"P5", b"P6"):
            return _decode_pnm(data)
    except (ValueError, IndexError, TypeError, struct.error, zlib.error):
        pass
    return None


def _grey(pixels: np.ndarray) -> np.ndarray:
    if pixels.shape[2] >= 3:
        return (pixels[:, :, :3] @ np.array([0.299, 0.587, 0.114])).astype(np.float32)
    return pixels[:, :, 0].astype(np.float32)


def _decode_pnm(data: bytes) -> np.ndarray:
    fields, at = [], 2
    while len(fields) < 3:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        start = at
        while at < len(data) and not data[at : at + 1].isspace():
            at += 1
        fields.append(int(data[start:at]))
    w, h, most = fields
    channels = 3 if data[:2] == b"P6" else 1
    if most > 255:
        raise ValueError("16-bit samples")
    return _grey(np.frombuffer(data, np.uint8, w * h * channels, at + 1).reshape(h, w, channels))


def _decode_png(data: bytes) -> np.ndarray:
    """All colour types, sample depths and both orders of rows of the PNG format, as grey."""
    at, packed, head, palette = len(PNG_MAGIC), [], None, None
    while at < len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(head[3]) if head else None
    if channels is None or head[2] not in (1, 2, 4, 8, 16) or min(head[:2]) < 1:
        raise ValueError("kind of PNG")
    w, h, depth, colour, _, _, interlaced = head
    raw, place = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8), 0
    out = np.zeros((h, w, channels), np.float32)
    # the seven passes of the interlaced order: first column and row, steps
    passes = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)] if interlaced else [(0, 0, 1, 1)]
    for x0, y0, dx, dy in passes:
        columns, rows = len(range(x0, w, dx)), len(range(y0, h, dy))
        if columns and rows:
            width = (columns * channels * depth + 7) // 8
            lines = raw[place : place + rows * (1 + width)].reshape(rows, 1 + width)
            place += rows * (1 + width)
            out[y0::dy, x0::dx] = _samples(_unfiltered(lines, max(1, channels * depth // 8)), columns * channels, depth).reshape(rows, columns, channels)
    if colour == 3:
        if palette is None:
            raise ValueError("no palette")
        return _grey(palette[out[:, :, 0].astype(int)].astype(np.float32))
    return _grey(out * (255 / (2**depth - 1)))


def _unfiltered(lines: np.ndarray, unit: int) -> np.ndarray:
    out = np.zeros((len(lines), lines.shape[1] - 1), np.uint8)
    above = np.zeros(out.shape[1], np.int64)
    for y, row in enumerate(lines):
        rule, line = row[0], row[1:].astype(np.int64)
        if rule == 1:
            for k in range(unit):
                line[k::unit] = np.cumsum(line[k::unit])
        elif rule == 2:
            line += above
        elif rule in (3, 4):
            found, up = line.tolist(), above.tolist()
            for x in range(len(found)):
                a, b, c = (found[x - unit], up[x], up[x - unit]) if x >= unit else (0, up[x], 0)
                if rule == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
                    guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                found[x] = (found[x] + guess) & 255
            line = np.array(found, np.int64)
        elif rule:
            raise ValueError("row filter")
        above = line & 255
        out[y] = above
    return out


def _samples(rows: np.ndarray, n: int, depth: int) -> np.ndarray:
    if depth == 16:
        return rows.reshape(len(rows), -1, 2).astype(np.float32) @ np.array([256, 1], np.float32)
    if depth == 8:
        return rows
    bits = np.unpackbits(rows, axis=1).reshape(len(rows), -1, depth)
    return (bits @ (1 << np.arange(depth)[::-1]))[:, :n]


def sampled(image: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Bilinear values at the points, those beyond the edge taken at the edge."""
    h, w = image.shape
    y, x = np.clip(y, 0, h - 1.001).astype(np.float32), np.clip(x, 0, w - 1.001).astype(np.float32)
    y0, x0 = y.astype(np.int32), x.astype(np.int32)
    fy, fx = y - y0, x - x0
    flat, k = image.reshape(-1), y0 * w + x0
    top, low = flat[k], flat[k + w]
    top += (flat[k + 1] - top) * fx
    low += (flat[k + w + 1] - low) * fx
    return top + (low - top) * fy


def resized(image: np.ndarray, scale: float) -> np.ndarray:
    """Bilinear resampling about pixel centres, after a blur when it shrinks much."""
    if scale == 1.0:
        return image
    source = image.astype(np.float32)
    while scale <= 0.5 and min(source.shape) >= 4:  # halve by means of four
        source = source[: len(source) // 2 * 2, : source.shape[1] // 2 * 2]
        source = (source[::2, ::2] + source[1::2, ::2] + source[::2, 1::2] + source[1::2, 1::2]) / 4
        scale *= 2
    if scale <= 0.75:
        source = smoothed(source, 1)
    h, w = max(2, round(source.shape[0] * scale)), max(2, round(source.shape[1] * scale))
    if min(source.shape) < 2:
        return source
    y, x = np.meshgrid((np.arange(h) + 0.5) / scale - 0.5, (np.arange(w) + 0.5) / scale - 0.5, indexing="ij")
    return sampled(source, np.maximum(y, 0), np.maximum(x, 0))


def smoothed(image: np.ndarray, radius: int) -> np.ndarray:
    """Mean over squares, edges repeated."""
    n = 2 * radius + 1
    padded = np.pad(image.astype(np.float32), radius, mode="edge")
    h, w = image.shape
    rows = sum((padded[k : k + h] for k in range(1, n)), padded[:h])
    return sum((rows[:, k : k + w] for k in range(1, n)), rows[:, :w]) / np.float32(n * n)


def _pattern() -> np.ndarray:
    """Pairs of points within the patch and apart from each other, drawn once from a normal law by a fixed seed.

    The most telling come first, dealt over ``TELLING_BYTES``: a patch is turned by its centroid, so a test
    along that direction mostly has the same answer, and tests near the middle
    are alike; tests across it and far from the middle are more like coins.
    """
    points = np.random.RandomState(7).normal(0, RADIUS / 2.5, (8 * BITS, 2, 2))
    points = points[(np.hypot(points[..., 0], points[..., 1]) < RADIUS - 0.5).all(axis=1)]
    apart = np.hypot(*(points[:, 0] - points[:, 1]).T)
    points = points[apart > 0.35 * RADIUS][:BITS]
    along, far = np.abs(points[:, 0, 1] - points[:, 1, 1]), np.hypot(*points.mean(axis=1).T)
    order = np.argsort(along - 0.75 * far, kind="stable")
    return points[np.concatenate((order[: 8 * TELLING_BYTES].reshape(8, -1).T.reshape(-1), order[8 * TELLING_BYTES :]))]


PATTERN = _pattern().astype(np.float32)
_RINGS, _TURNS = 5, 20
_RADII = np.repeat(np.linspace(RADIUS / _RINGS, RADIUS, _RINGS), _TURNS)
_ANGLES = np.tile(2 * np.pi * np.arange(_TURNS) / _TURNS, _RINGS)
_DISC = np.stack((_RADII * np.sin(_ANGLES), _RADII * np.cos(_ANGLES)), axis=1).astype(np.float32)
_PULL = (_RADII * np.exp(-2 * (_RADII / RADIUS) ** 2))[:, None].astype(np.float32) * _DISC


def corners(image: np.ndarray, most: int) -> np.ndarray:
    """``y, x``, finer than pixels, of the strongest local maxima of Harris' measure away from the edge."""
    if min(image.shape) <= 2 * MARGIN + 2:
        return np.zeros((0, 2), np.float32)
    gy, gx = np.gradient(image)
    yy, xx, xy = smoothed(gy * gy, 2), smoothed(gx * gx, 2), smoothed(gy * gx, 2)
    strength = yy * xx - xy * xy - 0.05 * (yy + xx) ** 2
    h, w = image.shape
    rows = strength[MARGIN - 2 : h - MARGIN + 2]
    best = rows[:, MARGIN - 2 : w - MARGIN - 2].copy()
    for k in range(1, 5):
        np.maximum(best, rows[:, MARGIN - 2 + k : w - MARGIN - 2 + k], out=best)
    top = best[: h - 2 * MARGIN].copy()
    for k in range(1, 5):
        np.maximum(top, best[k : h - 2 * MARGIN + k], out=top)
    inner = strength[MARGIN:-MARGIN, MARGIN:-MARGIN]
    y, x = np.nonzero((inner == top) & (inner > 20.0))
    order = np.lexsort((x, y, -inner[y, x]))[:most]
    y, x = y[order] + MARGIN, x[order] + MARGIN
    return np.stack((y + _peak(strength[y - 1, x], strength[y, x], strength[y + 1, x]), x + _peak(strength[y, x - 1], strength[y, x], strength[y, x + 1])), axis=1).astype(np.float32)


def _peak(before: np.ndarray, at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Where the parabola through three values is greatest, from the middle one."""
    bend = before - 2 * at + after
    return np.where(bend < 0, np.clip(0.5 * (before - after) / np.where(bend == 0, 1, bend), -0.5, 0.5), 0)


def scales(shape: tuple[int, int]) -> list[float]:
    """1 and each ``STEP`` below it that leaves the shorter side ``LEAST_SIDE`` pixels."""
    found = [1.0]
    while min(shape) * found[-1] * STEP >= LEAST_SIDE - 0.5:
        found.append(found[-1] * STEP)
    return found


def descriptors(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corners of all scales as ``x, y, scale, angle`` in full-size pixels, and 256 bits each.

    A corner's angle points to its patch's centroid of brightness; the tests
    are turned by it.  Each scale gives corners in proportion to its area.
    """
    places, bits = [], []
    for scale in scales(image.shape):
        level = smoothed(resized(image, scale), 1)
        at = corners(level, max(LEAST_CORNERS, round(level.size / CORNER_AREA)))
        if not len(at):
            continue
        y, x = at[:, :1], at[:, 1:]
        pull = sampled(level, y + _DISC[:, 0], x + _DISC[:, 1]) @ _PULL
        angle = np.arctan2(pull[:, 0], pull[:, 1])
        cos, sin = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
        dy, dx = PATTERN[None, :, :, 0], PATTERN[None, :, :, 1]
        value = sampled(level, y[:, :, None] + sin * dx + cos * dy, x[:, :, None] + cos * dx - sin * dy)
        bits.append(np.packbits(value[:, :, 0] < value[:, :, 1], axis=1))
        places.append(np.stack(((at[:, 1] + 0.5) / scale, (at[:, 0] + 0.5) / scale, np.full(len(at), 1 / scale), angle), axis=1))
    if not places:
        return np.zeros((0, 4)), np.zeros((0, BITS // 8), np.uint8)
    return np.concatenate(places), np.concatenate(bits)


def mutual_matches(left: np.ndarray, right: np.ndarray, most: int = MOST_APART) -> np.ndarray:
    """Rows ``i, j`` of descriptors that are each other's nearest and differ in at most ``most`` bits."""
    if not len(left) or not len(right):
        return np.zeros((0, 2), np.int64)
    x, y = left.view(np.uint64), right.view(np.uint64)
    apart = np.bitwise_count(x[:, None, :] ^ y[None, :, :]).sum(axis=2, dtype=np.int64)
    there, back = apart.argmin(axis=1), apart.argmin(axis=0)
    i = np.arange(len(left))
    kept = (back[there] == i) & (apart[i, there] <= most)
    return np.stack((i[kept], there[kept]), axis=1)


def consensus(left: np.ndarray, right: np.ndarray, tolerance: float = 3.0) -> int:
    """Most corner pairs that agree on one scaling, turn and shift.

    Every pair of ``x, y, scale, angle`` gives one such mapping; a mapping's
    agreement counts left corners that it puts within ``tolerance`` pixels of
    their partners, with partners that are scaled and turned like it (within
    a quarter octave and 30 degrees).  Corners at one place count once.
    """
    if not len(left):
        return 0
    scale, turn = right[:, 2] / left[:, 2], right[:, 3] - left[:, 3]
    a, b = scale * np.cos(turn), scale * np.sin(turn)
    tx = right[:, 0] - a * left[:, 0] + b * left[:, 1]
    ty = right[:, 1] - b * left[:, 0] - a * left[:, 1]
    px = a[:, None] * left[:, 0] - b[:, None] * left[:, 1] + tx[:, None]
    py = b[:, None] * left[:, 0] + a[:, None] * left[:, 1] + ty[:, None]
    near = np.hypot(px - right[:, 0], py - right[:, 1]) <= tolerance
    near &= np.abs(np.log2(scale[:, None] / scale)) <= 0.25 + 1e-6
    near &= np.cos(turn[:, None] - turn) >= np.cos(np.pi / 6)
    best = near[np.argsort(-near.sum(axis=1), kind="stable")[:8]]
    spots = np.unique(np.rint(left[:, :2] / 2), axis=0, return_inverse=True)[1].reshape(-1)
    return max(len(np.unique(spots[row])) for row in best)
