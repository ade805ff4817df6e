"""A media table from vectors: pictures, alike where vectors are, and cropped and edited copies of some."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .images import encode_png, resized, sampled, smoothed

SIDE = 96
EVERY = 5
EDITS = ("crop", "scale", "turn", "noise", "gamma", "blur", "brightness", "levels", "bar", "quarter", "turn and scale", "crop and brightness")
_textures: dict[int, np.ndarray] = {}


def _noise(rng: np.random.Generator) -> np.ndarray:
    return smoothed(rng.standard_normal((SIDE, SIDE)).astype(np.float32), 2)


def textures(n: int) -> np.ndarray:
    """``n`` fixed textures, one for each number of a vector."""
    if n not in _textures:
        rng = np.random.default_rng(11)
        _textures[n] = np.stack([_noise(rng) for _ in range(n)])
    return _textures[n]


def generator(vector: np.ndarray) -> np.random.Generator:
    """Seeded by all of the vector's 32-bit numbers."""
    return np.random.default_rng(int.from_bytes(hashlib.sha256(np.asarray(vector, "<f4").tobytes()).digest()))


def render(vector: np.ndarray, linear: bool) -> np.ndarray:
    """A picture of the vector: a sum of textures, so that near vectors give near pictures, or noise of its own."""
    vector = np.asarray(vector, np.float32)
    size = float(np.linalg.norm(vector))
    made = np.tensordot(vector / size, textures(len(vector)), 1) if linear and size > 0 else _noise(generator(vector))
    return np.rint(np.clip(128 + 250 * made, 0, 255))


def turned(picture: np.ndarray, degrees: float) -> np.ndarray:
    """Turned about its centre on the same canvas; what comes from outside is black."""
    h, w = picture.shape
    y, x = np.meshgrid(np.arange(h) - (h - 1) / 2, np.arange(w) - (w - 1) / 2, indexing="ij")
    cos, sin = np.cos(np.deg2rad(degrees)), np.sin(np.deg2rad(degrees))
    from_y, from_x = cos * y - sin * x + (h - 1) / 2, sin * y + cos * x + (w - 1) / 2
    inside = (from_y >= 0) & (from_y <= h - 1) & (from_x >= 0) & (from_x <= w - 1)
    return np.where(inside, sampled(picture.astype(np.float32), from_y, from_x), 0)


def cropped(picture: np.ndarray, share: float, rng: np.random.Generator) -> np.ndarray:
    """A rectangle with ``share`` of the picture's area, anywhere in it."""
    h, w = (max(1, int(n * share**0.5)) for n in picture.shape)
    y, x = rng.integers(0, picture.shape[0] - h + 1), rng.integers(0, picture.shape[1] - w + 1)
    return picture[y : y + h, x : x + w]


def edited(picture: np.ndarray, kind: str, rng: np.random.Generator, amount: float | None = None) -> np.ndarray:
    """A copy edited as ``kind`` says (one of ``EDITS``); ``amount`` from 0 to 1 (drawn where None) sets how much."""
    much = float(rng.random()) if amount is None else amount
    if kind == "crop":
        out = cropped(picture, 0.9 - 0.4 * much, rng)
    elif kind == "scale":
        out = resized(picture, 0.95 - 0.45 * much)
    elif kind == "turn":
        out = turned(picture, 3 + 42 * much)
    elif kind == "noise":
        out = picture + rng.normal(0, 2 + 8 * much, picture.shape)
    elif kind == "gamma":
        out = 255 * (picture / 255) ** (1.3 - 0.6 * much)
    elif kind == "blur":
        out = smoothed(picture, 1)
    elif kind == "brightness":
        out = picture * (0.95 - 0.3 * much) + 30 * much
    elif kind == "levels":
        step = 8 + 16 * much
        out = np.rint(picture / step) * step
    elif kind == "bar":
        out, at = picture.copy(), int(much * 0.8 * len(picture))
        out[at : at + len(picture) // 7] = 0
    elif kind == "quarter":
        out = np.rot90(picture)
    elif kind == "turn and scale":
        out = resized(turned(picture, 3 + 17 * much), 0.95 - 0.25 * much)
    else:
        out = cropped(picture, 0.9 - 0.3 * much, rng) * (1.1 - 0.3 * much)
    return np.rint(np.clip(out, 0, 255))


def media_from_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``media_id, image`` (PNG): 2 x key for each vector's picture, and 2 x key + 1 for a copy where the key is divisible by five.

    Vectors of even keys give sums of textures, those of odd keys noise of
    their own.  Copies take the kinds of ``EDITS`` in turn and amounts at random.
    """

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                ids, images = [], []
                for own, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    v = np.array([x or 0.0 for x in v], np.float32) if v else None
                    picture = None if v is None else render(v, own is not None and own % 2 == 0)
                    ids.append(None if own is None else 2 * own)
                    images.append(None if picture is None else encode_png(picture))
                    if own is not None and own % EVERY == 0 and picture is not None:
                        ids.append(2 * own + 1)
                        images.append(encode_png(edited(picture, EDITS[own // EVERY % len(EDITS)], generator(v))))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(images, pa.binary())], names=["media_id", "image"])

    return vectors.select(key, vector).mapInArrow(draw, "media_id long, image binary")
