"""Logistic regression on hashed word and character n-grams, scored over Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 16
BLOCK_BYTES = 1 << 20
SAMPLE_ROWS = 4_000
FIT_FEATURES = 1 << 20
BASE = 0x9E3779B97F4A7C15
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


POWERS = _powers(BASE, BLOCK_BYTES + 1)
INVERSE = _powers(pow(BASE, -1, 1 << 64), BLOCK_BYTES + 1)
GRAM = 3


@dataclass
class Carry:
    """What the next part of a long document needs of those before it."""

    word: np.uint64 | None = None  # hash of the last whole word
    open_sum: int = 0  # of a word that goes on, with its bytes so far
    open_bytes: int = 0
    chars: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint32))


@dataclass
class Block:
    """Some whole documents, or a part of a very long one, as bytes, words and characters."""

    docs: np.ndarray  # index of each piece's document
    bounds: np.ndarray  # the pieces' first bytes, and the end
    data: np.ndarray
    word_bounds: np.ndarray  # the pieces' first words, and the end
    hashes: np.ndarray
    chars: np.ndarray  # a number for each character, those carried over first
    char_bounds: np.ndarray  # the pieces' first characters, and the end
    part: bool  # of a document longer than a block
    before: np.uint64 | None = None  # hash of the word before the first one

    def per_piece(self, values: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """Sums over each piece of values of its bytes, or of what ``at`` bounds."""
        total = np.concatenate(([0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)))
        at = self.bounds if at is None else at
        return total[at[1:]] - total[at[:-1]]


def blocks(column: pa.Array) -> Iterator[Block]:
    """The texts of an Arrow string column (null: empty) in blocks of bounded size.

    A text longer than a block is cut between characters.  A word over a cut
    belongs to the part in which it ends; word pairs and character windows go
    over cuts, so that no count depends on the size of the blocks.
    """
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, 8 * column.offset)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at, n = 0, len(column)
    while at < n:
        last = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK_BYTES, "right")) - 1)
        lo, hi = int(offsets[at]), int(offsets[last])
        if hi - lo <= BLOCK_BYTES:
            yield _block(np.arange(at, last), offsets[at : last + 1] - lo, data[lo:hi])
        else:
            carry = Carry()
            while lo < hi:
                cut = min(hi, lo + BLOCK_BYTES)
                while cut < hi and cut > lo + 1 and (data[cut] & 0xC0) == 0x80:
                    cut -= 1
                yield _part(at, data[lo:cut], carry, cut == hi)
                lo = cut
        at = last


def _block(docs: np.ndarray, bounds: np.ndarray, data: np.ndarray) -> Block:
    start, sums = _words(data, bounds)[::2]
    chars, at = _characters(data, bounds)
    return Block(docs, bounds, data, np.searchsorted(start, bounds), _mixed(sums), chars, at, False)


def _part(doc: int, data: np.ndarray, carry: Carry, last: bool) -> Block:
    """A part of document ``doc``; ``carry`` is brought up to its end."""
    start, end, sums = _words(data, np.array([0, len(data)]))
    if carry.open_bytes:
        if len(start) and start[0] == 0:
            whole = carry.open_sum + int(sums[0]) * pow(BASE, carry.open_bytes, 1 << 64)
            sums[0] = np.uint64(whole & (1 << 64) - 1)
            goes_on = carry.open_bytes
        else:
            sums = np.concatenate((np.array([carry.open_sum], np.uint64), sums))
            start, end, goes_on = np.concatenate(([0], start)), np.concatenate(([0], end)), 0
        carry.open_bytes = 0
    else:
        goes_on = 0
    if not last and len(end) and end[-1] == len(data):
        carry.open_sum, carry.open_bytes = int(sums[-1]), int(end[-1] - start[-1]) + (goes_on if len(sums) == 1 else 0)
        sums = sums[:-1]
    hashes = _mixed(sums)
    chars, _ = _characters(data, np.array([0, len(data)]))
    chars = np.concatenate((carry.chars, chars))
    found = Block(np.array([doc]), np.array([0, len(data)]), data, np.array([0, len(hashes)]), hashes, chars, np.array([0, len(chars)]), True, carry.word)
    if len(hashes):
        carry.word = hashes[-1]
    carry.chars = chars[len(chars) - min(len(chars), GRAM - 1) :]
    return found


def _words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and polynomials of the words; a word ends with its piece."""
    inside = ~SPACE[data]
    before = np.concatenate(([False], inside[:-1])) if len(data) else inside
    first = np.zeros(len(data) + 1, bool)
    first[bounds] = True
    first = first[:-1]
    start = np.flatnonzero(inside & (~before | first))
    after = np.concatenate((inside[1:], [False])) if len(data) else inside
    following = np.concatenate((first[1:], [True])) if len(data) else first
    end = np.flatnonzero(inside & (~after | following)) + 1
    value = (data.astype(np.uint64) + np.uint64(1)) * POWERS[: len(data)]
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)))
    return start, end, (total[end] - total[start]) * INVERSE[start]


def _mixed(sums: np.ndarray) -> np.ndarray:
    return (sums ^ (sums >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _characters(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each character's UTF-8 bytes as one number, and the pieces' first characters."""
    follows = (data & 0xC0) == 0x80
    if not follows.any():
        return data.astype(np.uint32), bounds
    lead = np.flatnonzero(~follows)
    chars = data[lead].astype(np.uint32)
    padded, more = np.concatenate((data, np.zeros(3, np.uint8))), np.ones(len(lead), bool)
    for k in (1, 2, 3):
        byte = padded[lead + k].astype(np.uint32)
        more &= (byte & 0xC0) == 0x80
        chars |= np.where(more, byte << np.uint32(8 * k), 0).astype(np.uint32)
    return chars, np.searchsorted(lead, bounds)


def word_slots(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of the words and of each word with the one before it (0: it repeats it), and whether its document has one before it."""
    h = block.hashes
    slots = (h >> np.uint64(64 - BITS)).astype(np.int64)
    paired = np.ones(len(h) + 1, bool)
    paired[block.word_bounds] = block.before is not None
    pair = np.zeros(len(h), np.int64)
    if len(h):
        earlier = np.concatenate((np.array([block.before or 0], np.uint64), h[:-1]))
        mixed = (earlier * np.uint64(3) + h) * np.uint64(0x94D049BB133111EB)
        pair = np.where(earlier == h, 0, 1 + (mixed >> np.uint64(64 - BITS)).astype(np.int64) % ((1 << BITS) - 1))
    return slots, pair, paired[:-1]


def gram_slots(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the windows of three characters at each character, and whether the window lies in its piece."""
    c = block.chars.astype(np.uint64)
    slots = np.zeros(len(c), np.int64)
    inside = np.zeros(len(c), bool)
    if len(c) >= GRAM:
        mixed = ((c[:-2] * np.uint64(BASE) + c[1:-1]) * np.uint64(BASE) + c[2:]) * np.uint64(0xD6E8FEB86659FD93)
        slots[:-2] = mixed >> np.uint64(64 - BITS)
        inside[:-2] = True
        for back in range(1, GRAM):
            at = block.char_bounds[1:] - back
            inside[at[at >= 0]] = False
    return slots, inside


@dataclass
class TextModel:
    """Calibrated log-odds from mean weights of words, word pairs and character trigrams."""

    words: np.ndarray
    pairs: np.ndarray
    grams: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def sums(self, block: Block) -> np.ndarray:
        """Each piece's summed weights and counts, of words and pairs and then of trigrams."""
        words, pairs, paired = word_slots(block)
        weight = self.words[words] + np.where(paired, self.pairs[pairs], 0)
        grams, inside = gram_slots(block)
        chars = block.char_bounds
        return np.stack((block.per_piece(weight, block.word_bounds), np.diff(block.word_bounds), block.per_piece(np.where(inside, self.grams[grams], 0), chars), block.per_piece(inside, chars)))

    def logits(self, column: pa.Array) -> np.ndarray:
        total = np.zeros((4, len(column)))
        for block in blocks(column):
            total[:, block.docs] += self.sums(block)
        return self.from_sums(total)

    def from_sums(self, total: np.ndarray) -> np.ndarray:
        raw = self.bias + total[0] / np.maximum(total[1], 1) + total[2] / np.maximum(total[3], 1)
        return self.slope * raw + self.shift


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, slots (words, then pairs, then trigrams) and relative frequencies, in 12 bytes each; a long text's parts add up."""
    found = []
    size = 1 << BITS
    n = np.zeros((2, len(column)))
    for block in blocks(column):
        words, pairs, paired = word_slots(block)
        grams, inside = gram_slots(block)
        word_doc = np.repeat(block.docs, np.diff(block.word_bounds))
        char_doc = np.repeat(block.docs, np.diff(block.char_bounds))
        n[0] += np.bincount(word_doc, minlength=len(column))
        n[1] += np.bincount(char_doc[inside], minlength=len(column))
        for kind, doc, slot in ((0, word_doc, words), (0, word_doc[paired], pairs[paired] + size), (1, char_doc[inside], grams[inside] + 2 * size)):
            key, count = np.unique(doc * (4 * size) + slot, return_counts=True)
            found.append(((key // (4 * size)).astype(np.int32), (key % (4 * size)).astype(np.int32), count.astype(np.float32), kind))
    for rows, _, values, kind in found:
        values /= np.maximum(n[kind], 1)[rows]
    return tuple(np.concatenate([f[k] for f in found]) for k in range(3))


def fit(texts: list[str], labels: np.ndarray, prior: float | None = None, steps: int = 120, rate: float = 0.5, decay: float = 1e-5) -> TextModel:
    """Fit on three of four texts, calibrate (Platt) on the fourth, then move to the odds of ``prior``.

    ``prior`` is the true share of label 1 where the texts were drawn by class.
    """
    labels = np.asarray(labels, np.float64)
    size, n = 1 << BITS, len(labels)
    if n == 0 or labels.min() == labels.max():
        zero = np.zeros(size, np.float32)
        share = float(labels.mean()) if n else 0.5
        return TextModel(zero, zero, zero, float(np.log((share * n + 1) / ((1 - share) * n + 1))))
    rows, slots, values = features(pa.array(texts, pa.large_string()))
    held = np.arange(n) % 4 == 3
    if n < 40:
        held[:] = False
    train = ~held
    balance = np.where(labels == 1, 0.5 / max(1, (labels * train).sum()), 0.5 / max(1, ((1 - labels) * train).sum())) * train
    w, bias = np.zeros(3 * size), 0.0
    m, v, mb, vb = np.zeros(3 * size), np.zeros(3 * size), 0.0, 0.0
    pieces = [slice(at, at + FIT_FEATURES) for at in range(0, len(rows), FIT_FEATURES)]

    def scores() -> np.ndarray:
        return bias + sum(np.bincount(rows[p], w[slots[p]] * values[p], n) for p in pieces)

    for step in range(1, steps + 1):
        error = (_sigmoid(scores()) - labels) * balance
        g = decay * w
        for p in pieces:
            g += np.bincount(slots[p], error[rows[p]] * values[p], 3 * size)
        gb = error.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        unbias = np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
        w -= rate * unbias * m / (np.sqrt(v) + 1e-8)
        bias -= 0.1 * rate * unbias * mb / (np.sqrt(vb) + 1e-8)
    z = scores()
    slope, shift = _platt(z[held], labels[held]) if held.any() else (1.0, 0.0)
    if prior is not None:
        at = labels[held] if held.any() else labels
        share = (at.sum() + 1) / (len(at) + 2)
        shift += float(np.log(prior / (1 - prior)) - np.log(share / (1 - share)))
    a, b, c = (w[i * size : (i + 1) * size].astype(np.float32) for i in range(3))
    return TextModel(a, b, c, float(bias), slope, shift)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the calibrated log-odds, with Platt's softened targets."""
    ones, zeros = y.sum(), (1 - y).sum()
    target = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = _sigmoid(a * z + b)
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - target) * z).sum(), (p - target).sum()])
        h = np.array([[(w * z * z).sum() + 1e-6, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-7:
            break
    return (float(a), float(b)) if a > 0 and np.isfinite([a, b]).all() else (1.0, 0.0)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS, key: str = "doc_id") -> tuple[list[str], np.ndarray, float]:
    """At most ``rows`` labelled texts, whole, half of each class, and the share of label 1.

    Drawn by a hash of the key, so reruns agree.  Rows without key, label or
    text are left out.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).select(key, F.col(label).cast("int").alias("_label"))
    shares = {int(r[0]): r[1] for r in known.groupBy("_label").count().collect()}
    prior = (shares.get(1, 0) + 1) / (sum(shares.values()) + 2)
    order = F.xxhash64(F.col(key), F.lit("sample"))
    drawn = known.where("_label = 0").orderBy(order, key).limit(rows // 2).unionByName(known.where("_label = 1").orderBy(order, key).limit(rows // 2))
    found = docs.where(F.col("text").isNotNull()).select(key, "text").join(F.broadcast(drawn), key)
    got = found.orderBy(order, key, "text").limit(rows).select("text", "_label").collect()
    return [r[0] for r in got], np.array([r[1] for r in got], np.int64), prior
