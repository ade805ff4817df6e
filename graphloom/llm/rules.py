"""Quality rules: fixed base rules and a calibrated n-gram model."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .storage import free_name
from .textmodel import SPACE, Block, TextModel, blocks, fit, labelled_sample

SYMBOLS = b"#*$%&|<>"
LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20
REPEAT_WINDOW = 5
LEAST_PROBABILITY = 0.5
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True


def repeated_words(words: list[bytes], window: int = REPEAT_WINDOW) -> int:
    """Words that lie in a window of ``window`` words found twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    grams = list(zip(*(words[i : i + n] for i in range(window))))
    times = Counter(grams)
    if len(times) == n:
        return 0
    inside = np.zeros(len(words) + 1, np.int64)
    at = np.array([i for i, g in enumerate(grams) if times[g] > 1])
    np.add.at(inside, at, 1)
    np.add.at(inside, at + window, -1)
    return int((np.cumsum(inside)[:-1] > 0).sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split("\n")
    if len(set(lines)) == len(lines):
        return 0
    seen, n = set(), 0
    for line in lines:
        if line in seen:
            n += bool(line.strip(" \t\n\r\v\f"))
        seen.add(line)
    return n


def _may_repeat(block: Block) -> np.ndarray:
    """Whether two windows of a piece may be equal: equal windows have equal hashes."""
    out = np.zeros(len(block.docs), bool)
    h = block.hashes
    if len(h) >= REPEAT_WINDOW:
        n = len(h) - REPEAT_WINDOW + 1
        mixed = np.zeros(n, np.uint64)
        for i in range(REPEAT_WINDOW):
            mixed = mixed * np.uint64(0x9FB21C651E98DF25) + h[i : i + n]
        for k, (a, b) in enumerate(zip(block.word_bounds.tolist(), block.word_bounds[1:].tolist())):
            if b - a > REPEAT_WINDOW:
                own = np.sort(mixed[a : b - REPEAT_WINDOW + 1])
                out[k] = (own[1:] == own[:-1]).any()
    return out


def base_counts(column: pa.Array, texts: list[str | None]) -> np.ndarray:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of each whole text."""
    out = np.zeros((5, len(texts)), np.int64)
    for block in blocks(column):
        if block.part:
            doc = int(block.docs[0])
            if not out[:, doc].any():
                text = texts[doc] or ""
                words = text.encode("utf-8", "surrogatepass").split()
                out[:, doc] = len(words), sum(len(w.decode("utf-8", "surrogatepass")) for w in words), sum(text.count(chr(c)) for c in SYMBOLS), duplicate_lines(text), repeated_words(words)
            continue
        letter = (block.data & 0xC0) != 0x80
        out[0, block.docs] = np.diff(block.word_bounds)
        out[1, block.docs] = block.per_piece(letter & ~SPACE[block.data])
        out[2, block.docs] = block.per_piece(_IS_SYMBOL[block.data])
        for k in np.flatnonzero(_may_repeat(block)).tolist():
            words = block.data[block.bounds[k] : block.bounds[k + 1]].tobytes().split()
            out[4, block.docs[k]] = repeated_words(words)
        for doc in block.docs.tolist():
            out[3, doc] = duplicate_lines(texts[doc] or "")
    return out


def quality_model(docs: DataFrame, labels: DataFrame, **sample) -> TextModel:
    """The model of label ``quality``, fitted on the driver on a bounded sample."""
    texts, y, prior = labelled_sample(docs, labels, "quality", **sample)
    return fit(texts, y, prior)


def judge(docs: DataFrame, model: TextModel, least: float = LEAST_PROBABILITY) -> DataFrame:
    """``docs`` with the counts, ``quality_probability``, ``base_failed`` and ``kept``.

    ``base_failed``: fewer than ten words, or over 20 % of the words in
    repeated five-word windows.  ``kept``: not that, and a probability of at
    least ``least``.  A null text has no words and fails.  Columns of ``docs``
    whose names clash with the new ones keep theirs; the new one gets
    underscores in front.
    """
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "quality_probability", "base_failed", "kept"]
    names = [free_name(docs, n) for n in new]
    kinds = ["long"] * 5 + ["double", "boolean", "boolean"]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    at = docs.columns.index("text")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                counts = base_counts(batch.column(at), batch.column(at).to_pylist())
                p = 1 / (1 + np.exp(-np.clip(model.logits(batch.column(at)), -40, 40)))
                failed = (counts[0] < LEAST_WORDS) | (100 * counts[4] > MOST_REPEATED_PERCENT * counts[0])
                columns = [*batch.columns, *map(pa.array, counts), pa.array(p), pa.array(failed), pa.array(~failed & (p >= least))]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *names])

    return docs.mapInArrow(add, ", ".join([*fields, *(f"`{n}` {k}" for n, k in zip(names, kinds))]))
