"""Token ids of whole texts from public vocabulary files."""

from __future__ import annotations

import base64
import os
from functools import cached_property

import numpy as np

VOCABULARY = "byte_bpe_50k"
CACHED_CHUNKS = 200_000
LAST_LATIN = "ɏ"


def vocabulary_paths(name: str = VOCABULARY) -> tuple[str, str]:
    """The JSON and rank files of one byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(f"{name}.json"), public_tokenizers.path(f"{name}.tiktoken")


class ChunkEncoder:
    """Ids of a byte-level BPE vocabulary as little-endian bytes.

    A single space before a visible character always starts a new unit of the
    vocabulary's splitting pattern, so a text is cut at its spaces and the ids
    of each chunk are looked up; a bounded table keeps those of chunks seen
    before.  Texts in which a space borders another white space on its right
    are encoded in one piece.  Chunks beyond Latin letters go to the JSON
    file's own library, so that both agree on the classes of rare characters.
    """

    def __init__(self, json_path: str, ranks_path: str, width: int = 4):
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bpe = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.json_path = json_path
        self.dtype = f"<u{width}"
        self.chunks = _Chunks(self)

    @cached_property
    def tokenizer(self):
        """Loaded when the first text beyond Latin letters comes."""
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        found = Tokenizer.from_file(self.json_path)
        found.encode_special_tokens = True
        return found

    def ids(self, text: str) -> bytes:
        if text > "" and max(text) > LAST_LATIN:
            found = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            found = self.bpe.encode_ordinary(text)
        return np.asarray(found, dtype=self.dtype).tobytes()

    def encode(self, text: str) -> bytes:
        if len(self.chunks) > CACHED_CHUNKS:
            self.chunks.clear()
        first, *rest = text.split(" ")
        try:
            return self.ids(first) + b"".join(map(self.chunks.__getitem__, rest))
        except _Joined:
            return self.ids(text)


class _Joined(Exception):
    pass


class _Chunks(dict):
    def __init__(self, encoder: ChunkEncoder):
        self.encoder = encoder

    def __missing__(self, chunk: str) -> bytes:
        if not chunk or chunk[0].isspace() or chunk[0] in "\x1c\x1d\x1e\x1f\x85":
            raise _Joined
        self[chunk] = found = self.encoder.ids(f" {chunk}")
        return found


_encoders: dict[tuple, ChunkEncoder] = {}


def encoder(paths: tuple[str, str], width: int = 4) -> ChunkEncoder:
    """One encoder for each vocabulary and Python worker."""
    key = (*paths, width)
    if key not in _encoders:
        _encoders[key] = ChunkEncoder(*paths, width)
    return _encoders[key]
