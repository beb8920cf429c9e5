"""Token ids from a public tokenizer file (ranks of a byte-level BPE).

The file's path is a parameter.  The driver reads it and broadcasts its bytes
(under 2 MB), so executors need no copy of the file."""

from __future__ import annotations

import base64

import numpy as np
import tiktoken
from pyspark.sql import SparkSession

VOCABULARY_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the vocabulary's texts were cut before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MAX_FILE_BYTES = 64 << 20
PIECE = 1 << 20  # characters encoded at once


def ship(spark: SparkSession, path: str = VOCABULARY_FILE):
    with open(path, "rb") as f:
        content = f.read(MAX_FILE_BYTES + 1)
    if len(content) > MAX_FILE_BYTES:
        raise ValueError(f"tokenizer file over {MAX_FILE_BYTES} bytes: {path}")
    return spark.sparkContext.broadcast(content)


class Tokenizer:
    """``pad`` is the first id that no text has; ``dtype`` holds every id."""

    def __init__(self, content: bytes):
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pad = max(ranks.values()) + 1
        self.dtype = np.dtype("<u2") if self.pad < 1 << 16 else np.dtype("<u4")

    def ids(self, text: bytes) -> np.ndarray:
        """Ids of the whole text.  Very long texts are encoded piece by piece,
        cut before white space that follows a word, where the pattern cuts too."""
        whole = text.decode("utf-8", "replace")
        out, at = [], 0
        while len(whole) - at > PIECE:
            cut = at + PIECE
            while cut < len(whole) and not (whole[cut] == " " and whole[cut - 1].isalpha()):
                cut += 1
            out += self.encoding.encode_ordinary(whole[at:cut])
            at = cut
        out += self.encoding.encode_ordinary(whole[at:])
        return np.array(out, dtype=self.dtype)

    def text(self, ids: np.ndarray) -> str:
        return self.encoding.decode(ids.tolist(), errors="replace")
