"""A public rank file as a byte-level encoder inside tasks, with the bytes of each token."""

from __future__ import annotations

import base64
import uuid

import numpy as np
from pyspark.sql import SparkSession

#: A rank file may have as many bytes at most; the driver reads it and broadcasts it.
MOST_FILE_BYTES = 64 << 20
_LOADED: dict[str, tuple] = {}


def shared_ranks(spark: SparkSession, path: str, pattern: str):
    with open(path, "rb") as file:
        content = file.read(MOST_FILE_BYTES + 1)
    if len(content) > MOST_FILE_BYTES:
        raise ValueError(f"{path} is larger than {MOST_FILE_BYTES} bytes")
    return spark.sparkContext.broadcast((uuid.uuid4().hex, content, pattern))


def encoder(shared) -> tuple:
    """(function from text to ids, bytes of each id); each Python worker keeps the last one."""
    name, content, pattern = shared.value
    if name not in _LOADED:
        import tiktoken

        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines())}
        lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            lengths[rank] = len(token)
        _LOADED.clear()
        _LOADED[name] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary, lengths
    return _LOADED[name]


def well_formed(text: str | None) -> str:
    """The text with null as empty and lone surrogates, which have no UTF-8 form, as U+FFFD."""
    text = text or ""
    return text if text.isascii() else text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def public_ranks() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
