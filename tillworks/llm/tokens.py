"""Byte-level BPE ids of whole texts."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np


@lru_cache(maxsize=2)
def _loaded(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    if len(ranks) > 1 << 16:
        raise ValueError("ids must fit 16 bits")
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def ids_of(text: str | None, path: str, pattern: str) -> np.ndarray:
    """Ids (uint16) of a whole text; none for null or empty text. Special-token strings are ordinary text."""
    return _loaded(path, pattern).encode_to_numpy(text or "", disallowed_special=()).astype("<u2")


def vocabulary() -> tuple[str, str, int]:
    """Path of the public 50k vocabulary on this machine, its pre-token pattern and its size."""
    import public_tokenizers as public

    return public.path("byte_bpe_50k.tiktoken"), public.PATTERN, 50_257

