"""Token ids of texts under the public byte-level BPE vocabulary.

``path`` is the vocabulary's file for the tokenizers library. Ids are computed
with the same vocabulary in rank form (the file of the same name ending in
.tiktoken), several times faster; the tests hold both against each other.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import numpy as np

BPE_50K = "byte_bpe_50k.json"
_SPECIAL = {"<|endoftext|>": 50256}


def public_path(name: str = BPE_50K) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@lru_cache(maxsize=4)
def encoder(path: str):
    """A function from a text to its ids, as the tokenizers library gives them without added special tokens."""
    import public_tokenizers
    import tiktoken

    with open(os.path.splitext(path)[0] + ".tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    coder = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=_SPECIAL)
    return lambda text: np.array(coder.encode(text, allowed_special="all"), dtype="<u4")
