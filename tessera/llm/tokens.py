"""Token ids of the public byte-level BPE vocabulary.

The ids are those of ``tokenizers`` with ``byte_bpe_50k.json`` and
``add_special_tokens=False``. The rank file of the same vocabulary gives the
same ids about four times faster, so texts go through ``tiktoken``; texts on
which its pattern engine panics (runs of very many blanks) go through
``tokenizers``. Tests hold the two against each other.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import numpy as np

END = "<|endoftext|>"


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(2)
def _exact(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(2)
def _fast(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={END: len(ranks)})


def encode(text: str | None, json_path: str | None = None, rank_path: str | None = None) -> np.ndarray:
    """The ids of one whole text as uint32; a null text has none."""
    if not text:
        return np.empty(0, np.uint32)
    try:
        fast = _fast(rank_path or vocabulary("byte_bpe_50k.tiktoken"))
        ids = fast.encode(text, allowed_special="all") if END in text else fast.encode_ordinary(text)
    except BaseException as e:  # a panic of the pattern engine is no Exception, and its class cannot be imported
        if type(e).__name__ != "PanicException":
            raise
        ids = _exact(json_path or vocabulary("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids
    return np.array(ids, np.uint32)
