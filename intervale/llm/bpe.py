"""Byte-level BPE ids of a public vocabulary, from its ``tokenizers`` JSON file."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def encoding(path: str):
    """An encoder whose ids equal those of the ``tokenizers`` file, special tokens in a text included.

    It merges by rank, as that file's merges do, in a faster library; a test holds both against each other.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    byte = _byte_of()
    ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


#: What the pattern's ``\\s`` matches (a fixed list), and how long a run of it goes round the pattern, which keeps a place for every blank.
BLANK, LONG_RUN = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000", 10_000
_LONG = re.compile(f"[{BLANK}]{{{LONG_RUN},}}")


def encode(enc, text: str) -> np.ndarray:
    """Ids as a numpy array of uint32.

    Of a long run of blanks the pattern makes one pre-token, without the last blank if something else than a special token
    follows; it is merged as one piece without being matched.
    """
    parts, at = [], 0
    for run in _LONG.finditer(text):
        start, end = run.span()
        if end < len(text) and not any(text.startswith(t, end) for t in enc.special_tokens_set):
            end -= 1
        parts += [enc.encode_to_numpy(text[at:start], allowed_special="all", disallowed_special=()), np.array(enc._encode_single_piece(text[start:end]), np.uint32)]
        at = end
    last = enc.encode_to_numpy(text[at:], allowed_special="all", disallowed_special=())
    return np.concatenate([*parts, last]) if parts else last
