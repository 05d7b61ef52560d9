"""Public tokenizers by path. The files stay where they are installed; only their path is a parameter."""

from __future__ import annotations

import base64
from functools import cache


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def hf_tokenizer(path: str):
    """A tokenizers.Tokenizer with truncation and padding unused, one per worker."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


@cache
def byte_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@cache
def tiktoken_encoding(path: str, pattern: str, special: tuple[tuple[str, int], ...] = ()):
    import tiktoken

    return tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=byte_ranks(path), special_tokens=dict(special))


@cache
def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level BPE files: printable Latin-1 stays, the rest moves to U+0100 on."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in set(keep)]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(moved)}
