"""BPE encoding and decoding with tree concatenation of long unsplit text (operator 6).

A text is encoded exactly as `tokenizers` encodes it. One of up to `LEAF` characters goes straight to an encoder. A longer one is a
balanced tree: its halves, cut wherever the middle falls, down to `LEAF` characters are encoded independently, then siblings are
concatenated. At a join a window around the seam is encoded anew and grows (doubling) until both sides agree: its first token is the
token that the left side had there, its last token the one that the right side had. Windows begin and end at word
starts (a space after a letter, digit or stop), where the pre-tokenizer splits whatever stands around, so what lies outside of the window is
encoded as it is in the whole text; the agreement is still asked for. If a side is used up the window begins or ends with the text.

Text with a run of `RUN` characters without a white-space change may have pre-tokens too long for one encoder pass. There the pre-tokens
are cut first (the pre-tokenizer is linear), and each one over `RUN` characters is the same kind of tree over its bytes. A BPE sequence is the
encoding of its text exactly if every adjacent pair of tokens encodes to itself, so agreement on both sides proves the splice.

Cost: the leaves and O(window) for each join; memory is that of the one text in hand.

Cases: null text = empty text = no ids and empty decoded text. Repeated rows give repeated
results. Empty tables give empty tables. Special-token strings inside a text become special
ids, as in the library's default.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices
from .vocab import byte_alphabet, default_path, hf_tokenizer, tiktoken_encoding

RUN = 2048
LEAF = 2048
#: Characters on each side of a seam that the first window reaches for, and tokens in the tree over a pre-token.
WINDOW, PIECE_LEAF = 32, 1024
SCHEMA_TAIL = "n_tokens long, n_joins int, ids binary, decoded string"

#: Outside these ranges Unicode tables of two libraries may differ: such texts are left to `tokenizers` itself.
_RARE = re.compile("[^\\x00-ɏ‐-‧‰-⁞€]")
_RUN = re.compile(r"\S{%d}|\s{%d}" % (RUN, RUN))
_WORD_START = re.compile(r"(?<=[\w.,;:!?]) ")
SPECIAL = "<|endoftext|>"


class TreeBPE:
    """Pure BPE (no pre-tokenizer) over one long pre-token given in the byte alphabet."""

    def __init__(self, path: str, leaf: int = PIECE_LEAF):
        from tokenizers import Tokenizer

        full = hf_tokenizer(path)
        self.raw, self.leaf, self.joins = Tokenizer(full.model), leaf, 0
        self.pieces = {i: t for t, i in full.get_vocab(with_added_tokens=False).items()}

    def encode(self, piece: str) -> list[int]:
        """Ids of a pre-token in the byte alphabet."""
        parts = [piece]
        while len(parts[0]) > self.leaf:
            parts = [half for p in parts for half in (p[: len(p) // 2], p[len(p) // 2 :])]
        level = [e.ids for e in self.raw.encode_batch([p for p in parts if p], add_special_tokens=False)]
        while len(level) > 1:
            level = [self.join(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0] if level else []

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the concatenation of two encoded texts."""
        self.joins += 1
        width = 2
        while True:
            i, j = min(width, len(left)), min(width, len(right))
            seam = left[len(left) - i :] + right[:j]
            window = self.raw.encode("".join(map(self.pieces.__getitem__, seam)), add_special_tokens=False).ids
            left_agrees = i == len(left) or window[0] == left[len(left) - i]
            right_agrees = j == len(right) or window[-1] == right[j - 1]
            if left_agrees and right_agrees:
                return left[: len(left) - i] + window + right[j:]
            width *= 2


class Codec:
    """Encoder and decoder for byte_bpe files; `ranks_path` (same vocabulary as ranks) speeds up common text."""

    def __init__(self, path: str, ranks_path: str | None = None, pattern: str | None = None, leaf: int = LEAF):
        self.hf = hf_tokenizer(path)
        self.special_id = self.hf.token_to_id(SPECIAL)
        self.fast = tiktoken_encoding(ranks_path, pattern, ((SPECIAL, self.special_id),)) if ranks_path else None
        self.tree = TreeBPE(path)

        self.leaf, self.joins = leaf, 0
        pieces = self.hf.get_vocab(with_added_tokens=False)
        self.n_bytes = np.zeros(max(*pieces.values(), self.special_id or 0) + 1, np.int64)  # of each token
        for piece, i in pieces.items():
            self.n_bytes[i] = len(piece)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text; `joins` counts the concatenations it took."""
        self.joins = self.tree.joins = 0
        if not text:
            return np.empty(0, "<u4")
        if len(text) >= RUN and _RUN.search(text):
            ids = np.asarray(self.encode_long(text), "<u4")
            self.joins = self.tree.joins
            return ids
        if len(text) <= self.leaf:
            return self.flat(text)
        special = np.asarray([self.special_id], "<u4")
        out = []
        for k, part in enumerate(text.split(SPECIAL)):
            if k:
                out.append(special)
            if part:
                out.append(self.encode_tree(part))
        return out[0] if len(out) == 1 else np.concatenate(out)

    def flat(self, text: str) -> np.ndarray:
        """One encoder pass."""
        if self.fast is not None and not _RARE.search(text):
            return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)
        return np.asarray(self.hf.encode(text, add_special_tokens=False).ids, "<u4")

    def encode_tree(self, text: str) -> np.ndarray:
        """Ids of a text without special tokens from those of its halves."""
        bounds = [0, len(text)]
        while bounds[1] > self.leaf:
            bounds = [x for a, b in zip(bounds, bounds[1:], strict=False) for x in (a, (a + b) // 2)] + [len(text)]
        level = [self.flat(text[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
        while len(level) > 1:
            level = [self.join(text, bounds[i], bounds[i + 1], bounds[i + 2], *level[i : i + 2]) for i in range(0, len(level), 2)]
            bounds = bounds[::2]
        return level[0]

    def join(self, text: str, start: int, seam: int, end: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The encoding of text[start:end] from those of its sides."""
        self.joins += 1
        reach = WINDOW
        while True:
            at, to = start, end
            if seam - reach > start and (m := _WORD_START.search(text, seam - reach, seam)):
                at = m.start()
            if seam + reach < end:
                starts = [m.start() for m in _WORD_START.finditer(text, seam + 1, seam + reach)]
                to = starts[-1] if starts else end
            if (at == start and seam - reach > start) or (to == end and seam + reach < end):
                reach *= 2  # no word start within reach
                continue
            window = self.flat(text[at:to])
            i, j = self.tokens_of(left[::-1], text[at:seam]), self.tokens_of(right, text[seam:to])
            if (at == start or window[0] == left[len(left) - i]) and (to == end or window[-1] == right[j - 1]):
                return np.concatenate([left[: len(left) - i], window, right[j:]])
            reach *= 2

    def tokens_of(self, ids: np.ndarray, text: str) -> int:
        """How many of the first ids make up a stretch of text that ends where a token does."""
        n = len(text.encode())
        count = int(np.searchsorted(np.cumsum(self.n_bytes[ids[:n]]), n)) + 1
        return count

    def encode_long(self, text: str) -> list[int]:
        ids: list[int] = []
        for k, part in enumerate(text.split(SPECIAL)):
            if k:
                ids.append(self.special_id)
            short: list[str] = []
            for piece, _ in self.hf.pre_tokenizer.pre_tokenize_str(part) if part else ():
                if len(piece) <= RUN:
                    short.append(piece)
                    continue
                ids += self.flush(short)
                ids += self.tree.encode(piece)
                short = []
            ids += self.flush(short)
        return ids

    def flush(self, pieces: list[str]) -> list[int]:
        return [i for e in self.tree.raw.encode_batch(pieces, add_special_tokens=False) for i in e.ids] if pieces else []

    def decode(self, ids: np.ndarray) -> str:
        if self.fast is not None:
            return self.fast.decode_bytes(ids.tolist()).decode("utf-8", "replace")
        return self.hf.decode(ids.tolist(), skip_special_tokens=False)


@cache
def codec(path: str, ranks_path: str | None, pattern: str | None) -> Codec:
    return Codec(path, ranks_path, pattern)


def encode_decode(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
    ranks_path: str | None = None,
    pattern: str | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Per row: id_col, `keep` columns, n_tokens, n_joins (concatenations), ids (little-endian unsigned 32-bit), decoded (text decoded from those ids).

    One narrow map stage: no shuffle, nothing collected, a lost executor only repeats its own tasks.
    """
    if path is None:
        import public_tokenizers

        path, ranks_path, pattern = default_path("byte_bpe_50k.json"), default_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, ranks_path, pattern)
        for part in slices(batches, text_col, 2 << 20):
            ids, joins = [], []
            for t in part.column(1).to_pylist():
                ids.append(c.encode(t or ""))
                joins.append(c.joins)
            yield pa.record_batch(
                [
                    part.column(0),
                    *(part.column(2 + i) for i in range(len(keep))),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array(joins, pa.int32()),
                    pa.array([x.tobytes() for x in ids], pa.binary()),
                    pa.array([c.decode(x) for x in ids], pa.string()),
                ],
                names=[id_col, *keep, "n_tokens", "n_joins", "ids", "decoded"],
            )

    src = df.select(id_col, text_col, *keep)
    head = ", ".join(f"{c} {src.schema[c].dataType.simpleString()}" for c in (id_col, *keep))
    return src.mapInArrow(run, f"{head}, {SCHEMA_TAIL}")
