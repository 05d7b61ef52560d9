"""Secret scans by token efficiency (operator 1).

Base kinds are fixed patterns, leftmost and non-overlapping per kind, filtered after matching:
assign, access, hex. The method adds kind `random`: a run of key characters that a BPE vocabulary
learned from prose cannot shorten, that is, one with few characters a token. The limit depends on the
classes of characters; it is asked of the run's segments between signs, of the run and of windows of it
that hold both cases and digits, so that a path or name beside a key does not hide it. Runs that a base
span already touches, known digests (hex of a digest's length), UUIDs and numbers are excluded first.

Spans are `kind:start:end` in code points, end exclusive, over the whole match. One narrow map
stage; nothing is shuffled. Cases: null text = empty text = no spans. Repeated rows repeat.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .vocab import default_path, tiktoken_encoding

#: Fixed patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HEX_RUN = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")
#: Hex lengths of MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512.
DIGESTS = (32, 40, 56, 64, 96, 128)

RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
SIGNS = re.compile("[+/_=-]+")
NUMBER = re.compile("[0-9]+[eE]?")
MIXED = (re.compile("[a-z]"), re.compile("[A-Z]"), re.compile("[0-9]"))

#: Characters of a segment or window at least, and the step between windows.
SEGMENT, WINDOW, STEP = 20, 24, 2
#: Most characters a token of random segments: one letter case, hex digits, one case with digits, both cases. Set on random strings
#: against words and identifiers; the first three are asked of the lower-case form, which words of capitals shorten to as well.
MAX_LETTERS, MAX_HEX, MAX_DIGITS, MAX_CASES = 2.02, 2.25, 1.9, 1.75
#: The same for a window that may hold signs, if it has both cases and digits, and for a run of both cases with few signs.
MAX_WINDOW, MAX_RUN = 1.6, 1.7
#: Runs up to this many characters are remembered, so that the memory is bounded.
REMEMBER = 256
#: Distinct characters a segment must have: fewer are repeats, Roman numbers or bases.
MIN_DISTINCT = 7


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, sorted."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX_RUN.finditer(text)]  # a maximal run of 24 or more is such a match of HEX
    return sorted(out)


def known(body: str) -> bool:
    return NUMBER.fullmatch(body) is not None or (len(body) in DIGESTS and HEX.fullmatch(body.lower()) is not None) or UUID.fullmatch(body) is not None


def plain_order(piece: str) -> bool:
    """Few distinct characters, or a stretch of the alphabet."""
    return len(set(piece)) < MIN_DISTINCT or 2 * sum(ord(b) - ord(a) == 1 for a, b in zip(piece, piece[1:], strict=False)) >= len(piece)


class Efficiency:
    def __init__(self, ranks_path: str, pattern: str):
        self.encoding = tiktoken_encoding(ranks_path, pattern)
        self._remembered = lru_cache(100_000)(self._is_random)

    def ratio(self, piece: str) -> float:
        return len(piece) / len(self.encoding.encode_ordinary(piece))

    def segment(self, piece: str) -> bool:
        """A stretch without signs."""
        if len(piece) < SEGMENT or known(piece) or plain_order(piece):
            return False
        lower, upper, digit = (p.search(piece) is not None for p in MIXED)
        if lower and upper:
            return self.ratio(piece) <= MAX_CASES
        low = piece.lower()
        return self.ratio(low) <= (MAX_LETTERS if not digit else MAX_HEX if HEX.fullmatch(low) else MAX_DIGITS)

    def window(self, piece: str) -> bool:
        return all(p.search(piece) for p in MIXED) and self.ratio(piece) <= MAX_WINDOW and not plain_order(piece)

    def few_signs(self, run: str) -> bool:
        return 10 * sum(map(len, SIGNS.findall(run))) <= len(run) and all(p.search(run) for p in MIXED[:2]) and self.ratio(run) <= MAX_RUN and not plain_order(run)

    def is_random(self, run: str) -> bool:
        return self._remembered(run) if len(run) <= REMEMBER else self._is_random(run)

    def _is_random(self, run: str) -> bool:
        if known(run.strip("=-_/+")):
            return False
        if any(map(self.segment, SIGNS.split(run))) or self.window(run) or self.few_signs(run):
            return True
        last = len(run) - WINDOW
        return all(p.search(run) for p in MIXED) and any(self.window(run[at : at + WINDOW]) for at in [*range(0, last, STEP), last] if at >= 0)

    def spans(self, text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Random runs that touch none of the sorted `taken`: one pass over both."""
        found, k, reach = [], 0, -1  # reach: the furthest end of the taken spans that start before the run's end
        for m in RUN.finditer(text):
            while k < len(taken) and taken[k][0] < m.end():
                reach = max(reach, taken[k][2])
                k += 1
            if reach <= m.start() and self.is_random(m[0]):
                found.append((m.start(), 3, m.end()))
        return found


def show(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None, pattern: str | None = None, keep: tuple[str, ...] = (), redact: bool = False) -> DataFrame:
    """Per row: id_col, `keep` columns, n_assign, n_access, n_hex, n_random, base, spans; with redact also `redacted`.

    base and spans are comma-joined `kind:start:end`. redacted is the text with the union of its spans
    replaced by `<secret>` (null for a null text).
    """
    if ranks_path is None:
        import public_tokenizers

        ranks_path, pattern = default_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN

    src = df.select(id_col, text_col, *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = Efficiency(ranks_path, pattern)
        for part in slices(batches, text_col):
            texts = part.column(1).to_pylist()
            base = [base_spans(t or "") for t in texts]
            full = [sorted(b + test.spans(t or "", b)) for t, b in zip(texts, base, strict=True)]
            columns = [part.column(0), *(part.column(2 + i) for i in range(len(keep)))]
            columns += [pa.array([sum(s[1] == k for s in f) for f in full], pa.int64()) for k in range(4)]
            columns += [pa.array(list(map(show, base)), pa.string()), pa.array(list(map(show, full)), pa.string())]
            if redact:
                columns.append(pa.array([without(t, f) for t, f in zip(texts, full, strict=True)], pa.string()))
            yield pa.record_batch(columns, names=names)

    names = [id_col, *keep, *(f"n_{k}" for k in KINDS), "base", "spans", *["redacted"] * redact]
    head = ", ".join(f"{c} {src.schema[c].dataType.simpleString()}" for c in (id_col, *keep))
    return src.mapInArrow(run, head + "".join(f", n_{k} long" for k in KINDS) + ", base string, spans string" + ", redacted string" * redact)


def without(text: str | None, spans: list[tuple[int, int, int]], mark: str = "<secret>") -> str | None:
    if text is None or not spans:
        return text
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(df: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars", ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """The same rows and columns with all spans of the text replaced; a changed text's length goes to chars_col, if there is one.

    Overlapping spans become one mark. A null text stays null, an empty one empty; repeated rows repeat; empty in, empty out.
    """
    if ranks_path is None:
        import public_tokenizers

        ranks_path, pattern = default_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    at_text = df.columns.index(text_col)
    at_chars = df.columns.index(chars_col) if chars_col in df.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = Efficiency(ranks_path, pattern)
        for part in slices(batches, text_col):
            texts = part.column(at_text).to_pylist()
            new = []
            for t in texts:
                base = base_spans(t or "")
                new.append(without(t, sorted(base + test.spans(t or "", base))))
            columns = list(part.columns)
            columns[at_text] = pa.array(new, columns[at_text].type)
            if at_chars is not None:
                sizes = columns[at_chars].to_pylist()
                columns[at_chars] = pa.array([n if a == b else len(b) for n, a, b in zip(sizes, texts, new, strict=True)], columns[at_chars].type)
            yield pa.record_batch(columns, schema=part.schema)

    return df.mapInArrow(run, df.schema)


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return scanned.select(id_col, "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_random")
