"""Token ids in frequency-ranked, byte-aligned variable-length coding (operator 9).

Ids are renamed by global frequency (the most frequent id is 0), so most take one byte. A
document is coded as separate control bytes (two bits an id: its byte length less one, four
ids a control byte) followed by the data bytes. Documents are packed in ascending id order into
blocks; a block is one row of the token file, a Parquet table in the shared folder, written and
committed by Spark so that it can live in any store and survives lost executors:

    part, seq      which range of documents, and the block's place in it
    first          ids in earlier blocks of this part
    doc_ids, n     per document: its id and number of token ids
    control, data  the coded ids of the block

The rank table is a second small Parquet table (token id by rank). Decoding looks lengths up in a
256-row table by control byte, takes offsets by a running sum and gathers four byte planes; no
loop over ids.

Counts cover all rows: documents are tokenized once into a table of 16- or 32-bit ids, counted
there, and coded from there. Cases: null text = empty text = the end id alone. Repeated document
ids are kept, in a fixed order of their contents. Null document ids come first. Empty table: empty file.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, written
from .vocab import byte_alphabet, default_path, hf_tokenizer

BLOCK_IDS = 1 << 18

#: Characters of the plain path: composed, without case surprises, in the same class in every Unicode version.
_RARE = re.compile("[^\\x09-\\x0d\\x20-\\x7e\\xa0\\xa1-\\xb1\\xb4-\\xb8\\xba\\xbb\\xbf-įı-ɀ‐-‧‰-⁞€]|<\\|")
_LONG = re.compile(r"(?:\A|\s)\S{4096}")
_WHITE = "\n\t\r\x0b\x0c\xa0"
#: Pre-tokens of the plain alphabet that aren't letters, set apart by spaces: the second form where digits, apostrophes or underscores occur.
_SIGNS = "[!-/:-@\\[-`{-~¡-©«-±´¶-¸»¿×÷‐-⁞€]+"
_OTHER, _ANY_OTHER = re.compile(_SIGNS), re.compile(f"'(?:s|t|re|ve|m|ll|d)|{_SIGNS}|[0-9]")
_SPECIAL = re.compile("[0-9_']")
#: Ends a text in a run of plain texts; the plain alphabet lacks it.
_STOP = "\x02"


class WordEncoder:
    """Ids of a word-end BPE file as `tokenizers` gives them.

    Plain texts take a short cut with the same ids: once pre-tokens are set apart, each ends with one space, which
    stands for the word-end mark. The file's ids are its merge order (byte symbols, their word-end forms, then merges), so they
    serve as ranks for a byte-level encoder in which a last byte and its space merge first. Texts outside the plain
    alphabet, with special-token marks or with very long words go to the `tokenizers` tokenizer whole.
    """

    def __init__(self, path: str):
        import tiktoken

        self.tok = hf_tokenizer(path)
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.size = max(vocab.values()) + 1
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        byte_of = {c: b for b, c in byte_alphabet().items()}
        ranks = {}
        for token, i in self.tok.get_vocab(with_added_tokens=False).items():
            body = token.removesuffix("</w>")
            if all(c in byte_of for c in body) and not token.startswith("<|"):
                ranks[bytes(byte_of[c] for c in body) + b" " * (body != token)] = i
        if not all(bytes([b]) in ranks and ranks.get(bytes([b, 32]), self.size) < 512 for b in range(256)):
            raise ValueError("not a word-end BPE file whose ids are merge ranks")
        self.fast = tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={})

        self.stop = ranks[_STOP.encode() + b" "]

    @staticmethod
    def plain(text: str) -> bool:
        return not (_RARE.search(text) or (len(text) >= 4096 and _LONG.search(text)))

    @staticmethod
    def apart(text: str) -> str:
        low = text.lower()
        return (_ANY_OTHER if _SPECIAL.search(low) else _OTHER).sub(r" \g<0> ", low)

    def encode_all(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, each with the end id, and where each text ends."""
        if all(map(self.plain, texts)):
            joined = "".join(f"{self.apart(t)} {_STOP} " for t in texts)
            for c in _WHITE:
                joined = joined.replace(c, " ")
            ids = self.fast.encode_to_numpy(joined)
            ends = np.flatnonzero(ids == self.stop)
            ids = ids.astype(self.dtype)
            ids[ends] = end_id
            return ids, ends + 1
        parts = [self.encode_all([t], end_id)[0] if self.plain(t) else np.asarray([*self.tok.encode(t, add_special_tokens=False).ids, end_id], self.dtype) for t in texts]
        return np.concatenate(parts), np.cumsum([len(p) for p in parts])


@cache
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


_SHIFT = np.array([6, 4, 2, 0], np.uint8)
#: Byte length of each of the four ids of a control byte.
LENGTHS = ((np.arange(256)[:, None] >> _SHIFT) & 3).astype(np.uint8) + 1


def code(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    v = np.ascontiguousarray(values, "<u4")
    n = (v > 0xFF).astype(np.uint8)
    if len(v) and v.max() > 0xFFFF:
        n += (v > 0xFFFF).astype(np.uint8) + (v > 0xFFFFFF)
    quads = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    quads[: len(v)] = n
    quads = quads.reshape(-1, 4)
    control = quads[:, 0] << 6 | quads[:, 1] << 4 | quads[:, 2] << 2 | quads[:, 3]
    ends = np.cumsum(n + np.uint8(1), dtype=np.int64)
    starts = ends - n - 1
    data = np.empty(int(ends[-1]) if len(v) else 0, np.uint8)
    data[starts] = v
    for k in range(1, 4):
        longer = np.flatnonzero(n >= k)
        if not len(longer):
            break
        data[starts[longer] + k] = v[longer] >> np.uint32(8 * k)
    return control.tobytes(), data.tobytes()


def uncode(control: bytes, data: bytes, count: int) -> np.ndarray:
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:count]
    ends = np.cumsum(lengths, dtype=np.int64)
    starts = ends - lengths
    raw = np.frombuffer(data, np.uint8)
    out = raw[starts].astype(np.uint32)
    for k in range(1, 4):
        longer = np.flatnonzero(lengths > k)
        if not len(longer):
            break
        out[longer] |= raw[starts[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def token_table(df: DataFrame, id_col: str, text_col: str, path: str, end_id: int) -> DataFrame:
    """id, ids (binary, narrowest width, with the end id) of each text; `counts` is null but in one more row a task, which has no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        total = np.zeros(enc.size, np.int64)
        kind = None
        for part in slices(batches, text_col, 4 << 20):
            kind = part.column(0).type
            flat, ends = enc.encode_all([t or "" for t in part.column(1).to_pylist()], end_id)
            total += np.bincount(flat, minlength=enc.size)
            offsets = np.zeros(len(ends) + 1, np.int64)
            offsets[1:] = ends * enc.dtype.itemsize
            coded = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
            yield pa.record_batch([part.column(0), coded.cast(pa.binary()), pa.nulls(len(ends), pa.binary())], names=["id", "ids", "counts"])
        if kind is not None:
            yield pa.record_batch([pa.nulls(1, kind), pa.nulls(1, pa.binary()), pa.array([total.tobytes()], pa.binary())], names=["id", "ids", "counts"])

    src = df.select(id_col, text_col)
    return src.mapInArrow(run, f"id {src.schema[id_col].dataType.simpleString()}, ids binary, counts binary")


def flat_ids(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a binary column without nulls, and the number of each row, from Arrow's buffers as they are."""
    offsets = np.frombuffer(column.buffers()[1], np.int32 if pa.types.is_binary(column.type) else np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.empty(0, f"<u{width}"), np.empty(0, np.int64)
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return raw.view(f"<u{width}"), np.diff(offsets).astype(np.int64) // width


def rank_table(tokens: DataFrame) -> DataFrame:
    """(token, n) over all ids. Only the counts column is read; each task sends one row for a token at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in batch.column(0):
                n = np.frombuffer(x.as_buffer(), np.int64)
                total = n.copy() if total is None else total + n
        if total is not None:
            at = np.flatnonzero(total)
            yield pa.record_batch([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["token", "n"])

    return tokens.where("counts is not null").select("counts").mapInArrow(run, "token int, n long").groupBy("token").agg(F.sum("n").alias("n"))


def write_token_file(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = 1) -> tuple[DataFrame, DataFrame]:
    """Write the token file; returns (its blocks, its rank table), both read back from storage.

    The rank table is bounded by the vocabulary (one row a token id), never by the data.
    """
    path = path or default_path("word_bpe_49k.json")
    enc = encoder(path)
    size, width = enc.size, enc.dtype.itemsize
    tokens = written(token_table(df, id_col, text_col, path, end_id), "tokens")
    counts = {r.token: r.n for r in rank_table(tokens).collect()}
    order = sorted(range(size), key=lambda t: (-counts.get(t, 0), t))
    rank_of = np.empty(size, np.uint32)
    rank_of[order] = np.arange(size, dtype=np.uint32)
    spark = df.sparkSession
    ranks = written(spark.createDataFrame(list(enumerate(order)), "rank int, token int").coalesce(1), "ranks")
    shared = spark.sparkContext.broadcast(rank_of)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, first = TaskContext.get().partitionId(), 0, 0
        docs: list = []
        sizes: list[np.ndarray] = []
        held: list[np.ndarray] = []
        waiting = 0
        for batch in batches:
            ids, n = flat_ids(batch.column(1), width)
            names, ends, at = batch.column(0).to_pylist(), np.cumsum(n), 0
            while at < len(n):  # rows up to the one that fills the block
                start = int(ends[at] - n[at])
                to = min(len(n), int(np.searchsorted(ends, start + BLOCK_IDS - waiting)) + 1)
                stop = int(ends[to - 1])
                docs += names[at:to]
                sizes.append(n[at:to])
                held.append(ids[start:stop].copy())
                waiting, at = waiting + stop - start, to
                if waiting >= BLOCK_IDS:
                    yield block(part, seq, first, docs, sizes, held, shared.value)
                    seq, first, docs, sizes, held, waiting = seq + 1, first + waiting, [], [], [], 0
        if docs:
            yield block(part, seq, first, docs, sizes, held, shared.value)

    keyed = tokens.where("counts is null").select("id", "ids").withColumn("tie", F.xxhash64("ids"))  # lets a range boundary fall inside one repeated id
    ordered = keyed.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie", "ids").select("id", "ids")
    kind = tokens.schema["id"].dataType.simpleString()
    blocks = written(ordered.mapInArrow(pack, f"part int, seq long, first long, doc_ids array<{kind}>, n array<long>, control binary, data binary"), "tokenfile")
    return blocks, ranks


def block(part: int, seq: int, first: int, docs: list, sizes: list[np.ndarray], held: list[np.ndarray], rank_of: np.ndarray) -> pa.RecordBatch:
    control, data = code(rank_of[np.concatenate(held)])
    kind = pa.int64() if all(d is None or isinstance(d, int) for d in docs) else pa.string()
    return pa.record_batch(
        [pa.array([part], pa.int32()), pa.array([seq], pa.int64()), pa.array([first], pa.int64()), pa.array([docs], pa.list_(kind)), pa.array([np.concatenate(sizes)], pa.list_(pa.int64())), pa.array([control], pa.binary()), pa.array([data], pa.binary())],
        names=["part", "seq", "first", "doc_ids", "n", "control", "data"],
    )


def read_token_file(blocks: DataFrame, ranks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document, from the files: id_col, start, n_tokens, ids_crc32.

    A part's offset is the sum of the sizes of earlier parts: one row a part, as many as shuffle partitions.
    """
    spark = blocks.sparkSession
    sizes = blocks.groupBy("part").agg(F.sum(F.expr("aggregate(n, 0L, (a, x) -> a + x)")).alias("n")).collect()
    offsets, at = {}, 0
    for r in sorted(sizes, key=lambda r: r.part):
        offsets[r.part], at = at, at + r.n
    token_of = np.empty(ranks.count(), np.uint32)
    for r in ranks.collect():
        token_of[r.rank] = r.token
    shared = spark.sparkContext.broadcast((offsets, token_of))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offsets, token_of = shared.value
        for batch in batches:
            for row in range(batch.num_rows):
                part, first, docs, n, control, data = (batch.column(i)[row] for i in range(6))
                n = np.asarray(n.values)
                ids = token_of[uncode(control.as_py(), data.as_py(), int(n.sum()))].astype("<u4", copy=False)
                ends = np.cumsum(n)
                starts = ends - n
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.record_batch([docs.values, pa.array(starts + first.as_py() + offsets[part.as_py()], pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], names=[id_col, "start", "n_tokens", "ids_crc32"])

    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    return blocks.select("part", "first", "doc_ids", "n", "control", "data").mapInArrow(run, f"{id_col} {kind}, start long, n_tokens long, ids_crc32 long")
