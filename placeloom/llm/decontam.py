"""Benchmark decontamination by size-partitioned MinHash containment search (operator 10).

Texts are lower-cased words (runs of letters, digits, marks and underscore) in shingles of five; an item of fewer words
is one shingle of its own length. Containment is the share of an item's distinct shingles that a document
has; a pair at `threshold` (0.8) or more is reported.

Items are partitioned by size (powers of two of their shingle count). An item's MinHash sketch is its k least shingle
hashes, k = floor((1 - threshold) * size) + 1: at the threshold fewer than k shingles are missing, so a contained item always
shows at least one of them, and the search loses nothing, however long the document is. A partition's hash bound is
the largest hash in its items' sketches; the document's sketch for that partition is its hashes up to the bound,
and a document with fewer hashes than the partition's least item needs is not searched. Items met by one sketch hash at
least are verified by exact containment over shingle strings.

A benchmark of at most `BLOCK_BYTES` of text and `BLOCK_ITEMS` items goes to the tasks whole, and documents stay where they are: one
narrow map stage. A larger one is never broadcast. Its sketches are a table of (hash, item); documents give the hashes of their own
sketches that a bitmap of fixed size (`BITMAP_BITS`) lets through, once a distinct text; an equi-join on the hash finds the candidates, and
only candidates' texts are joined with the items' texts for the verification. Documents are read the same few times whatever
the benchmark's size. Documents are keyed by the MD5 of their text there, so copies are searched and verified once.

Cases: null or empty texts, or texts without a word, match nothing. Repeated rows and repeated items each give
their own pairs. Empty tables give no pairs.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, unused, written

SHINGLE, THRESHOLD = 5, 0.8
BLOCK_BYTES, BLOCK_ITEMS = 8 << 20, 20_000
#: Bits of the bitmap of sketch hashes (16 MB), by leading bits of a hash.
BITMAP_BITS = 27
CHUNK = 4 << 20

_WORD = re.compile(r"\w+")
#: Non-ASCII characters that aren't word characters in common text; everything else above ASCII is checked too before the byte path is taken.
_NOT_PLAIN = re.compile("[^\\x00-\\x7f\\xaa\\xb2\\xb3\\xb5\\xb9\\xba\\xbc-\\xbe\\xc0-\\xd6\\xd8-\\xf6\\xf8-ɏ]")
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*b"0123456789_abcdefghijklmnopqrstuvwxyz", *range(128, 256)]] = True

_P = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INVERSE = pow(_P, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _tables:
        _tables.clear()
        _tables[size] = (_powers(_P, size), _powers(_INVERSE, size))
    return _tables[size]


def normal(text: str) -> bytes:
    """Lower-cased words, one space between."""
    return " ".join(_WORD.findall(text.lower())).encode()


def _words(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the lower-cased text, and start and end of its words in them."""
    text = text.lower()
    raw = text.encode() if not _NOT_PLAIN.search(text) else " ".join(_WORD.findall(text)).encode()
    data = np.frombuffer(raw, np.uint8)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = _IS_WORD[data]
    edge = np.diff(inside)
    return data, np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit polynomial hash of every word, in order: differences of one running sum, brought to a common origin."""
    data, starts, ends = _words(text)
    if not len(starts):
        return np.empty(0, np.uint64)
    up, down = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def mix(h: np.ndarray) -> np.ndarray:
    """The SplitMix64 finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * np.uint64(_P) + words[k : k + n]
    return mix(out)


class Partition:
    """Items of one shingle length and one power of two of sizes: their sketches, sorted."""

    def __init__(self, width: int, members: list[tuple[int, np.ndarray]], threshold: float):
        self.width = width
        self.needs = min(int(np.ceil(threshold * len(h) - 1e-9)) for _, h in members)
        hashes, owners = [], []
        for at, h in members:
            k = int(np.floor((1 - threshold) * len(h) + 1e-9)) + 1
            least = np.sort(h)[:k]
            hashes.append(least)
            owners.append(np.full(len(least), at))
        hashes, owners = np.concatenate(hashes), np.concatenate(owners)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.owners = hashes[order], owners[order]
        self.bound = self.hashes[-1]
        self.maybe = np.zeros(1 << 18, bool)  # by leading bits
        self.maybe[(self.hashes >> np.uint64(46)).astype(np.int64)] = True

    def candidates(self, shingles: np.ndarray) -> np.ndarray:
        """Items that share a sketch hash with the document's sketch."""
        if len(shingles) < self.needs:
            return np.empty(0, np.int64)
        sketch = shingles[shingles <= self.bound]
        sketch = sketch[self.maybe[(sketch >> np.uint64(46)).astype(np.int64)]]
        if not len(sketch):
            return np.empty(0, np.int64)
        low = np.searchsorted(self.hashes, sketch, "left")
        high = np.searchsorted(self.hashes, sketch, "right")
        hit = high > low
        return np.unique(np.concatenate([self.owners[a:b] for a, b in zip(low[hit], high[hit], strict=True)])) if hit.any() else np.empty(0, np.int64)


def shingle_strings(words: list[str], size: int) -> set[str]:
    return {" ".join(words[k : k + size]) for k in range(len(words) - size + 1)}


class Index:
    """A block of items: size partitions for the search, shingle strings for the verification."""

    def __init__(self, items: list[tuple[object, str]], shingle: int, threshold: float):
        self.threshold, self.items = threshold, []
        groups: dict[tuple[int, int], list] = defaultdict(list)
        for item_id, text in items:
            words = _WORD.findall((text or "").lower())
            if not words:
                continue
            width = min(shingle, len(words))
            hashes = np.unique(shingle_hashes(word_hashes(text), width))
            groups[width, len(hashes).bit_length()].append((len(self.items), hashes))
            self.items.append((item_id, width, shingle_strings(words, width)))
        self.partitions = [Partition(width, members, threshold) for (width, _), members in sorted(groups.items())]
        self.widths = sorted({p.width for p in self.partitions})

    def search(self, text: str) -> list[tuple[int, int]]:
        """(item, shingles found) of the items whose containment in the text is at the threshold or more."""
        found: set[int] = set()
        for words in self.pieces(text):
            shingles = {w: shingle_hashes(words, w) for w in self.widths}
            for p in self.partitions:
                found.update(p.candidates(shingles[p.width]).tolist())
        if not found:
            return []
        words = _WORD.findall(text.lower())
        have = {w: shingle_strings(words, w) for w in {self.items[i][1] for i in found}}
        out = []
        for i in sorted(found):
            _, width, strings = self.items[i]
            n = len(strings & have[width])
            if n >= self.threshold * len(strings) - 1e-9:
                out.append((i, n))
        return out

    @staticmethod
    def pieces(text: str) -> Iterator[np.ndarray]:
        """Word hashes of the whole text; hashing takes CHUNK characters at a time, words are not cut."""
        if len(text) <= CHUNK:
            yield word_hashes(text)
            return
        parts, at = [], 0
        while at < len(text):
            to = min(len(text), at + CHUNK)
            while to < len(text) and (text[to].isalnum() or text[to] == "_" or not text[to].isascii()):
                to += 1
            parts.append(word_hashes(text[at:to]))
            at = to
        yield np.concatenate(parts)


def one_block(items: DataFrame, item_col: str, text_col: str) -> list[tuple[object, str]] | None:
    """The items with a text if they fit in one block, else None: no more than a block comes to the driver."""
    items = items.select(item_col, text_col).where(F.col(text_col).isNotNull())
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()
    if n > BLOCK_ITEMS or size > BLOCK_BYTES:
        return None
    return [(r[0], r[1]) for r in items.collect()]


def sketch_of(words: np.ndarray, shingle: int, threshold: float) -> tuple[int, np.ndarray, int]:
    """(shingle length, the sketch: least hashes, number of distinct hashes) of an item's word hashes."""
    width = min(shingle, len(words))
    h = np.unique(shingle_hashes(words, width)) if width else np.empty(0, np.uint64)
    return width, h[: int(np.floor((1 - threshold) * len(h) + 1e-9)) + 1], len(h)


def joined(docs: DataFrame, items: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """key, item, n_shingles, n_found of the pairs at the threshold. docs: (key, text), no null text; items: (item, text), item a row number."""
    spark = docs.sparkSession

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            rows = [(i, *sketch_of(word_hashes(t), shingle, threshold)) for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
            n = [len(r[2]) for r in rows]
            hashes = np.concatenate([r[2] for r in rows]) if rows else np.empty(0, np.uint64)
            columns = [np.repeat(np.array([r[k] for r in rows], np.int64), n) for k in (0, 1)]
            classes = np.repeat(np.array([r[3].bit_length() for r in rows], np.int64), n)
            needs = np.repeat(np.array([int(np.ceil(threshold * r[3] - 1e-9)) for r in rows], np.int64), n)
            yield pa.record_batch([*map(pa.array, (*columns, classes, needs)), pa.array(hashes.view(np.int64))], names=["item", "width", "class", "needs", "hash"])

    sketch = written(items.mapInArrow(sketches, "item long, width long, class long, needs long, hash long"), "sketches")
    # the order of unsigned hashes is that of signed ones with the top bit turned
    top = F.expr("hash ^ (-9223372036854775807L - 1L)")
    bounds = [(r.width, r.needs, (r.bound + (1 << 63)) & _MASK) for r in sketch.groupBy("width", "class").agg(F.min("needs").alias("needs"), F.max(top).alias("bound")).collect()]

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: list[np.ndarray] = []
        for batch in batches:
            at.append(np.unique(batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - BITMAP_BITS)))
            if len(at) > 50:
                at = [np.unique(np.concatenate(at))]
        if at:
            yield pa.record_batch([pa.array(np.unique(np.concatenate(at)).astype(np.int32))], names=["at"])

    # 64 bits of the bitmap make a word: at most 2 million rows of 16 bytes, whatever the benchmark's size
    words = sketch.select("hash").mapInArrow(marked, "at int").select(F.shiftright("at", 6).alias("w"), F.expr("shiftleft(1L, at & 63)").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bitmap = np.zeros(1 << (BITMAP_BITS - 6), np.uint64)
    bitmap[words["w"].to_numpy()] = words["b"].to_numpy().view(np.uint64)
    shared = spark.sparkContext.broadcast((bounds, bitmap))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, bitmap = shared.value
        widths = sorted({w for w, _, _ in bounds})
        for part in slices(batches, "text"):
            at, out = [], []
            for i, t in enumerate(part.column(1).to_pylist()):
                words = next(Index.pieces(t))
                found = []
                for width in widths:
                    h = shingle_hashes(words, width)
                    limit = max((b for w, needs, b in bounds if w == width and needs <= len(h)), default=None)
                    if limit is None:
                        continue
                    h = h[h <= np.uint64(limit)]
                    lead = h >> np.uint64(64 - BITMAP_BITS)
                    found.append(h[(bitmap[(lead >> np.uint64(6)).astype(np.int64)] >> (lead & np.uint64(63))) & np.uint64(1) == 1])
                h = np.unique(np.concatenate(found)) if found else np.empty(0, np.uint64)
                at.append(np.full(len(h), i, np.int64))
                out.append(h)
            yield pa.record_batch([part.column(0).take(pa.array(np.concatenate(at))), pa.array(np.concatenate(out).view(np.int64))], names=["key", "hash"])

    hits = docs.mapInArrow(search, "key string, hash long").distinct()
    candidates = written(hits.join(sketch.select("hash", "item"), "hash").select("key", "item").distinct(), "candidates")
    texts = docs.join(candidates.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])
    pairs = candidates.join(items.withColumnRenamed("text", "item_text"), "item").join(texts, "key").select("key", "item", "item_text", "text")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, words, have = None, [], {}
        for part in slices(batches, "text"):
            out = []
            for key, item, item_text, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if key != last:
                    last, words, have = key, _WORD.findall(text.lower()), {}
                own = _WORD.findall(item_text.lower())
                width = min(shingle, len(own))
                if width not in have:
                    have[width] = shingle_strings(words, width)
                want = shingle_strings(own, width)
                n = len(want & have[width])
                if n >= threshold * len(want) - 1e-9:
                    out.append((key, item, len(want), n))
            if out:
                yield pa.record_batch([pa.array(c) for c in zip(*out, strict=True)], names=["key", "item", "n_shingles", "n_found"])

    return written(pairs.sortWithinPartitions("key", "item").mapInArrow(verify, "key string, item long, n_shingles long, n_found long"), "contained")


def numbered(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """item (a row number), item_id, text of the items with a word."""
    rows = items.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("text")).where(F.col(text_col).isNotNull())
    return written(rows.withColumn("item", F.monotonically_increasing_id()), "items")


def text_key(text_col: str):
    return F.md5(F.col(text_col).cast("binary"))


def contaminated(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs id_col, item_col, n_shingles (of the item), n_found, containment."""
    spark = df.sparkSession
    src = df.select(F.col(id_col), F.col(text_col))
    kinds = src.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    schema = f"{id_col} {kinds[0]}, {item_col} {kinds[1]}, n_shingles long, n_found long, containment double"
    block = one_block(items, item_col, item_text_col)
    if block is None:
        rows = numbered(items, item_col, item_text_col)
        docs = src.select(F.col(id_col).alias("id"), text_key(text_col).alias("key"), F.col(text_col).alias("text")).where("text is not null")
        found = joined(docs.select("key", "text"), rows.select("item", "text"), shingle, threshold).join(rows.select("item", "item_id"), "item")
        share = (F.col("n_found").cast("double") / F.col("n_shingles")).alias("containment")
        return docs.select("id", "key").join(found, "key").select(F.col("id").alias(id_col), F.col("item_id").alias(item_col), "n_shingles", "n_found", share)
    shared = spark.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(shared.value, shingle, threshold)
        for part in slices(batches, text_col):
            at, hits = [], []
            for i, t in enumerate(part.column(1).to_pylist()):
                for hit in index.search(t) if t else ():
                    at.append(i)
                    hits.append(hit)
            if at:
                sizes = [len(index.items[i][2]) for i, _ in hits]
                item_ids = pa.array([index.items[i][0] for i, _ in hits])
                yield pa.record_batch(
                    [part.column(0).take(pa.array(at)), item_ids, pa.array(sizes, pa.int64()), pa.array([n for _, n in hits], pa.int64()), pa.array([n / s for (_, n), s in zip(hits, sizes, strict=True)], pa.float64())],
                    names=[id_col, item_col, "n_shingles", "n_found", "containment"],
                )

    return src.mapInArrow(run, schema)


def clean(df: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all their columns, that contain no item.

    Rows whose text is null, empty or without a word stay, as do all rows where no item has a word; repeated rows stay or go together;
    empty in, empty out.
    """
    spark = df.sparkSession
    at_text = df.columns.index(text_col)
    block = one_block(items, item_col, item_text_col)
    if block is None:
        docs = df.select(text_key(text_col).alias("key"), F.col(text_col).alias("text")).where("text is not null")
        found = joined(docs, numbered(items, item_col, item_text_col).select("item", "text"), shingle, threshold)
        key = unused(df, "_placeloom_key")
        return df.join(found.select(F.col("key").alias(key)).distinct(), text_key(text_col) == F.col(key), "left_anti")
    shared = spark.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(shared.value, shingle, threshold)
        for part in slices(batches, text_col):
            yield part.filter(pa.array([not (t and index.search(t)) for t in part.column(at_text).to_pylist()], pa.bool_()))

    return df.mapInArrow(run, df.schema)
