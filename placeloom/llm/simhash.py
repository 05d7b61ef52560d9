"""SimHash near-duplicates by deletion-variant signatures (operator 7).

Fingerprint: ASCII-lower-cased words (runs without ASCII white space), 3-word shingles with repeats
(fewer words: the whole sequence), XXH64 with seed 42 of each; a bit is 1 where more than half of the
hashes have it. No word: fingerprint 0, which links like any other. Two fingerprints link at `bits`
(3) or fewer differing bits.

Search: 64 bits are cut into two segments of 32, fewer than the four that exact segment matching would need:
of three differing bits one segment holds at most one. Each distinct fingerprint is indexed under its 2 x 32
one-wildcard segment variants; fingerprints that link meet under one of these keys. Distinct fingerprints are
shuffled by key and sorted; a bucket streams through a task, which verifies distances and keeps a spanning forest
of its links, never the pairs. A bucket over `BUCKET` members isn't compared there: its members go on, keyed by
one-wildcard variants of halves of the other segment as well, then of the quarters, which fixes 53 of 64 bits and so
bounds a bucket by 2,048 fingerprints. No bucket is capped: every link is found.

Work is per distinct fingerprint; copies meet only in partial minima. Component ids come from
large-star/small-star rounds over the forests' edges.

Three bits of 64 are a narrow reading: they find few pairs of a Jaccard similarity near 0.8. `similar_groups` therefore searches by the same
signatures over wider fingerprints: 96 bits over a text's distinct five-word shingles, six segments of 16 bits, 96 one-wildcard
variants, at most `RADIUS` differing bits, and set sizes that allow the similarity. What is found are candidates; a link is a pair whose exact Jaccard
similarity of shingle sets is `SIMILARITY` (0.8) or more. Texts of equal shingle sets are one candidate. Of a bucket's candidates star forests at
half the radius and at the radius (there only links between groups) go on, not the pairs. Each text is verified against its nearest candidate first; then only
candidates between groups that are still apart are. What is then left in buckets that gave stars in place of pairs, between groups that are apart, makes no
row a pair: sketches rule pairs out, a spanning forest of the others gives groups, and a group's sets meet in tasks, which return links that join.
Every candidate is verified, ruled out or its texts are in one group. A bucket over `BUCKET` members is first keyed by a second segment as well, which
joins most of it cheaply; then its blocks meet block by block, so no pair of it is lost. The chance that a pair at 0.8 shares a variant is 0.86, at 0.85 0.93, at 0.9 0.98 (a segment
differs by at most one bit; bits differ with probability acos(2J / (1 + J)) / pi), and 0.9, 0.98, over 0.99 that it lies within the radius.

Cases: null text = empty text. A null id gets its fingerprint's component like any row; where a fingerprint has no
id at all, it takes no part in linking and its component is null. Repeated rows repeat. Empty in, empty out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, unused, written
from .components import components
from .decontam import mix

SEED, SHINGLE, BITS = 42, 3, 3
#: The reading of similar_groups: words a shingle, least similarity, differing bits of 96, segments of 16 bits.
WORDS, SIMILARITY, RADIUS, SEGMENTS = 5, 0.8, 19, 6
#: Buckets up to this size are compared all at once.
SMALL = 64
#: Distinct fingerprints compared within one task; larger buckets are keyed further.
BUCKET = 1 << 16
#: Shingles compared within one task; larger groups meet block by block.
BLOCK = 1 << 19
#: Bits of a sketch.
CELLS = 1 << 10
CHUNK = 1 << 20


def word_lists(raw: bytes) -> Iterator[list[bytes]]:
    """Words of a text, a piece of about CHUNK bytes at a time."""
    at = 0
    while at < len(raw):
        to = at + CHUNK
        if to < len(raw):
            cut = max(raw.rfind(c, at, to) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            while cut <= at and to < len(raw):  # one word fills the piece
                to += CHUNK
                cut = max(raw.rfind(c, at, to) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            to = cut if cut > at else len(raw)
        yield raw[at:to].split()
        at = to


def fingerprint(text: str | None, shingle: int = SHINGLE) -> bytes:
    """The fingerprint's 8 bytes, most significant first."""
    digest = xxhash.xxh64_digest
    ones, total, kept = np.zeros(64, np.int64), 0, []
    for words in word_lists((text or "").encode().lower()):
        words = kept + words
        hashes = [digest(b" ".join(s), SEED) for s in zip(*(words[k:] for k in range(shingle)), strict=False)] if shingle != 3 else [digest(b"%b %b %b" % s, SEED) for s in zip(words, words[1:], words[2:], strict=False)]
        if hashes:
            bits = np.unpackbits(np.frombuffer(b"".join(hashes), np.uint8).reshape(-1, 8), axis=1)
            ones += bits.sum(0, dtype=np.int64)
            total += len(hashes)
        kept = words[len(words) - min(len(words), shingle - 1) :]
    if total == 0:
        if not kept:
            return bytes(8)
        return digest(b" ".join(kept), SEED)
    return np.packbits(ones * 2 > total).tobytes()


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Per row: id, fp (the fingerprint as a signed long)."""
    src = df.select(id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            raw = b"".join(fingerprint(t, shingle) for t in part.column(1).to_pylist())
            yield pa.record_batch([part.column(0), pa.array(np.frombuffer(raw, ">i8").astype(np.int64))], names=["id", "fp"])

    return src.mapInArrow(run, f"id {src.schema[id_col].dataType.simpleString()}, fp long")


def forest(fps: np.ndarray, bits: int, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of a spanning forest of the links among distinct fingerprints; with `side`, of links between sides only."""
    left, a, b = np.arange(len(fps)), [], []
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            at = todo.pop()
            near = np.bitwise_count(fps[left] ^ fps[at]) <= bits
            if side is not None:
                near &= side[left] != side[at]
            if near.any():
                hit = left[near]
                left = left[~near]
                a.append(np.full(len(hit), at))
                b.append(hit)
                todo.extend(hit.tolist())
    return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, np.int64), np.empty(0, np.int64))


def sides(k1: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(value of each key's wildcard bit, whether only links across it are sought).

    Fingerprints that agree in the whole segment meet under all its wildcards; they are linked under wildcard 0 alone.
    """
    at = (k1 >> 32).astype(np.uint64)
    return ((fp >> at) & np.uint64(1)).astype(bool), (at & np.uint64(31)) != 0


def _links(bits: int, bucket: int | None):
    """Over rows (k1, k2, fp, rep) sorted by key: links as (null, null, rep, rep), members of large buckets as they came."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []  # rows of the last key, which may go on
        passing = False  # the last key is over the bucket limit: its rows stream out

        def solve(k1, k2, fp, rep):
            """Whole buckets only."""
            starts = np.flatnonzero(np.concatenate([[True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])]))
            ends = np.append(starts[1:], len(k1))
            a, b, over = [], [], np.zeros(len(k1), bool)
            side, across = sides(k1, fp)
            first = starts[ends - starts == 2]
            first = first[~across[first] | (side[first] != side[first + 1])]
            near = first[np.bitwise_count(fp[first] ^ fp[first + 1]) <= bits]
            a.append(rep[near])
            b.append(rep[near + 1])
            for s, e in zip(starts[ends - starts > 2].tolist(), ends[ends - starts > 2].tolist(), strict=True):
                if bucket is not None and e - s > bucket:
                    over[s:e] = True
                    continue
                if across[s] and (side[s:e] == side[s]).all():
                    continue
                i, j = forest(fp[s:e], bits, side[s:e] if across[s] else None)
                a.append(rep[s:e][i])
                b.append(rep[s:e][j])
            return np.concatenate(a), np.concatenate(b), over

        def out(a, b, k1, k2, fp, rep):
            n = len(a)
            none = np.zeros(n, np.int64)
            mask = np.concatenate([np.ones(n, bool), np.zeros(len(k1), bool)])
            return pa.record_batch(
                [pa.array(np.concatenate([none, k1]), mask=mask), pa.array(np.concatenate([none, k2]), mask=mask), pa.array(np.concatenate([a, fp.view(np.int64)])), pa.array(np.concatenate([b, rep]))],
                names=["k1", "k2", "x", "y"],
            )

        nothing = np.empty(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            new = tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            cols = tuple(np.concatenate([*(h[i] for h in held), new[i]]) for i in range(4)) if held else new
            k1, k2 = cols[0], cols[1]
            last = int(np.flatnonzero((k1 != k1[-1]) | (k2 != k2[-1]))[-1]) + 1 if ((k1 != k1[-1]) | (k2 != k2[-1])).any() else 0
            head = 0
            if passing:  # rows that still belong to the large bucket
                same = (k1 == k1[0]) & (k2 == k2[0]) & (k1 == passing_key[0]) & (k2 == passing_key[1])
                head = int(same.sum())
                if head:
                    yield out(nothing, nothing, k1[:head], k2[:head], cols[2][:head].view(np.uint64), cols[3][:head])
                if head < len(k1):
                    passing = False
                last = max(last, head)
            if last > head:
                part = [c[head:last] for c in cols]
                fp = part[2].view(np.uint64)
                a, b, over = solve(part[0], part[1], fp, part[3])
                if len(a) or over.any():
                    yield out(a, b, part[0][over], part[1][over], fp[over], part[3][over])
            held = [] if passing else [tuple(c[last:] for c in cols)]
            if held and bucket is not None and len(held[0][0]) > bucket:
                k1, k2, fp, rep = held[0]
                passing, passing_key, held = True, (k1[0], k2[0]), []
                yield out(nothing, nothing, k1, k2, fp.view(np.uint64), rep)
        if held and len(held[0][0]):
            k1, k2, fp, rep = held[0]
            fp = fp.view(np.uint64)
            a, b, over = solve(k1, k2, fp, rep)
            if len(a) or over.any():
                yield out(a, b, k1[over], k2[over], fp[over], rep[over])

    return run


def _variants(df: DataFrame, source: str, width: int, parts: int, tag) -> DataFrame:
    """One row for each of `parts` segments of `width` bits of `source` and each wildcard bit: column `variant`."""
    n = F.explode(F.sequence(F.lit(0), F.lit(parts * width - 1))).alias("n")
    df = df.select("*", n)
    segment = F.expr(f"shiftrightunsigned({source}, cast((n div {width}) * {width} as int)) & {(1 << width) - 1}L")
    wild = F.expr(f"~shiftleft(1L, cast(n % {width} as int))")
    return df.withColumn("variant", tag(segment.bitwiseAND(wild), F.col("n").cast("long"))).drop("n")


def links(distinct: DataFrame, bits: int = BITS, bucket: int = BUCKET) -> DataFrame:
    """Links (u, v) among representatives that connect just what links at `bits` or fewer connect. distinct: (fp, rep), rep not null."""
    if bits > 3:
        raise ValueError("two segments with one wildcard bit find up to three differing bits")
    schema = "k1 long, k2 long, x long, y long"

    def level(keyed: DataFrame, limit: int | None, name: str) -> DataFrame:
        keyed = keyed.select("k1", "k2", "fp", "rep").repartition("k1", "k2").sortWithinPartitions("k1", "k2", "rep")
        return written(keyed.mapInArrow(_links(bits, limit), schema), name)

    def tagged(bits_below: int):
        return lambda value, n: value + n * F.lit(1 << bits_below)

    one = level(_variants(distinct, "fp", 32, 2, tagged(32)).select(F.col("variant").alias("k1"), F.lit(0).cast("long").alias("k2"), "fp", "rep"), bucket, "links1")
    found = [one.where("k1 is null")]
    large = one.where("k1 is not null").select("k1", F.col("x").alias("fp"), F.col("y").alias("rep"))
    if not large.isEmpty():
        # k1 >> 32 = segment * 32 + wildcard, segment 0 being the low half: the other half is cut in two
        other = F.expr("case when shiftright(k1, 37) = 0 then shiftrightunsigned(fp, 32) else fp & 4294967295L end")
        two = level(_variants(large.withColumn("other", other), "other", 16, 2, tagged(16)).select("k1", F.col("variant").alias("k2"), "fp", "rep"), bucket, "links2")
        found.append(two.where("k1 is null"))
        large = two.where("k1 is not null").select("k1", "k2", F.col("x").alias("fp"), F.col("y").alias("rep"))
        if not large.isEmpty():
            # k2 >> 16 = half * 16 + wildcard: the other half of the other segment is cut in two quarters
            other = F.expr("case when shiftright(k1, 37) = 0 then shiftrightunsigned(fp, 32) else fp & 4294967295L end")
            half = F.expr("case when shiftright(k2, 20) = 0 then shiftrightunsigned(other, 16) else other & 65535L end")
            three = _variants(large.withColumn("other", other).withColumn("half", half), "half", 8, 2, tagged(8))
            three = level(three.select("k1", (F.col("k2") + F.col("variant") * F.lit(1 << 24)).alias("k2"), "fp", "rep"), None, "links3")
            found.append(three.where("k1 is null"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.select(F.col("x").alias("u"), F.col("y").alias("v")).distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, shingle: int = SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """Per row: id_col, fingerprint (16 hex digits), component_id (least id reachable over links)."""
    prints = written(fingerprints(df, id_col, text_col, shingle), "fingerprints")
    distinct = written(prints.groupBy("fp").agg(F.min("id").alias("rep")), "distinct")
    roots = components(links(distinct.where("rep is not null"), bits, bucket))
    labels = distinct.join(roots, distinct.rep == roots.node, "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    return prints.join(labels, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def shingle_set(text: str | None, shingle: int = WORDS) -> np.ndarray:
    """Sorted distinct XXH64 of a text's shingles (fewer words: the whole sequence; none: no element)."""
    digest = xxhash.xxh64_intdigest
    parts, kept = [], []
    for words in word_lists((text or "").encode().lower()):
        words = kept + words
        if len(words) >= shingle:
            parts.append(np.unique(np.fromiter((digest(b" ".join(s), SEED) for s in zip(*(words[k:] for k in range(shingle)), strict=False)), np.uint64, len(words) - shingle + 1)))
        kept = words[len(words) - min(len(words), shingle - 1) :]
    if not parts:
        return np.array([digest(b" ".join(kept), SEED)] if kept else [], np.uint64)
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


def wide_print(hashes: np.ndarray) -> tuple[int, int]:
    """The 96 bits of a shingle set as a signed 64-bit and a signed 32-bit number."""
    if not len(hashes):
        return 0, 0
    raw = np.empty((len(hashes), 12), np.uint8)
    raw[:, :8] = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    raw[:, 8:] = (mix(hashes ^ np.uint64(SEED)) >> np.uint64(32)).astype(">u4").view(np.uint8).reshape(-1, 4)
    ones = np.zeros(96, np.int64)
    for at in range(0, len(raw), 1 << 15):  # 3 MB of bits at a time
        ones += np.unpackbits(raw[at : at + (1 << 15)], axis=1).sum(0, dtype=np.int64)
    packed = np.packbits(ones * 2 > len(hashes)).tobytes()
    return int.from_bytes(packed[:8], "big", signed=True), int.from_bytes(packed[8:], "big", signed=True)


def sketch(hashes: np.ndarray) -> bytes:
    """`CELLS` bits: whether a cell holds an odd number of a shingle set's hashes. Each element that only one of two sets has changes one bit, so
    sketches differ in no more bits than sets in elements."""
    return np.packbits(np.bincount((hashes & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS) & 1).tobytes()


def sketched(texts: DataFrame, shingle: int) -> DataFrame:
    """id, set (the shingle set's bytes), sketch of texts (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            sets = [shingle_set(t, shingle) for t in part.column(1).to_pylist()]
            yield pa.record_batch([part.column(0), pa.array([h.tobytes() for h in sets], pa.binary()), pa.array([sketch(h) for h in sets], pa.binary())], names=["id", "set", "sketch"])

    return texts.select("id", "text").mapInArrow(run, "id long, set binary, sketch binary")


def wide_prints(df: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """Per row: id, key (equal for equal shingle sets), hi, lo (the fingerprint), n (size of the set)."""
    src = df.select(id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            sets = [shingle_set(t, shingle) for t in part.column(1).to_pylist()]
            prints = [wide_print(h) for h in sets]
            yield pa.record_batch(
                [part.column(0), pa.array([hashlib.blake2b(h.tobytes(), digest_size=16).digest() for h in sets], pa.binary()), pa.array([a for a, _ in prints], pa.int64()), pa.array([b for _, b in prints], pa.int32()), pa.array([len(h) for h in sets], pa.int32())],
                names=["id", "key", "hi", "lo", "n"],
            )

    return src.mapInArrow(run, f"id {src.schema[id_col].dataType.simpleString()}, key binary, hi long, lo int, n int")


class Bucket:
    """Members of buckets, sorted by key: fingerprints, set sizes, representatives and the side of the wildcard bit.

    With `root`, only members of different roots are candidates, and those of part 1 or 2 only with the other part's; with `sketch`, only
    those whose sketches allow the similarity."""

    def __init__(self, columns: list[np.ndarray], similarity: float, root: np.ndarray | None = None, part: np.ndarray | None = None, sketch: np.ndarray | None = None):
        self.key, self.hi, self.lo, self.n, self.rep = columns
        self.root, self.part = root, part
        self.sketch = None if sketch is None else np.frombuffer(b"".join(sketch), np.uint64).reshape(len(sketch), -1)
        self.hi, self.lo, self.similarity = self.hi.view(np.uint64), self.lo.view(np.uint32), similarity
        # the last variant of a key: its low 16 bits are the segment's value, above them are segment * 16 + wildcard
        variant = (self.key >> 16) & 0x7F
        segment, wild = variant >> 4, (variant & 15).astype(np.uint64)
        value = np.where(segment < 4, self.hi >> (segment.astype(np.uint64) * np.uint64(16) & np.uint64(63)), self.lo.astype(np.uint64) >> ((segment.astype(np.uint64) & np.uint64(1)) * np.uint64(16)))
        self.side, self.across = (value >> wild & np.uint64(1)).astype(bool), wild != 0

    def distance(self, i, j) -> np.ndarray:
        return np.bitwise_count(self.hi[i] ^ self.hi[j]).astype(np.int32) + np.bitwise_count(self.lo[i] ^ self.lo[j])

    def close(self, i, j, radius: int) -> np.ndarray:
        """Whether members are candidates: texts that agree in the whole segment are compared under wildcard 0 alone."""
        sizes = np.minimum(self.n[i], self.n[j]) >= self.similarity * np.maximum(self.n[i], self.n[j]) - 1e-9
        near = sizes & (self.distance(i, j) <= radius) & (~self.across[j] | (self.side[i] != self.side[j]))
        if self.root is not None:
            near &= (self.root[i] != self.root[j]) & ((self.part[j] == 0) | (self.part[i] != self.part[j]))
        if self.sketch is not None:
            k = np.flatnonzero(near)
            i, j = np.broadcast_to(i, j.shape)[k], j[k]
            most = (1 - self.similarity) / (1 + self.similarity) * (self.n[i] + self.n[j]) + 1e-6
            near[k] = np.bitwise_count(self.sketch[i] ^ self.sketch[j]).sum(1, dtype=np.int64) <= most
        return near

    def forest(self, a: int, b: int, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Stars over members a to b: index arrays of links."""
        left, out = np.arange(a, b), []
        while len(left) > 1:
            todo, left = [left[0]], left[1:]
            while todo and len(left):
                at = todo.pop()
                near = self.close(at, left, radius)
                if near.any():
                    hit, left = left[near], left[~near]
                    out.append((np.full(len(hit), at), hit))
                    todo.extend(hit.tolist())
        return out

    def links(self, *radii: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index arrays of candidates, and whether stars (at each radius, a wider one's only between groups) stand for a member's pairs (at the last)."""
        radius = radii[-1]
        starts = np.flatnonzero(np.concatenate([[True], self.key[1:] != self.key[:-1]]))
        sizes = np.diff(np.append(starts, len(self.key)))
        size = np.repeat(sizes, sizes)
        ends = np.repeat(starts + sizes, sizes)
        found = []
        at = np.flatnonzero(size <= SMALL)
        for step in range(1, int(min(SMALL, sizes.max(initial=0)))):
            at = at[at + step < ends[at]]
            if not len(at):
                break
            near = at[self.close(at, at + step, radius)]
            found.append((near, near + step))
        i, j = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 2
        # buckets with more links than members, and large ones: forests in place of pairs
        bucket = np.repeat(np.arange(len(starts)), sizes)
        dense = (np.bincount(bucket[i], minlength=len(starts)) > sizes) | (sizes > SMALL)
        out = [(i[~dense[bucket[i]]], j[~dense[bucket[i]]])]
        for k in np.flatnonzero(dense).tolist():
            a, b = int(starts[k]), int(starts[k] + sizes[k])
            if self.across[a] and (self.side[a:b] == self.side[a]).all():
                dense[k] = False  # no candidate is sought here
                continue
            stars = [self.forest(a, b, r) for r in radii]
            out += stars[0]
            if len(radii) > 1:  # of the wider stars only links between groups that are still apart
                top = np.arange(b - a)
                for at, hit in stars[0]:
                    top[hit - a] = top[at[0] - a]  # a forest's stars come from its roots on
                for at, hit in stars[1]:
                    joined, first = np.unique(top[hit - a], return_index=True)
                    fresh = first[joined != top[at[0] - a]]
                    if len(fresh):
                        out.append((at[fresh], hit[fresh]))
                        top[np.isin(top, joined)] = top[at[0] - a]
        i, j = (np.concatenate(c) for c in zip(*out, strict=True))
        linked = np.zeros(len(self.key), bool)  # other members have no candidate in their bucket
        linked[i] = linked[j] = True
        return i, j, np.repeat(dense, sizes) & linked


def whole_buckets(batches: Iterator[pa.RecordBatch], limit: int | None) -> Iterator[tuple[bool, list[np.ndarray]]]:
    """(over, columns) of batches sorted by the first column: whole buckets, or rows of a bucket over the limit."""
    held, over = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            columns = [np.concatenate(c) for c in zip(held, columns, strict=True)]
        if over is not None:
            head = int(np.searchsorted(columns[0], over, "right"))
            if head:
                yield True, [c[:head] for c in columns]
            columns = [c[head:] for c in columns]
            if not len(columns[0]):
                continue
            over = None
        last = int(np.searchsorted(columns[0], columns[0][-1], "left"))
        if last:
            yield False, [c[:last] for c in columns]
        held = [c[last:] for c in columns]
        if limit is not None and len(held[0]) > limit:
            yield True, held
            held, over = None, columns[0][-1]
    if held is not None:
        yield False, held


def wide_candidates(distinct: DataFrame, similarity: float, radius: int, bucket: int) -> tuple[DataFrame, DataFrame]:
    """(u, v, d: candidates u < v at d differing bits; key, hi, lo, n, rep, over: members of buckets whose candidates are not all among
    them, either because stars stand for pairs or, if over, because of the bucket's size). distinct: (hi, lo, n, rep)."""

    def search(limit: int | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for over, columns in whole_buckets(batches, limit):
                if over:
                    none = pa.nulls(len(columns[0]), pa.int64())
                    yield pa.record_batch([none, none, pa.nulls(len(columns[0]), pa.int32()), *map(pa.array, columns)], names=names)
                    continue
                members = Bucket(columns, similarity)
                i, j, dense = members.links(radius // 2, radius)
                if limit is not None and dense.any():
                    none = pa.nulls(int(dense.sum()), pa.int64())
                    yield pa.record_batch([none, none, pa.array(np.zeros(len(none), np.int32)), *(pa.array(c[dense]) for c in columns)], names=names)
                if len(i):
                    u, v = members.rep[i], members.rep[j]
                    rest = [pa.nulls(len(i), t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())]
                    yield pa.record_batch([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v)), pa.array(members.distance(i, j).astype(np.int32)), *rest], names=names)

        return run

    names = ["u", "v", "d", "key", "hi", "lo", "n", "rep"]
    schema = "u long, v long, d int, key long, hi long, lo int, n int, rep long"

    def keyed(df: DataFrame, above: Column, but: Column | None = None) -> DataFrame:
        """One row for each segment and wildcard bit, but for one segment; `above` goes into the key's upper bits."""
        df = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(SEGMENTS * 16 - 1))).alias("variant"))
        if but is not None:
            df = df.where(F.floor(F.col("variant") / 16) != but)
        segment = F.expr("case when variant < 64 then shiftrightunsigned(hi, cast(variant div 16 as int) * 16) else shiftrightunsigned(cast(lo as long), (cast(variant div 16 as int) - 4) * 16) end & 65535L")
        value = segment.bitwiseAND(F.expr("~shiftleft(1L, variant % 16)"))
        df = df.withColumn("key", above + F.col("variant") * F.lit(1 << 16) + value)
        return df.select("key", "hi", "lo", "n", "rep").repartition("key").sortWithinPartitions("key", "rep")

    one = written(keyed(distinct.select("hi", "lo", "n", "rep"), F.lit(0).cast("long")).mapInArrow(search(bucket), schema), "similar1")
    found = one.where("key is null")
    members = one.where("key is not null").select("key", "hi", "lo", "n", "rep", F.col("d").isNull().alias("over"))
    large = members.where("over")
    if not large.isEmpty():
        two = keyed(large.select(F.col("key").alias("first"), "hi", "lo", "n", "rep"), F.col("first") * F.lit(1 << 24), F.expr("shiftright(first, 20)"))
        found = found.unionByName(written(two.mapInArrow(search(None), schema), "similar2"))
    return found.groupBy("u", "v").agg(F.min("d").alias("d")), members


def mixed_members(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of buckets of more than one root, with their root and the bucket's size."""
    members = written(members.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").withColumn("root", F.coalesce("root", "rep")), "similar-members")
    mixed = members.groupBy("key").agg(F.count("*").alias("size"), F.min("root").alias("least"), F.max("root").alias("most")).where("least != most")
    return written(members.join(mixed.select("key", "size"), "key").select("key", "hi", "lo", "n", "rep", "root", "size"), "similar-mixed")


def apart_candidates(members: DataFrame, roots: DataFrame, similarity: float, radius: int, bucket: int) -> DataFrame:
    """`mixed_candidates` of all members."""
    return mixed_candidates(mixed_members(members, roots), similarity, radius, bucket)


def mixed_candidates(members: DataFrame, similarity: float, radius: int, bucket: int, done: DataFrame | None = None, sketches: DataFrame | None = None) -> DataFrame:
    """u, v: candidates u < v of the buckets of `mixed_members` whose texts have different roots; of a bucket with more of them than members a
    spanning forest, so that components hold the ends of all. Pairs in `done` are left out where they aren't of a forest, pairs whose sketches
    (id, sketch) rule the similarity out everywhere. A bucket over the limit is cut in blocks by hash, and each two blocks meet in a task."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, columns in whole_buckets(batches, None):
            rows = Bucket(columns[:5], similarity, *columns[5:])
            i, j, dense = rows.links(radius)
            if len(i):
                u, v = rows.rep[i], rows.rep[j]
                yield pa.record_batch([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v)), pa.array(dense[i])], names=["u", "v", "star"])

    columns = ["key", "hi", "lo", "n", "rep", "root"]
    # about half a bucket a block; most buckets are one
    blocks = F.when(F.col("size") > bucket, F.ceil(F.col("size") / max(1, bucket // 2)).cast("long")).otherwise(1)
    rows = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    tile = F.greatest("block", "other") * F.lit(1 << 16) + F.least("block", "other") + F.when(F.col("blocks") > 1, 1).otherwise(0)
    part = F.when(F.col("block") == F.col("other"), 0).when(F.col("block") > F.col("other"), 1).otherwise(2)
    rows = rows.select((F.col("key") + tile * F.lit(1 << 24)).alias("key"), *columns[1:], part.alias("part"))
    if sketches is not None:  # members without a text have no candidate
        rows = rows.join(sketches.select(F.col("id").alias("rep"), "sketch"), "rep").select("key", *columns[1:], "part", "sketch")
    found = rows.repartition("key").sortWithinPartitions("key", "rep").mapInArrow(search, "u long, v long, star boolean")
    found = found.groupBy("u", "v").agg(F.max("star").alias("star"))
    if done is not None:
        found = found.join(done.select("u", "v", F.lit(True).alias("done")), ["u", "v"], "left").where(F.col("star") | F.col("done").isNull())
    return found.select("u", "v")


def joining(sets: list[np.ndarray], root: np.ndarray, part: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Index arrays of pairs at the similarity that join the roots just as all such pairs do. Members of part 1 or 2 meet the other part's alone.

    Each set that isn't of the most frequent root is looked up by its rarest elements, so many that a similar set has one of them at least."""
    n = np.array([len(s) for s in sets])
    elements, at = np.concatenate(sets), np.concatenate([[0], np.cumsum(n)])
    order = np.argsort(elements, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], elements[order][1:] != elements[order][:-1]]))
    holders = np.diff(np.append(starts, len(order)))
    element = np.empty(len(order), np.int64)
    element[order] = np.repeat(np.arange(len(starts)), holders)
    owner = np.repeat(np.arange(len(sets)), n)[order]

    def shared(ids: np.ndarray) -> np.ndarray:
        """How many of the elements each set has."""
        k = holders[ids]
        return np.bincount(owner[np.repeat(starts[ids] - (np.cumsum(k) - k), k) + np.arange(k.sum())], minlength=len(sets))

    root, a, b = root.copy(), [], []
    values, count = np.unique(root, return_counts=True)
    for i in np.flatnonzero(root != values[count.argmax()]).tolist():
        met = (root != root[i]) & ((part == 0) | (part != part[i]))
        ids = element[at[i] : at[i + 1]]
        rare = ids[np.argsort(holders[ids], kind="stable")][: n[i] - int(np.ceil(similarity * n[i] - 1e-9)) + 1]
        if not (met & (shared(rare) > 0)).any():
            continue
        both = shared(ids)
        hit = np.flatnonzero(met & (both >= similarity * (n[i] + n - both) - 1e-9))
        if len(hit):
            joined, first = np.unique(root[hit], return_index=True)
            a += [i] * len(first)
            b += hit[first].tolist()
            root[np.isin(root, joined)] = root[i]
    return np.array(a, np.int64), np.array(b, np.int64)


def joining_links(groups: DataFrame, sets: DataFrame, similarity: float, block: int) -> DataFrame:
    """Links u < v that join the roots within each group as all its pairs at the similarity do: at most a row for each root and two blocks.
    groups: (id, group, root); sets: (id, set). A group of over `block` shingles is cut in blocks by hash, and each two blocks meet in a task."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(columns):
            group, tile, ids, root, part, raw = columns
            ends = np.append(np.flatnonzero((group[1:] != group[:-1]) | (tile[1:] != tile[:-1])) + 1, len(group)).tolist()
            u, v = [], []
            for s, e in zip([0, *ends], ends, strict=False):
                i, j = joining([np.frombuffer(r, np.uint64) for r in raw[s:e]], root[s:e], part[s:e], similarity)
                u.append(ids[s:e][i])
                v.append(ids[s:e][j])
            u, v = np.concatenate(u), np.concatenate(v)
            return pa.record_batch([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["u", "v"])

        held = None
        for batch in batches:
            for piece in slices(iter([batch]), "set"):
                columns = [c.to_numpy(zero_copy_only=False) for c in piece.columns]
                if held is not None:
                    columns = [np.concatenate(c) for c in zip(held, columns, strict=True)]
                ended = np.flatnonzero((columns[0] != columns[0][-1]) | (columns[1] != columns[1][-1]))
                last = int(ended[-1]) + 1 if len(ended) else 0
                if last:
                    yield solve([c[:last] for c in columns])
                held = [c[last:] for c in columns]
        if held is not None:
            yield solve(held)

    rows = written(groups.select("id", "group", "root").join(sets.select("id", "set").hint("merge"), "id"), "similar-groups")
    size = rows.groupBy("group").agg(F.sum(F.octet_length("set") / 8).alias("size")).where(F.col("size") > block)
    # about half the limit a block; most groups are one tile
    rows = rows.join(size.select("group", F.ceil(F.col("size") / max(1, block // 2)).cast("long").alias("blocks")), "group", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    tile = F.greatest("block", "other") * F.lit(1 << 31) + F.least("block", "other")
    part = F.when(F.col("block") == F.col("other"), 0).when(F.col("block") > F.col("other"), 1).otherwise(2)
    rows = rows.select("group", tile.alias("tile"), "id", "root", part.alias("part"), "set")
    return written(rows.repartition("group", "tile").sortWithinPartitions("group", "tile").mapInArrow(search, "u long, v long"), "similar-links")


def ends(pairs: DataFrame) -> DataFrame:
    """The distinct ids of pairs."""
    return pairs.select(F.col("u").alias("id")).distinct().unionByName(pairs.select(F.col("v").alias("id")).distinct()).distinct()


def verified(pairs: DataFrame, texts: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """The pairs (u, v) whose texts' shingle sets have the similarity. texts: (id, text)."""
    both = pairs.select("u", "v").join(texts.select(F.col("id").alias("u"), F.col("text").alias("a")).hint("merge"), "u").join(texts.select(F.col("id").alias("v"), F.col("text").alias("b")).hint("merge"), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, mine = None, None
        for batch in batches:
            for part in slices(iter([batch]), "b"):
                keep = []
                for u, a, b in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    if u != last:
                        last, mine = u, shingle_set(a, shingle)
                    other = shingle_set(b, shingle)
                    shared = len(np.intersect1d(mine, other, assume_unique=True))
                    keep.append(shared >= similarity * (len(mine) + len(other) - shared) - 1e-9)
                yield part.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return written(both.select("u", "v", "a", "b").mapInArrow(run, "u long, v long"), "similar-links")


def similar_candidates(df: DataFrame, id_col: str, text_col: str, similarity: float, shingle: int, radius: int, bucket: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(distinct shingle sets: key, rep; candidates: u, v, d; members of buckets with further candidates, as in wide_candidates)."""
    prints = written(wide_prints(df, id_col, text_col, shingle), "similar-prints")
    distinct = written(prints.groupBy("key", "hi", "lo", "n").agg(F.min("id").alias("rep")), "similar-sets")
    least = int(np.ceil(similarity / (1 - similarity) - 1e-9)) if similarity < 1 else 1 << 30  # smaller sets are similar only if equal
    candidates, members = wide_candidates(distinct.where(F.col("n") >= least), similarity, radius, bucket)
    return distinct, written(candidates, "similar-candidates"), members


def tested(candidates: DataFrame, members: DataFrame) -> DataFrame:
    """id of all texts that may have to be verified: stars reach all members with a candidate, but for those of buckets over the limit."""
    return ends(candidates).unionByName(members.where("over").select(F.col("rep").alias("id")).distinct()).distinct()


def similar_roots(candidates: DataFrame, members: DataFrame, texts: DataFrame, similarity: float, shingle: int, radius: int, bucket: int) -> DataFrame:
    """(node, root) over the candidates that are links; texts: (id, text) of those in `tested` at least."""
    nearest = written(candidates.groupBy("v").agg(F.min(F.struct("d", "u")).alias("near")).select(F.col("near.u").alias("u"), "v"), "similar-nearest")
    links_ = verified(nearest, texts, similarity, shingle)
    roots = components(links_)
    # candidates between groups that are still apart
    apart = candidates.join(roots.select(F.col("node").alias("u"), F.col("root").alias("ru")), "u", "left").join(roots.select(F.col("node").alias("v"), F.col("root").alias("rv")), "v", "left")
    apart = written(apart.where(F.coalesce("ru", "u") != F.coalesce("rv", "v")).select("u", "v").join(nearest, ["u", "v"], "left_anti"), "similar-apart")
    if not apart.isEmpty():
        links_ = links_.unionByName(verified(apart, texts, similarity, shingle))
        roots = components(links_)
    # what remains are candidates of dense and large buckets: groups that hold the ends of them, compared as sets
    members = mixed_members(members, roots)
    if members.isEmpty():
        return roots
    sets = written(sketched(texts.join(members.select(F.col("rep").alias("id")).distinct(), "id", "left_semi"), shingle), "similar-shingles")
    rest = components(mixed_candidates(members, similarity, radius, bucket, nearest.unionByName(apart), sets))
    if rest.isEmpty():
        return roots
    groups = rest.select(F.col("node").alias("id"), F.col("root").alias("group")).unionByName(rest.select(F.col("root").alias("id"), F.col("root").alias("group")).distinct())
    groups = groups.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    return components(links_.unionByName(joining_links(groups, sets, similarity, BLOCK)))


def similar_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, shingle: int = WORDS, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """One row per distinct shingle set: key, rep (its least id), component_id (least id reachable over links at the similarity).

    Ids are longs, none null and none repeated. A null text is an empty one; texts without a word are one set that links to no other.
    """
    distinct, candidates, members = similar_candidates(df, id_col, text_col, similarity, shingle, radius, bucket)
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(tested(candidates, members), "id", "left_semi")
    roots = similar_roots(candidates, members, written(texts, "similar-texts"), similarity, shingle, radius, bucket)
    return distinct.join(roots, distinct.rep == roots.node, "left").select("key", "rep", F.coalesce("root", "rep").alias("component_id"))


ROW = "_placeloom_row"


def one_of_each(df: DataFrame, text_col: str = "text", similarity: float = SIMILARITY, shingle: int = WORDS, bucket: int = BUCKET) -> DataFrame:
    """The first row, with all its columns, of each group of similar_groups. Rows are told apart by position, not by an id.

    A null text is an empty one, and of all texts without a word one row stays. Repeated rows and equal texts are one group; of ties the row
    that stands first in the written table stays. Empty in, empty out. An input column may have any name.
    """
    row = unused(df, ROW)
    rows = written(df.withColumn(row, F.monotonically_increasing_id()), "rows")
    distinct, candidates, members = similar_candidates(rows, row, text_col, similarity, shingle, RADIUS, bucket)
    # texts are shuffled once, whatever the size: copies go, and the rest is split in rows with candidates and rows without
    told = distinct.select(F.col("rep").alias(row)).join(tested(candidates, members).select(F.col("id").alias(row), F.lit(True).alias(row + "t")), row, "left")
    rows = written(rows.join(told.withColumn(row + "t", F.coalesce(row + "t", F.lit(False))).hint("merge"), row), "rows")
    touched = rows.where(F.col(row + "t"))
    roots = similar_roots(candidates, members, touched.select(F.col(row).alias("id"), F.col(text_col).alias("text")), similarity, shingle, RADIUS, bucket)
    touched = touched.join(roots.select(F.col("node").alias(row)).hint("merge"), row, "left_anti")
    return rows.where(~F.col(row + "t")).select(*df.columns).unionByName(touched.select(*df.columns))
