"""Language identification with interpolated Kneser-Ney character language models (operator 5).

Learning takes labelled rows outside the held-out fifth, at most about `ROWS_A_LANGUAGE` rows and `CHARS_A_LANGUAGE` characters a language (documented,
unbiased bounds: rows are kept whole by a hash of their id). A text is its letters in lower case with one space for
whatever lies between. Counts of `ORDER`-grams a language are made on the executors; the models are estimated
on the driver, whose share is bounded by that sample: absolute discounts n1 / (n1 + 2 n2) per order, continuation counts in the lower
orders, a uniform floor below the unigrams.

Storage: per order one sorted array of 64-bit hashes of n-grams, beside it a row of log probabilities, one a language
(a language that lacks the n-gram has its backed-off value there), and likewise the log back-off weights of contexts. A look-up
jumps by the hash's leading bits, so it is a few array reads, without loops over text.

Prediction: the language with the least cross-entropy a character. Rejection is calibrated on sampled rows that the models were
not estimated from: a text is rejected if its cross-entropy lies above the midpoint between its language's own texts and
random letters (and above the own texts' mean and six deviations), with an allowance for short texts.

Cases: null text, or text without a letter (marks alone are none): `und`, score 0, rejected. No labelled row at all: every row is `und`, and only texts without a letter are rejected. Null ids count
as held out. Repeated rows repeat; empty in, empty out. Equal cross-entropies go to the first language by name.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, written
from .decontam import mix

ORDER = 5
ROWS_A_LANGUAGE, CHARS_A_LANGUAGE = 600, 8_000_000
CHAR_BITS = 12  # ids of characters; rarer ones share the id UNKNOWN
SPACE, START, UNKNOWN, FIRST = 0, 1, 2, 3
#: Characters whose evidence is counted in full by the score.
SCORE_CHARS = 200
BATCH_CHARS = 1 << 19


@cache
def letters() -> np.ndarray:
    """Lower-case code point of each letter or mark, 0 for any other code point."""
    out = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if unicodedata.category(c)[0] in "LM":
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


@cache
def true_letters() -> np.ndarray:
    """Whether each code point is a letter, not a mark."""
    return np.fromiter((unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)), bool, 0x110000)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def squeezed(points: np.ndarray) -> np.ndarray:
    """Letters in lower case, one 0 for each run of others, none at the ends."""
    low = letters()[points]
    keep = low != 0
    keep[1:] |= keep[:-1]
    low = low[keep]
    return low[:-1] if len(low) and low[-1] == 0 else low


def grams(text: str | None, order: int) -> Counter:
    """Counts of n-grams of a text, padded at the front."""
    s = "".join(" " if c == 0 else chr(c) for c in squeezed(code_points(text or "")).tolist())
    s = "\x01" * (order - 1) + s
    return Counter(s[i : i + order] for i in range(len(s) - order + 1))


@dataclass
class Table:
    """Sorted hashes with a row of float32 values each."""

    hashes: np.ndarray
    values: np.ndarray
    shift: int = 0
    starts: np.ndarray = field(default=None)

    @classmethod
    def of(cls, keys: np.ndarray, values: np.ndarray) -> Table:
        h = mix(keys.astype(np.uint64))
        order = np.argsort(h)
        h = h[order]
        bits = max(1, int(np.ceil(np.log2(len(h) + 1))) + 1)
        lead = (h >> np.uint64(64 - bits)).astype(np.int64)
        starts = np.searchsorted(lead, np.arange((1 << bits) + 1)).astype(np.int32)
        return cls(np.append(h, ~np.uint64(0)), np.ascontiguousarray(values[order], np.float32), 64 - bits, starts)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Positions, -1 where a key is missing."""
        h = mix(keys)
        lead = (h >> np.uint64(self.shift)).astype(np.int64)
        at = self.starts[lead]
        got = self.hashes[at]
        out = np.where(got == h, at, -1)
        todo = np.flatnonzero(got < h)
        at, h = at[todo], h[todo]
        while len(todo):
            at = at + 1
            got = self.hashes[at]
            hit = got == h
            out[todo[hit]] = at[hit]
            more = got < h
            todo, at, h = todo[more], at[more], h[more]
        return out


@dataclass
class Models:
    languages: list[str]
    order: int
    alphabet: dict[str, int]
    floor: np.ndarray  # order 1, a row for each character id
    probs: dict[int, Table]
    backoffs: dict[int, Table]
    limits: np.ndarray
    spread: np.ndarray

    def ids(self) -> np.ndarray:
        """Character id of each code point."""
        low = letters()
        by_point = np.where(np.arange(0x110000) == 0, SPACE, UNKNOWN).astype(np.uint64)
        for c, i in self.alphabet.items():
            by_point[ord(c)] = i
        out = by_point[low]
        out[low == 0] = SPACE
        return out


def estimate(counts: dict[str, dict[str, int]], order: int = ORDER) -> Models:
    """Models from ORDER-gram counts a language."""
    languages = sorted(counts)
    seen = Counter()
    for by in counts.values():
        for g, n in by.items():
            seen[g[-1]] += n
    common = [c for c, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0])) if c not in " \x01"][: (1 << CHAR_BITS) - FIRST]
    alphabet = {c: FIRST + i for i, c in enumerate(sorted(common))}
    ids = alphabet | {" ": SPACE, "\x01": START}
    size, one = len(alphabet) + FIRST, np.uint64(CHAR_BITS)

    keys: dict[tuple[int, int], np.ndarray] = {}
    p: dict[tuple[int, int], np.ndarray] = {}
    contexts: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    floor = np.zeros((size, len(languages)))
    for at, lang in enumerate(languages):
        packed = []
        for g in counts[lang]:
            k = 0
            for c in g:
                k = k << CHAR_BITS | ids.get(c, UNKNOWN)
            packed.append(k)
        k, where = np.unique(np.asarray(packed, np.uint64), return_inverse=True)
        n = np.bincount(where, weights=np.fromiter(counts[lang].values(), float, len(packed)), minlength=len(k))
        by_order = {order: (k, n)}
        for m in range(order - 1, 0, -1):
            suffix = by_order[m + 1][0] & np.uint64((1 << CHAR_BITS * m) - 1)
            k, n = np.unique(suffix, return_counts=True)
            by_order[m] = (k, n.astype(float))
        for m in range(1, order + 1):
            k, n = by_order[m]
            n1, n2 = (n == 1).sum(), (n == 2).sum()
            discount = min(0.95, max(0.05, n1 / (n1 + 2 * n2) if n1 else 0.5))
            ctx, where = np.unique(k >> one, return_inverse=True)
            total, kinds = np.bincount(where, weights=n), np.bincount(where)
            back = discount * kinds / total
            first = np.maximum(n - discount, 0) / total[where]
            if m == 1:
                floor[:, at] = back[0] / size
                floor[k.astype(np.int64), at] += first
            else:
                suffix = k & np.uint64((1 << CHAR_BITS * (m - 1)) - 1)
                lower = floor[suffix.astype(np.int64), at] if m == 2 else p[at, m - 1][np.searchsorted(keys[at, m - 1], suffix)]
                keys[at, m], p[at, m] = k, first + back[where] * lower
                contexts[at, m] = ctx, back
    every = range(len(languages))
    full = np.log(floor)
    probs, backoffs, below, below_keys = {}, {}, full, None
    for m in range(2, order + 1):
        union = np.unique(np.concatenate([keys[a, m] for a in every]))
        around = np.unique(np.concatenate([contexts[a, m][0] for a in every]))
        back = np.zeros((len(around), len(languages)))
        for a in every:
            back[np.searchsorted(around, contexts[a, m][0]), a] = np.log(contexts[a, m][1])
        suffix = union & np.uint64((1 << CHAR_BITS * (m - 1)) - 1)
        lower = below[suffix.astype(np.int64)] if m == 2 else below[np.searchsorted(below_keys, suffix)]
        rows = lower + back[np.searchsorted(around, union >> one)]
        for a in every:
            rows[np.searchsorted(union, keys[a, m]), a] = np.log(p[a, m])
        probs[m], backoffs[m] = Table.of(union, rows), Table.of(around, back)
        below, below_keys = rows, union
    none = np.full(len(languages), np.inf)
    return Models(languages, order, alphabet, full.astype(np.float32), probs, backoffs, none, np.ones(len(languages)))


class Scorer:
    def __init__(self, models: Models):
        self.m, self.ids, self.letter = models, models.ids(), true_letters()

    def chars(self, text: str) -> np.ndarray:
        """Character ids of a text's letters (with their marks) and single spaces; none where there are marks alone."""
        points = code_points(text)
        if not (self.letter[points[:64]].any() or self.letter[points[64:]].any()):
            return self.ids[:0]
        ids = self.ids[points]
        keep = ids != SPACE
        keep[1:] |= keep[:-1]
        ids = ids[keep]
        return ids[:-1] if len(ids) and ids[-1] == SPACE else ids

    def rows(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Log probabilities of the characters at `at`, a row each."""
        m = self.m
        if not m.languages:
            return np.zeros((len(at), 0), np.float32)
        low = np.uint64(CHAR_BITS)
        keys = np.zeros(len(at), np.uint64)
        for k in range(m.order - 1, -1, -1):
            keys = keys << low | ids[at - k]
        out = np.zeros((len(at), len(m.languages)), np.float32)
        todo = np.arange(len(at))
        for n in range(m.order, 1, -1):
            found = m.probs[n].find(keys)
            hit = found >= 0
            values = m.probs[n].values[found[hit]]
            if n == m.order:
                out[hit] = values
            else:
                out[todo[hit]] += values
            miss = ~hit
            todo, keys = todo[miss], keys[miss]
            if not len(todo):
                return out
            context = m.backoffs[n].find(keys >> low)
            known = context >= 0
            out[todo[known]] += m.backoffs[n].values[context[known]]
            keys = keys & np.uint64((1 << CHAR_BITS * (n - 1)) - 1)
        out[todo] += m.floor[keys.astype(np.int64)]
        return out

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy (nats a character) a language, and number of characters, of each text."""
        sums, sizes = np.zeros((len(texts), len(self.m.languages))), np.zeros(len(texts), np.int64)
        held, owners, n = [], [], 0

        def flush():
            pad = np.full(self.m.order - 1, START, np.uint64)
            ids = np.concatenate([x for c in held for x in (pad, c)])
            lengths = np.array([len(c) for c in held])
            starts = np.cumsum(lengths + len(pad)) - lengths
            at = np.arange(lengths.sum()) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
            rows = self.rows(ids, at)
            np.add.at(sums, owners, np.add.reduceat(rows, np.cumsum(lengths) - lengths, axis=0, dtype=np.float64))

        for i, t in enumerate(texts):
            ids = self.chars(t or "")
            sizes[i] = len(ids)
            for a in range(0, len(ids), BATCH_CHARS):  # a very long text in pieces, each with its true left context
                piece = ids[max(0, a - self.m.order + 1) : a + BATCH_CHARS]
                if a:
                    rows = self.rows(piece, np.arange(self.m.order - 1, len(piece)))
                    sums[i] += rows.sum(0, dtype=np.float64)
                    continue
                held.append(piece)
                owners.append(i)
                n += len(piece)
            if n >= BATCH_CHARS:
                flush()
                held, owners, n = [], [], 0
        if held:
            flush()
        return -sums / np.maximum(sizes, 1)[:, None], sizes


def is_held_out(id_col: str):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER, rows_a_language: int = ROWS_A_LANGUAGE, chars_a_language: int = CHARS_A_LANGUAGE) -> Models:
    """Models from labelled rows that aren't held out: of each language a sample of about rows_a_language rows, or fewer where
    rows are so long that the sample would hold over chars_a_language characters."""
    labelled = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~is_held_out("id"))
    found = labelled.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).collect()
    sizes = {r.lang: min(1.0, rows_a_language / r["n"], chars_a_language / max(r.chars, 1)) for r in found}
    if not sizes:
        return Models([], order, {}, np.zeros((FIRST, 0)), {}, {}, np.zeros(0), np.zeros(0))
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 30)).cast("double") / (1 << 30)
    share = F.create_map(*[F.lit(x) for lang, part in sizes.items() for x in (lang, part)])[F.col("lang")]
    sample = written(labelled.where(draw < share).select("text", "lang", (F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(5)) == 0).alias("calibrate")), "langid-sample")
    if sample.isEmpty():
        sample = written(labelled.select("text", "lang", F.lit(False).alias("calibrate")), "langid-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, Counter] = {}
        for batch in batches:
            for t, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total.setdefault(lang, Counter()).update(grams(t, order))
        for lang, c in total.items():
            yield pa.record_batch([pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["lang", "gram", "n"])

    def counted(rows: DataFrame) -> dict[str, dict[str, int]]:
        out: dict[str, dict[str, int]] = {}
        grouped = rows.select("text", "lang").mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
        for lang, gram, n in zip(*(c.to_pylist() for c in grouped.columns), strict=True):
            out.setdefault(lang, {})[gram] = n
        return out

    counts = counted(sample.where(~F.col("calibrate")))
    if set(counts) != set(sizes):  # a language of a few rows: no row is spared for calibration
        counts = counts | {k: v for k, v in counted(sample).items() if k not in counts}
    counts = {k: v for k, v in counts.items() if v}
    if not counts:
        return Models([], order, {}, np.zeros((FIRST, 0)), {}, {}, np.zeros(0), np.zeros(0))
    models = estimate(counts, order)
    at = F.array_position(F.array(*map(F.lit, models.languages)), F.col("lang")).cast("int")
    spared = scored(sample.where("calibrate"), models, "text", ["lang"]).where("size >= 50").withColumn("at", at).where("at > 0")
    own = np.array([[r.entropy, r["at"] - 1] for r in spared.select("at", F.element_at("entropies", F.col("at")).alias("entropy")).collect()]).reshape(-1, 2)
    calibrate(models, own)
    return models


def calibrate(models: Models, own: np.ndarray) -> None:
    """Limits from (cross-entropy, language) of own texts and of random letters of the language's alphabet."""
    rng = np.random.default_rng(0)
    alphabet = [c for c in models.alphabet if c.isalpha()]
    random_texts = ["".join(rng.choice(alphabet, 2000)) for _ in range(4)] if alphabet else []
    wild = Scorer(models).score(random_texts)[0].mean(0) if random_texts else np.zeros(len(models.languages))
    for at in range(len(models.languages)):
        e = own[own[:, 1] == at, 0]
        if len(e) == 0:
            continue
        models.limits[at] = max((e.mean() + wild[at]) / 2, e.mean() + 6 * e.std())
        models.spread[at] = max(wild[at] - e.mean(), 0.1)


def scored(df: DataFrame, models: Models, text_col: str, keep: list[str]) -> DataFrame:
    """keep columns, entropies (array, a language each), size."""
    shared = df.sparkSession.sparkContext.broadcast(models)
    src = df.select(*keep, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for part in slices(batches, text_col):
            entropy, size = scorer.score(part.column(len(keep)).to_pylist())
            yield pa.record_batch([*(part.column(i) for i in range(len(keep))), pa.array(entropy.tolist(), pa.list_(pa.float64())), pa.array(size)], names=[*keep, "entropies", "size"])

    return src.mapInArrow(run, "".join(f"`{c}` {src.schema[c].dataType.simpleString()}, " for c in keep) + "entropies array<double>, size long")


def is_rejected(models: Models, entropy: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(best language, rejected) of scored texts."""
    at = entropy.argmin(1)
    best = entropy[np.arange(len(at)), at]
    return at, (size == 0) | (best > models.limits[at] + 2 * models.spread[at] / np.sqrt(np.maximum(size, 1)))


def accepted(df: DataFrame, models: Models, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose language isn't rejected.

    Null, empty and letterless texts go, as they have no language. Repeated rows stay or go together; equal cross-entropies don't
    matter here, as only the least is compared. Empty in, empty out.
    """
    shared = df.sparkSession.sparkContext.broadcast(models)
    at_text = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        scorer = Scorer(m)
        for part in slices(batches, text_col):
            entropy, size = scorer.score(part.column(at_text).to_pylist())
            yield part.filter(pa.array(~is_rejected(m, entropy, size)[1] if m.languages else size > 0))

    return df.mapInArrow(run, df.schema)


def identify(df: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: id_col, keep columns, held_out, lang_pred, score, entropy, rejected.

    score: posterior of the language if each character up to SCORE_CHARS counts in full, none beyond.
    """
    names = list(dict.fromkeys([id_col, *keep]))
    shared = df.sparkSession.sparkContext.broadcast(models)
    src = df.select(*names, text_col) if text_col not in names else df.select(*names)
    at_text = src.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        scorer = Scorer(m)
        for part in slices(batches, text_col):
            n = part.num_rows
            entropy, size = scorer.score(part.column(at_text).to_pylist())
            if not m.languages:
                lang, score, best, rejected = ["und"] * n, np.zeros(n), np.zeros(n), size == 0
            else:
                at, rejected = is_rejected(m, entropy, size)
                best = entropy[np.arange(n), at]
                weight = np.minimum(size, SCORE_CHARS)[:, None]
                score = np.where(size > 0, 1 / np.exp(-(entropy - best[:, None]) * weight).sum(1), 0.0)
                lang = [m.languages[k] if s else "und" for k, s in zip(at.tolist(), size.tolist(), strict=True)]
            yield pa.record_batch([*(part.column(i) for i in range(len(names))), pa.array(lang, pa.string()), pa.array(score), pa.array(best), pa.array(rejected)], names=[*names, "lang_pred", "score", "entropy", "rejected"])

    out = src.mapInArrow(run, "".join(f"`{c}` {src.schema[c].dataType.simpleString()}, " for c in names) + "lang_pred string, score double, entropy double, rejected boolean")
    return out.select(*names, is_held_out(id_col).alias("held_out"), "lang_pred", "score", "entropy", "rejected")
