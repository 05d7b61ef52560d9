import hashlib
import random
import re
import struct
import time
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from placeloom.llm import decontam, shards, simhash, tiff

rng = random.Random(11)
WORDS = [f"w{i}" for i in range(400)]


def prose(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def near(text, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    return " ".join(words)


BASE = [prose(200) for _ in range(12)]
TEXTS = [None, "", " \n", "one", "ONE two", "one two three", "É x É", "a\x0bb\x0cc d", *BASE, *BASE[:6], *[near(b, k) for b in BASE for k in (1, 1, 2, 5)], "x" * 5000, prose(3000)]


def frame(spark, texts, parts=3):
    return spark.createDataFrame([(i, t, "clash", -1) for i, t in enumerate(texts)], "doc_id long, text string, fp string, shard int").repartition(parts)


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    parts = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, prints):
    parent = {i: i for i in ids}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(ids)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((top(ids[a]), top(ids[b])))
                parent[y] = x
    return {i: top(i) for i in ids}


@pytest.mark.parametrize("bucket", [2048, 2])
def test_simhash_against_brute_force(spark, bucket):
    got = {r.doc_id: r for r in simhash.near_duplicates(frame(spark, TEXTS), bucket=bucket).collect()}
    prints = [brute_print(t) for t in TEXTS]
    want = brute_components(list(range(len(TEXTS))), prints)
    for i in range(len(TEXTS)):
        assert got[i].fingerprint == f"{prints[i]:016x}", i
        assert got[i].component_id == want[i], i
    assert len(set(want.values())) < len(TEXTS) - 20


@pytest.mark.parametrize("bucket", [2048, 8, 2])
def test_links_in_a_dense_cluster(spark, bucket):
    centre = rng.getrandbits(64)
    prints = set()
    while len(prints) < 300:
        f = centre
        for b in rng.sample(range(64), rng.randrange(0, 7)):
            f ^= 1 << b
        prints.add(f)
    prints = sorted(prints)
    rows = [(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(prints)]
    df = spark.createDataFrame(rows, "fp long, rep long").repartition(3)
    from placeloom.llm.components import components

    roots = {r.node: r.root for r in components(simhash.links(df, bucket=bucket)).collect()}
    want = brute_components(list(range(len(prints))), prints)
    assert {i: roots.get(i, i) for i in want} == want


def brute_sets(texts):
    out = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        out[i] = frozenset(" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    return out


def brute_pairs(texts, similarity=0.8):
    """Pairs of ids at the five-word similarity, by counting every shared shingle."""
    sets, holders, shared = brute_sets(texts), defaultdict(list), defaultdict(int)
    for i, s in sets.items():
        for g in s or ("",):
            for j in holders[g]:
                shared[j, i] += 1
            holders[g].append(i)
    return {(a, b) for (a, b), n in shared.items() if n >= similarity * (len(sets[a] or ("",)) + len(sets[b] or ("",)) - n) - 1e-9}


def brute_similar(texts, similarity=0.8):
    """Groups of ids that pairs at the similarity connect."""
    parent = {i: i for i in texts}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in brute_pairs(texts, similarity):
        parent[top(b)] = top(a)
    groups = defaultdict(list)
    for i in texts:
        groups[top(i)].append(i)
    return list(groups.values())


def cluster_texts():
    texts = dict(enumerate(TEXTS))
    for b in BASE[:8]:  # copies with more and more words exchanged, cut or added
        for k in range(1, 10):
            texts[len(texts)] = near(b, k)
            words = b.split()
            texts[len(texts)] = " ".join(words[: len(words) - 4 * k])
            texts[len(texts)] = b + " " + prose(4 * k)
    long = prose(3000)
    for k in range(30):
        texts[len(texts)] = near(long, k)
    return texts


@pytest.mark.parametrize("bucket", [1 << 16, 8])
def test_similar_groups_against_brute_force(spark, bucket):
    texts = cluster_texts()
    df = spark.createDataFrame(list(texts.items()), "id long, text string").repartition(5)
    prints = {r.id: r.key for r in simhash.wide_prints(df, "id", "text", 5).collect()}
    component = {r.key: r.component_id for r in simhash.similar_groups(df, "id", bucket=bucket).collect()}
    got = {i: component[k] for i, k in prints.items()}
    groups = brute_similar(texts)
    for g in groups:  # nothing is linked that isn't similar, and a group's name is its least member
        assert all(got[i] in g for i in g)
    pairs = brute_pairs(texts)
    found = sum(got[a] == got[b] for a, b in pairs)
    assert found >= (0.97 if bucket > 8 else 0.9) * len(pairs) and len(pairs) > 300
    sets = brute_sets(texts)
    assert len(set(got.values())) >= len(groups) and all((prints[a] == prints[b]) == (sets[a] == sets[b]) for a, b in pairs)


@pytest.mark.parametrize("bucket", [1 << 16, 40, 8])
def test_no_candidate_of_a_bucket_is_lost(spark, bucket):
    """Similar texts that agree in a segment but for one bit, within the radius, are in one group, whatever their bucket's size and density."""
    texts = cluster_texts()
    base = prose(120)
    for k in range(250):  # similar to few of many others within the radius
        texts[len(texts)] = near(base, 3 + k % 4)
    df = spark.createDataFrame(list(texts.items()), "id long, text string").repartition(5)
    prints = {r.id: r for r in simhash.wide_prints(df, "id", "text", 5).collect()}
    component = {r.key: r.component_id for r in simhash.similar_groups(df, "id", bucket=bucket).collect()}
    bits = {i: ((r.hi % (1 << 64)) << 32) | (r.lo % (1 << 32)) for i, r in prints.items()}

    def meet(x):
        return x.bit_count() <= simhash.RADIUS and any((x >> s & 0xFFFF).bit_count() <= 1 for s in range(0, 96, 16))

    pairs = [(a, b) for a, b in brute_pairs(texts) if prints[a].n >= 4 and meet(bits[a] ^ bits[b])]
    assert len(pairs) > 1000 and [p for p in pairs if component[prints[p[0]].key] != component[prints[p[1]].key]] == []


def test_blocks_of_a_large_bucket_meet(spark):
    """Members that share one segment and no other are candidates, in a bucket over the limit as in any other."""
    rng = np.random.default_rng(3)
    rows = [(int(rng.integers(1 << 60)) << 4 & ~0xFFFF | 5, int(rng.integers(-(1 << 31), 1 << 31)), 50, i) for i in range(200)]
    for i in range(0, 200, 4):  # 15 bits from the last, three in each other segment
        flip = sum(0x0111 << at for at in (16, 32, 48))
        hi = (rows[i][0] & 0x7FFFFFFFFFFFFFFF) ^ flip & 0x7FFFFFFFFFFFFFFF
        rows.append((hi, int(np.int32(np.uint32((rows[i][1] % (1 << 32)) ^ 0x01110111))), 50, 1000 + i))
    rows = [(h & 0x7FFFFFFFFFFFFFFF, *r) for h, *r in rows]
    distinct = spark.createDataFrame(rows, "hi long, lo int, n int, rep long")
    none = spark.createDataFrame([], "node long, root long")
    for bucket in (1 << 16, 70, 2):
        candidates, members = simhash.wide_candidates(distinct, 0.8, 19, bucket)
        more = simhash.apart_candidates(members, none, 0.8, 19, bucket)
        got = {(r.u, r.v) for r in candidates.select("u", "v").union(more).collect()}
        assert {(i, 1000 + i) for i in range(0, 200, 4)} <= got


def test_rows_of_a_group_are_no_pairs(spark, monkeypatch):
    """Near copies of one text of which many are similar to none: pairs to verify and edges stay some rows a member."""
    base, rows = prose(150), []
    verified, components = simhash.verified, simhash.components
    monkeypatch.setattr(simhash, "verified", lambda pairs, *a: rows.append(pairs.count()) or verified(pairs, *a))
    monkeypatch.setattr(simhash, "components", lambda edges: rows.append(edges.count()) or components(edges))
    texts = {i: near(base, 1 + i % 12) for i in range(900)}
    df = spark.createDataFrame(list(texts.items()), "id long, text string").repartition(5)
    got = {r.rep: r.component_id for r in simhash.similar_groups(df, "id").collect()}
    groups = brute_similar(texts)
    large = [got[a] for a in max(groups, key=len) if a in got]
    assert len(large) > 200 and large.count(min(large)) > 0.95 * len(large) and len(groups) > 225 and len(set(got.values())) >= len(groups)
    assert sum(rows) <= 40 * len(texts), rows


@pytest.mark.parametrize("block", [3000, 150])
def test_groups_of_several_blocks_meet(spark, monkeypatch, block):
    """As test_no_candidate_of_a_bucket_is_lost, with few shingles a block: some hold one text."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    test_no_candidate_of_a_bucket_is_lost(spark, 1 << 16)


def test_joining_against_all_pairs():
    rng = np.random.default_rng(5)
    for case in range(60):
        pool = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
        sets = [np.unique(rng.choice(pool, int(rng.integers(4, 30)), replace=False)) if case % 2 else np.unique(np.append(rng.choice(pool[:20], 18, replace=False), rng.choice(pool[20:], int(rng.integers(0, 5)), replace=False))) for _ in range(40)]
        root, part = rng.integers(0, 15, 40), (np.zeros(40, int) if case % 3 else rng.integers(1, 3, 40))
        similar = [(i, j) for i in range(40) for j in range(i) if (part[i] == 0 or part[i] != part[j]) and (n := len(np.intersect1d(sets[i], sets[j]))) >= 0.8 * (len(sets[i]) + len(sets[j]) - n) - 1e-9]
        a, b = simhash.joining(sets, root, part, 0.8)

        def labels(pairs, root=root):
            now = root.copy()
            for i, j in pairs:
                now[now == now[i]] = now[j]
            return {frozenset(np.flatnonzero(now == r).tolist()) for r in set(now.tolist())}

        assert labels(zip(a.tolist(), b.tolist(), strict=True)) == labels(similar)
        assert {(max(p), min(p)) for p in zip(a.tolist(), b.tolist(), strict=True)} <= set(similar) and len(a) < len(set(root.tolist()))


def test_sketches_rule_out_no_similar_pair():
    rng = np.random.default_rng(7)
    for n in (4, 5, 60, 900, 5000):
        for _ in range(40):
            own = int(rng.integers(0, n // 5 + 1))
            both = rng.integers(0, 1 << 63, n - own, dtype=np.uint64)
            a, b = (np.unique(np.append(both, rng.integers(0, 1 << 63, k, dtype=np.uint64))) for k in (own, int(rng.integers(0, own + 1))))
            bits = int.from_bytes(simhash.sketch(a), "big") ^ int.from_bytes(simhash.sketch(b), "big")
            assert bits.bit_count() <= len(np.setxor1d(a, b))


def test_similar_groups_of_one_large_cluster(spark, monkeypatch):
    """Thousands of near copies: stars in place of pairs, and a bucket over the limit is keyed by a second segment."""
    base = prose(300)
    texts = {i: near(base, 1 + i % 3) for i in range(2500)} | {3000 + i: prose(100) for i in range(200)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(7)
    for bucket in (1 << 16, 500):
        got = simhash.one_of_each(df, bucket=bucket).collect()
        assert sum(r.doc_id < 3000 for r in got) <= 2 and sum(r.doc_id >= 3000 for r in got) == 200


def test_recall_of_similar_pairs_on_documents(spark, sf_small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_small.replace('0.001', '0.01')}/documents.parquet").collect()}
    df = spark.createDataFrame(list(texts.items()), "id long, text string").repartition(4)
    prints = {r.id: r.key for r in simhash.wide_prints(df, "id", "text", 5).collect()}
    component = {r.key: r.component_id for r in simhash.similar_groups(df, "id").collect()}
    pairs = brute_pairs(texts)
    assert sum(component[prints[a]] == component[prints[b]] for a, b in pairs) >= 0.9 * len(pairs)


def test_one_of_each_edge_rows(spark):
    df = spark.createDataFrame([(None, None, "a"), (None, "", "b"), (1, " \n", "c"), (1, "x", "d"), (2, "X", "e"), (3, "x y", "f")], "_Placeloom_rowt long, text string, n string").repartition(3)
    got = simhash.one_of_each(df).collect()
    assert len(got) == 3 and got[0].__fields__ == ["_Placeloom_rowt", "text", "n"] and sum(not (r.text or "").strip() for r in got) == 1
    assert simhash.one_of_each(df.limit(0)).count() == 0


def test_long_text_pieces(monkeypatch):
    text = prose(500)
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "CHUNK", 37)
    assert simhash.fingerprint(text) == whole
    assert simhash.fingerprint("y" * 200 + " z") == brute_print("y" * 200 + " z").to_bytes(8, "big")


def test_null_ids_and_empty(spark):
    df = spark.createDataFrame([(None, BASE[0]), (3, BASE[0]), (None, BASE[1])], "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.component_id)) for r in simhash.near_duplicates(df).collect())
    assert got == [("3", "3"), ("None", "3"), ("None", "None")]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def check_shards(rows, texts, shards_n):
    by = defaultdict(list)
    place = defaultdict(set)
    for r in rows:
        by[r.shard].append(r.slot)
        place[texts[r.doc_id] or ""].add(r.shard)
        assert r.size == len((texts[r.doc_id] or "").encode()) + 8
        assert r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode())
    assert all(len(s) == 1 for s in place.values())
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert all(0 <= k < shards_n for k in by)
    load = defaultdict(int)
    for r in rows:
        load[r.shard] += r.size
    return load


def test_shards_are_near_equal_and_whole(spark):
    texts = TEXTS + [prose(rng.randrange(1, 60)) for _ in range(900)]
    rows = shards.pack_into(frame(spark, texts), 24).collect()
    assert len(rows) == len(texts) and {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    load = check_shards(rows, texts, 24)
    rest = sorted(load.values())
    assert rest[-2] - rest[0] <= 30  # but for the one group over an even share, if any
    assert shards.pack_into(frame(spark, texts).limit(0), 24).count() == 0


def test_shards_with_a_group_over_an_even_share(spark):
    texts = [prose(30)] * 200 + [prose(20) for _ in range(300)]
    load = check_shards(shards.pack_into(frame(spark, texts), 5).collect(), texts, 5)
    assert sorted(load.values())[-1] == 200 * (len(texts[0]) + 8)
    assert sorted(load.values())[-2] - min(load.values()) < 400


def test_fixed_capacity(spark):
    texts = [prose(rng.randrange(1, 60)) for _ in range(300)] + [prose(2000)] * 2 + [prose(1500)]
    load = check_shards(shards.pack(frame(spark, texts), 4000).collect(), texts, 10**6)
    over = [v for v in load.values() if v > 4000]
    assert len(over) == 2


def pieces(h, plan):
    """(size, first rank, end rank, bin) of every size of a plan, by way of its whole and cut parts."""
    whole, cut = shards.parts_of(h, plan)
    return cut + [(int(s), 0, int(n), k) for top, low, k in whole for s, n in zip(h.sizes, h.counts, strict=True) if low <= s <= top]


def test_a_plan_of_five_million_sizes_takes_seconds():
    draw = np.random.default_rng(1)
    h = shards.Histogram(np.arange(8, 5_000_008), draw.integers(1, 4, 5_000_000))
    began = time.perf_counter()
    plan = shards.plan_into(h, 24)
    assert time.perf_counter() - began < 60 and len(plan) < 10_000
    load = np.zeros(24, np.int64)
    for at, first, to, end, k in plan:
        load[k] += h.sums[to] - h.sums[at] - first * h.sizes[at] + (end * h.sizes[to] if end else 0)
    assert load.sum() == h.sums[-1] and load.max() - load.min() < 10_000


def plain_best_fit(sizes, capacity):
    bins = []
    for s in sorted(sizes, reverse=True):
        fit = [(r, k) for k, r in enumerate(bins) if r >= s]
        if fit:
            bins[min(fit)[1]] -= s
        else:
            bins.append(capacity - s)
    return [capacity - r for r in bins]


def test_run_packing_is_best_fit_decreasing():
    for _ in range(200):
        capacity = rng.randrange(10, 200)
        sizes = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 120))]
        histogram = defaultdict(int)
        for s in sizes:
            histogram[s] += 1
        load = defaultdict(int)
        for s, a, b, k in pieces(h := shards.Histogram.of(histogram.items()), shards.best_fit(h, capacity)):
            load[k] += s * (b - a)
        assert [load[k] for k in range(len(load))] == plain_best_fit(sizes, capacity)


def test_tree():
    tree, keys = shards.Tree(), set()
    for _ in range(3000):
        k = (rng.randrange(50), rng.randrange(20))
        if k in keys:
            tree.remove(k)
            keys.discard(k)
        else:
            tree.add(k)
            keys.add(k)
        q = (rng.randrange(52), -1)
        assert tree.least_from(q) == min((x for x in keys if x >= q), default=None)
        assert tree.greatest_below(q) == max((x for x in keys if x < q), default=None)


@pytest.mark.parametrize("compression", [1, 5, 8, 32773, 32946])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [0, 16, 48])
def test_tiff_round_trip(compression, predictor, tile):
    for n, order in ((1, "<"), (37, ">"), (200, "<")):
        kind = rng.randrange(3)
        payload = bytes(rng.getrandbits(8) if kind == 0 else rng.choice(b"aab ") if kind == 1 else 0 for _ in range(64 * n))
        media = tiff.write(payload, compression, predictor, tile, page_rows=64, strip_rows=10, order=order)
        got = list(tiff.pages(media))
        assert b"".join(p["samples"] for p in got) == payload
        assert [p["page"] for p in got] == list(range(-(-n // 64)))


def test_lzw_long_and_packbits():
    for data in (b"", b"a", bytes(70000), rng.randbytes(70000), b"abc" * 30000):
        assert tiff.unlzw(tiff.lzw(data), len(data) + 9) == data
        assert tiff.unpack_bits(tiff.pack_bits(data), len(data) + 9) == data
        for n in (0, 1, len(data) // 2):
            assert tiff.unlzw(tiff.lzw(data), n) == data[:n] == tiff.unpack_bits(tiff.pack_bits(data), n)
    # a published example of PackBits
    assert tiff.unpack_bits(bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA"), 99) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")


def test_tiff_errors():
    with pytest.raises(ValueError):
        list(tiff.pages(b"nothing"))
    media = bytearray(tiff.write(bytes(64)))
    media[-4:] = media[4:8]  # the last directory points at itself
    assert len(list(tiff.pages(bytes(media)))) == 1
    assert list(tiff.pages(None)) == []


def test_mutated_tiff_files_raise_one_error(spark, monkeypatch):
    monkeypatch.setattr(tiff, "MAX_PAGE_BYTES", 1 << 24)
    draw = random.Random(3)
    whole = [tiff.write((prose(draw.randrange(1, 80)) * 3).encode().ljust(4096, b"\0")[:4096], *scheme, page_rows=32, strip_rows=9, order=draw.choice("<>")) for scheme in tiff.SCHEMES]
    outcome = {"read": 0, "error": 0}
    bad = []
    for k in range(3000):
        media = bytearray(draw.choice(whole))
        for _ in range(draw.randrange(1, 5)):
            media[draw.randrange(len(media)) if draw.random() < 0.5 else max(0, len(media) - draw.randrange(1, 400))] = draw.randrange(256)
        media = bytes(media[: draw.randrange(len(media))] if draw.random() < 0.2 else media)
        try:
            list(tiff.pages(media))
            outcome["read"] += 1
        except ValueError:
            outcome["error"] += 1
            if k % 100 == 0:
                bad.append(media)
    assert outcome["error"] > 500 and outcome["read"] > 100
    rows = [(0, whole[0]), (None, None), *((k + 1, m) for k, m in enumerate([*bad, b"", b"II*\0", b"no"])), (999, whole[1])]
    got = tiff.explode_pages(spark.createDataFrame(rows, "doc_id long, media binary").repartition(2)).collect()
    assert {r.doc_id for r in got if r.error} == set(range(1, len(rows) - 2)) and all(r.samples is None and r.width is None for r in got if r.error)
    assert {r.doc_id: sum(x.doc_id == r.doc_id for x in got) for r in got if r.doc_id in (0, 999)} == {0: 2, 999: 2}


def test_tiff_sizes_that_data_cannot_fill():
    media = bytearray(tiff.write(bytes(64 * 32)))
    for tag in (256, 257):
        huge = bytearray(media)
        at = huge.index(struct.pack("<HHI", tag, 4, 1)) + 8
        huge[at : at + 4] = struct.pack("<I", 0xFFFFFFFF)
        with pytest.raises(ValueError):
            list(tiff.pages(bytes(huge)))


def test_tiff_of_few_bits():
    for bits in (1, 2, 4):
        values = np.array([[rng.randrange(1 << bits) for _ in range(13)] for _ in range(5)], np.uint8)
        fine = np.unpackbits(values[..., None], axis=2)[..., 8 - bits :].reshape(5, -1)
        data = tiff.pack_bits(np.packbits(fine, axis=1).tobytes())
        tags = [(256, 13), (257, 5), (258, bits), (259, tiff.PACKBITS), (273, 8), (277, 1), (278, 5), (279, len(data))]
        at = 8 + len(data) + len(data) % 2
        media = b"II" + struct.pack("<HI", 42, at) + data.ljust(at - 8, b"\0") + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, 4, 1, v) for t, v in tags) + bytes(4)
        (page,) = tiff.pages(media)
        assert page["samples"] == values.tobytes() and page["bits"] == bits


def test_every_tiff_scheme_is_in_use(spark, sf_small):
    df = spark.read.parquet(f"{sf_small.replace('0.001', '0.01')}/documents.parquet")
    texts = {r.doc_id: r.text for r in df.collect()}
    got = tiff.media_digest(tiff.text_to_tiff(df)).collect()
    stored = {r.feature.rsplit("stored=")[1] for r in got}
    assert stored == {f"{how}/{p}/{layout}" for how in ("deflate", "lzw", "packbits", "none") for p in (1, 2) for layout in ("strips", "tiles")}
    assert len(got) == len(texts) and all(r.payload_sha256 == hashlib.sha256(tiff.payload_of(texts[r.doc_id])[0]).hexdigest() for r in got)


def test_tiff_digest(spark):
    texts = [None, "", "a", "é" * 32, "x" * 64, "x" * 65, prose(60000), "é" * 32]
    got = {r.doc_id: r for r in tiff.media_digest(tiff.text_to_tiff(frame(spark, texts))).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert got[3][1:] == got[7][1:] and got[3].media_sha256 != got[4].media_sha256
    pages = tiff.explode_pages(tiff.text_to_tiff(frame(spark, texts), compression=5, predictor=2, tile=64))
    rows = pages.where("doc_id = 6").orderBy("page").collect()
    assert len(rows) > 1 and b"".join(bytes(r.samples) for r in rows).rstrip(b"\0") == texts[6].encode()


def brute_containment(texts, items):
    def grams(words, n):
        return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}

    out = {}
    for j, item in enumerate(items):
        w = re.findall(r"\w+", (item or "").lower())
        if not w:
            continue
        n = min(5, len(w))
        want = grams(w, n)
        for i, t in enumerate(texts):
            have = grams(re.findall(r"\w+", (t or "").lower()), n)
            if len(want & have) / len(want) >= 0.8:
                out[i, j] = (len(want), len(want & have))
    return out


def test_decontamination_against_brute_force(spark, monkeypatch):
    items = [None, "", "...", "one", "alpha beta gamma", *[prose(rng.randrange(5, 60)) for _ in range(60)], "Été à la «plage» — où"]
    texts = [None, "", "one", "ONE, alpha beta; gamma x", "l'été à la plage où"]
    for k, item in enumerate(items[5:65]):
        w = item.split()
        cut = rng.randrange(0, max(1, len(w) // 4))
        texts.append(prose(300) + ". " + " ".join(w[: len(w) - cut]).upper() + ", " + prose(rng.randrange(0, 3000)))
        texts.append(prose(100) + "\n" + near(item, k % 3) + " " + prose(100))
    df = frame(spark, texts)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = brute_containment(texts, items)
    got = {(r.doc_id, r.item_id): (r.n_shingles, r.n_found) for r in decontam.contaminated(df, bench).collect()}
    assert got == want and len(want) > 60
    left = {r.doc_id for r in decontam.clean(df, bench).collect()}
    assert left == set(range(len(texts))) - {i for i, _ in want}
    monkeypatch.setattr(decontam, "BLOCK_ITEMS", 7)
    clash = df.withColumnsRenamed({"fp": "_placeloom_key", "shard": "key"})
    kept = decontam.clean(clash, bench)
    assert kept.columns == clash.columns and {r.doc_id for r in kept.collect()} == left
    got = {(r.doc_id, r.item_id): (r.n_shingles, r.n_found) for r in decontam.contaminated(df, bench).collect()}
    assert got == want
    assert decontam.contaminated(df, bench.limit(0)).count() == 0 == decontam.contaminated(df.limit(0), bench).count()


def test_word_hashes_in_pieces(monkeypatch):
    text = "Ab_c d—é " + prose(500) + " ١٢ 漢字 x"
    whole = decontam.word_hashes(text)
    assert len(whole) == len(re.findall(r"\w+", text.lower()))
    monkeypatch.setattr(decontam, "CHUNK", 41)
    assert (np.concatenate(list(decontam.Index.pieces(text))) == whole).all()


def test_shards_of_equal_sizes_are_split_by_rank(spark):
    """One size holds every group, so ranks within a size decide the shard."""
    texts = [f"{i:06d}" for i in range(700)] + ["x" * 300] * 40 + ["y" * 300] * 40 + ["z" * 300] * 40
    load = check_shards(shards.pack_into(frame(spark, texts), 6).collect(), texts, 6)
    big = 40 * 308
    assert sorted(load.values())[-3:] == [big] * 3  # three groups over an even share, one shard each
    rest = sorted(load.values())[:3]
    assert rest[-1] == 234 * 14 and rest[0] == 232 * 14  # full bins of the least capacity, and what is left


def test_plans_cover_every_group_once():
    for _ in range(150):
        histogram = defaultdict(int)
        for _ in range(rng.randrange(1, 40)):
            histogram[rng.choice([1, 2, 3, 5, 50, 51, 400])] += rng.randrange(1, 4)
        k = rng.randrange(1, 9)
        runs = pieces(h := shards.Histogram.of(histogram.items()), shards.plan_into(h, k))
        seen = defaultdict(list)
        for size, a, b, at in runs:
            assert 0 <= at < k and a < b
            seen[size] += range(a, b)
        assert {s: sorted(r) for s, r in seen.items()} == {s: list(range(n)) for s, n in histogram.items()}
