import random
import re

import numpy as np
import xxhash
from evigraph.llm import simhash


def slow_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not ws:
        return 0
    shingles = [" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(marks):
    """Smallest id reachable over fingerprints at most two bits apart."""
    parts = {f: f for f in {f for _, f in marks}}

    def find(x):
        while parts[x] != x:
            x = parts[x]
        return x

    fs = sorted(parts)
    for i, a in enumerate(fs):
        for b in fs[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                parts[find(b)] = find(a)
    least = {}
    for i, f in marks:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return [least.get(find(f)) for _, f in marks]


def test_matches_brute_force(odd, odd_rows):
    got = sorted(((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in simhash.near_duplicates(odd).collect()), key=str)
    marks = [(r[0], slow_fingerprint(r[1])) for r in odd_rows]
    want = sorted(((i, f, c) for (i, f), c in zip(marks, slow_components(marks), strict=True)), key=str)
    assert got == want


def test_spark_hash_agrees(spark):
    from pyspark.sql import functions as F

    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] % (1 << 64) == xxhash.xxh64_intdigest(b"a b c", 42)


def test_hot_buckets_are_linked_exactly(spark):
    rng = random.Random(1)
    center = rng.getrandbits(64)
    near = {center ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(300)}
    near |= {center ^ sum(1 << b for b in rng.sample(range(64), 5)) for _ in range(200)} | {rng.getrandbits(64) for _ in range(50)}
    fps = sorted(near)
    signed = [f - (1 << 64) if f >= 1 << 63 else f for f in fps]
    for limit in (4, 1000):  # all buckets by stand-ins, then all by pairs
        edges = simhash.hamming_links(spark.createDataFrame([(f,) for f in signed], "fp long"), limit).collect()
        parent = {f: f for f in signed}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for e in edges:
            assert ((e.u ^ e.v) % (1 << 64)).bit_count() <= 2
            parent[find(e.u)] = find(e.v)
        groups = {}
        for f in signed:
            groups.setdefault(find(f), set()).add(f % (1 << 64))
        want = {}
        for f, c in zip(fps, slow_components([(f, f) for f in fps]), strict=True):
            want.setdefault(c, set()).add(f)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_keep_one_and_odd_tables(odd, empty, clashing):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(1) == 1 and 2 not in ids and ids.count(6) == 1 and 4 in ids and 8 not in ids
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0
    assert simhash.near_duplicates(clashing).count() == odd.count()


def five_word_sets(rows):
    sets = {}
    for i, text in rows:
        ws = text.lower().split()
        sets[i] = {tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))}
    return sets


def similar_least(sets):
    """Smallest id reachable over pairs of Jaccard similarity 0.8 or more."""
    least = {i: i for i in sets}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                least[b] = a
    return {find(i) for i in sets}


def test_keep_one_finds_all_similar_pairs(spark, monkeypatch):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    shared, rows = " ".join(rng.choices(vocabulary, k=12)), []
    for size, copies in ((120, 30), (400, 8), (9, 6), (60, 6), (1500, 4)) * 2:
        base = rng.choices(vocabulary, k=size)
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randint(0, max(1, size // 45))):
                text[rng.randrange(size)] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(text)))
    rows += [(len(rows) + k, shared + " " + " ".join(rng.choices(vocabulary, k=5 + k))) for k in range(20)]
    sets = five_word_sets(rows)
    want = similar_least(sets)
    marks = {i: slow_fingerprint(t) for i, t in rows}
    far = [(i, j) for i in sets for j in sets if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and (marks[i] ^ marks[j]).bit_count() > 2]
    assert len(far) > 50 and len(want) < len(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == want
    # groups in one part or many, and groups that go by way of central sets
    for group, part in ((1 << 14, 4), (2, 256), (2, 3)):
        monkeypatch.setattr(simhash, "GROUP", group)
        monkeypatch.setattr(simhash, "PART", part)
        assert {r.doc_id for r in simhash.keep_one(docs).collect()} == want
    # if the central sets are similar to none, the members of a block still meet each other
    monkeypatch.setattr(simhash, "_close", lambda pairs, facts: pairs.limit(0))
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == want


def test_min_wise_blocks_meet_and_codes_are_near():
    rng = np.random.default_rng(5)
    far = []
    for n in (1, 4, 9, 60, 3000):
        for _ in range(100):
            shared = rng.integers(0, 1 << 63, n * 8 // 9 + 1, dtype=np.uint64)
            one, two = (np.unique(np.concatenate([shared, rng.integers(0, 1 << 63, n // 9, dtype=np.uint64)])) for _ in range(2))
            (k, c), (j, d) = simhash.min_wise(one), simhash.min_wise(two)
            assert (k == j).any()
            far.append(sum(((x ^ y) % (1 << 64)).bit_count() for x, y in zip(c.tolist(), d.tolist(), strict=True)))
    assert max(far) <= simhash.FAR_BITS


def test_keep_one_with_repeated_ids_and_nulls(spark):
    words = "one two three four five six seven eight nine ten"
    other = "red orange yellow green blue indigo violet black white gray"
    rows = [(1, words), (1, words), (1, other), (2, words.upper()), (3, other + " "), (None, "alpha beta"), (None, "alpha  beta"), (None, None), (4, ""), (5, "gamma")]
    kept = [tuple(r) for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(kept) == 5 and (1, words) in kept and (1, other) in kept and (4, "") in kept and (5, "gamma") in kept
    assert sum(i is None for i, _ in kept) == 1
