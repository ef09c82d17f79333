import itertools
import random

import xxhash

from tallymark.llm import simhash
from tallymark.llm.components import connected_components


def brute_fingerprint(text):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").translate(dict.fromkeys((9, 10, 11, 12, 13), " ")).split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    parent = {f: f for f in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(parent, 2):
        if (a ^ b).bit_count() <= 2:
            parent[find(a)] = find(b)
    return {f: find(f) for f in parent}


def check(df, rows):
    prints = [(i, brute_fingerprint(t)) for i, t in rows]
    roots = brute_components({f for _, f in prints})
    least = {}
    for i, f in prints:
        if i is not None:
            least[roots[f]] = min(i, least.get(roots[f], i))
    want = sorted((str(i), f, least.get(roots[f])) for i, f in prints)
    got = sorted((str(r["doc_id"]), r["fp"] % 2**64, r["component_id"]) for r in simhash.near_duplicate_groups(df).collect())
    assert got == want


def test_documents(documents, texts):
    check(documents, list(texts.items()))


def test_odd_rows(odd, nothing):
    check(odd, [(r["doc_id"], r["text"]) for r in odd.collect()])
    assert simhash.near_duplicate_groups(nothing).count() == 0


def test_masks_cover_the_radius():
    for radius in (1, 2, 3):
        masks = simhash.covering_masks(radius)
        for bits in itertools.combinations(range(0, 64, 3), radius):
            assert any(all(not m >> b & 1 for b in bits) for m in masks)


def test_links_of_a_large_group_of_near_copies(spark):
    random.seed(3)
    base = random.getrandbits(63)
    prints = {base ^ 1 << a ^ 1 << b for a, b in itertools.combinations(range(40), 2)} | {random.getrandbits(62) for _ in range(300)}
    links = simhash.fingerprint_links(spark.createDataFrame([(p,) for p in prints], "fp long"))
    rows = [(r["a"], r["b"]) for r in links.collect()]
    assert all((a % 2**64 ^ b % 2**64).bit_count() <= 2 for a, b in rows)
    assert len(rows) < 70 * len(prints)
    roots = {r["node"]: r["root"] for r in connected_components(links, "a", "b").collect()}
    want = brute_components(prints)
    for a, b in itertools.combinations(sorted(prints)[:200], 2):
        assert (roots.get(a, a) == roots.get(b, b)) == (want[a] == want[b])


def test_components_against_union_find(spark):
    random.seed(4)
    edges = [(random.randrange(400), random.randrange(400)) for _ in range(300)] + [(i, i + 1) for i in range(1000, 1100)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    assert got == {n: find(n) for n in list(parent)}


def test_keep_first(documents):
    groups = simhash.near_duplicate_groups(documents)
    want = {r["component_id"] for r in groups.collect()}
    kept = simhash.keep_first(documents)
    assert {r["doc_id"] for r in kept.collect()} == want and kept.columns == documents.columns
