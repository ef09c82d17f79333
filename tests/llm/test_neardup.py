import itertools
import random

import corpus_pipeline
import numpy as np
import xxhash

from conftest import SF
from tallymark.llm import neardup


def grams(text):
    words = text.lower().split()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def jaccard(a, b):
    return len(grams(a) & grams(b)) / len(grams(a) | grams(b))


def copies(seed, n_words, edits):
    """A text, and near copies of it with 1 to ``edits`` words changed."""
    draw = random.Random(seed)
    base = [f"w{draw.randrange(5000)}" for _ in range(n_words)]
    texts = [base]
    for n in range(1, edits + 1):
        own = list(base)
        for at in draw.sample(range(n_words), n):
            own[at] = f"x{seed}_{n}_{at}"
        texts.append(own)
    return [" ".join(t) for t in texts]


def test_the_stage_drops_all_near_copies(spark):
    """Short texts have no passage of 50 words, so no later stage would find their copies."""
    texts = [t for seed in range(60) for t in copies(seed, 45 if seed % 2 else 200, 5)]
    random.Random(1).shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.one_of_each_group(spark, df, SF).collect()}
    near = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if jaccard(texts[a], texts[b]) >= 0.8]
    assert len(near) > 200 and not [p for p in near if p[0] in kept and p[1] in kept]
    assert {b for _, b in near} >= set(range(len(texts))) - kept


def test_fingerprints_link_without_bands(spark, monkeypatch):
    """Near copies within two bits meet by their fingerprints; far texts with the same fingerprint are not linked."""
    def sketch(rows, same=None):
        sets = [(doc_id, neardup.shingle_set(text)) for doc_id, text in rows]
        return [(doc_id, str(doc_id).encode(), neardup.fingerprint(own) if same is None else same, []) for doc_id, own in sets]

    monkeypatch.setattr(neardup, "_sketch", lambda rows: sketch(rows))
    texts = [t for seed in range(40) for t in copies(seed, 600, 1)]
    prints = [neardup.fingerprint(neardup.shingle_set(t)) for t in texts]
    ones = [((neardup.shingle_set(texts[0])[:, None] >> np.uint64(bit)) & np.uint64(1)).sum() for bit in range(64)]
    assert [2 * int(n) > len(neardup.shingle_set(texts[0])) for n in ones] == [bool(prints[0] >> bit & 1) for bit in range(64)]
    within = {b for a, b in itertools.combinations(range(80), 2) if (prints[a] ^ prints[b]).bit_count() <= 2 and jaccard(texts[a], texts[b]) >= 0.8}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r["doc_id"] for r in neardup.keep_first(df).collect()}
    assert len(within) >= 10 and set(range(80)) - kept == within
    monkeypatch.setattr(neardup, "_sketch", lambda rows: sketch(rows, 5))
    far = spark.createDataFrame([(n, copies(100 + n, 60, 0)[0]) for n in range(5)], "doc_id long, text string")
    assert neardup.keep_first(far).count() == 5


def test_the_first_of_a_band_is_not_the_only_one_compared(spark, monkeypatch):
    """All share every band: the first is near to none, the others are near in twos."""
    monkeypatch.setattr(neardup, "bands", lambda own: [1, 2])
    texts = [copies(0, 80, 0)[0]] + [t for seed in range(1, 12) for t in copies(seed, 80, 1)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in neardup.keep_first(df).collect()} == {0, *range(1, 23, 2)}


def test_many_near_copies_and_odd_rows(spark, odd, nothing):
    base = [f"w{n}" for n in range(300)]
    rows = [(n, " ".join(base[:n] + [f"x{n}"] + base[n + 1:])) for n in range(300)] + [(n, "Same  text here") for n in range(900, 1000)] + [(None, "same text here")]
    kept = neardup.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["0", "900", "None"]
    assert neardup.keep_first(odd).columns == odd.columns and neardup.keep_first(nothing).count() == 0


def test_min_hashes_of_several_sets_in_one_array(monkeypatch):
    monkeypatch.setattr(neardup, "_AT_ONCE", 300)
    texts = ["", "a b", " ", *(" ".join(f"{k}w{n}" for n in range(size)) for k, size in enumerate((5, 200, 3, 900, 40)))]
    sets = neardup.shingle_sets(texts)
    assert [own.tolist() for own in sets] == [neardup.shingle_set(t).tolist() for t in texts]
    found = [neardup.bands(least) for least in neardup.min_hashes(sets)]
    assert [len(keys) for keys in found] == [24 if len(own) else 0 for own in sets]
    for own, keys in zip(sets, found, strict=True):
        mixed = own ^ own >> np.uint64(29)
        for band, key in enumerate(keys):
            least = [min(int(v ^ v >> np.uint64(32)) for v in mixed * f) for f in neardup._FACTORS[4 * band:4 * band + 4]]
            assert key == xxhash.xxh64_intdigest(np.array(least, np.uint64).tobytes(), seed=band) - (1 << 63)
