"""SimHash near-duplicates against brute force."""

import random

import xxhash

from strandframe.llm import simhash


def plain(text):
    import re

    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    n = min(3, len(words))
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i : i + n]), seed=42) for i in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(fps):
    """Smallest member reachable, over all pairs."""
    label = {f: f for f in fps}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    fps = sorted(fps)
    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                ra, rb = sorted((root(a), root(b)))
                label[rb] = ra
    return {f: root(f) for f in fps}


def test_documents(spark):
    rng = random.Random(1)
    words = ["ab", "Cd", "éÉ", "x", "Y1", "z", "q"]
    texts = [None, "", " \t\n", "one", "one two", "ONE two\x0bthree", "a b  c", "w " * 70000]
    base = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(6)]
    for b in base:
        for _ in range(8):
            w = b.split(" ")
            w[rng.randrange(60)] = rng.choice(words)
            texts.append(" ".join(w))
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, base[0], None), (7, "a b  c", "again"), (7, "a b  c", "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    want_fp = [plain(t) for _, t, _ in rows]
    comp = components(set(want_fp))
    low = {}
    for (i, _, _), f in zip(rows, want_fp):
        if i is not None:
            low[comp[f]] = min(low.get(comp[f], i), i)
    want = sorted(((i, f"{f:016x}", low.get(comp[f])) for (i, _, _), f in zip(rows, want_fp)), key=repr)
    got = sorted((tuple(r) for r in simhash.near_duplicates(df).collect()), key=repr)
    assert got == want
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_links_in_a_crowd_and_outside(spark, monkeypatch):
    """Crowded index entries take the other way; components are those of all pairs."""
    rng = random.Random(2)
    fps = set()
    for _ in range(5):
        f = rng.getrandbits(64)
        for _ in range(200):
            g = f
            for _ in range(rng.choice((1, 1, 2, 3, 6))):
                g ^= 1 << rng.randrange(64)
            fps.add(g)
    fps |= {rng.getrandbits(64) for _ in range(300)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long").repartition(3)
    want = components(fps)
    for crowd in (64, 3, 10**9):
        monkeypatch.setattr(simhash, "CROWD", crowd)
        label = {f: f for f in fps}
        edges = [(a & (1 << 64) - 1, b & (1 << 64) - 1) for a, b in map(tuple, simhash.links(df).collect())]
        assert all((a ^ b).bit_count() <= 2 for a, b in edges)
        changed = True
        while changed:
            changed = False
            for a, b in edges:
                m = min(label[a], label[b])
                changed |= label[a] != m or label[b] != m
                label[a] = label[b] = m
        assert label == want


def test_allot():
    assert simhash.allot([{-1: 0, 0: 5, 1: 50, 2: 99}] * 2, 1)[0] == 55
    cost, ts = simhash.allot([{-1: 0, 0: 90, 1: 95, 2: 200}, {-1: 0, 0: 10, 1: 30, 2: 99}, {-1: 0, 0: 10, 1: 30, 2: 99}], 0)
    assert (cost, sorted(ts)) == (40, [-1, 0, 1]) and ts[0] == -1
