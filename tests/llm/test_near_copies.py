"""SimHash, passages and lattice hashing against brute force on small tables."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from orderlens.llm import graph, lattice, passages, simhash


def classes(n, links):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return [root(i) for i in range(n)]


def test_connected(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(60)] + [(200 + rng.randrange(80), 200 + rng.randrange(80)) for _ in range(60)]
    links += [(300, 300 + i) for i in range(1, 40)] + [(7, 7), (3, 2), (2, 3)]
    got = {r["id"]: r["component"] for r in graph.connected(
        spark.createDataFrame(links, "a long, b long")).collect()}
    want = classes(400, links)
    assert got == {i: want[i] for pair in links if pair[0] != pair[1] for i in pair}
    assert graph.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_simhash_classes(spark):
    rng = random.Random(2)
    words = ["valve", "wafer", "seat", "EPDM", "gear", "disc", "iron"]
    texts = [" ".join(rng.choices(words, k=rng.choice([1, 2, 3, 4, 120]))) for _ in range(120)]
    texts += [texts[4].upper(), texts[9], "", None, " \t", "Ä ä", "valve " * 40_000]
    long = " ".join(rng.choices(words, k=400))
    texts += [long, long + " gear", long + " disc", "iron " + long]
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(3, texts[3], "x")],
                                 "row_id long, description string, fingerprint string")
    prints = [brute_fingerprint(t) for t in texts]
    want = classes(len(texts), [(i, j) for i in range(len(texts)) for j in range(i)
                                if (prints[i] ^ prints[j]).bit_count() <= 2])
    for shard in (3, 512):
        got = simhash.simhash_classes(rows, shard=shard).collect()
        assert len(got) == len(texts) + 1
        assert all(r["fingerprint"] == f"{prints[r['row_id']]:016x}"
                   and r["component_id"] == want[r["row_id"]] for r in got)
    assert simhash.simhash_classes(rows.limit(0)).count() == 0


def test_fingerprint_links_in_crowded_buckets(spark):
    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(30)]
    values = list({v ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) & (1 << 64) - 1
                   for v in base for _ in range(12)})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.fingerprint_links(spark.createDataFrame([(v,) for v in signed], "fingerprint long"),
                                      shard=4).collect()
    at = {v: i for i, v in enumerate(signed)}
    near = [(i, j) for i in range(len(values)) for j in range(i)
            if (values[i] ^ values[j]).bit_count() <= 2]
    found = [(at[r["a"]], at[r["b"]]) for r in links]
    assert {(max(p), min(p)) for p in found} <= set(near)
    assert classes(len(values), found) == classes(len(values), near)


def test_bk_tree():
    rng = random.Random(1)
    values = [rng.getrandbits(12) for _ in range(300)]
    tree = simhash.BKTree(values)
    for q in values[:40]:
        assert sorted(tree.within(q, 2)) == [i for i, v in enumerate(values) if (v ^ q).bit_count() <= 2]
    assert simhash.BKTree([]).within(3, 2) == []


def prose(rng, n):
    return [f"{rng.choice('abcdefgh')}{rng.randrange(4000)}" for _ in range(n)]


def test_compact_windows_cover_every_stretch():
    rng = np.random.default_rng(4)
    for n, high in ((5, 9), (60, 2 ** 60), (90, 2 ** 60), (40, 4)):
        hashes = rng.integers(0, high, n, dtype=np.uint64) << np.uint64(3)
        cover = {}
        for left, centre, right in passages.compact_windows(hashes, 10):
            assert right - left + 1 >= 10
            for i in range(left, centre + 1):
                for j in range(max(centre, i + 9), right + 1):
                    assert (i, j) not in cover
                    cover[i, j] = centre
        keyed = hashes >> np.uint64(n.bit_length())
        assert len(cover) == sum(n - w + 1 for w in range(10, n + 1))
        assert all(c == i + int(np.argmin(keyed[i:j + 1])) for (i, j), c in cover.items())


def test_passages(spark):
    rng = random.Random(6)
    shared, other, line = prose(rng, 60), prose(rng, 70), prose(rng, 30)
    edited = list(other)
    edited[35] = "changed"
    texts = [prose(rng, 100) + shared + prose(rng, 30), shared + prose(rng, 80), prose(rng, 9) + other,
             prose(rng, 120) + edited + prose(rng, 4), line + prose(rng, 90), prose(rng, 90) + line,
             prose(rng, 200), ["gear"] * 300, ["gear"] * 300, [], prose(rng, 40)]
    # a text that shares part of a passage only must not hide it: 10 holds 30 words of 11 and 12
    both = prose(rng, 60)
    texts += [prose(rng, 30) + both[15:45] + prose(rng, 30), both + prose(rng, 10), prose(rng, 20) + both]
    rows = spark.createDataFrame([(i, " ".join(t).upper() if i == 1 else "\n".join(t), 0) for i, t in enumerate(texts)]
                                 + [(99, None, 0), (None, " ".join(shared), 0)], "row_id long, description string, start int")
    got = {(r["row_id"], r["partner_id"]): r for r in passages.repeated_passages(rows).collect()}
    assert set(got) == {(1, 0), (3, 2), (8, 7), (13, 12)}
    assert (got[1, 0]["start"], got[1, 0]["stop"], got[1, 0]["partner_start"]) == (0, 60, 100)
    assert (got[3, 2]["start"], got[3, 2]["stop"]) == (120, 190) and got[3, 2]["similarity"] >= 0.8
    assert got[13, 12]["start"] == 20
    left = {r["row_id"]: r["description"] for r in passages.without_passages(
        rows, passages.repeated_passages(rows)).collect()}
    assert set(left) == {*range(14), 99, None} - {8}
    assert left[1].split() == [w.upper() for w in texts[1][60:]] and left[99] is None
    assert left[3].split() == texts[3][:120] + texts[3][190:] and left[6].split() == texts[6]
    assert passages.repeated_passages(rows.limit(0)).count() == 0
    assert passages.without_passages(rows.limit(0), passages.repeated_passages(rows.limit(0))).count() == 0


def test_many_holders_of_a_passage(spark):
    rng = random.Random(9)
    shared = prose(rng, 55)
    rows = spark.createDataFrame([(i, " ".join(prose(rng, 20) + shared + prose(rng, 20))) for i in range(150)],
                                 "row_id long, description string")
    got = passages.repeated_passages(rows).collect()
    assert {r["row_id"] for r in got} == set(range(1, 150)) and {r["partner_id"] for r in got} == {0}


def test_edited_passages_behind_unrelated_rows(spark):
    """Smaller rows hold every 30 words of both versions, so no stretch beside a centre is rare."""
    rng = random.Random(31)
    texts, pairs, hiding = [], [], []
    for k in range(6):
        one = prose(rng, 60)
        two = one[:30] + ["changed"] + one[31:]
        hiding += [prose(rng, 15) + v[i:i + 30] + prose(rng, 15) for v in (one, two) for i in range(31)]
        pairs.append((1000 + 2 * k, 1001 + 2 * k))
        texts += [(1000 + 2 * k, prose(rng, 10) + one), (1001 + 2 * k, two + prose(rng, 10))]
    rows = spark.createDataFrame([(i, " ".join(t)) for i, t in [*enumerate(hiding), *texts]],
                                 "row_id long, description string")
    got = {}
    for r in passages.repeated_passages(rows).collect():
        got.setdefault((r["partner_id"], r["row_id"]), set()).update(range(r["start"], r["stop"]))
    assert got == {p: set(range(60)) for p in pairs}


@pytest.mark.parametrize("shard", [7, 256])
def test_crowded_centres_meet_in_shards(spark, monkeypatch, shard):
    monkeypatch.setattr(passages, "SHARD", shard)
    rng = random.Random(14)
    line = prose(rng, 20)
    texts = [prose(rng, 40) + line + prose(rng, 40) for _ in range(120)]
    for i in range(60, 120, 3):  # an exact passage around the line, and copies of another
        at = rng.randrange(60)
        texts[i] = texts[i][:30] + texts[at][20:80] + texts[i][70:]
    texts += [texts[5], texts[61], texts[61]]
    rows = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)],
                                 "row_id long, description string")
    held = {}
    for i, t in enumerate(texts):
        for j in range(len(t) - 49):
            held.setdefault(tuple(t[j:j + 50]), []).append((i, j))
    got = {}
    for r in passages.repeated_passages(rows).collect():
        assert r["partner_id"] < r["row_id"]
        got.setdefault(r["row_id"], set()).update(range(r["start"], r["stop"]))
    want = {}
    for places in held.values():
        for i, j in places[1:]:
            want.setdefault(i, set()).update(range(j, j + 50))
    assert set(got) == set(want) and all(got[i] >= want[i] for i in want)


def test_explained_windows_stay_partners(spark):
    """A = P + L, B = P + L + Q, C = R + L + Q: C shares the 50 words L + Q with B only."""
    rng = random.Random(45)
    texts = []
    for _ in range(120):
        p, line, q, r = prose(rng, 40), prose(rng, 45), prose(rng, 5), prose(rng, 40)
        texts += [p + line, p + line + q, r + line + q]
    rows = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)],
                                 "row_id long, description string")
    got = {(r["row_id"], r["partner_id"]): (r["start"], r["stop"])
           for r in passages.repeated_passages(rows).collect()}
    for k in range(0, 360, 3):
        assert got[k + 1, k] == (0, 85) and got[k + 2, k + 1] == (40, 90)
    assert len(got) == 240


def test_passage_whose_lines_stand_alone_earlier():
    def spans(one, other):
        hashed = [passages.shingle_hashes([w.encode() for w in t], {}) for t in (one, other)]
        return {(a, b + 5, c, d + 5) for a, b, c, d, _ in passages.similar_passages(*hashed, 46, 0.8)}

    for seed in range(30):
        rng = random.Random(seed)
        passage, noise = prose(rng, 50), [prose(rng, 40) for _ in range(5)]
        head, tail = passage[:10], passage[35:]
        # the opening line earlier, after the same word, and all words earlier in two pieces
        for other in (head + noise[0] + passage, noise[1][-1:] + head + noise[0] + passage,
                      passage[:30] + noise[0] + passage[20:] + noise[2] + passage,
                      tail + noise[0] + head + noise[2] + passage + noise[3]):
            at = next(i for i in range(len(other)) if other[i:i + 50] == passage)
            assert (40, 90, at, at + 50) in spans(noise[1] + passage + noise[4], other)
        long = passage + prose(rng, 40)
        edited = long[:60] + ["changed"] + long[61:]
        assert (40, 130, 50, 140) in spans(noise[1] + edited, head + noise[0] + long)
        # two equal passages of the partner overlap in one
        p, line, q = prose(rng, 20), prose(rng, 45), prose(rng, 5)
        got = spans(p + line + q, p + line + noise[0] + line + q)
        assert {(0, 65, 0, 65), (20, 70, 105, 155)} <= got


def brute_links(vectors, least):
    units = [lattice.unit_vector(v) for v in vectors]
    return [(i, j) for i, u in enumerate(units) for j, w in enumerate(units) if i != j
            and u is not None and w is not None and len(u) == len(w) and u @ w >= least]


@pytest.mark.parametrize("shard", [7, 256])
def test_lattice_links(spark, shard):
    rng = np.random.default_rng(3)
    vectors = [rng.standard_normal(24).round(3).tolist() for _ in range(80)]
    for i in range(40):  # crowds of near and of equal vectors
        vectors.append((np.array(vectors[i % 3]) + rng.standard_normal(24) * 0.04).tolist())
        vectors.append(vectors[5])
    vectors += [(2.5 * np.array(vectors[7])).tolist(), None, [], [0.0] * 24, [float("nan")] * 24,
                [None] * 24, [float("inf")] + [1.0] * 23, vectors[1][:12], [1e-170] * 24, [1.0] * 24, [-0.0] * 24]
    schema = "point_id long, vector array<double>, n_links int"
    points = spark.createDataFrame([(i + 10, v, 0) for i, v in enumerate(vectors)], schema)
    got = {r["point_id"] - 10: r for r in lattice.lattice_links(points, shard=shard).collect()}
    links = brute_links(vectors, 0.95)
    want = classes(len(vectors), links)
    counts = np.bincount([a for a, _ in links], minlength=len(vectors))
    assert len(got) == len(vectors)
    assert [got[i]["n_links"] for i in range(len(vectors))] == counts.tolist()
    assert [got[i]["component_id"] - 10 for i in range(len(vectors))] == want
    assert all(got[i]["kept"] == (want[i] == i) for i in got)
    assert lattice.lattice_links(points.limit(0)).count() == 0


def test_lattice_recall_at_the_limit(spark):
    rng = np.random.default_rng(12)
    one = rng.standard_normal((400, 64))
    one /= np.linalg.norm(one, axis=1, keepdims=True)
    side = rng.standard_normal((400, 64))
    side -= (side * one).sum(1, keepdims=True) * one
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    two = 0.951 * one + (1 - 0.951 ** 2) ** 0.5 * side
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.concatenate([one, two]))],
                                   "point_id long, vector array<double>")
    found = lattice.lattice_links(points).filter(F.col("n_links") > 0).count()
    assert found >= 0.97 * 800


def test_nearest_e8_point():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((200, 8)) * 2
    near = lattice.nearest_e8(x)
    steps = lattice.roots()
    assert len(steps) == 240 and ((steps ** 2).sum(1) == 2).all()
    assert ((x - near) ** 2).sum(1).max() <= 1 + 1e-9
    best = ((x[:, None] - near[:, None] - steps) ** 2).sum(2).min(1)
    assert (((x - near) ** 2).sum(1) <= best + 1e-9).all()
