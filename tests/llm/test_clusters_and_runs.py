"""Centroid clustering, SimHash near duplicates and periodic runs against brute force, and on odd tables."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rulefold.llm import centroids, periodic, queries, simhash
from tests.llm.conftest import prose

# 11 Centroid clustering


def brute_clusters(rows, dimensions, clusters, rounds, scale=1024, seed=3):
    usable = [(k, [int(np.floor(scale * float(x))) for x in v]) for k, v in rows if v is not None and len(v) == dimensions and all(x is not None and np.isfinite(x) for x in v)]
    name = lambda k: hashlib.sha256(f"{seed}:{'' if k is None else k}".encode()).hexdigest()
    centres = [v for _, v in sorted(usable, key=lambda r: (name(r[0]), r[1]))[:clusters]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min((far(v, c), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in usable]
        for j in range(len(centres)):
            members = [v for (_, v), o in zip(usable, own, strict=True) if o == j]
            if members:
                centres[j] = [sum(col) // len(members) for col in zip(*members, strict=True)]
    return sorted((str(k), *nearest(v)[::-1]) for k, v in usable), centres


@pytest.mark.parametrize("grain", [0.002, 0.5])  # the coarse one is full of ties
def test_clusters_against_all_distances(spark, grain):
    rng = np.random.RandomState(4)
    points = np.round(rng.randn(400, 6) / grain) * grain / 4
    rows = [(i, p.tolist()) for i, p in enumerate(points)]
    got, centres = centroids.cluster(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), dimensions=6)
    want, want_centres = brute_clusters(rows, 6, 8, 10)
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in got.collect()) == want
    assert centres.tolist() == want_centres


def test_clusters_of_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [0.0, 0.0]), (2, None), (3, []), (4, [1.0]), (5, [1.0, None]), (6, [nan, 1.0]), (7, [-inf, 1.0]), (8, [1.0, 2.0, 3.0]), (9, [-0.0004, 100000.5])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").select("*", F.lit(1).alias("cluster"), F.lit("own").alias("x"))
    got, centres = centroids.cluster(df, dimensions=2, clusters=8)
    rows = [(k, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for k, v in rows]
    want, want_centres = brute_clusters(rows, 2, 8, 10)
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in got.collect()) == want and centres.tolist() == want_centres
    none, centres = centroids.cluster(df.limit(0), dimensions=2)
    assert none.count() == 0 and len(centres) == 0 and none.columns == ["vec_id", "cluster", "distance"]
    with pytest.raises(Exception, match="too large"):
        centroids.cluster(spark.createDataFrame([(1, [1e30, 0.0])], "vec_id bigint, embedding array<double>"), dimensions=2)


def test_bounds_skip_distances_and_change_nothing():
    rng = np.random.RandomState(5)
    x = np.concatenate([rng.randint(-60, 60, (300, 16)) + centre for centre in rng.randint(-2000, 2000, (8, 16))])
    c = x[rng.choice(len(x), 8, replace=False)]
    state = centroids.first_bounds(x, c)
    for _ in range(6):
        now = np.stack([x[state.cluster == j].mean(axis=0).astype(np.int64) if (state.cluster == j).any() else c[j] for j in range(8)])
        state, taken = centroids.assigned(x, now, np.sqrt(centroids.squared(now, c).astype(float)) * (1 + 2**-48), state)
        exact = np.stack([centroids.squared(x, own) for own in now], axis=1)
        assert (state.cluster == exact.argmin(axis=1)).all()
        assert (state.upper**2 >= exact.min(axis=1)).all() and (state.lower**2 <= exact).all()
        c = now
    assert taken < len(x) * 8 / 4


def test_cluster_query_agrees_with_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{d}/embeddings.parquet'")
    columns = "vec_id cluster distance cluster_inertia inertia centroid_sha256".split()
    want = sorted(con.execute(f"select {', '.join(columns)} from ({queries.ORACLE['op11_centroids']})").fetchall())
    assert sorted(map(tuple, queries.QUERIES["op11_centroids"](spark, d).select(*columns).collect())) == want and want


# 12 SimHash


def brute_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(keys, prints, radius=4):
    group = list(range(len(keys)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(keys)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                group[root(i)] = root(j)
    least = {}
    for i, k in enumerate(keys):
        if k is not None:
            least[root(i)] = min(k, least.get(root(i), k))
    return [least.get(root(i)) for i in range(len(keys))]


def unsigned(x):
    return x % 2**64


def test_simhash_against_all_pairs(spark):
    rng = random.Random(9)
    rows = []
    for g in range(12):
        base = prose(300 + g, 150 + 30 * g).split()
        for _ in range(rng.randint(1, 12)):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = f"edit{rng.random()}"
            rows.append((len(rows), " ".join(w).upper() if rng.random() < 0.2 else "\t ".join(w)))
    prints = [brute_fingerprint(t) for _, t in rows]
    got = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [unsigned(got[i].simhash) for i in range(len(rows))] == prints
    want = brute_components(range(len(rows)), prints)
    assert [got[i].component_id for i in range(len(rows))] == want
    assert 12 < len(set(want)) < len(rows)  # some near ones link, some do not


@pytest.mark.parametrize("target", [64, 1 << 19])  # the small one splits starts down to single variants
def test_links_of_dense_fingerprints(spark, target):
    rng = random.Random(3)
    prints = set()
    for _ in range(4):
        centre = rng.getrandbits(64)
        prints |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(12)}
    prints |= {0, 15, 31, 2**63, 2**64 - 1}
    prints = sorted(prints)
    df = spark.createDataFrame([(p - 2**64 if p >> 63 else p,) for p in prints], "f bigint")
    found = simhash.links(df, target=target, step=29).collect()
    assert all(bin(unsigned(r.u) ^ unsigned(r.v)).count("1") for r in found)
    group = {p: p for p in prints}
    for _ in prints:
        for r in found:
            u, v = unsigned(r.u), unsigned(r.v)
            group[u] = group[v] = min(group[u], group[v])
    assert [group[p] for p in prints] == brute_components(prints, prints)
    with pytest.raises(ValueError):
        simhash.links(df, radius=3)


def test_simhash_of_odd_rows(odd, odd_rows):
    prints = [brute_fingerprint(r[1]) for r in odd_rows]
    want = brute_components([r[0] for r in odd_rows], prints)
    got = simhash.near_duplicates(odd).collect()
    assert sorted((str(r.doc_id), unsigned(r.simhash), r.component_id or -1) for r in got) == sorted((str(r[0]), p, c or -1) for r, p, c in zip(odd_rows, prints, want, strict=True))
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


# 13 Periodic runs


def brute_runs(words, least=24, times=3):
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((a, b - a, q) for (a, b), q in found.items())


def odd_sequence(rng):
    out = []
    for _ in range(rng.randint(1, 6)):
        kind, letters = rng.random(), "abcdefgh"[: rng.randint(1, 8)]
        if kind < 0.5:
            unit = [rng.choice(letters) for _ in range(rng.randint(1, 14))]
            out += (unit * rng.randint(2, 30))[: rng.randint(5, 120)]
        else:
            out += [rng.choice(letters) for _ in range(rng.randint(1, 40))]
    return out


def test_runs_against_every_period():
    rng = random.Random(11)
    some = 0
    for _ in range(300):
        words = odd_sequence(rng)
        ids = np.array([ord(w) for w in words])
        want = brute_runs(words)
        assert [tuple(r) for r in periodic.runs(ids).tolist()] == want
        some += len(want) > 1
    assert some > 50
    morse = [bin(i).count("1") % 2 for i in range(4096)]
    assert not len(periodic.runs(np.array(morse)))
    fibonacci, before = [1, 2], [1]
    while len(fibonacci) < 1500:
        fibonacci, before = fibonacci + before, fibonacci
    assert [tuple(r) for r in periodic.runs(np.array(fibonacci)).tolist()] == brute_runs(fibonacci)
    assert periodic.runs(np.zeros(100_000, np.int64)).tolist() == [[0, 100_000, 1]]
    assert periodic.least_overlap() == 16
    with pytest.raises(ValueError):
        periodic.runs(np.arange(5), times=2)


def planted(key, text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    h, n = zlib.crc32(str(key).encode()) if key is not None else 1, len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def brute_report(key, text):
    words = planted(key, text)
    runs = brute_runs(words)
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    kept = " ".join(w for i, w in enumerate(words) if i not in drop)
    return (key, len(runs), *best, runs and 1000 * best[1] // best[2] or None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(kept))


def test_periodic_query_against_every_period(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, "  ".join(odd_sequence(rng)) + rng.choice(["", "\n", "\x0b x"])) for i in range(60)]
    rows += [(100 + i, prose(i, rng.randint(0, 150))) for i in range(60)]
    rows += [(None, "a " * 40), (-7, None), (-7, ""), (-8, " \t\x0b\n"), (5, "x " * 23), (5, "x " * 24), (6, "x " * 30), (7, "Ää öß " * 20)]
    spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("runs", F.lit("own")).write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in queries.QUERIES["op13_periodic"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted((brute_report(*r) for r in rows), key=str)
    assert sum(r[1] > 0 for r in got) > 20


def test_periodic_on_odd_rows(odd, odd_rows):
    docs = odd.withColumn("Runs", F.lit("own"))
    got = periodic.collapsed(docs).collect()
    assert sorted((str(r.doc_id), r.n_words) for r in got) == sorted((str(r[0]), len((r[1] or "").split())) for r in odd_rows)
    assert "Runs" not in periodic.collapsed(docs).columns and periodic.collapsed(docs.limit(0)).count() == 0
