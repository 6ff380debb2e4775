import numpy as np
import pytest
from pyspark.sql import functions as F

from keystride.llm import graph_search, oracle, projection_dedup

SCHEMA = "vec_id bigint, embedding array<float>, label int"
NAN, INF = float("nan"), float("inf")


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def clustered(n, seed, noise=0.08, dims=16):
    """Vectors with exact and near copies among them."""
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, dims)).astype(np.float32)
    for i in range(n // 3):
        x[-i - 1] = x[i // 5] + (noise * draw.normal(size=dims) if i % 3 else 0)
    return x


def brute_links(rows, threshold=0.93):
    """n_links and component of each row."""
    def usable(v, label):
        return v is not None and label is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and any(v)

    n = len(rows)
    links, parent = [set() for _ in rows], list(range(n))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(n):
        for j in range(i):
            (_, a, la), (_, b, lb) = rows[i], rows[j]
            if usable(a, la) and usable(b, lb) and la == lb and len(a) == len(b):
                a, b = np.array(a, float), np.array(b, float)
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold:
                    links[i].add(j)
                    links[j].add(i)
                    parent[find(i)] = find(j)
    least = {}
    for i, (v, *_) in enumerate(rows):
        if v is not None:
            least[find(i)] = min(v, least.get(find(i), v))
    return sorted((repr(rows[i][0]), len(links[i]), least.get(find(i))) for i in range(n))


def grouped(spark, rows, **options):
    got = projection_dedup.group(spark.createDataFrame(rows, SCHEMA), **options).collect()
    assert all(r.kept == (r.component_id is None or r.vec_id == r.component_id) for r in got)
    return sorted((repr(r.vec_id), r.n_links, r.component_id) for r in got)


def test_links_and_classes_equal_brute_force(spark):
    rows = [(i, v.tolist(), int(i % 4)) for i, v in enumerate(clustered(400, 1))]
    assert grouped(spark, rows) == brute_links(rows)


def isolated_pairs(n, seed, dims=24, cosine=0.932):
    """Pairs just above the threshold, unlike all other vectors."""
    draw = np.random.default_rng(seed)
    a = unit(draw.normal(size=(n, dims)))
    b = draw.normal(size=(n, dims))
    b = unit(b - (a * b).sum(axis=1, keepdims=True) * a)
    both = np.concatenate([a, cosine * a + np.sqrt(1 - cosine ** 2) * b])
    return [(i, v.tolist(), 0) for i, v in enumerate(both)]


def test_passes_grow_with_the_label(spark):
    rows = isolated_pairs(1500, 4)
    linked = lambda got: sum(n > 0 for _, n, _ in got) / len(rows)
    few = linked(grouped(spark, rows, window=2, block=64, passes=projection_dedup.PASSES))
    grown = linked(grouped(spark, rows, window=2, block=64))
    # log2(3000 / 2) leading bits of 0.88 each agree in one of 14 passes for 98 % of pairs at most.
    assert few < 0.985 <= grown
    sizes = spark.createDataFrame([(10,), (10_000,), (10 ** 7,), (10 ** 9,)], "n bigint")
    got = [r.p for r in sizes.select("n", projection_dedup.passes_of(F.col("n")).alias("p")).orderBy("n").collect()]
    assert got[:2] == [14, 14] and 14 < got[2] < got[3] < 100


def test_sql_counts_the_same_links(spark, answers, plain):
    rows = [(i, v.tolist(), int(i % 4)) for i, v in enumerate(clustered(300, 6))]
    rows += [(300, None, 1), (301, [0.0] * 16, 1), (302, rows[5][1], None), (303, [1.0, None], 2), (304, [NAN, 1.0], 2), (None, rows[7][1], 3), (7, rows[7][1], 3)]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert plain(projection_dedup.group(frame)) == answers(oracle.projection_dedup(), embeddings=frame)


def test_windows_across_blocks(spark):
    rows = [(i, v.tolist(), 0) for i, v in enumerate(clustered(300, 2))]
    want = brute_links(rows)
    got = grouped(spark, rows, window=60, block=64, passes=20)
    assert sum(n for _, n, _ in got) >= 0.95 * sum(n for _, n, _ in want)
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    with pytest.raises(ValueError):
        projection_dedup.group(spark.createDataFrame(rows[:2], SCHEMA), window=8, block=4).count()


def test_links_of_a_crowd_larger_than_the_windows(spark):
    draw = np.random.default_rng(3)
    # Distinct vectors around one: some pairs of them are within the threshold, some are not.
    x = draw.normal(size=16) + 0.22 * draw.normal(size=(700, 16))
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x.astype(np.float32))]
    rows += [(1000 + i, rows[i][1], 0) for i in range(5)]
    want = brute_links(rows)
    assert max(n for _, n, _ in want) > 300
    assert grouped(spark, rows, window=32, block=64) == want


def test_chunks_of_a_class_count_each_pair_once(spark):
    x = np.random.default_rng(4).normal(size=(60, 3))
    rows = [(i, 7, 60, 1 + i % 3, v.tolist()) for i, v in enumerate(x)] + [(100 + i, 8 + i // 3, 3, 1, x[i].tolist()) for i in range(9)]
    frame = spark.createDataFrame(rows, "key bigint, root bigint, size bigint, n bigint, vector array<double>")
    got = {r.key: r.links for r in projection_dedup.count_links(frame, 0.5, least_chunk=8, most_chunk=16).collect()}
    want = {}
    for k, root, _, _, a in rows:
        near = [n for other, r, _, n, b in rows if r == root and other != k and unit(np.array([a]))[0] @ unit(np.array([b]))[0] >= 0.5]
        if near:
            want[k] = sum(near)
    assert got == want


ODD = [
    (1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [1.0, None], 0), (5, [NAN, 1.0], 0), (6, [INF, 1.0], 0),
    (7, [1.0, 1.0], None), (8, [1.0, 1.0], 0), (9, [2.0, 2.0], 0), (10, [1.0, 1.0], 0), (10, [1.0, 1.0], 0), (11, [1.0, 1.0], 1),
    (12, [1.0, 1.0, 1.0], 0), (None, [1.0, 1.01], 0), (None, [5.0, -1.0], 0), (13, [1e-30, 1e-30], 0), (14, [-1.0, -1.0], 0),
    (15, [3e38, 3e38], 0), (16, [0.0, -0.0], 0),
]


def test_odd_vectors(spark):
    assert grouped(spark, ODD) == brute_links(ODD)
    assert grouped(spark, [(1, [1.0], 0)]) == [("1", 0, 1)]
    assert projection_dedup.group(spark.createDataFrame([], SCHEMA)).count() == 0


def brute_nearest(rows, k=5, every=5):
    known = [(i, np.array(v, float)) for i, v in rows]
    out = {}
    for q, a in known:
        if q % every == 0:
            near = sorted((-float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), i) for i, b in known if i != q and len(b) == len(a))
            out[q] = [(i, -s) for s, i in near[:k]]
    return out


def searched(spark, rows, **options):
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("rank", F.lit(0))
    got = {}
    for r in graph_search.search(frame, F.col("vec_id") % 5 == 0, **options).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return got


@pytest.mark.parametrize("shard_rows", [2048, 150])
def test_recall_against_brute_force(spark, shard_rows):
    rows = [(i, v.tolist()) for i, v in enumerate(clustered(900, 4))]
    want, got = brute_nearest(rows), searched(spark, rows, shard_rows=shard_rows)
    hit = sum(len({i for i, _ in got[q]} & {i for i, _ in near}) for q, near in want.items())
    assert hit >= 0.95 * sum(map(len, want.values()))
    for q in want:
        assert len(got[q]) == 5 and [s for _, s in got[q]] == sorted((s for _, s in got[q]), reverse=True), (q, got[q], want[q])


def test_small_and_odd_tables_are_exact(spark):
    copies = [(i, [1.0, 2.0]) for i in range(40)]
    rows = copies + [(100, [2.0, 1.0]), (105, [1.0, 2.5]), (110, [1.0, 0.0, 0.0])]
    want, got = brute_nearest(rows), searched(spark, rows)
    for q, near in want.items():
        assert [i for i, _ in got.get(q, [])] == [i for i, _ in near]
        assert [s for _, s in got.get(q, [])] == pytest.approx([s for _, s in near])
    odd = [(0, [1.0, 1.0]), (5, None), (10, [0.0, 0.0]), (15, [NAN, 1.0]), (20, [None, 1.0]), (1, [1.0, 0.5]), (0, [1.0, 1.0]), (None, [1.0, 1.0])]
    assert {q: [i for i, _ in near] for q, near in searched(spark, odd).items()} == {0: [1]}
    assert searched(spark, []) == {}


def test_pruning_keeps_the_nearest_and_no_more_than_the_degree():
    x = unit(np.random.default_rng(0).normal(size=(300, 8)))
    graph = graph_search.Graph(x, degree=12)
    near = (x @ x.T - 2 * np.eye(300)).argmax(axis=1)
    assert ((graph.out >= 0).sum(axis=1) <= 12).all() and (graph.out == near[:, None]).any(axis=1).mean() > 0.95
    assert graph_search.Graph(x[:1]).search(x[:3], 4)[0][:, 0].tolist() == [0, 0, 0]
