from contextlib import contextmanager

import numpy as np

from spanveil.llm import embeddings

SCHEMA = "vec_id long, embedding array<float>, label int"


def fixture(n=400, group=90, seed=2):
    """Random vectors, a dense group, pairs around the threshold, equal vectors, and odd rows."""
    draw = np.random.default_rng(seed)
    x = draw.standard_normal((n, 16))
    centre = draw.standard_normal(16)
    x = np.vstack((x, centre + 0.05 * draw.standard_normal((group, 16)), x[:50] + 0.12 * draw.standard_normal((50, 16)), x[:20] * 3, x[:20]))
    rows = [(i, [float(v) for v in row.astype(np.float32)], int(i % 3 if i < n else 1)) for i, row in enumerate(x)]
    rows = [(i, v, (i - n - group) % 50 % 3 if i >= n + group else k) for i, v, k in rows]
    last = len(rows)
    nan, inf = float("nan"), float("inf")
    odd = [(last, None, 1), (last + 1, [0.0] * 16, 1), (last + 2, [nan] + [1.0] * 15, 1), (last + 3, [inf] + [1.0] * 15, 1), (last + 4, [None] + [1.0] * 15, 1), (last + 5, rows[0][1], None), (last + 6, [], 1), (last + 7, [1.0, 2.0], 1), (last + 8, [2.0, 4.0], 1), (None, rows[1][1], 1), (3, rows[3][1], 0)]
    return rows + odd


def plain(rows, least=0.98):
    """Links and components by all pairs."""
    good = []
    for k, (_, v, label) in enumerate(rows):
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good.append((k, np.array(v, np.float64), label))
    links = [[] for _ in rows]
    for i, x, a in good:
        for j, y, b in good:
            if i != j and a == b and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                links[i].append(j)
    component, seen = [None] * len(rows), set()
    for i in range(len(rows)):
        if i not in seen:
            reach, todo = {i}, [i]
            while todo:
                for j in links[todo.pop()]:
                    if j not in reach:
                        reach.add(j)
                        todo.append(j)
            seen |= reach
            ids = [rows[j][0] for j in reach if rows[j][0] is not None]
            for j in reach:
                component[j] = min(ids) if ids else None
    return [(rows[i][0], len(links[i]), component[i]) for i in range(len(rows))]


def test_recall_and_precision(spark):
    rows = fixture()
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", node int")
    got = sorted((tuple(r)[:3] for r in embeddings.links(df).collect()), key=repr)
    want = sorted(plain(rows), key=repr)
    assert len(got) == len(want)
    found, there = sum(r[1] for r in got), sum(r[1] for r in want)
    assert found <= there and found >= 0.97 * there
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True) if g[0] == w[0] and [r[0] for r in want].count(w[0]) == 1)
    same = sum(g[2] == w[2] for g, w in zip(got, want, strict=True))
    assert same >= 0.97 * len(want)


@contextmanager
def partitions(spark, n):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", n)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def dense(group, others=400, size=32, seed=3):
    """Vectors of one label: a group of which any two are linked, and others."""
    draw = np.random.default_rng(seed)
    x = np.vstack((draw.standard_normal(size) + 0.08 * draw.standard_normal((group, size)), draw.standard_normal((others, size)))).astype(np.float32)
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    return [(i, [float(v) for v in row], 1) for i, row in enumerate(x)], ((y @ y.T >= 0.98).sum(axis=1) - 1).tolist()


def test_a_dense_group_loses_no_link_on_any_partitions(spark):
    rows, want = dense(400)
    assert sum(want) == 400 * 399
    for n in (1, 4, 211):
        with partitions(spark, n):
            got = {r["vec_id"]: r["n_links"] for r in embeddings.links(spark.createDataFrame(rows, SCHEMA).repartition(max(1, n // 30))).collect()}
            assert [got[i] for i in range(len(rows))] == want


def test_a_group_of_many_blocks_and_reruns(spark):
    rows, want = dense(2000)
    assert sum(want) == 2000 * 1999
    for n in (2, 7):
        with partitions(spark, n):
            got = {r["vec_id"]: tuple(r)[1:] for r in embeddings.links(spark.createDataFrame(rows, SCHEMA).repartition(n)).collect()}
            assert [got[i][0] for i in range(len(rows))] == want
            assert {got[i][1] for i in range(2000)} == {0}


def test_partitions_and_the_order_of_rows_do_not_matter(spark):
    rows = fixture()
    first = sorted(map(tuple, embeddings.links(spark.createDataFrame(rows, SCHEMA).coalesce(1)).collect()), key=repr)
    with partitions(spark, 9):
        assert sorted(map(tuple, embeddings.links(spark.createDataFrame(rows[::-1], SCHEMA).repartition(5)).collect()), key=repr) == first


def test_equal_keys_and_very_long_vectors(spark):
    draw = np.random.default_rng(1)
    base = draw.standard_normal(5000)
    rows = [(i, [float(v) for v in base * (1 + 1e-4 * i)], 1) for i in range(40)] + [(100 + i, [float(v) for v in draw.standard_normal(5000)], 1) for i in range(20)]
    got = {r["vec_id"]: tuple(r)[1:] for r in embeddings.links(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i][:2] == (39, 0) for i in range(40)) and all(got[100 + i] == (0, 100 + i, True) for i in range(20))


def test_empty_table(spark):
    assert embeddings.links(spark.createDataFrame([], SCHEMA)).count() == 0
