import numpy as np
import pytest

from tallyspark.llm import embedding_join as ej
from tallyspark.llm.components import components
from tallyspark.plans.staging import stage

DDL = "vec_id bigint, embedding array<float>, label int"


def brute(rows, threshold):
    """n_links and component of each usable row, by all pairs."""
    use = [(k, i, np.array(v, float)) for k, (i, v, _) in enumerate(rows) if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links = {k: [] for k, _, _ in use}
    for a, (k, _, x) in enumerate(use):
        for m, _, y in use[a + 1 :]:
            if len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= threshold:
                links[k].append(m)
                links[m].append(k)
    out = [(r[0], 0, r[0]) for r in rows]
    for k, i, _ in use:
        seen, todo = {k}, [k]
        while todo:
            for m in links[todo.pop()]:
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        out[k] = (i, len(links[k]), min(rows[m][0] for m in seen))
    return sorted(map(str, out))


def clustered(n, d, seed, spread):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(max(2, n // 12), d))
    x = centers[rng.integers(0, len(centers), n)] + rng.normal(size=(n, d)) * spread
    return [(int(i), x[i].astype(np.float32).tolist(), 0) for i in range(n)]


@pytest.mark.parametrize("d, spread", [(3, 0.3), (16, 0.25), (40, 0.22)])
def test_links_and_components_against_all_pairs(spark, d, spread):
    rows = clustered(300, d, d, spread)
    got = ej.link_vectors(spark.createDataFrame(rows, DDL).repartition(5), block=32).collect()
    assert sorted(str((r.vec_id, r.n_links, r.component_id)) for r in got) == brute(rows, 0.95)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_intervals_are_skipped_only_when_apart(monkeypatch, spark):
    monkeypatch.setattr(ej, "INTERVAL", 8)
    rows = clustered(200, 6, 9, 0.2)
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    order = np.lexsort(np.floor(x[:, :3] / 0.3162).T[::-1])
    tile = ej._Tile(x[order], x[order][:, :4], np.ones(len(x), np.int64), 0, 0.95, np.sqrt(0.1))
    near = x[order] @ x[order].T >= 0.95
    np.fill_diagonal(near, False)
    assert (tile.links == near.sum(1)).all()
    compared = sum(m.size for _, _, m in tile.found)
    assert compared < near.size / 2


def test_odd_vectors(spark):
    rows = [
        (1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [1.0, 0.1], 1), (3, [1.0, 0.1], 1), (9, None, 0), (10, [], 0), (11, [0.0, 0.0], 0),
        (12, [float("nan"), 1.0], 0), (13, [float("inf"), 1.0], 0), (14, [None, 1.0], 0), (15, [1.0, 0.0, 0.0], 0), (None, [1.0, 0.0], 0), (16, [-1.0, 0.0], 0),
        (17, [1e-30, 0.0], 0), (18, [3e38, 0.0], 0),
    ]
    got = ej.link_vectors(spark.createDataFrame(rows, DDL)).collect()
    assert sorted(str((r.vec_id, r.n_links, r.component_id)) for r in got) == brute(rows, 0.95)
    assert [r.kept for r in got if r.vec_id is None] == [False]
    empty = spark.createDataFrame([], DDL)
    assert ej.link_vectors(empty).collect() == []
    assert [r.n_links for r in ej.link_vectors(spark.createDataFrame([(1, None, 0)], DDL)).collect()] == [0]


def test_components_of_paths_stars_and_cycles(spark):
    links = [(i + 1, i) for i in range(0, 60)] + [(100, k) for k in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "u bigint, v bigint")).collect()))
    assert got == {**{i: 0 for i in range(1, 61)}, **{k: 100 for k in range(101, 160)}, 201: 200, 202: 200}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).collect() == []


def test_the_sample_is_picked_by_all_tasks(spark):
    rows = [(i, [float(i % 7 + 1), float(i % 11), 1.0]) for i in range(400)]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(8)
    units = stage(ej.unit_vectors(vectors), "units")
    parts = units.rdd.getNumPartitions()
    assert parts > 1
    tracker = spark.sparkContext.statusTracker()

    def wide(group, call):
        """Stages of ``call`` with a task per part of the table."""
        spark.sparkContext.setJobGroup(group, group)
        try:
            call()
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
        return sum(tracker.getStageInfo(s).numTasks == parts for s in stages if tracker.getStageInfo(s))

    # The table is counted, and then scanned for the sample.
    assert wide("sample-fit", lambda: ej.leading_directions(units)) > wide("sample-count", units.count)
