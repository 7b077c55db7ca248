import random
from pathlib import Path

from stormlane.llm import components
from stormlane.llm.common import checkpointed


def _shuffle_files(spark) -> set[str]:
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {str(p) for f in folders for p in Path(f).glob("*/shuffle_*")}


def test_a_checkpoint_leaves_no_shuffle_files(spark):
    before = _shuffle_files(spark)
    setting = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    rows = checkpointed(spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count())
    assert sorted(map(tuple, rows.collect())) == [(k, 143 - (k == 6)) for k in range(7)]
    assert not _shuffle_files(spark) - before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting


def test_stars_take_no_round(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(components, "_round", lambda *a, f=components._round: rounds.append(1) or f(*a))
    stars = [(hub, leaf) for hub in (0, 100) for leaf in range(hub + 1, hub + 50)]
    found = dict(map(tuple, components.connected_components(spark.createDataFrame(stars, "u int, v int")).collect()))
    assert found == {n: n // 100 * 100 for n in [*range(50), *range(100, 150)]}
    assert not rounds


def test_components_with_and_without_broadcasts(spark, monkeypatch):
    pick = random.Random(1)
    links = [(pick.randrange(300), pick.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(None, 1), (2, None), (500, 500)]
    root: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in links:
        if u is not None and v is not None and u != v and find(u) != find(v):
            root[max(find(u), find(v))] = min(find(u), find(v))
    expected = sorted((x, find(x)) for x in list(root))
    edges = spark.createDataFrame(links, "u bigint, v bigint")
    assert sorted(map(tuple, components.connected_components(edges).collect())) == expected
    monkeypatch.setattr(components, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(components, "SCAN_ROWS", 50)
    assert sorted(map(tuple, components.connected_components(edges).collect())) == expected
