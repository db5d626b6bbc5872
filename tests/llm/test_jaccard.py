"""Work and results of the similarity join on families of near copies."""

import random

import pytest
from pyspark.sql import functions as F

from stormglass.llm import graph, jaccard


def families(n_families, n_copies, n_words=240, edits=(2, 14), seed=3):
    """Near copies of a few texts: some pairs of a family link, most are a little too far apart."""
    rng = random.Random(seed)
    out = []
    for f in range(n_families):
        base = [f"f{f}w{rng.randrange(100_000)}" for _ in range(n_words)]
        for _ in range(n_copies):
            words = list(base)
            for _ in range(rng.randrange(*edits)):
                words[rng.randrange(n_words)] = f"e{rng.randrange(1_000_000)}"
            out.append((len(out), " ".join(words)))
    return out


def named(rows, size=4, percent=85):
    sets = [{tuple(w[i:i + size]) for i in range(len(w) - size + 1)} for w in (t.split() for _, t in rows)]
    group = list(range(len(rows)))
    def find(x):
        while group[x] != x:
            x = group[x]
        return x
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                group[max(x, y)] = min(x, y)
    return [(i, len(s), find(i)) for i, s in enumerate(sets)]


@pytest.fixture
def written(monkeypatch):
    """(name, rows) of every table that the join writes."""
    tables, write = [], jaccard.materialise
    def counted(df, name="table"):
        out = write(df, name)
        tables.append((name, out.count()))
        return out
    monkeypatch.setattr(jaccard, "materialise", counted)
    return tables


@pytest.mark.parametrize("block", [jaccard.BLOCK, 16])
def test_families_are_compared_in_few_groups(spark, written, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = families(3, 40)
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(tuple(r) for r in jaccard.components_of(table).collect()) == named(rows)
    # A copy shares dozens of buckets with each other one; it meets them in a few groups.
    assert [n for name, n in written if name == "members"][-1] < 10 * len(rows)
    assert sum(n for name, n in written if name == "walked") < 40 * len(rows)


def test_least_shared_keys_of_a_pair(spark):
    """No linked pair shares fewer bucket keys than are asked for, in any common order."""
    rng = random.Random(5)
    cases = []
    for _ in range(400):
        both, more, percent = rng.randrange(1, 60), rng.randrange(12), rng.choice((80, 85, 90))
        left = rng.randrange(more + 1)
        order = list(range(both + more))
        rng.shuffle(order)
        a, b = (sorted(order[:both] + own) for own in (order[both:both + left], order[both + left:]))
        if 100 * both >= percent * (both + more):
            keys = [set(x[:jaccard.key_counts(len(x), percent)[0]]) for x in (a, b)]
            cases.append((len(a), len(b), percent, len(keys[0] & keys[1])))
    assert len(cases) > 100
    for percent in (80, 85, 90):
        table = spark.createDataFrame([c for c in cases if c[2] == percent], "a long, b long, percent long, shared long")
        need = jaccard._least_of_pair(F.col("a"), F.col("b"), percent)
        assert not table.filter(F.col("shared") < need).collect()
        assert table.filter(need > 0).count() > 10


@pytest.mark.parametrize("full", [jaccard.FULL, 64])
def test_links_are_found_in_one_walk(spark, written, monkeypatch, full):
    """Copies with many candidates too far apart take no second walk and no verification by joins."""
    monkeypatch.setattr(jaccard, "FULL", full)
    monkeypatch.setattr(jaccard, "BLOCK", 64)
    rows = families(2, 60, edits=(4, 16), seed=8)
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(tuple(r) for r in jaccard.components_of(table).collect()) == named(rows)
    names = [name for name, _ in written]
    assert names.count("walked") == 1 and names.count("pairs") == 1  # pairs: those with bucket leaders


def test_stars_take_no_round(spark, monkeypatch):
    names, write = [], graph.materialise
    monkeypatch.setattr(graph, "materialise", lambda df, name="table": names.append(name) or write(df, name))
    def found(rows):
        names.clear()
        return sorted(tuple(r) for r in graph.components(spark.createDataFrame(rows, "u long, v long")).collect())
    assert found([(5, 1), (1, 7), (7, 1), (9, 2), (3, 3), (None, 4)]) == [(1, 1), (2, 2), (5, 1), (7, 1), (9, 2)]
    assert names == ["edges"]
    assert found([(i, i + 1) for i in range(20)] + [(40, 30)]) == [(i, 0) for i in range(21)] + [(30, 30), (40, 30)]
    assert "small-star" in names
