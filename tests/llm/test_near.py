import re
from itertools import combinations

import numpy as np
import pytest
from tests.llm.conftest import prose

from leafmill.llm import graphs, near

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def brute(pairs, k):
    sets = [(i, shingles(t, k)) for i, t in pairs]
    parent = {i: i for i, _ in sets if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (a, x), (b, y) in combinations(sets, 2):
        if a is not None and b is not None and x and y and 5 * len(x & y) >= 4 * len(x | y):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {i: root(i) for i in parent}


def test_query(rows, documents):
    got, expected = rows("op10_near"), brute(list(zip(documents.doc_id, documents.text)), 4)
    assert got["component_id"].to_dict() == expected
    assert all(got["n_shingles"][i] == len(shingles(t, 4)) for i, t in zip(documents.doc_id, documents.text))
    assert (got["kept"] == (got.index == got["component_id"])).all()


def family(seed: int, base: str, n: int, changes: int) -> list[str]:
    import random

    r, words = random.Random(seed), base.split()
    out = [base]
    for _ in range(n):
        own = words[:]
        for at in r.sample(range(len(own)), changes):
            own[at] = f"new{r.randint(0, 10**9)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("k, changes", [(4, 2), (5, 3), (4, 5)])
def test_families(spark, k, changes):
    texts = [t for s in range(6) for t in family(s, prose(100 + s, 110), 12, changes)] + [prose(s, 3 + s % 9) for s in range(60)]
    texts += [t for s in range(12) for t in family(s, prose(900 + s % 3, 20 + s), 2, 1)]
    passage = prose(77, 90)
    texts += [f"{passage} {prose(500 + i, 30)}" for i in range(25)]  # alike, but not enough
    pairs = [(1000 - i, t) for i, t in enumerate(texts)]
    got = near.near_duplicates(spark, spark.createDataFrame(pairs, "doc_id long, text string"), k).collect()
    assert {r.doc_id: r.component_id for r in got} == brute(pairs, k)


def test_rest_is_exact(spark, monkeypatch):
    """Even with stars that find nothing, the prefix join over the buckets' members finds every link."""
    texts = [t for s in range(5) for t in family(s, prose(40 + s, 60 + 5 * s), 6, 2)]
    pairs = list(enumerate(texts))
    monkeypatch.setattr(near, "star_pairs", lambda members: members.select(members.rep.alias("a"), members.rep.alias("b")).where("false"))
    got = near.near_duplicates(spark, spark.createDataFrame(pairs, "doc_id long, text string"), 4).collect()
    assert {r.doc_id: r.component_id for r in got} == brute(pairs, 4)


def brute_rows(rows, k):
    """Components by id where ids may repeat: rows of one id that have words are one document."""
    sets = [(i, shingles(t, k)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (a, x), (b, y) in combinations(sets, 2):
        if x and y and 5 * len(x & y) >= 4 * len(x | y):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return sorted((i, root(i) if x else i) for i, x in sets)


def test_repeated_ids(spark):
    x, y, z = prose(301, 50), prose(302, 50), prose(303, 50)
    first = [(1, x), (1, y), (2, x + " more"), (3, y + " more")]
    second = [(1, x), (1, y), (0, y)]
    third = [(7, x), (7, y), (7, z), (7, ""), (5, z + " end"), (9, x), (9, x), (8, None), (None, x), (6, y + " a"), (6, prose(304, 40)), (4, prose(304, 40) + " b")]
    hot = [(1, prose(1000 + i, 30)) for i in range(40)] + [(100 + i, prose(1000 + i, 30) + " z") for i in range(40)]
    for rows in (first, second, third, hot):
        got = near.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 4).collect()
        assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id is not None) == brute_rows(rows, 4)
        assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)


def test_long_words(spark, twins):
    """Words that collide under any polynomial hash modulo a power of two are different words."""
    rows = [(i, f"{w} a b c") for i, w in enumerate(twins)]
    got = near.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert all(r.component_id == r.doc_id for r in got)


def test_outsiders_meet_a_cluster_once(spark):
    """Members of one component are not compared with each other."""
    base = prose(801, 100).split()
    texts = [" ".join([*base[:i], f"new{i}", *base[i + 1 :]]) for i in range(0, 60)] + [" ".join(base[:78] + prose(802, 22).split())]
    pairs = list(enumerate(texts))
    got = near.near_duplicates(spark, spark.createDataFrame(pairs, "doc_id long, text string"), 4).collect()
    assert {r.doc_id: r.component_id for r in got} == brute(pairs, 4)


def test_odd(spark, odd, empty):
    got = near.near_duplicates(spark, odd, 4).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert (by[2].component_id, by[3].component_id, by[1].kept, by[2].kept) == (1, 1, True, False)
    assert by[4].n_shingles == by[5].n_shingles == by[6].n_shingles == 0 and by[4].kept and by[6].component_id == 6 and by[7].n_shingles == 1
    assert all(r.kept and r.component_id is None for r in got if r.doc_id is None)
    assert near.near_duplicates(spark, empty).count() == 0
    stays = near.without_duplicates(spark, odd)
    assert stays.columns == odd.columns and sorted(r.doc_id for r in stays.collect() if r.doc_id) == [1, 4, 5, 6, 7, 8, 9, 10, 11] and stays.where("doc_id is null").count() == 2
    same = odd.where("doc_id in (3, 7)")
    assert near.without_duplicates(spark, same.union(same)).count() == 2
    assert near.without_duplicates(spark, empty).count() == 0


def test_components(spark):
    import random

    r = random.Random(3)
    links = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + i) for i in range(1, 80)] + [(r.randint(0, 60), r.randint(0, 60)) for _ in range(40)]
    got = {x.vertex: x.component for x in graphs.components(spark, spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {v: v for p in links for v in p}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    assert got == {v: root(v) for v in parent if root(v) != v}
    assert graphs.components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


def test_densified():
    values, full = np.arange(256, dtype=np.uint64).reshape(2, 128), np.zeros((2, 128), bool)
    full[0, 5] = True
    out = near.densified(values, full)
    assert (out[0] == 5).all() and (out[1] == values[1]).all()
