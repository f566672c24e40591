"""Groups of near copies meet few pivots, are listed once, and lose no link by that."""

import random

from pyspark.sql import functions as F

from quillmask.llm import neardup
from quillmask.llm.store import Tables


def brute(texts, s):
    sets = {i: set(neardup.shingles(t, s.words).tolist()) for i, t in texts.items()}
    of = {i: i for i in texts}

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    for a in texts:
        for b in texts:
            if a < b and 100 * len(sets[a] & sets[b]) >= s.percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                of[y] = x
    return {i: root(i) for i in texts}


def test_groups_of_copies_by_brute_force(spark):
    rng, texts = random.Random(5), {}
    for group in range(4):
        base = [f"w{group}x{rng.randrange(10**6)}" for _ in range(90)]
        for _ in range(22):
            words = list(base)
            for _ in range(rng.randrange(1, 4)):
                words[rng.randrange(90)] = f"e{rng.randrange(12)}"
            texts[len(texts)] = " ".join(words)
    s = neardup.Settings(short=2, later=3, levels=3)
    out = neardup.clustered(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), s)
    got, wanted = {r["doc"]: r["component_id"] for r in out.collect()}, brute(texts, s)
    assert got == wanted and 4 < len(set(wanted.values())) < len(texts)


def test_lists_of_a_group_meet_one_pivot(spark):
    # 1 is the pivot of three lists, 2 of one that 1 isn't in, though it is in all of 1's
    rows = [(v, d, 1) for v in (1, 2, 3) for d in (1, 2, 3, 4)] + [(4, d, 2) for d in (2, 3, 5)]
    lists = spark.createDataFrame([(v, d, 10, 7, (0, 0, p, 10)) for v, d, p in rows], "value long, doc long, n long, score short, pivot struct<score:int,h:int,doc:long,n:long>")
    met = neardup._fewer_pivots(neardup._meetings(lists), Tables(spark))
    assert sorted(map(tuple, met.select("doc", "pivot").collect())) == [(2, 1), (3, 1), (4, 1), (5, 1)]


def test_members_are_listed_once(spark):
    """What lists are made from is read from a table, not generated for each of its two readers."""
    members = spark.createDataFrame([(9, d, 1, 10, False, True, [5, 6]) for d in (1, 2)], "pivot long, doc long, score int, n long, linked boolean, near boolean, outside array<long>")
    none = spark.createDataFrame([], "doc long, component long")
    tables = Tables(spark)
    lists = neardup._relisted(tables.written(neardup._under(members, none), "under"))
    assert "Generate" not in lists._jdf.queryExecution().executedPlan().toString()
    found = lists.groupBy(F.col("near"), F.col("value")).agg(F.max("members")).collect()
    assert sorted(map(tuple, found)) == [(False, 5, 2), (False, 6, 2), (True, 0, 2)]
