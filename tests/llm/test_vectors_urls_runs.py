"""Vector codes, URL rules and periodic runs against plain Python, and odd rows."""

import collections
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmask.llm import codes, queries, runs, store, urlrules
from quillmask.llm.urlrules import Listed

# vector codes


def codes_by_hand(rows, parts=4, entries=256, rounds=4):
    """rows: (id, label, integers) in order of the first entries."""
    m = len(rows[0][2]) // parts
    cut = [[x[p * m : (p + 1) * m] for p in range(parts)] for _, _, x in rows]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((u - v) ** 2 for u, v in zip(a, b))
    near = lambda v, book: min(range(len(book)), key=lambda e: (far(v, book[e]), e))
    for _ in range(rounds):
        for p in range(parts):
            groups = collections.defaultdict(list)
            for c in cut:
                groups[near(c[p], books[p])].append(c[p])
            books[p] = [[sum(v) // len(groups[e]) for v in zip(*groups[e])] if e in groups else old for e, old in enumerate(books[p])]
    found = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    return found, [sum(far(c[p], books[p][f[p]]) for p in range(parts)) for c, f in zip(cut, found)], books


@pytest.mark.parametrize("partitions", [1, 7])
def test_codes(spark, partitions):
    rnd = random.Random(2)
    made = [(i, [rnd.gauss(0, 1) for _ in range(8)], rnd.choice([1, 2, None]), "x") for i in range(60)]
    made += [(70 + i, made[3][1], 1, "x") for i in range(30)] + [(3, made[3][1], 1, "x"), (None, [0.5] * 8, None, "x"), (80, [-0.0] * 8, 2, "x"), (81, [1e38] + [0.0] * 7, 2, "x")]
    odd = [(90, None, 1, "x"), (91, [1.0, None] + [0.0] * 6, 1, "x"), (92, [float("nan")] * 8, 1, "x"), (93, [float("inf")] + [0.0] * 7, 1, "x"), (94, [1.0, 2.0], 1, "x"), (95, [], None, "x")]
    df = spark.createDataFrame(made + odd, "vec_id long, embedding array<float>, label int, codes string").repartition(partitions)
    out, books = codes.compressed(df, entries=16)
    bound = codes.largest(8)
    scaled = [(i, label, [int(min(max(np.floor(1024 * float(np.float32(c))), -bound), bound)) for c in v]) for i, v, label, _ in made]
    scaled.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    wanted, errors, entries = codes_by_hand(scaled, entries=16)
    assert books.entries.tolist() == entries
    totals = collections.Counter()
    for (_, label, _), e in zip(scaled, errors):
        totals[label] += e
    found = collections.Counter((r["id"], tuple(r["codes"]), r["error"], r["label_error"]) for r in out.collect())
    assert found == collections.Counter((i, tuple(f), e, totals[label]) for (i, label, _), f, e in zip(scaled, wanted, errors))


def test_codes_of_few_rows_and_uneven_parts(spark):
    df = spark.createDataFrame([(2, [1.0, 2.0, 3.0]), (1, [4.0, 5.0, 6.0])], "vec_id long, embedding array<double>")
    out, books = codes.compressed(df, label=None)
    assert books.entries.shape == (4, 2, 1) and books.entries[:, 0, 0].tolist() == [4096, 5120, 6144, 0]
    assert {(r["id"], *r["codes"], r["error"], r["label_error"]) for r in out.collect()} == {(1, 0, 0, 0, 0, 0, 0), (2, 1, 1, 1, 0, 0, 0)}
    assert [r["restored"] for r in codes.restored(out, books).orderBy("id").collect()] == [[4.0, 5.0, 6.0, 0.0], [1.0, 2.0, 3.0, 0.0]]
    out, books = codes.compressed(df.limit(0), label=None)
    assert out.count() == 0 and books is None


def test_errors_of_many_labels(spark, monkeypatch):
    monkeypatch.setattr(codes, "BROADCAST_LABELS", 2)
    rows = spark.createDataFrame([(i, None if i % 2 else i % 6, [i], i) for i in range(200)], "id long, label int, codes array<bigint>, error bigint")
    got = codes.with_label_errors(rows, store.Tables(spark)).collect()
    totals = collections.Counter()
    for i in range(200):
        totals[None if i % 2 else i % 6] += i
    assert len(got) == 200 and all(r["label_error"] == totals[r["label"]] for r in got)


# URL rules


def parted_by_hand(url):
    rest = (url or "").partition("://")[2]
    host = "".join(itertools.takewhile(lambda c: c not in "/?#", rest))
    path = "".join(itertools.takewhile(lambda c: c not in "?#", rest[len(host) :]))
    return "".join(c.lower() if c.isascii() else c for c in host), path


def tokens_by_hand(host, path):
    import re

    return {"h:" + x for x in host.split(".") if x} | {"p:" + x for x in re.sub("[0-9]+", "0", path).split("/") if x}


ODD_URLS = [None, "", "x", "://", "http://", "HTTP://A.Example.ORG", "http://Éa.org?x/y", "a://b.org#/de/", "a://example.org/es/", "a://notexample.org/es/", "a://x.com/fr/1?u=://y.org/", "a://com/de/", "a://q.com/de", "a://org\n/\nz", "http://x.net/" + "s1/" * 20_000, "a://b..org//", "a://example.org/en/12"]


def test_urls_are_parted(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(ODD_URLS)], "i int, url string").withColumn("p", urlrules.parted(F.col("url")))
    for r in df.select("i", "p.host", "p.path", urlrules.tokens(F.col("p.host"), F.col("p.path")).alias("t")).collect():
        assert (r["host"], r["path"]) == parted_by_hand(ODD_URLS[r["i"]]), ODD_URLS[r["i"]]
        assert r["t"] == sorted(tokens_by_hand(r["host"], r["path"]))


def judged_by_hand(urls, listed, labelled, support, confidence, most):
    n = len(labelled)
    least = max(1, -(-int(round(n * support * 1e6)) // 10**6))
    baskets = [(tokens_by_hand(*parted_by_hand(u)), v) for u, v in labelled]
    where = collections.defaultdict(list)
    for i, (ts, _) in enumerate(baskets):
        for t in ts:
            where[t].append(i)
    often = {}
    for t in sorted(where):
        if len(where[t]) >= least:
            often.setdefault(tuple(where[t]), t)
    sets = collections.Counter()
    for ts, v in baskets:
        for k in range(1, most + 1):
            for c in itertools.combinations(sorted(ts & set(often.values())), k):
                sets[c, v] += 1
                sets[c, None] += 1
    sure = {(c, v): (n_, sets[c, None]) for (c, v), n_ in sets.items() if v and n_ >= least and n_ >= confidence * sets[c, None]}
    needed = {(c, v): x for (c, v), x in sure.items() if not any(w == v and set(d) < set(c) and y[0] * x[1] >= x[0] * y[1] for (d, w), y in sure.items())}
    out = []
    for u in urls:
        host, path = parted_by_hand(u)
        fits = [r for r in listed if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.host + r.path), default=None)
        mined = sorted((-x[0] / x[1], -x[0], v != "block", len(c), c) for (c, v), x in needed.items() if set(c) <= tokens_by_hand(host, path))
        verdict = best.verdict if best else ("allow" if mined[0][2] else "block") if mined else "allow"
        out.append((host, path, best and best.host + best.path, verdict))
    return out, len(needed)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_urls_are_judged(spark, seed):
    rnd = random.Random(seed)
    urls = [f"http://{rnd.choice('abc')}.{rnd.choice(['x', 'y', 'zz'])}.{rnd.choice(['com', 'org', 'net'])}/{rnd.choice(['de', 'fr', 'en'])}/{rnd.choice(['p', 'q'])}{rnd.randint(1, 99)}" for _ in range(300)] + ODD_URLS
    listed = queries.URL_RULES + [Listed("y.net", "/en/p", "block"), Listed("net", "/fr/", "allow")]
    pages = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(urls)] + [(3, urls[3], "h", 1)], "page_id long, url string, host string, verdict int")
    own = [(u, next(iter([max(f, key=lambda r: len(r.host + r.path)).verdict]), None)) for u in urls + [urls[3]] for h, p in [parted_by_hand(u)] for f in [[r for r in listed if (h == r.host or h.endswith("." + r.host)) and p.startswith(r.path)]] if f]
    given = [(u, rnd.choice(["block", "block", "allow"]) if "/de/" in (u or "") else "allow") for u in urls[::2]]
    for labelled, options in ((None, {}), (given, {"support": 0.02, "confidence": 0.6, "most_tokens": 2})):
        labels = None if labelled is None else spark.createDataFrame(labelled, "url string, label string")
        got = {r["page_id"]: r for r in urlrules.judged(pages, listed, labels, **options).collect()}
        wanted, n = judged_by_hand(urls, listed, labelled or own, options.get("support", 0.01), options.get("confidence", 0.9), options.get("most_tokens", 3))
        assert n > 0 and [(got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) for i in range(len(urls))] == wanted
    assert urlrules.judged(pages, listed).count() == len(urls) + 1


def test_urls_without_labels_or_rows(spark):
    pages = spark.createDataFrame([(1, "a://b.net/c")], "page_id long, url string")
    none = spark.createDataFrame([], "url string, label string")
    assert [(r["rule"], r["verdict"], r["mined"]) for r in urlrules.judged(pages, [], none).collect()] == [(None, "allow", None)]
    assert urlrules.judged(pages.limit(0), queries.URL_RULES).count() == 0
    long_path = "/".join(f"s{chr(97 + i)}" for i in range(26))  # 2^26 sets of tokens, all on the same URLs
    labels = spark.createDataFrame([(f"a://b.net/{long_path}", "block")] * 30 + [("a://c.net/", "allow")] * 30, "url string, label string")
    assert [(r["verdict"], r["mined"]["support"]) for r in urlrules.judged(spark.createDataFrame([(1, f"x://b.org/{long_path}")], "page_id long, url string"), [], labels).collect()] == [("block", 30)]


# periodic runs


def runs_by_hand(w, least=6, times=4):
    ends = {}
    for d in range(1, len(w) // times + 1):
        i = 0
        while i + d < len(w):
            start = i
            while i + d < len(w) and w[i] == w[i + d]:
                i += 1
            if i > start and i + d - start >= max(least, times * d):
                ends.setdefault((start, i + d), d)
            i += 1
    return sorted(((start, end - start, d) for (start, end), d in ends.items()), key=lambda r: (r[0], r[2]))


def repetitive(rnd):
    letters, w = "abcde"[: rnd.choice([1, 2, 2, 3, 5])], []
    while len(w) < 150:
        w += [rnd.choice(letters) for _ in range(rnd.randint(1, 18))] * rnd.randint(1, 8) if rnd.random() < 0.5 else [rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 6))]
        if rnd.random() < 0.05:
            break
    return w[: rnd.randint(0, 150)]


@pytest.mark.parametrize(("least", "times"), [(6, 4), (4, 3), (11, 5)])
def test_runs(least, times):
    rnd, met = random.Random(least), 0
    for _ in range(700):
        w = repetitive(rnd)
        found, collapsed = runs.found_in(" ".join(w).encode(), least, times)
        wanted = runs_by_hand(w, least, times)
        met += len(wanted)
        assert [(r["start"], r["length"], r["period"]) for r in found] == wanted, w
        again = {i for start, length, period in wanted for i in range(start + period, start + length)}
        assert collapsed.decode().split() == [x for i, x in enumerate(w) if i not in again]
    assert met > 300
    with pytest.raises(ValueError):
        runs.runs_of(np.zeros(9, np.int64), 6, 2)


def test_runs_with_long_periods():
    rnd = random.Random(1)
    for period, n in ((700, 3100), (1500, 6000), (4097, 20_000)):
        stretch = [f"w{rnd.randrange(period // 3)}" for _ in range(period)]
        w = [f"u{i}" for i in range(33)] + (stretch * (n // period + 2))[:n] + ["end"]
        found, _ = runs.found_in(" ".join(w).encode())
        assert [(r["start"], r["length"], r["period"]) for r in found if r["period"] == period] == [(33, n, period)]
    found, collapsed = runs.found_in(b"a " * 100_000)
    assert found == [{"start": 0, "length": 100_000, "period": 1}] and collapsed == b"a"


def test_runs_of_documents(spark):
    rnd = random.Random(6)
    values = [None, "", "  \n", "a " * 5, "a " * 6, "A\u00a0b " * 8, "x y\t" * 40_000, "a\u2003 a\x1ca a a a a"] + [" ".join(repetitive(rnd)) for _ in range(60)] + ["a " * 6]
    docs = spark.createDataFrame([(i, v, 7, "c") for i, v in enumerate(values)] + [(None, "b " * 9, 7, "c")], "doc_id long, text string, n_runs int, collapsed string")
    got = {r["doc_id"]: r for r in runs.with_runs(docs).collect()}
    assert len(got) == len(values) + 1 and got[None]["n_runs"] == 1 and got[0]["text"] is None
    for i, v in enumerate(values):
        w = (v or "").encode().split()
        wanted = runs_by_hand(w) if len(w) < 1000 else [(0, len(w), 2)]
        assert [tuple(r) for r in got[i]["runs"]] == wanted and got[i]["n_runs"] == len(wanted)
    best = {r["doc_id"]: r["b"] for r in runs.with_runs(docs).select("doc_id", runs.most_repeated(F.col("runs")).alias("b")).collect()}
    for i, r in got.items():
        assert best[i] == min(r["runs"], key=lambda x: (-x["length"] / x["period"], x["start"], x["period"]), default=None)
    assert runs.with_runs(docs.limit(0)).count() == 0
    bad = spark.sql("SELECT 1L AS doc_id, cast(concat(unhex('FF20'), unhex('FF20'), unhex('FF20'), unhex('FF20'), unhex('FF20'), unhex('FF')) AS string) AS text")
    assert runs.with_runs(bad, keep=["doc_id"]).select("n_runs", F.hex("collapsed").alias("h")).collect() == [(1, "FF")]
