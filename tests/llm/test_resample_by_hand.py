"""Importance resampling against plain Python: counts, log ratios, slope, bounds, and the drawn and screened rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from quillmask.llm import resample

WORD = 1 << 64


def grams(text):
    h = [xxhash.xxh64_intdigest(t) for t in re.findall(r"\w+|[^\w\s]", text or "")]
    pairs = [(a * 0x9E3779B97F4A7C15 + b) % WORD for a, b in zip(h, h[1:], strict=False)]
    return [x % resample.BUCKETS for x in h] + [(x ^ (x >> 32)) % resample.BUCKETS for x in pairs]


def features(text, ratio, mark):
    g = grams(text)
    if not g:
        return [0.0, 0.0]
    lowest = sorted(map(mark, set(g)))[: resample.MARKS]
    return [max(sum(map(ratio, g)) / len(g), resample.LEAST_MEAN), sum(lowest) / len(lowest)]


def best_by_hand(rows, cost):
    """The least loss of a bound on the first of each row; the second is whether it is to be kept."""
    values = sorted({v for v, _ in rows})
    bounds = [-math.inf, *((a + b) / 2 for a, b in zip(values, values[1:], strict=False))]
    return min(loss_by_hand(rows, b, cost) for b in bounds)


def loss_by_hand(rows, bound, cost):
    return sum((cost if good else 1) for v, good in rows if (v >= bound) != good)


def test_weights_and_drawn_rows(spark):
    rnd = random.Random(21)
    rows, labels = [], []
    for i in range(500):
        words = [rnd.choice(["plain", "words", "of", "the", "prose", "here", "and", "there", "été"]) for _ in range(rnd.randint(0, 80))]
        kind = i % 5
        words += {3: rnd.sample(["idiot", "scum", "moron"], 2), 4: ["$$$", "BUY", "!!"] * rnd.randint(2, 9)}.get(kind, [])
        rnd.shuffle(words)
        rows.append((i, " ".join(words)))
        if i % 2:
            labels.append((i, int(kind != 4), int(kind == 3)))
    rows += [(None, "plain words"), (7, rows[7][1]), (7, rows[7][1]), (600, None), (601, " \n ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    given = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    done = resample.drawn(docs, given, columns=["doc_id", "text"])
    got = done.table.withColumns({"drawn": done.drawn, "toxic": done.toxic}).collect()
    resampled = Counter(tuple(r) for r in resample.resampled(docs, given).collect())
    noise = {(r[0], r[1]): r[2] for r in docs.select("doc_id", "text", resample.gumbel(F.col("doc_id"), F.col("text"), seed=5)).collect()}
    chosen = {r["__id"]: (r["kind"], r["fits"]) for r in resample.labelled(given, resample.LABEL_ROWS).collect()}
    assert {i: k for i, (k, _) in chosen.items()} == {i: resample.TOXIC if x else resample.TARGET if q else resample.LOW for i, q, x in labels}

    raw, target, having, sizes = Counter(), Counter(), [Counter() for _ in range(3)], Counter()
    for i, text in rows:
        g = grams(text)
        raw.update(g)
        kind, fits = chosen.get(i, (None, False))
        if fits:
            sizes[kind] += 1
            having[kind].update(set(g))
            if kind == resample.TARGET:
                target.update(g)
    n_raw, n_target = sum(raw.values()) + resample.BUCKETS * resample.SMOOTHING, sum(target.values()) + resample.BUCKETS * resample.SMOOTHING
    ratio = lambda b: math.log((target[b] + resample.SMOOTHING) / n_target) - math.log((raw[b] + resample.SMOOTHING) / n_raw)
    share = lambda k, b: math.log((having[k][b] + resample.MARK_SMOOTHING) / (sizes[k] + 2 * resample.MARK_SMOOTHING))
    mark = lambda b: share(resample.TARGET, b) - share(resample.TOXIC, b)

    held = [(*features(text, ratio, mark), kind) for i, text in rows[:500] for kind, fits in (chosen.get(i, (None, True)),) if not fits]
    # the log weight is linear in the mean log ratio, and in nothing else
    means = np.array([features(r["text"], ratio, mark)[0] for r in got])
    y = np.array([r["log_weight"] for r in got])
    w = np.linalg.lstsq(np.stack((np.ones(len(means)), means), 1), y, rcond=None)[0]
    assert np.abs(w[0] + w[1] * means - y).max() < 1e-3 and w[1] > 0
    assert all(abs(r["log_weight"] - w[0]) < 1e-3 for r in got if not r["text"] or r["text"].isspace())
    # it is the regression of the held-out targets and documents of low quality: the slope of the penalised likelihood is 0 there
    hx, hy = (np.array(v, float) for v in zip(*((m, k == resample.TARGET) for m, _, k in held if k != resample.TOXIC), strict=True))
    rest = hy - 1 / (1 + np.exp(-np.clip(w[0] + w[1] * hx, -30, 30)))
    assert abs(rest.sum()) < 0.05 and abs((rest @ (hx - hx.mean())) / hx.std() - 0.01 * w[1] * hx.std()) < 0.05

    draws = [(w[0] + w[1] * m, k == resample.TARGET) for m, _, k in held if k != resample.TOXIC]
    bound = resample.best_bound(*(np.array(v, float) for v in zip(*draws, strict=True)))
    assert loss_by_hand(draws, bound, 1) == best_by_hand(draws, 1)
    k = sum(r["log_weight"] >= bound for r in got)
    assert all(abs(r["perturbed"] - r["log_weight"] - noise[r["doc_id"], r["text"]]) < 1e-9 for r in got)
    least = sorted((r["perturbed"] for r in got), reverse=True)[k - 1]
    assert all(r["drawn"] == (r["perturbed"] >= least) for r in got) and len(got) == len(rows)
    screen = [(v, k == resample.TARGET) for _, v, k in held if k != resample.LOW]
    below = max((r["marks"] for r in got if r["toxic"]), default=-math.inf)
    assert all(r["toxic"] == (r["marks"] <= below) and abs(r["marks"] - features(r["text"], ratio, mark)[1]) < 1e-3 for r in got)
    assert loss_by_hand(screen, below + 1e-6, resample.CLEAN_COST) == best_by_hand(screen, resample.CLEAN_COST)
    assert len({(r["drawn"], r["toxic"]) for r in got if r["doc_id"] == 7}) == 1
    assert resampled == Counter((r["doc_id"], r["text"]) for r in got if r["drawn"] and not r["toxic"])
