"""Cases on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, columns with clashing names."""

import base64
import collections
import gzip
import hashlib
import io
import json
import os
import random
import re
import time
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quillmask.llm import bpe, cascade, codes, compaction, graphann, mixing, neardup, quotes, resample, store, warc, wavelet

WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
ODD = ["", None, "  ", "a", "it's  x\n\n y ", "é漢字 ٣ 😀\x00<|endoftext|>", "É\u00a0È\u2003 \x1c\x85 ÀB", "a  b\tc d", "word " * 3000, "same text", "same text"]


def texts(spark, values, more="extra string", extra=("x",)):
    rows = [(i, v, *extra) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"doc_id long, text string, {more}")


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def test_bpe_matches_the_reference_library(spark, ranks):
    import tiktoken

    model = bpe.model_proto(ranks)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(1)
    values = ODD + ["".join(rnd.choice(" \n\tab.'s,é漢٣<|>") for _ in range(rnd.randint(1, 50))) for _ in range(200)]
    docs = texts(spark, values, "token_ids int", (3,))
    out = bpe.decode_documents(bpe.encode_documents(docs, model, public_tokenizers.PATTERN), model, public_tokenizers.PATTERN).collect()
    assert len(out) == len(values)
    for r in out:
        ids = np.frombuffer(r["token_ids"], "<u4").tolist()
        assert ids == own.encode_ordinary(values[r["doc_id"]] or "") and r["n_tokens"] == len(ids)
        assert bytes(r["decoded"]) == (values[r["doc_id"]] or "").encode()
    assert bpe.encode_documents(docs.limit(0), model, public_tokenizers.PATTERN).count() == 0
    with pytest.raises(ValueError, match="without a rank"):
        bpe.model_proto({b"a": 0})


def test_splitter_is_the_pattern():
    import regex

    from quillmask.llm import chunks

    rnd = random.Random(5)
    own, wanted = chunks.splitter(public_tokenizers.PATTERN), regex.compile(public_tokenizers.PATTERN).findall
    for _ in range(20_000):
        kind = rnd.random()
        pool = " \n\t'strevmld.a9_\x1c\x1f" if kind < 0.4 else " 'sé漢٣²½\x85\u3000\u0301_९Ⅷ😀𝟘" if kind < 0.7 else [chr(rnd.choice([*range(0x3000), *range(0xE000, 0x20000)])) for _ in range(4)]
        text = "".join(rnd.choice(pool) for _ in range(rnd.randint(0, 12)))
        assert own(text) == wanted(text), repr(text)
    assert chunks.splitter(r"\p{Lu}+|.")("ABc") == ["AB", "c"]


def test_remembered_tokens_bound_memory_not_results():
    from quillmask.llm import chunks

    made = []
    few = chunks.Chunked(str.split, lambda t: made.append(t) or [len(t)], remembered=2)
    texts_ = ("a bb a", "ccc dddd", "a", "ccc", "eeeee a", "bb", None, "x" * 60, "x" * 60)
    assert [few.encode(x) for x in texts_] == [chunks.packed(x) for x in ([1, 2, 1], [3, 4], [1], [3], [5, 1], [2], [], [60], [60])]
    assert made == ["a", "bb", "ccc", "dddd", "a", "eeeee", "bb", "x" * 60, "x" * 60]


def pages(spark):
    rows = [(1, "u 1", "same"), (5, None, "same"), (3, "u", "same"), (2, "u", None), (4, "u", ""), (6, "u", "é\r\n\r\nWARC/1.1\r\n"), (None, "u", "same"), (7, "u", "alone"), (8, "u", "y" * 70_000), (9, "u", "twice"), (9, "u", "twice"), (2, "u", "twice"), (2, "u", "twice"), (None, "u", "twice"), (None, "u", "nameless"), (None, "u", "nameless")]
    return spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, payload string")


@pytest.mark.parametrize("least", [0, 1])
def test_warc_round_trip(spark, least):
    path = store.fresh_dir(spark, "warc")
    rows = pages(spark)
    warc.write_archives(rows, path, least=least)
    got = warc.read_archives(spark, path).collect()
    assert len(got) == rows.count()
    groups = collections.defaultdict(list)
    for r in rows.collect():
        groups[r["html"] or ""].append(r["page_id"])
    wanted = collections.Counter()
    for html, ids in groups.items():
        data = html.encode()
        largest = max((i for i in ids if i is not None), default=None)
        for i in ids:
            revisit = len(data) >= least and largest is not None and i != largest
            wanted[i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", largest if revisit else None] += 1
    assert collections.Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == wanted
    fields = [f for data in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).collect() for f, _, _ in warc.parse(gzip.open(io.BytesIO(data["content"])))]
    named = collections.Counter(f["warc-record-id"] for f in fields)
    assert max(named.values()) == 1 and len(named) == rows.count()
    digests = {f["warc-record-id"]: (f["warc-type"], f["warc-payload-digest"]) for f in fields}
    assert all(digests[f["warc-refers-to"]] == ("response", f["warc-payload-digest"]) for f in fields if f["warc-type"] == "revisit")
    assert len({f["warc-record-id"].split(":")[2] for f in fields}) == 1
    empty = store.fresh_dir(spark, "warc")
    warc.write_archives(rows.limit(0), empty)
    assert warc.read_archives(spark, empty).count() == 0


def test_wavelet_file():
    rnd = np.random.default_rng(4)
    for n, most in ((0, 1), (1, 0), (700, 50_000), (5000, 7), (2000, 100_000)):
        ids = rnd.integers(0, most + 1, n)
        shard = wavelet.Shard(wavelet.to_file(ids, [1, None], np.array([0, n // 2]), (2, 3)))
        assert shard.ids().tolist() == ids.tolist() and shard.documents() == [1, None] and shard.order == [2, 3]
        for i in range(0, n, 97):
            assert shard.access(i) == ids[i]
        for token in set(ids[:5].tolist()) | {most + 1}:
            places = np.flatnonzero(ids == token).tolist()
            assert shard.count(token) == len(places) and shard.count(token, n // 3, n // 2) == sum(n // 3 <= p < n // 2 for p in places)
            assert [shard.find(token, k) for k in range(min(len(places), 9))] == places[:9] and shard.find(token, len(places)) is None


def test_wavelet_shards(spark):
    from tokenizers import Tokenizer

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        text = f.read()
    own = Tokenizer.from_str(text)
    docs = texts(spark, ODD, "start int", (1,)).union(spark.createDataFrame([(None, "no id", 1), (4, "again", 1)], "doc_id long, text string, start int"))
    path = store.fresh_dir(spark, "wavelet")
    wavelet.write_shards(docs, path, text, end_id=2, shard_tokens=50)
    got = wavelet.with_starts(store.written(wavelet.read_shards(spark, path), "read")).collect()
    at = 0
    rows = sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] is not None, (r["text"] or "").encode()))
    assert len(got) == len(rows) and len({(r["part"], r["number"]) for r in got}) >= 3
    for r, g in zip(rows, sorted(got, key=lambda g: g["start"]), strict=True):
        ids = [*own.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        assert (g["doc_id"], g["start"], g["n_tokens"], g["ids_crc32"]) == (r["doc_id"], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    empty = store.fresh_dir(spark, "wavelet")
    wavelet.write_shards(docs.limit(0), empty, text, end_id=2)
    assert wavelet.with_starts(store.written(wavelet.read_shards(spark, empty), "read")).count() == 0


def measures_by_hand(text):
    text = text or ""
    w = WORDS(text)
    windows = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {k + j for k in range(len(w) - 2) if windows[w[k], w[k + 1], w[k + 2]] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORDS(x)]
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in text), len(lines) - len(set(lines)), len(covered)


def test_cascade(spark):
    rnd = random.Random(3)
    values = ODD + ["\n".join(" ".join(rnd.choice(["a", "b", "c|", "dé"]) for _ in range(rnd.randint(0, 6))) for _ in range(rnd.randint(1, 6))) for _ in range(60)]
    values += [" ".join("w" + rnd.choice("abcdefgh") * rnd.randint(1, 6) for _ in range(80)) + x for x in ("", " !!" * 40, " #" * 60)] + [" ".join(f"WORD{i}" for i in range(99))]
    docs = texts(spark, values, "n_words string, kept string", ("q", "q"))
    got = {r["doc_id"]: r for r in cascade.judged(docs).collect()}
    names = [r.name for r in cascade.RULES]
    other = {r["doc_id"]: r["kept"] for r in cascade.judged(docs, order=names[::-1]).collect()}
    for i, v in enumerate(values):
        m = measures_by_hand(v)
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == m, v
        assert got[i]["base_failed"] == (m[0] < 50 or 100 * m[4] > 50 * m[0])
        assert got[i]["kept"] == other[i] and got[i]["kept"] == (got[i]["rejected_by"] is None)
    assert {got[len(values) - k]["rejected_by"] for k in (1, 2, 3)} <= {"capitals", "exclamations", "symbols", "letters", "digits"} - {None}
    assert sorted(e.name for e in cascade.estimates(docs)) == sorted(names)
    assert cascade.judged(docs.limit(0)).count() == 0
    names += ["few_words", "repetition"]
    for least, order in ((50, None), (50, names), (1, names[::-1])):
        wanted = {r["doc_id"] for r in cascade.judged(docs, order=names[:-2], least_words=least).collect() if r["kept"]}
        assert {r["doc_id"] for r in cascade.accepted(docs, order=order, least_words=least).collect()} == wanted
    assert cascade.accepted(docs, order=names).columns == docs.columns and cascade.accepted(docs.limit(0)).count() == 0


def test_compaction(spark):
    docs = texts(spark, ODD * 40, "_metadata string", ("m",)).repartition(3)
    table = compaction.ShardedTable(spark, store.fresh_dir(spark, "sharded"), fan=3, least_bytes=2_000, target_bytes=60_000)
    with pytest.raises(ValueError):
        table.read()
    files = table.stage(docs, 20)
    table.append(files[:10], docs.schema)
    with pytest.raises(Exception):  # the version is taken
        table.commit(0, docs.schema.json(), [])
    before = len(table.manifest()[2])
    table.compact()
    table.append(files[10:], docs.schema)
    table.append([], docs.schema)
    table.compact()
    version, _, now = table.manifest()
    assert version > 3 and before == 10 and len(now) < len(files) and not table.due(now)
    assert len(table.versions()) <= 2 and sum(f.rows for f in now) == docs.count()
    count = lambda df: collections.Counter(map(tuple, df.collect()))
    assert count(table.read()) == count(docs)


def test_compaction_beside_another_writer(spark, monkeypatch):
    docs = texts(spark, [str(i) for i in range(60)])
    folder = store.fresh_dir(spark, "sharded")
    table, other = (compaction.ShardedTable(spark, folder, fan=3, least_bytes=2_000, target_bytes=60_000, keep_versions=99) for _ in range(2))
    table.append([], docs.schema)  # an empty first arrival
    assert table.read().count() == 0
    commit, rivals = table.commit, [lambda: other.append(other.stage(docs.limit(10), 5), docs.schema), other.compact]

    def second(*args):
        if rivals:
            rivals.pop(0)()
        return commit(*args)

    monkeypatch.setattr(table, "commit", second)
    table.append(table.stage(docs, 10), docs.schema)  # the other's arrival comes first
    assert table.read().count() == 70
    table.compact()  # the other merges the same shards first
    assert not rivals and table.read().count() == 70 and not table.due(table.manifest()[2])
    named = {f.path for v in table.versions() for f in table.manifest(v)[2]}
    there = {r[0].rpartition("/data/")[2] for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{folder}/data").select("path").collect()}
    assert {f"data/{x}" for x in there} == named


def check_mix(rows, block):
    """Every row once, whole blocks in every slot, and less than a block from the weights while no source has run out."""
    slots = collections.defaultdict(set)
    for r in rows:
        slots[r["mix_slot"]].add((r["mix_source"], r["mix_block"]))
    assert sorted(slots) == list(range(len(slots))) and all(len(x) == 1 for x in slots.values())
    assert len({r["mix_position"] for r in rows}) == len(rows)
    assert max(collections.Counter((r["mix_source"], r["mix_block"]) for r in rows).values()) <= block


def test_mixing(spark):
    rows = [(i, None if i % 13 == 0 else f"s{min(i % 7, 3)}", None if i % 5 else "t", i) for i in range(900)] + [(5, "s1", None, 5)] * 20 + [(None, "s2", None, 1), (None, None, "", 1), (None, None, "", 1), (1000, "s1", "word " * 200_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, mix_block int")
    check_mix(mixing.mixed(docs, 8).collect(), 8)
    got = mixing.mixed(docs, 8, weights={"s0": 3.0, "s1": 1.0, None: 0.0, "nowhere": 9.0}, group_rows=50).collect()
    check_mix(got, 8)
    assert len(got) == len(rows)
    weighted = {r["mix_slot"] for r in got if r["source"] in ("s0", "s1")}
    assert max(weighted) == len(weighted) - 1
    assert mixing.mixed(docs.limit(0), 8).count() == 0


def by_hand(blocks, weights):
    """Earliest deadline first in exact arithmetic, slot by slot, with the fluid mix it is held against."""
    done, fluid, lag, slots = [0] * len(blocks), [Fraction(0)] * len(blocks), Fraction(0), []

    def time_of(s, target):
        """When the fluid mix has done `target` blocks of source s."""
        at, now = [Fraction(0)] * len(blocks), Fraction(0)
        while at[s] < target:
            live = [k for k in range(len(blocks)) if at[k] < blocks[k]]
            total = sum(weights[k] for k in live)
            step = min([(blocks[k] - at[k]) * total / weights[k] for k in live] + [(target - at[s]) * total / weights[s]])
            for k in live:
                at[k] += step * weights[k] / total
            now += step
        return now

    ends = [[time_of(s, i) for i in range(n + 1)] for s, n in enumerate(blocks)]
    for slot in range(sum(blocks)):
        ready = [(-(-ends[s][done[s] + 1] // 1), s) for s in range(len(blocks)) if done[s] < blocks[s] and ends[s][done[s]] // 1 <= slot]
        due, s = min(ready)
        assert due > slot
        done[s] += 1
        slots.append(s)
        left, rest = Fraction(1), None
        while left:
            live = [k for k in range(len(blocks)) if fluid[k] < blocks[k]]
            if not live:
                break
            total = sum(weights[k] for k in live)
            step = min([left] + [(blocks[k] - fluid[k]) * total / weights[k] for k in live])
            for k in live:
                fluid[k] += step * weights[k] / total
            left -= step
        lag = max([lag, *(abs(fluid[k] - done[k]) for k in range(len(blocks)))])
    return slots, lag


def test_schedule_is_earliest_deadline_first():
    rnd = random.Random(8)
    for _ in range(12):
        blocks = [rnd.randint(1, 25) for _ in range(rnd.randint(1, 6))]
        weights = [Fraction(rnd.randint(1, 40), 7) for _ in blocks]
        wanted, lag = by_hand(blocks, weights)
        source, block = mixing.schedule(np.array(blocks), np.array([float(w) for w in weights]))
        assert source.tolist() == wanted and lag < 1
        for s, n in enumerate(blocks):
            assert block[source == s].tolist() == list(range(n))


def test_schedule_does_not_depend_on_how_far_windows_are_made_ahead():
    rnd = np.random.default_rng(5)
    for n in (1, 2, 7, 60):
        blocks, weights = rnd.integers(1, 90, n), rnd.random(n) + 1e-3
        wanted = mixing.schedule(blocks, weights)
        pieces = list(mixing.slots(blocks, weights, size=37, ahead=1))
        assert all(len(p[0]) <= 37 for p in pieces)
        assert [np.concatenate(x).tolist() for x in zip(*pieces, strict=True)] == [x.tolist() for x in wanted]


@pytest.mark.parametrize("weights", [[0.6180339887, 0.2718281828, 0.1100878, 0.00003, 0.00001], [(i % 17 + 0.1) ** 1.5 for i in range(200)]])
def test_lag_stays_below_a_block(weights):
    w = np.array(weights) / sum(weights)
    blocks = np.ceil(w * 120_000).astype(np.int64) + 2
    source, _ = mixing.schedule(blocks, w)
    first = min(int(np.flatnonzero(source == s)[-1]) for s in range(len(w)))  # until then no source has run out
    slots = min(100_000, first) + 1
    for s in range(len(w)):
        assert np.abs(np.cumsum(source[:slots] == s) - w[s] * np.arange(1, slots + 1)).max() < 1
    assert slots > 90_000


def test_mixed_rows_follow_the_schedule_whatever_the_number_of_sources(spark):
    rnd = random.Random(4)
    sizes = {f"s{i:03}": rnd.randint(1, 60) for i in range(200)}
    weights = {s: rnd.random() + 0.01 for s in sizes}
    rows = [(k * 1000 + i, s) for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    got = mixing.mixed(spark.createDataFrame(rows, "doc_id long, source string"), 4, weights=weights, group_rows=16).collect()
    check_mix(got, 4)
    names = sorted(sizes)
    source, block = mixing.schedule(np.array([-(-sizes[s] // 4) for s in names]), np.array([weights[s] for s in names]))
    assert {(r["mix_slot"], r["source"], r["mix_block"]) for r in got} == {(t, names[s], b) for t, (s, b) in enumerate(zip(source.tolist(), block.tolist(), strict=True))}


def test_groups_of_many_spans_follow_the_schedule(spark, monkeypatch):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"))
    columns = ("doc_id", "mix_source", "mix_block", "mix_slot", "mix_position")
    wanted = sorted(map(tuple, mixing.mixed(docs, 8, group_rows=16).select(*columns).collect()))
    monkeypatch.setattr(mixing, "SPAN_GROUPS", 7)
    got = mixing.mixed(docs, 8, group_rows=16)
    assert sorted(map(tuple, got.select(*columns).collect())) == wanted
    check_mix(got.collect(), 8)


def folders(spark):
    return set(os.listdir(store.shared_root(spark)))


def test_a_job_leaves_nothing_but_its_result(spark, tmp_path):
    texts = [(i, f"text {i % 40} of some words that are the same in several documents {i % 3}", f"s{i % 3}") for i in range(120)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(120)], "doc_id long, quality int, toxic int")
    rnd = np.random.default_rng(2)
    vectors = spark.createDataFrame([(i, rnd.normal(size=4).tolist()) for i in range(60)], "vec_id long, embedding array<double>")
    steps = {
        "mix": lambda: mixing.mixed(docs, 8),
        "draw": lambda: resample.resampled(docs, labels),
        "near": lambda: neardup.kept_documents(docs, neardup.Settings(percent=80)),
        "codes": lambda: codes.compressed(vectors, label=None, parts=2)[0],
        "graph": lambda: graphann.nearest(vectors, vectors, 5),
    }
    before = folders(spark)
    for name, step in steps.items():
        with store.job(spark):
            step().write.parquet(str(tmp_path / name))
            assert folders(spark) > before, name
        assert folders(spark) == before, name
        assert spark.read.parquet(str(tmp_path / name)).count() > 0
    with pytest.raises(RuntimeError), store.job(spark):
        store.written(docs, "kept")
        raise RuntimeError
    assert folders(spark) == before


def components_by_hand(values, percent):
    sets = []
    for v in values:
        w = WORDS((v or "").translate(LOWER))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    label = list(range(len(values)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                low, high = sorted((root(i), root(j)))
                label[high] = low
    return [(len(s), root(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("settings", [neardup.Settings(short=1, later=2, levels=2, hot=1), neardup.Settings(percent=70, short=2, later=3, levels=1), neardup.Settings(percent=80, short=1, later=1, levels=6, hot=1)])
def test_pivots_lose_no_link(spark, settings):
    """Families of a text with changed, missing and added words, some without their base; all lists are long, hot ones are dealt out."""
    rnd = random.Random(settings.percent)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    values = []
    for size in (12, 30, 60, 100):
        base = [word() for _ in range(size)]
        for _ in range(45):
            other = list(base)
            for _ in range(rnd.randint(0, 4)):
                at = rnd.randrange(len(other))
                other[at : at + 1] = rnd.choice([[word()], [], [other[at], word()]])
            values.append(" ".join(other))
        for _ in range(5):  # a passage of it in another text
            values.append(" ".join([word() for _ in range(size)] + base[: size // 2]))
    rnd.shuffle(values)
    got = {r["doc"]: (r["n_shingles"], r["component_id"]) for r in neardup.clustered(texts(spark, values), settings).collect()}
    wanted = components_by_hand(values, settings.percent)
    assert [got[i] for i in range(len(values))] == wanted
    assert len({c for _, c in wanted}) > 20 and max(collections.Counter(c for _, c in wanted).values()) > 10


@pytest.mark.parametrize("percent,k", [(85, 256), (80, 24)])
def test_near_duplicates(spark, percent, k):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(25)]
    values = list(ODD)
    for _ in range(6):
        base = [word() for _ in range(rnd.choice([4, 30, 90, 160]))]
        for _ in range(7):
            other = list(base)
            for _ in range(rnd.randint(0, 5)):
                other[rnd.randrange(len(other))] = word()
            values.append(" ".join(other).upper() if rnd.random() < 0.3 else " ".join(other))
    values += [" ".join([word() for _ in range(rnd.randint(3, 40))] + passage) for _ in range(12)]
    docs = texts(spark, values, "n long, component string, doc long", (1, "c", 2))
    got = {r["doc"]: (r["n_shingles"], r["component_id"]) for r in neardup.clustered(docs, neardup.Settings(percent=percent, k=k)).collect()}
    assert [got[i] for i in range(len(values))] == components_by_hand(values, percent)
    kept = {r["doc_id"] for r in neardup.kept_documents(docs, neardup.Settings(percent=percent, k=k)).collect()}
    assert kept == {i for i, (_, c) in got.items() if c == i}


def test_near_duplicates_of_odd_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "x y z"), (1, "x y z"), (None, "a b c d e f"), (3, None)]
    found = neardup.clustered(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["doc"] or 0, r["component_id"] or 0) for r in found.collect()) == [(0, 0), (1, 1), (1, 1), (1, 1), (2, 1), (3, 3)]
    assert neardup.clustered(found.limit(0).select(F.col("doc").alias("doc_id"), F.lit("t").alias("text"))).count() == 0


def test_components(spark):
    rnd = random.Random(9)
    links = [(a, b) for a, b in (sorted(rnd.sample(range(300), 2)) for _ in range(220))] + [(i, i + 1) for i in range(1000, 1060)]
    label = {x: x for e in links for x in e}
    for _ in range(400):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    got = {r["doc"]: r["component"] for r in neardup.components(spark.createDataFrame(links, "a long, b long"), store.Tables(spark)).collect()}
    assert {d: got.get(d, d) for d in label} == label


def test_resampling(spark):
    rnd = random.Random(7)
    good = lambda: " ".join(rnd.choice(["plain", "words", "of", "the", "prose", "here"]) for _ in range(60))
    junk = lambda: " ".join(rnd.choice(["$$$", "BUY", "!!", "plain###"]) for _ in range(60))
    values = [good() if i % 4 else junk() for i in range(400)] + ["", None]
    docs = texts(spark, values, "quality int, log_weight int", (9, 9))
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0, 0.0) for i in range(0, 400, 2)] + [(None, 1, 0, 0.0)], "doc_id long, quality int, toxic int, text double")
    kept = {r["doc_id"] for r in resample.resampled(docs, labels).collect()}
    assert all((i in kept) == bool(i % 4) for i in range(400))
    assert resample.resampled(docs, labels).columns == docs.columns
    assert resample.resampled(docs, labels.limit(0)).count() == len(values)
    assert resample.resampled(docs.limit(0), labels).count() == 0


def test_resampling_drops_good_prose_with_toxic_words(spark):
    rnd = random.Random(11)
    prose = lambda n: [rnd.choice(["plain", "words", "of", "the", "prose", "here", "and", "there"]) for _ in range(n)]
    rows, labels = [], []
    for i in range(1200):
        toxic, words = i % 5 == 0, prose(rnd.choice([60, 200, 600]))
        for w in rnd.sample(["idiot", "scum", "moron", "trash"], 3) if toxic else []:
            words[rnd.randrange(len(words))] = w
        rows.append((i, " ".join(words)))
        if i % 3:
            labels.append((i, 1, int(toxic)))
    rows += [(2000 + i, "odd " * 3000) for i in range(4)]  # long copies labelled as targets set no bound
    labels += [(2000 + i, 1, 0) for i in range(4)]
    kept = {r["doc_id"] for r in resample.resampled(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    toxic = {i for i in range(0, 1200, 5)}
    assert len(kept & toxic) <= 0.05 * len(toxic)
    assert len(kept - toxic) >= 0.95 * len(set(range(1200)) - toxic)


def test_best_bound():
    y = np.array([0, 0, 1, 0, 1, 1, 1], float)
    assert resample.best_bound(np.array([1, 2, 3, 4, 5, 6, 7], float), y) == 2.5
    assert resample.best_bound(np.array([5, 5, 5], float), np.array([1, 1, 0], float)) == -np.inf


def test_kth_largest(spark):
    rnd = random.Random(1)
    values = [round(rnd.gauss(0, 1), 1) for _ in range(3000)]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 7, 1500, 3000):
        assert resample.kth_largest(rows, "v", k, bins=8, few=20) == sorted(values, reverse=True)[k - 1]


def nearest_by_hand(ids, x, k):
    out = {}
    for q in (i for i in ids if i % 20 == 0):
        scores = x @ x[ids.index(q)]
        order = sorted((-s, i) for s, i in zip(scores, ids, strict=True) if i != q)[:k]
        out[q] = [i for _, i in order]
    return out


def test_graph_search(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 12))
    x[300:600] = x[300]  # a third of all rows are one vector
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    bad = [(2000, None, 0), (2020, [0.0] * 12, 0), (2040, [float("nan")] * 12, 0), (2060, [1.0] * 3, 0), (2080, [1.0, None] * 6, 0), (None, [1.0] * 12, 0), (0, x[0].tolist(), 0)]
    vectors = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, score int")
    got = collections.defaultdict(list)
    for r in graphann.nearest(vectors, vectors.filter("vec_id % 20 = 0"), k=20, shard_nodes=200).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    wanted = nearest_by_hand(list(range(900)), x, 20)
    assert set(got) == set(wanted) and all(len(v) == 20 for v in got.values())
    assert sum(len(set(got[q]) & set(w)) for q, w in wanted.items()) >= 0.97 * 20 * len(wanted)
    few = vectors.filter("vec_id < 5")
    assert graphann.nearest(few, few.filter("vec_id = 0"), k=20).count() == 4
    assert graphann.nearest(few.limit(0), few.limit(0), k=20).count() == 0


def test_quote_linking(spark):
    rows = [
        (1, 0, "Hello all.\n\nShall we meet?", "x"),
        (1, 1, "> Shall  we MEET?\nYes.", "x"),
        (1, 2, "> > Shall we meet?\n> Yes.\n\nGood.\n", "x"),
        (1, 3, ">Hello all.\nHi.", "x"),
        (1, 4, "> never said\nHm.", "x"),
        (1, 5, "> Hello all.\n> Good.\n> Yes.\n> No.\nAnd?", "x"),
        (2, 0, "> Hello all.\n", "x"),
        (2, 1, None, "x"),
        (2, 2, "", "x"),
        (None, 1, "> Yes.\nlost", "x"),
        (3, None, "no turn", "x"),
        (2, 1, "twice", "x"),
    ]
    out = quotes.linked(spark.createDataFrame(rows, "conv_id long, turn long, text string, own_text string")).collect()
    got = {(r["conv_id"], r["turn"], r["own_text"]): (r["parent_turn"], r["root_turn"], r["reply_depth"]) for r in out}
    assert len(out) == len(rows)
    assert got[1, 1, "Yes."] == (0, 0, 1) and got[1, 2, "Good."] == (1, 0, 2) and got[1, 3, "Hi."] == (0, 0, 1)
    assert got[1, 4, "Hm."] == (None, 4, 0) and got[1, 5, "And?"] == (2, 0, 3)
    assert got[2, 0, ""] == (None, 0, 0) and got[None, 1, "lost"] == (None, None, None) and got[3, None, "no turn"] == (None, None, None)
    order = [(r["conv_id"], r["root_turn"], r["reply_depth"], r["turn"]) for r in out if r["conv_id"] == 1]
    assert order == sorted(order)
    assert quotes.linked(spark.createDataFrame([], "conv_id long, turn long, text string")).count() == 0


def test_deeper_quotes_link_where_shallower_ones_have_no_original(spark):
    rows = [
        (1, 0, "Hello all."),
        (1, 1, "> Hello all.\n"),
        (1, 2, "> > Hello all.\nLate."),
        (1, 3, "> > > Late.\n> > Hello all.\n> never said\nLater."),
        (1, 4, "> Later.\n> > Hello all.\n> > Late.\nLast."),
        (1, 5, ">>> Last.\n>>> Later.\n>>> Hello all.\n"),
    ]
    out = quotes.linked(spark.createDataFrame(rows, "conv_id long, turn long, text string")).collect()
    assert {r["turn"]: (r["parent_turn"], r["root_turn"], r["reply_depth"]) for r in out} == {0: (None, 0, 0), 1: (0, 0, 1), 2: (0, 0, 1), 3: (0, 0, 1), 4: (3, 0, 2), 5: (4, 0, 3)}


def test_marks_are_what_the_grammar_says(spark):
    rnd = random.Random(12)
    lines = ["".join(rnd.choice("> \tx") for _ in range(rnd.randint(0, 14))) for _ in range(3000)]
    df = spark.createDataFrame([(x,) for x in lines], "x string")
    grammar = re.compile(r"[ \t]*(?:>[ \t]?)+")
    for r in df.select("x", F.regexp_extract("x", quotes.MARKS, 0).alias("m"), F.col("x").rlike(quotes.MARKS).alias("quoted")).collect():
        found = grammar.match(r["x"])
        assert (r["m"], r["quoted"]) == (found.group() if found else "", bool(found)), repr(r["x"])


def test_quotes_of_very_long_texts(spark):
    blanks, marks = " " * 1_000_000, 100_000
    rows = [(1, 0, f"  hi{blanks}there\n\n"), (1, 1, "> " * marks + f"hi{blanks}there\nfirst"), (1, 2, ">" * marks + "nothing" + " \n\t" * 300_000), (1, 3, f"{blanks}\n" * 3 + ">first\nlast" + "\n \r\n" * 200_000)]
    began = time.time()
    out = {r["turn"]: r for r in quotes.linked(spark.createDataFrame(rows, "conv_id long, turn long, text string")).collect()}
    assert [(out[t]["parent_turn"], out[t]["reply_depth"]) for t in range(4)] == [(None, 0), (0, 1), (None, 0), (1, 2)]
    assert [out[t]["own_text"] for t in range(4)] == [f"hi{blanks}there", "first", "", "last"]
    assert time.time() - began < 60
    found = spark.createDataFrame(rows[1:2], "conv_id long, turn long, text string").select(F.inline(quotes.passages(F.col("text")))).collect()
    assert [r["level"] for r in found] == [marks, 0]


def test_graph_search_for_odd_queries(spark):
    """Queries of another width don't ask; an id with several vectors asks by the smallest, however rows are dealt out."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 3))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    queries = [(i, [1.0, 2.0]) for i in range(0, 180, 20)] + [(20, [0.3, 0.2, 0.1]), (20, [0.3, -0.2, 0.9]), (20, [0.3, 0.2, 0.1]), (40, x[40].tolist()), (777, [1.0, 1.0, 1.0])]
    wanted = None
    for parts in (1, 3, 7):
        asked = spark.createDataFrame(queries, "vec_id long, embedding array<double>").repartition(parts)
        got = [tuple(r) for r in graphann.nearest(vectors, asked, k=5).orderBy("query_id", "rank").collect()]
        wanted = wanted or got
        assert got == wanted
    assert {r[0] for r in wanted} == {20, 40, 777}
    for q, v in ((20, [0.3, -0.2, 0.9]), (40, x[40]), (777, [1.0] * 3)):
        best = [int(i) for i in np.argsort(-(x @ np.array(v)), kind="stable") if i != q][:5]
        assert [r[2] for r in wanted if r[0] == q] == best
    none = spark.createDataFrame([(20, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert graphann.nearest(vectors, none, k=5).count() == 0


def clustered_vectors(n, width=64, groups=40, seed=5):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(groups, width))
    x = middles[rng.integers(0, groups, n)] + 0.7 * rng.normal(size=(n, width))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_recall_on_a_full_shard():
    x = clustered_vectors(graphann.SHARD_NODES)
    ids = np.arange(len(x))
    graph, entry = graphann.build(graphann.lengthened(x)[0])
    index = {"nodes": ids.astype("<i8").tobytes(), "vectors": x.astype("<f8").tobytes(), "graph": graph.astype("<i4").tobytes(), "entry": entry.astype("<i4").tobytes(), "dim": x.shape[1]}
    got, _ = graphann.Shard(index).search(x[::20], 21, graphann.BEAM)
    wanted = ids[np.argsort(-(x[::20] @ x.T), axis=1, kind="stable")[:, :21]]
    assert np.mean([len(set(a) & set(b)) / 21 for a, b in zip(got.tolist(), wanted.tolist(), strict=True)]) >= 0.9


def test_recall_over_several_shards(spark):
    x = clustered_vectors(3000, seed=6)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(set)
    for r in graphann.nearest(vectors, vectors.filter("vec_id % 20 = 0"), k=20, shard_nodes=700).collect():
        got[r["query_id"]].add(r["vec_id"])
    wanted = nearest_by_hand(list(range(len(x))), x, 20)
    assert sum(len(got[q] & set(w)) for q, w in wanted.items()) >= 0.9 * 20 * len(wanted)
