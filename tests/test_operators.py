import json
import random

import pytest
from pyspark.sql import functions as F

from quillmask.functions import columns as c
from quillmask.operators import dedup, fakes, fields, lines, plan, rules
from quillmask.plans import pipeline
from quillmask.sources import layout


def values(spark, column, texts, kind="string"):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"i int, x {kind}")
    return [r[0] for r in rows.orderBy("i").select(column(F.col("x"))).collect()]


# group captured by each pattern, before cleaning
CAPTURED = [
    (rules.EMAIL, 0, "mail ahmet.yilmaz@example.com.", ["ahmet.yilmaz@example.com"]),
    (rules.PHONE, 0, "Phone: +90 532 123 45 67", ["+90 532 123 45 67"]),
    (rules.PHONE, 0, "Phone: 532 123 45 67", [" 532 123 45 67"]),
    (rules.PHONE, 0, "Tel/5321234567", ["/5321234567"]),
    (rules.PHONE, 0, "(487) 555-7209", ["(487) 555-7209"]),
    (rules.PHONE, 0, "IBAN: TR33 0006 1005 1978 6457 8413 26", []),
    (rules.NATIONAL_ID, 0, "TC ID: 12345678950 x 123456789501", ["12345678950"]),
    (rules.IBAN, 0, "IBAN: TR33 0006 1005 1978 6457 8413 26", ["TR33 0006 1005 1978 6457 8413 26"]),
    (rules.IBAN, 0, "TR33 0006 1005 1978 6457 84", []),
    (rules.STUDENT_ID, 1, "Student ID: 20210123456", ["20210123456"]),
    (rules.STUDENT_ID, 1, "the index finger", ["finger"]),
    (rules.STUDENT_ID, 1, "indexation", ["ation"]),
    (rules.PERSON, 1, "Name: Ahmet Yilmaz", ["Ahmet Yilmaz"]),
    (rules.PERSON, 1, "name: foo bar", ["foo bar"]),
    (rules.PERSON, 1, "Name: Ahmet Yilmaz Phone: +90", ["Ahmet Yilmaz Phone"]),
    (rules.PERSON, 1, "Name: Ahmet", []),
    (rules.ORGANIZATION, 1, "Company: ABC Teknoloji A.S.", ["ABC Teknoloji A.S."]),
    (rules.ORGANIZATION, 1, "University: X Y, Email a", ["X Y, Email a"]),
    (rules.ORGANIZATION_SUFFIX, 1, "ABC Teknoloji A.Ş.", []),
    (rules.ORGANIZATION_SUFFIX, 1, "Acme Holding Ltd. today", ["Acme Holding Ltd"]),
    (rules.ORGANIZATION_SUFFIX, 1, "Koç Üniversitesi", ["Koç Üniversitesi"]),
    (rules.SIGNATURE, 1, "ıslak İMZA:", ["ıslak İMZA"]),
    (rules.HANDWRITING, 1, "EL YAZISI", ["EL YAZISI"]),
]


def test_patterns(spark):
    for pattern in {p for p, *_ in CAPTURED}:
        cases = [(g, t, w) for p, g, t, w in CAPTURED if p == pattern]
        got = values(spark, lambda x, p=pattern, g=cases[0][0]: rules.matches(x, p, g), [t for _, t, _ in cases])
        for (_, text, wanted), found in zip(cases, got, strict=True):
            assert [m["raw"] for m in found] == wanted, text
            assert all(text[m["start"] : m["end"]] == m["raw"] for m in found)


def test_validators_and_cleaning(spark):
    assert values(spark, c.valid_national_id, ["12345678950", "12345678951", "02345678950", "11111111111", "", None]) == [True, False, False, False, False, False]
    assert values(spark, c.valid_phone, ["+90 532 123 45 67", "0532 1234567", "1321234567"]) == [True, True, False]
    assert values(spark, c.clean_entity, [" :A  b\tc.–", "…", ""]) == ["A b c", "…", ""]
    assert values(spark, lambda x: c.exact_round(x, 2), [2.675, 0.125, -0.375], "double") == [round(2.675, 2), round(0.125, 2), round(-0.375, 2)]


def test_boxes(spark):
    boxes = [[0, 0, 10, 10], None, ["1", "2", "3", "x"], ["1", "2", "3"]]
    got = values(spark, c.parsed_box, [b and [str(v) for v in b] for b in boxes], "array<string>")
    assert got[0]["x1"] == 10.0 and got[1:] == [None, None, None]


def test_unsalted_digits(spark):
    cases = [("PHONE", "+90 532 111 22 33", "+90 509 876 54 32"), ("TURKISH_ID", "12345678901", "65432109820"), ("IBAN", "TR33 0006 1005 1978 6457 8413 26", "TR65 4321 0987 6543 2109 8765 43"), ("STUDENT_ID", "2020123456", "5432109876"), ("SIGNATURE", "M. Y", "Generated Signature"), ("LOCATION", "x", None)]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, t string, x string").orderBy("i")
    assert [r[0] for r in rows.select(fakes.fake_value(F.col("t"), F.col("x"))).collect()] == [w for *_, w in cases]


def test_replacement_shapes(spark):
    rnd = random.Random(5)
    phones = ["".join(rnd.choice("0123456789 -/()+") for _ in range(rnd.randint(1, 18))) for _ in range(60)] + ["+905321112233", "none", ""]
    for kind in ("PHONE", "STUDENT_ID"):
        got = values(spark, lambda x, k=kind: fakes.fake_value(F.lit(k), x, F.lit("s")), phones)
        for old, new in zip(phones, got, strict=True):
            if kind == "STUDENT_ID":
                assert len(new) == len(old) and (not new or new.isdigit())
            elif any(ch.isdigit() for ch in old):
                assert [ch if not ch.isdigit() else "0" for ch in old] == [ch if not ch.isdigit() else "0" for ch in new]
    ids = values(spark, lambda x: c.valid_national_id(fakes.fake_value(F.lit("TURKISH_ID"), x, F.lit("s"))), ["12345678901", "10000000146"])
    assert ids == [True, True]
    mails = values(spark, lambda x: fakes.fake_value(F.lit("EMAIL"), x, F.lit("s")), ["a@b.org", "someone.long@host.info", "nothing"])
    assert mails[0].endswith(".org") and len(mails[0].split("@")[0]) == 3 and len(mails[1].split("@")[0]) == 12 and "@" in mails[2]


def random_blocks(seed, n):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        x, y = rnd.choice([10, 40, 40, 90]), rnd.randint(0, 30) / 1.0
        out.append((i, rnd.choice(["ab", "c d", "  ", "x"]), x, y, x + 20, y + rnd.choice([8, 10, 12])))
    return out


def lines_by_hand(blocks):
    found = []
    for i, text, x0, y0, x1, y1 in sorted((b for b in blocks if b[1].strip()), key=lambda b: (b[3], b[2])):
        middle = (y0 + y1) / 2
        near = next((f for f in found if abs(middle - sum(f[0]) / len(f[0])) <= 4), None)
        if near is None:
            near = ([], [])
            found.append(near)
        near[0].append(middle)
        near[1].append((x0, y0, i, text))
    return [" ".join(t for *_, t in sorted(f[1], key=lambda m: (m[0], m[1], m[2]))) for f in found]


def block_rows(spark, docs):
    rows = [(d, 1, i, t, (float(a), float(b), float(e), float(g)), "F", 9.0, 0) for d, blocks in docs.items() for i, t, a, b, e, g in blocks]
    return spark.createDataFrame(rows, "doc_id long, page int, block_no int, text string, box struct<x0:double,y0:double,x1:double,y1:double>, font string, size double, color int")


def test_lines_against_a_plain_fold(spark):
    docs = {d: random_blocks(d, 25) for d in range(12)}
    got = lines.group_lines(block_rows(spark, docs)).orderBy("doc_id", "line_no").collect()
    for d, blocks in docs.items():
        mine = [r for r in got if r["doc_id"] == d]
        assert [r["text"] for r in mine] == lines_by_hand(blocks)
        for r in mine:
            assert all(r["text"][s["start"] : s["end"]] == s["text"] for s in r["segments"])


def detections(spark, rows):
    full = [(d, 1, kind, text, box, conf, "m", "r", None, None, None, None, (0, i, 0, 0)) for i, (d, kind, text, box, conf) in enumerate(rows)]
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    return spark.createDataFrame(full, f"doc_id long, page int, type string, original_text string, box {box}, confidence double, method string, rule string, font string, size double, color int, label_box {box}, ord struct<phase:int,line_no:int,rule_no:int,match_no:int>")


def overlap(a, b):
    w, h = max(0, min(a[2], b[2]) - max(a[0], b[0])), max(0, min(a[3], b[3]) - max(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return w * h / union if union else 0


def test_dedup_against_a_plain_fold(spark):
    rnd = random.Random(2)
    rows = []
    for d in range(8):
        for _ in range(20):
            x = float(rnd.randint(0, 12))
            rows.append((d, rnd.choice("AB"), rnd.choice(["u", "U.", "v", "w", "z", "q"]), (x, 0.0, x + 10, 5.0), rnd.choice([0.5, 0.7, 0.9])))
    got = {(r["doc_id"], r["ord"]["line_no"]) for r in dedup.deduplicate(detections(spark, rows)).collect()}
    wanted = set()
    for d in range(8):
        kept = []
        for i, r in sorted(((i, r) for i, r in enumerate(rows) if r[0] == d), key=lambda p: (p[1][1], -p[1][4], p[0])):
            if not any(k[1] == r[1] and (k[2].strip(".").lower() == r[2].strip(".").lower() or overlap(k[3], r[3]) > 0.55) for _, k in kept):
                kept.append((i, r))
        wanted |= {(d, i) for i, _ in kept}
    assert got == wanted
    again = dedup.deduplicate(dedup.deduplicate(detections(spark, rows)))
    assert again.count() == len(wanted)


def test_first_type_decides_and_unsupported(spark):
    found = detections(spark, [(1, "STUDENT_ID", "2020123456", (0.0, 9.0, 5.0, 10.0), 0.8), (1, "PHONE", "2020123456", (0.0, 9.0, 5.0, 10.0), 0.9), (1, "LOCATION", "Ankara", (0.0, 1.0, 5.0, 2.0), 0.8)])
    rows = {r["type"]: r for r in pipeline.build_replacements(found, "k").collect()}
    assert rows["PHONE"]["fake_text"] == rows["STUDENT_ID"]["fake_text"] and rows["PHONE"]["fake_text"][0] == "5"
    assert rows["LOCATION"]["fake_text"] is None and rows["LOCATION"]["unsupported"]
    with pytest.raises(Exception, match="no replacement"):
        pipeline.build_replacements(found, "k", strict=True).collect()
    one, two = (sorted(r["fake_text"] or "" for r in pipeline.build_replacements(found, "k", scope=s).collect()) for s in ("run", "run"))
    assert one == two


def test_last_style_wins(spark):
    found = detections(spark, [(1, "EMAIL", "x", (0.0, 1.0, 5.0, 2.0), 0.8), (1, "PHONE", " x", (0.0, 9.0, 5.0, 10.0), 0.9)]).withColumn("font", F.col("type"))
    mapped = plan.anonymization_map(pipeline.build_replacements(found, None), found, dedup.order_key()).collect()
    assert {r["font"] for r in mapped} == {"PHONE"} and {r["color"] for r in mapped} == {0}


def test_json_sources(spark, tmp_path):
    pages = [{"page": 1, "width": 595, "height": 842, "blocks": [{"text": "Name: Ada Byron", "bbox": [50, 60, 140, 72], "font": "F", "size": 12.345, "color": 255}, {"text": "x", "bbox": [1, 2]}], "images": []}, {"page_no": 3, "blocks": [], "images": [{"bbox": [1, 2, 3, 4], "width": 5, "height": 6}]}]
    (tmp_path / "a.json").write_text(json.dumps(pages), encoding="utf-8")
    read = layout.read_layout(spark, str(tmp_path / "a.json"))
    assert sorted(r["page"] for r in read.collect()) == [1, 3]
    blocks = layout.blocks_of(read).orderBy("block_no").collect()
    assert blocks[0]["size"] == round(12.345, 2) and blocks[1]["box"] is None
    form = pipeline.Layout(layout.blocks_of(read), layout.images_of(read), layout.pages_of(read))
    assert [(r["type"], r["original_text"]) for r in pipeline.detect_pii(form).collect()] == [("PERSON", "Ada Byron")]
    (tmp_path / "b.json").write_text("{}")
    with pytest.raises(Exception, match="list of pages"):
        layout.read_layout(spark, str(tmp_path / "b.json")).collect()
    for name, content in (("c", [{"type": "PHONE", "text": "1", "page": 1, "bbox": [1, 2, 3, 4]}]), ("d", {"items": [{"type": "PHONE", "value": "1", "page": 1}]})):
        (tmp_path / f"{name}.json").write_text(json.dumps(content))
        assert [r["original_text"] for r in layout.read_detections(spark, str(tmp_path / f"{name}.json")).collect()] == ["1"]
    (tmp_path / "e.json").write_text('{"detections": [{"type": "PHONE"}]}')
    with pytest.raises(Exception, match="no text"):
        layout.read_detections(spark, str(tmp_path / "e.json")).collect()
    layout.write_json(pipeline.detect_pii(form), str(tmp_path / "out"))
    assert "Ada Byron" in "".join(f.read_text() for f in (tmp_path / "out").glob("part-*"))
    row = layout.envelope(pipeline.detect_pii(form)).first()
    assert row["summary"] == {"PERSON": 1} and len(row["detections"]) == 1


def test_scans(spark):
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    pages = spark.createDataFrame([(1, 1, " " * 50 + "short"), (2, 1, "x" * 100), (2, 2, "")], "doc_id long, page int, text string")
    flags = layout.scanned(pages, docs)
    assert {r["doc_id"]: r["is_scanned"] for r in flags.collect()} == {1: True, 2: False, 3: True}
    words = spark.createDataFrame([(1, 1, 0, " w ", 90, 300, 600, 30, 15), (1, 1, 1, " ", 90, 1, 1, 1, 1), (1, 1, 2, "low", -1, 1, 1, 1, 1)], "doc_id long, page int, word_no int, text string, conf int, left int, top int, width int, height int")
    assert [(r["text"], r["size"]) for r in layout.routed(layout.ocr_blocks(words).limit(0), layout.ocr_blocks(words), flags).collect()] == [("w", 3.6)]


def test_entities_of_a_model(spark):
    def load():
        return lambda text: [("PERSON", 0, 3), ("DATE", 4, 6), ("gpe", 4, 7)]

    found = fields.detect_entities(lines.group_lines(block_rows(spark, {1: [(0, "Ada in Rome", 0, 0, 66, 10)]})), load).collect()
    assert sorted((r["type"], r["original_text"]) for r in found) == [("LOCATION", "in"), ("PERSON", "Ada")]


def test_stream(spark, tmp_path):
    from quillmask.streaming.documents import detect_stream

    spark.createDataFrame([(1, "mail a@b.com"), (2, "nothing"), (3, None)], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    detect_stream(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert [r["original_text"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["a@b.com"]
