import pytest
from pyspark.sql import functions as F

from quillmask.operators import lines, metrics, rule_tables, rules

TEXTS = [(1, "mail a@example.com and b@example.org\nPhone: 532 123 45 67"), (2, None), (3, ""), (4, "TC ID: 10000000146\nB-1234 a@example.com")]


def found_in(spark, n=3):
    rows = [(d, d % 5, f"t{d % n}" if d % 7 else None, 0.5 + (d % 6) / 10) for d in range(60)]
    return spark.createDataFrame(rows, "doc_id long, page int, original_text string, confidence double")


def test_metrics_observed_while_writing(spark, tmp_path):
    found = found_in(spark)
    store = metrics.MetricsStore(spark, str(tmp_path / "metrics"))
    row = store.write("a", found, str(tmp_path / "out"))
    assert row["detections"] == spark.read.parquet(str(tmp_path / "out")).count() == 60
    store.write("b", found_in(spark, 5), str(tmp_path / "more"))
    store.write("b", found_in(spark, 5), str(tmp_path / "more"))  # a retry takes the place of the first try
    assert store.total().first().asDict() == {"detections": 120, "confident": 40, "distinct_texts": 5, "pages_with_detections": 60}


def test_metrics_of_nothing(spark, tmp_path):
    store = metrics.MetricsStore(spark, str(tmp_path / "metrics"))
    assert store.write("none", found_in(spark).limit(0), str(tmp_path / "out"))["detections"] == 0
    assert tuple(store.total().first()) == (0, 0, 0, 0)


def test_metrics_of_null_days_and_extra_columns(spark):
    found = found_in(spark).withColumns({"day": F.when(F.col("doc_id") < 10, F.lit("x")), "texts": F.lit("clash")})
    days = {r["day"]: r for r in metrics.merged(metrics.sketched(found, "day"), "day").collect()}
    assert (days["x"]["detections"], days[None]["detections"]) == (10, 50)


def test_sketches_of_days_stay_within_their_error(spark):
    ids = spark.range(200_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("page"), (F.col("id") % 150_000).cast("string").alias("original_text"), F.lit(1.0).alias("confidence"), (F.col("id") % 7).alias("day"))
    total = metrics.merged(metrics.sketched(ids, "day")).first()
    assert total["detections"] == 200_000
    assert abs(total["distinct_texts"] - 150_000) <= metrics.ERROR * 150_000
    assert abs(total["pages_with_detections"] - 200_000) <= metrics.ERROR * 200_000


def test_rules_come_back_from_their_table(spark):
    table = rule_tables.to_table(spark, rules.REGEX_RULES).withColumn("note", F.lit("x"))
    assert rule_tables.from_table(table) == rules.REGEX_RULES


def test_a_view_over_documents(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    docs.createOrReplaceTempView("given_docs")
    rule_tables.to_table(spark, rules.REGEX_RULES).createOrReplaceTempView("own_rules")
    spark.sql(r"SELECT * FROM own_rules UNION ALL SELECT 'badge', 'BADGE', r'B-(\d{4})', 0.9D, NULL, 1, NULL, NULL, NULL, 20").createOrReplaceTempView("given_rules")
    rule_tables.create_view(spark, "given_docs", "given_rules", "given_found")
    got = spark.sql("SELECT doc_id, rule, original_text FROM given_found WHERE rule = 'badge' OR type = 'EMAIL' ORDER BY ALL").collect()
    assert [tuple(r) for r in got] == [(1, "email", "a@example.com"), (1, "email", "b@example.org"), (4, "badge", "1234"), (4, "email", "a@example.com")]
    wanted = rules.detect_with_rules(lines.single_lines(docs, "doc_id", "text"), rules.REGEX_RULES)
    assert spark.table("given_found").filter("rule <> 'badge'").exceptAll(wanted).count() == 0 == wanted.exceptAll(spark.table("given_found")).count()


def test_a_table_without_rules(spark):
    docs = lines.single_lines(spark.createDataFrame(TEXTS, "doc_id long, text string"), "doc_id", "text")
    found = rule_tables.detect_by_table(docs, rule_tables.to_table(spark, ()))
    assert found.count() == 0 and found.columns == list(rules.COLUMNS)


@pytest.mark.parametrize(
    "change, says",
    [({"pattern": "("}, "pattern"), ({"pattern": None}, "needed"), ({"capture": 3}, "group"), ({"validator": "no"}, "validator"), ({"finder": "no"}, "finder"), ({"confidence": 2.0}, "confidence"), ({"name": "email"}, "twice"), ({"prefilter": "["}, "prefilter")],
)
def test_wrong_rules_are_named(spark, change, says):
    row = {"name": "mine", "pii_type": "X", "pattern": "a(b)", "confidence": 0.5, "method": None, "capture": 1, "validator": None, "prefilter": None, "finder": None, "ord": 9} | change
    table = rule_tables.to_table(spark, rules.REGEX_RULES[:1]).unionByName(spark.createDataFrame([row], rule_tables.SCHEMA))
    with pytest.raises(ValueError, match=says) as raised:
        rule_tables.from_table(table)
    assert row["name"] in str(raised.value)
