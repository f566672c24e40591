"""Forms: a page for each customer, by arithmetic on the customer's key, with known personal data and planted cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import box, national_checks

FIRST_NAMES = ("Ahmet", "Elif", "Mehmet", "Zeynep", "Can")
LAST_NAMES = ("Yilmaz", "Kaya", "Demir", "Sahin", "Koksal", "Aydin", "Arslan")
FIRMS = ("Acme Holding", "Toros Teknoloji", "Ege Insaat")
WIDTH, HEIGHT = 595.0, 842.0


def _pad(x, n: int):
    return F.lpad(x.cast("string"), n, "0")


def blocks(customers: DataFrame) -> DataFrame:
    """Blocks of the forms; doc_id is the customer's key k. Planted: k mod 7 = 0 a wrong national id, mod 5 the e-mail twice,
    mod 11 a student id shaped like a phone number, mod 13 a handwriting label; the name's two spans are up to 3 points apart."""
    k, nine = F.col("k"), F.col("nine")
    # what stands in several places is a column first, as a generator computes it for each of them
    several = {
        "nine": (100_000_000 + (k * 7919) % 899_999_999).cast("string"), "p": _pad((k * 7919) % 10_000_000, 7), "q": _pad((k * 104_729) % 1_000_000_000, 9), "r": _pad((k * 15_485_863) % 1_000_000_000_000, 12),
        "mail": F.concat(F.lit("user"), k.cast("string"), F.lit("@example"), (k % 10).cast("string"), F.lit(".com")),
    }
    tenth, eleventh = national_checks([F.substring(nine, i + 1, 1).cast("int") for i in range(9)])
    eleventh = F.when(k % 7 == 0, (eleventh + 1) % 10).otherwise(eleventh)
    checks = F.concat(tenth.cast("string"), eleventh.cast("string"))
    p, q, r, mail = (F.col(c) for c in ("p", "q", "r", "mail"))
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (k % len(names) + 1).cast("int"))
    iban = F.concat(F.lit("TR"), F.substring(r, 1, 2), *(F.concat(F.lit(" "), F.substring(F.concat(r, r), s, 4)) for s in (3, 7, 11, 15, 19)), F.lit(" "), F.substring(r, 11, 2))
    student = F.when(k % 11 == 0, F.concat(F.lit("20"), F.substring(q, 1, 8))).otherwise(F.concat(F.lit("20"), q))
    parts = [  # text, x, y
        (F.lit("Name:"), 50, 60 + k % 4),
        (F.concat_ws(" ", pick(FIRST_NAMES), pick(LAST_NAMES)), 120, F.lit(60)),
        (F.concat(F.lit("Phone: +90 5"), F.substring(p, 1, 2), F.lit(" "), F.substring(p, 3, 3), F.lit(" "), F.substring(p, 6, 2), F.lit(" 42")), 50, F.lit(90)),
        (F.concat(F.lit("Email: "), mail), 50, F.lit(120)),
        (F.concat(F.lit("TC ID: "), nine, F.col("checks")), 50, F.lit(150)),
        (F.concat(F.lit("IBAN: "), iban), 50, F.lit(180)),
        (F.concat(F.lit("Student ID: "), student), 50, F.lit(210)),
        (F.concat(F.lit("Company: "), pick(FIRMS), F.lit(" Ltd")), 50, F.lit(240)),
        (F.lit("Signature:"), 50, F.lit(300)),
        (F.when(k % 13 == 0, F.lit("Handwritten")), 50, F.lit(400)),
        (F.when(k % 5 == 0, F.concat(F.lit("Email: "), mail)), 50, F.lit(500)),
    ]
    rows = F.array(*(F.struct(F.lit(i).alias("block_no"), t.alias("text"), F.lit(float(x)).alias("x"), y.cast("double").alias("y")) for i, (t, x, y) in enumerate(parts)))
    values = customers.select(F.col("c_custkey").alias("k")).withColumns(several).withColumn("checks", checks)
    found = values.select(k.alias("doc_id"), F.inline(rows)).filter("text is not null")
    b = box(F.col("x"), F.col("y"), F.col("x") + 6 * F.length("text"), F.col("y") + 12)
    return found.select("doc_id", F.lit(1).alias("page"), "block_no", "text", b.alias("box"), F.when(F.col("block_no") == 1, F.lit("Bold")).otherwise(F.lit("Body")).alias("font"), F.lit(12.0).alias("size"), (F.col("block_no") * 65_793).cast("int").alias("color"))


def images(customers: DataFrame) -> DataFrame:
    """An image beside the signature label; where k mod 3 = 0 it is far away."""
    k = F.col("c_custkey")
    near = box(F.lit(130), F.lit(290), F.lit(310), F.lit(345))
    return customers.select(k.alias("doc_id"), F.lit(1).alias("page"), F.lit(0).alias("image_no"), F.when(k % 3 == 0, box(F.lit(400), F.lit(700), F.lit(500), F.lit(760))).otherwise(near).alias("box"))


def pages(customers: DataFrame) -> DataFrame:
    return customers.select(F.col("c_custkey").alias("doc_id"), F.lit(1).alias("page"), F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"))


def second_pages(first: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks and pages of the forms' second pages, from the first pages' blocks: the student id and the e-mail once more, in
    another style, and two signature labels, of which one ends in the right part of the page."""
    again = first.filter("block_no in (3, 6)").select("doc_id", F.lit(2).alias("page"), "block_no", "text", "box")
    label = lambda no, x, y: F.struct(F.lit(no).alias("block_no"), F.lit("Signature:").alias("text"), box(F.lit(x), F.lit(y), F.lit(x + 60), F.lit(y + 12)).alias("box"))
    labels = first.filter("block_no = 8").select("doc_id", F.lit(2).alias("page"), F.inline(F.array(label(8, 430.0, 300.0), label(9, 50.0, 600.0))))
    found = again.unionByName(labels).withColumns({"font": F.lit("Second"), "size": F.lit(9.0), "color": F.lit(77)})
    return found, first.filter("block_no = 8").select("doc_id", F.lit(2).alias("page"), F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"))
