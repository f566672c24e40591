"""Format-preserving replacement values, drawn by a salted hash, as expressions.

A value's seed is the first 16 hexadecimal digits of SHA-256 of "salt:text" (of the text alone without a salt). Position
i gets the digit (seed + 7919 i) mod 10, which is (seed - i) mod 10. The salt is a literal or a column, never drawn in a
task, so that a task run again gives the same values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import let, only_digits

# Types that have a replacement, the signature's replacement, name parts of organisations, names never given.
TYPES = ("PERSON", "ORGANIZATION", "EMAIL", "PHONE", "TURKISH_ID", "IBAN", "STUDENT_ID", "SIGNATURE")
PLACEHOLDER = "Generated Signature"
SUFFIXES = ("A.S.", "Ltd. Sti.", "Grup", "Holding", "Teknoloji", "Insaat", "Danismanlik")
PREFIXES = ("Anadolu", "Akdeniz", "Bogazici", "Karadeniz", "Toros", "Ege", "Marmara", "Yildiz", "Atlas", "Altin", "Günes", "Demir", "Celik", "Kartal", "Bahar")
DENIED = ("öcalan", "ocalan", "pkk", "apocular")
ATTEMPTS = 10

#: Our own names; the contract is a plausible name for each text, not particular ones.
FIRST = ("Alice", "Brian", "Carla", "David", "Elena", "Frank", "Grace", "Henry", "Irene", "James", "Karen", "Louis", "Maria", "Nolan", "Olivia", "Peter")
LAST = ("Adams", "Baker", "Clark", "Dixon", "Evans", "Foster", "Grant", "Harris", "Irwin", "Jensen", "Keller", "Lawson", "Miller")
HOSTS = ("example", "sample", "mailbox", "postbox", "inbox")


def seed(text: Column, salt: Column | None) -> Column:
    """The seed as a decimal string: it needs 64 bits without a sign."""
    salted = text if salt is None else F.concat(salt, F.lit(":"), text)
    return F.conv(F.substring(F.sha2(salted.cast("binary"), 256), 1, 16), 16, 10)


def last_digit(seed_: Column) -> Column:
    return F.substring(seed_, -1, 1).cast("int")


def seed_mod(seed_: Column, n: int, over: int = 1) -> Column:
    """(seed // over) mod n."""
    return F.pmod(F.floor(seed_.cast("decimal(20,0)") / F.lit(over).cast("decimal(20,0)")), F.lit(n)).cast("int") if over > 1 else F.pmod(seed_.cast("decimal(20,0)"), F.lit(n)).cast("int")


def digit_at(seed_: Column, i: Column | int) -> Column:
    return F.pmod(last_digit(seed_) - i, F.lit(10)).cast("int")


def digit_run(seed_: Column, n: Column | int) -> Column:
    """The first n digits as a string: they count down from the seed's last digit, over and over."""
    n = F.lit(n) if isinstance(n, int) else n
    down = F.repeat(F.lit("9876543210"), (n / 10).cast("int") + 2)
    return F.when(n > 0, F.substr(down, 10 - last_digit(seed_), n)).otherwise("")


#: Characters that are replaced.
DIGIT, LETTER_OR_DIGIT = r"(?U)\d", r"[\p{L}\p{N}]"


def fill(text: Column, values: Column, slot: str, spare: str = "0") -> Column:
    """Puts the next of `values` into each character of `text` that is a slot (a pattern); `spare` when they are used up. What lies
    between slots is found in one pass of the pattern, so that a step is a slot and not a character put to a pattern."""

    def put(between: Column, ready: Column) -> Column:
        return F.array_join(F.transform(between, lambda part, i: F.when(i == 0, part).otherwise(F.concat(F.substr(ready, i, F.lit(1)), part))), "")

    enough = lambda between: F.rpad(values, F.size(between), F.lit(spare))
    return let(F.split(text, slot, -1), lambda between: let(enough(between), lambda ready: put(between, ready)))


def national_id(text: Column, s: Column) -> Column:
    def whole(last: int) -> str:
        nine = [last or 1, *((last - i) % 10 for i in range(1, 9))]
        tenth = (7 * sum(nine[0:9:2]) - sum(nine[1:8:2])) % 10
        return "".join(map(str, (*nine, tenth, (sum(nine) + tenth) % 10)))

    # all digits follow from the seed's last one
    return fill(text, pick(tuple(map(whole, range(10))), last_digit(s)), DIGIT)


def student_id(text: Column, s: Column) -> Column:
    """A digit for every character; the first isn't 0 where the original begins with another digit."""
    run = digit_run(s, F.length(text))
    return F.when(text.rlike(r"(?U)^\d") & ~text.startswith("0") & run.startswith("0"), F.concat(F.lit("1"), F.substr(run, F.lit(2)))).otherwise(run)


def phone(text: Column, s: Column) -> Column:
    """Keeps separators, and the digits of +90 where the number begins with it; the first digit replaced is a 5."""
    plus = F.instr(text, "+")
    coded = F.regexp_replace(text, r"(?U)[\s\-()]", "").startswith("+90") & (F.substr(text, plus + 1, F.lit(1)) == "9")
    kept = F.when(coded & (F.substr(text, plus + 2, F.lit(1)) == "0"), plus + 2).when(coded, plus + 1).otherwise(F.lit(0))
    n = F.length(only_digits(text))
    values = F.concat(F.lit("5"), F.substr(digit_run(s, n), F.lit(2)))
    own = F.concat(F.lit("+90 5"), F.substr(digit_run(s, 10), F.lit(2), F.lit(2)), F.lit(" "), F.substr(digit_run(s, 10), F.lit(4), F.lit(3)), F.lit(" "), F.substr(digit_run(s, 10), F.lit(7), F.lit(4)))
    filled = F.concat(F.substr(text, F.lit(1), kept), fill(F.substr(text, kept + 1), values, DIGIT))
    return F.when(n == 0, own).otherwise(filled)


def iban(text: Column, s: Column) -> Column:
    value = F.concat(F.lit("TR"), digit_run(s, 24))
    return F.when(text.rlike(LETTER_OR_DIGIT), fill(text, value, LETTER_OR_DIGIT)).otherwise(F.concat(text, value))


def pick(names: tuple[str, ...], i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), i + 1)


def person(s: Column) -> Column:
    return F.concat_ws(" ", pick(FIRST, seed_mod(s, len(FIRST))), pick(LAST, seed_mod(s, len(LAST), len(FIRST))))


def organization(s: Column, names: tuple[str, ...] = ()) -> Column:
    """A firm of `names`: that of the seed, or the next of ATTEMPTS that holds no denied name. Without one (and without
    names) a prefix and a suffix of the fixed lists."""
    safe = F.concat_ws(" ", pick(PREFIXES, seed_mod(s, len(PREFIXES))), pick(SUFFIXES, seed_mod(s, len(SUFFIXES), len(PREFIXES))))
    if not names:
        return safe
    tries = F.transform(F.sequence(F.lit(0), F.lit(ATTEMPTS - 1)), lambda k: pick(names, F.pmod(seed_mod(s, len(names)) + k, F.lit(len(names))).cast("int")))
    allowed = F.filter(tries, lambda x: ~F.rlike(F.lower(x), F.lit("|".join(DENIED))))
    return F.coalesce(F.get(allowed, F.lit(0)), safe)


def email(text: Column, s: Column) -> Column:
    """Keeps the length of the local part (3 at least) and a top-level domain of up to three characters."""
    local = F.lower(F.concat(pick(FIRST, seed_mod(s, len(FIRST))), pick(LAST, seed_mod(s, len(LAST), len(FIRST))), F.lpad(seed_mod(s, 100).cast("string"), 2, "0")))
    host = pick(HOSTS, seed_mod(s, len(HOSTS), 1000))
    at = F.instr(text, "@")
    domain = F.substr(text, at + 1)
    tld = F.substring_index(domain, ".", -1)
    kept = F.when(domain.contains(".") & (F.length(tld) <= 3), tld).otherwise(F.lit("com"))
    shaped = F.concat(F.rpad(local, F.greatest(at - 1, F.lit(3)), F.lit("x")), F.lit("@"), host, F.lit("."), kept)
    return F.when(at == 0, F.concat(local, F.lit("@"), host, F.lit(".com"))).otherwise(shaped)


def fake_value(pii_type: Column, text: Column, salt: Column | None = None, firms: tuple[str, ...] = ()) -> Column:
    """The replacement of a text by its type; null for types without one."""
    kind = F.upper(pii_type)
    return let(
        seed(text, salt),
        lambda s: F.when(kind == "TURKISH_ID", national_id(text, s))
        .when(kind == "STUDENT_ID", student_id(text, s))
        .when(kind == "PHONE", phone(text, s))
        .when(kind == "IBAN", iban(text, s))
        .when(kind == "EMAIL", email(text, s))
        .when(kind == "PERSON", person(s))
        .when(kind == "ORGANIZATION", organization(s, firms))
        .when(kind == "SIGNATURE", F.lit(PLACEHOLDER)),
    )


def run_salt(run_key: str, scope: str = "doc") -> Column:
    """The salt of a run, and of each document of it for scope 'doc'. run_key is drawn once, on the driver."""
    return F.lit(run_key) if scope == "run" else F.substring(F.sha2(F.concat(F.lit(run_key), F.lit("/"), F.col("doc_id").cast("string")), 256), 1, 16)


def mapping(found: DataFrame, order: Column, scope: str = "doc") -> DataFrame:
    """For each text (of a document, or of the run) the type that its first detection has. A partial aggregate, so that a common text is no hot key."""
    keys = ["original_text"] if scope == "run" else ["doc_id", "original_text"]
    return found.groupBy(*keys).agg(F.min_by("type", F.struct("doc_id", order)).alias("first_type"))


def replacements(found: DataFrame, order: Column, run_key: str | None, scope: str = "doc", strict: bool = False, known: DataFrame | None = None) -> DataFrame:
    """Detections with first_type, fake_text, unsupported (a type without replacement) and, for signatures, metadata. The first
    detection of a text decides its value, whatever type later ones have. strict: an unsupported type is an error. known: values
    given before (original_text, fake_text, and doc_id if they are a document's own), which are used again; see mapped_values()."""
    kind = F.upper("type")
    typed = kind.isin(*TYPES)
    if scope == "run":
        rows = found.join(mapping(found.filter(typed), order, scope), "original_text", "left")
    else:  # a document's rows of one text are few, and a window reads the detections once
        first = F.min_by("type", F.when(typed, order)).over(Window.partitionBy("doc_id", "original_text"))
        rows = found.withColumn("first_type", first)
    supported = typed
    if strict:
        supported = F.when(supported, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no replacement for type "), F.coalesce(kind, F.lit("null")))).cast("boolean"))
    rows = rows.withColumn("type", kind)
    salt = None if run_key is None else run_salt(run_key, scope)
    metadata = F.when(F.col("type") == "SIGNATURE", F.struct(F.lit(True).alias("placeholder"), F.lit("pending").alias("signature_generation"), F.length("original_text").alias("original_length")))
    fake = F.when(supported, fake_value(F.col("first_type"), F.col("original_text"), salt))
    if known is not None:
        keys = [c for c in ("doc_id", "original_text") if c in known.columns]
        given = known.groupBy(*keys).agg(F.min("fake_text").alias("given"))
        rows = rows.join(given, keys, "left")
        fake = F.when(supported, F.coalesce("given", fake))
    return rows.withColumn("fake_text", fake).drop("given").withColumn("unsupported", ~F.upper("type").isin(*TYPES)).withColumn("metadata", metadata)


def mapped_values(replaced: DataFrame, scope: str = "doc") -> DataFrame:
    """The values that replacements() gave, for its `known`: a later run over other detections gives the same texts the same values."""
    keys = ["original_text"] if scope == "run" else ["doc_id", "original_text"]
    return replaced.filter("fake_text is not null").groupBy(*keys).agg(F.min("fake_text").alias("fake_text"))
