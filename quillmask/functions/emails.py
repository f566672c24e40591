"""E-mail addresses in a line, found from their @ signs.

The pattern `rules.EMAIL`, put to a line as it is, tries each place of a long run of address characters and reads on to the
run's end each time, which is quadratic. Here a line is cut at its @ signs. Left of one, the address characters that end
the piece are its run, and the local part begins at the run's first word boundary; right of it, the domain is
matched at the beginning of the next piece alone. An address takes characters that the next one may not begin in, so
pieces are gone through in order. Every character is read a bounded number of times, and the matches are those of the
pattern.
"""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import gathered, let

# Characters of a local part, those of them that aren't part of words, and the domain's pattern.
WORD = string.ascii_letters + string.digits + "_"
OTHER = ".%+-"
DOMAIN = r"(?U)^[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"

HIT = "struct<raw:string,start:int,end:int>"


def local_length(run: Column, before: Column) -> Column:
    """Characters of a run of local characters from its first word boundary on; 0 without one. before: the character that stands before it, or an empty text."""
    begins = F.substring(run, 1, 1).rlike("[A-Za-z0-9_]")
    alike = F.length(F.when(begins, F.ltrim(run, F.lit(WORD))).otherwise(F.ltrim(run, F.lit(OTHER))))
    return F.when(before.rlike(r"(?U)\w") != begins, F.length(run)).otherwise(alike)


def email_matches(text: Column) -> Column:
    """Array of struct(raw, start, end) of the addresses of a line."""

    def of(parts: Column) -> Column:
        def step(carry: Column, i: Column) -> Column:
            # carry: where the piece left of the sign begins, and how much of it the last address took
            def addressed(left: Column, right: Column) -> Column:
                size = F.length(left)

                def with_run(low: Column) -> Column:
                    before = F.when(low > 0, F.substring(left, low, F.lit(1))).when(i > 1, F.lit("@")).otherwise(F.lit(""))
                    local = local_length(F.substring(left, low + 1, size), before)

                    def hits(n: Column, domain: Column) -> Column:
                        at, whole = carry["at"] + size, (n > 0) & (domain != "")
                        raw = F.concat(F.substring(left, size - n + 1, n), F.lit("@"), domain)
                        one = F.struct(raw.alias("raw"), (at - n).alias("start"), (at + 1 + F.length(domain)).alias("end"))
                        then = F.struct((at + 1).alias("at"), F.when(whole, F.length(domain)).otherwise(F.lit(0)).alias("used"))
                        return F.struct(then.alias("carry"), F.when(whole, F.array(one)).otherwise(F.array().cast(f"array<{HIT}>")).alias("hits"))

                    return let(local, lambda n: let(F.regexp_extract(right, DOMAIN, 0), lambda domain: hits(n, domain)))

                return let(F.greatest(F.length(F.rtrim(left, F.lit(WORD + OTHER))), carry["used"]), with_run)

            return let(F.get(parts, i - 1), lambda left: let(F.get(parts, i), lambda right: addressed(left, right)))

        first = F.struct(F.lit(0).alias("at"), F.lit(0).alias("used"))
        found = gathered(F.sequence(F.lit(1), F.size(parts) - 1), first, step, HIT)
        return F.when(F.size(parts) > 1, found).otherwise(F.array().cast(f"array<{HIT}>"))

    return let(F.split(text, "@", -1), of)
