"""Places of a regex in a text, as code points, with built-in functions only."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 128


def spans(text: Column, regex: Column) -> Column:
    """array<struct<start:int, end:int, match:string>> of the leftmost non-overlapping matches.

    The text between the matches and the matches themselves alternate, so a start is the sum of
    the lengths before it. The sums run in chunks of 128, so a text with very many matches costs
    no quadratic copying. The regex must not match the empty string.
    """
    found = F.regexp_extract_all(text, regex, F.lit(0))
    rest = F.split(text, regex, -1)
    steps = F.zip_with(rest, found, lambda p, m: F.struct(
        F.length(p).alias("gap"), F.length(m).alias("size"), m.alias("match")))
    steps = F.filter(steps, lambda s: s["match"].isNotNull())

    def chunk(all_steps, c):
        base = F.aggregate(F.slice(all_steps, F.lit(1), c * CHUNK), F.lit(0), lambda a, s: a + s["gap"] + s["size"])
        start = F.struct(base.alias("at"), F.array().cast("array<struct<start:int,end:int,match:string>>").alias("out"))

        def add(acc, s):
            a = acc["at"] + s["gap"]
            return F.struct((a + s["size"]).alias("at"), F.concat(acc["out"], F.array(F.struct(
                a.alias("start"), (a + s["size"]).alias("end"), s["match"].alias("match")))).alias("out"))
        return F.aggregate(F.slice(all_steps, c * CHUNK + 1, F.lit(CHUNK)), start, add, lambda acc: acc["out"])

    # the array is bound once: transform over a one-element array gives it a name
    return F.flatten(F.flatten(F.transform(F.array(steps), lambda s: F.transform(
        F.sequence(F.lit(0), F.floor((F.size(s) - 1) / CHUNK).cast("int")), lambda c: chunk(s, c)))))
