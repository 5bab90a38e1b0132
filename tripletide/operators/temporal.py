"""Years in names and what they imply: lifetimes, plausibility, events outside a life."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import ontology as o

FIRST_YEAR, MAX_LIFESPAN = 1000, 130
#: Month names in dates.
_MONTHS_EN = "January|February|March|April|May|June|July|August|September|October|November|December"
_MONTHS_DE = "Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember"
#: Fixed values: (pattern, groups that hold years), in order of precedence.
YEAR_PATTERNS = (
    (r"(?i)\b(1[0-9]{3}|20[0-9]{2})\b", (1,)),
    (r"(?i)\((\d{4})[-–](\d{4})\)", (1, 2)),
    (r"(?i)\((\d{4})\)", (1,)),
    (r"(?i)(\d{4})$", (1,)),
    (rf"(?i)(?:{_MONTHS_EN})\s+\d{{1,2}},?\s+(\d{{4}})", (1,)),
    (rf"(?i)\d{{1,2}}\.\s*(?:{_MONTHS_DE})\s+(\d{{4}})", (1,)),
    (r"(?i)^(\d{4})-\d{2}-\d{2}", (1,)),
)


def years(text: Column, this_year: int) -> Column:
    """All plausible years of a text, by pattern and then place, each once; null text has none."""
    found = []
    for pattern, groups in YEAR_PATTERNS:
        per = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in groups]
        both = F.flatten(F.transform(F.arrays_zip(per[0].alias("a"), per[-1].alias("b")), lambda z: F.array(z["a"], z["b"])))
        found.append(per[0] if len(per) == 1 else both)
    n = F.transform(F.concat(*found), lambda x: x.cast("int"))
    return F.coalesce(F.array_distinct(F.filter(n, lambda x: x.between(FIRST_YEAR, this_year + 10))), F.array().cast("array<int>"))


def one_year(text: Column, this_year: int) -> Column:
    """The last of `years`, null where there is none."""
    y = years(text, this_year)
    return F.get(y, F.size(y) - 1)


def year_range(text: Column, this_year: int) -> Column:
    """Struct (from, to) of the first ``dddd-dddd`` whose years are both plausible, else null."""
    r = r"(\d{4})\s*[-–—]\s*(\d{4})"
    a, b = (F.regexp_extract(text, r, g).try_cast("int") for g in (1, 2))
    ok = a.between(FIRST_YEAR, this_year + 10) & b.between(FIRST_YEAR, this_year + 10)
    return F.when(ok, F.struct(a.alias("from"), b.alias("to")))


def context(edges: DataFrame, this_year: int) -> DataFrame:
    """(s_id, birth_year, death_year): from the edges of each subject; of several the last in order of seq counts."""
    kind = F.when(F.col("pred").isin(*o.BIRTH), "birth").when(F.col("pred").isin(*o.DEATH), "death")
    e = edges.select("seq", "s_id", kind.alias("kind"), one_year(F.col("o_name"), this_year).alias("year")).where("kind is not null and year is not null")
    last = lambda k: F.max_by(F.when(F.col("kind") == k, F.col("year")), F.when(F.col("kind") == k, F.col("seq")))
    return e.groupBy("s_id").agg(last("birth").alias("birth_year"), last("death").alias("death_year"))


def in_lifetime(year: Column, birth: Column, death: Column) -> Column:
    """False outside the known life, true if the birth is known, else null."""
    return F.when((year < birth) | (year > death), False).when(birth.isNotNull(), True)


def check(batch: DataFrame, edges: DataFrame, this_year: int) -> DataFrame:
    """(seq, severity, rule): the first temporal conflict of each fact; plausibility, then birth and death, then events in a life."""
    p, y, b, d = F.col("pred"), F.col("year"), F.col("birth_year"), F.col("death_year")
    j = batch.withColumn("year", one_year(F.col("o_name"), this_year)).join(context(edges, this_year), "s_id", "left")
    rules = [
        ("future", y > this_year + 1, 0.9),
        ("early_award", p.isin(*o.AWARDS) & (y < 1800), 0.8),
        ("other_birth", p.isin(*o.BIRTH) & (b != y), 0.9),
        ("birth_after_death", p.isin(*o.BIRTH) & (y > d), 0.95),
        ("long_life", p.isin(*o.BIRTH) & (d - y > MAX_LIFESPAN), 0.8),
        ("other_death", p.isin(*o.DEATH) & (d != y), 0.9),
        ("death_before_birth", p.isin(*o.DEATH) & (y < b), 0.95),
        ("long_life", p.isin(*o.DEATH) & (y - b > MAX_LIFESPAN), 0.8),
        ("active_after_death", p.isin(*o.LIFETIME) & p.isin(*o.PRESENT) & y.isNull() & d.isNotNull(), 0.9),
        ("before_birth", p.isin(*o.LIFETIME) & (y < b), 0.9),
        ("after_death", p.isin(*o.LIFETIME) & (y > d), 0.95),
    ]
    rule, sev = None, None
    for name, cond, s in rules:
        c = F.coalesce(cond, F.lit(False))
        rule = F.when(c, name) if rule is None else rule.when(c, name)
        sev = F.when(c, s) if sev is None else sev.when(c, s)
    return j.select("seq", sev.alias("severity"), rule.alias("rule")).where("rule is not null")
