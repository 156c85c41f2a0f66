"""What two people are to each other, from the steps between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Steps of blood up and down, siblings and spouses, each with the gender of who is reached.
UP, DOWN = {"mother": "F", "father": "M"}, {"son": "M", "daughter": "F"}
SIBLING, SPOUSE = {"brother": "M", "sister": "F"}, {"husband": "M", "wife": "F"}
#: Names by marriage of two steps, by what they are and the gender of who is reached, or the step before the marriage.
BY_MARRIAGE = {
    ("spouse", "mother"): "mother-in-law", ("spouse", "father"): "father-in-law", ("spouse", "brother"): "brother-in-law", ("spouse", "sister"): "sister-in-law",
    ("son", "spouse"): "daughter-in-law", ("daughter", "spouse"): "son-in-law", ("brother", "spouse"): "sister-in-law", ("sister", "spouse"): "brother-in-law",
}
#: Words for degrees of cousins.
DEGREES = {2: "second", 3: "third", 4: "fourth"}


def _table(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def gender(relation: Column) -> Column:
    return _table({**UP, **DOWN, **SIBLING, **SPOUSE})[relation]


def term(up: Column, down: Column, sex: Column) -> Column:
    """The name of someone so many generations up to a common ancestor and down from it; null where there is no common one."""
    great = lambda n: F.repeat(F.lit("great-"), F.greatest(n - 2, F.lit(0)).cast("int"))
    by = lambda m, f: F.when(sex == "M", m).otherwise(f)
    degree = (up - 1).cast("int")
    cousin = F.when(degree == 1, "cousin").otherwise(F.concat(F.coalesce(_table(DEGREES)[degree], F.concat(degree.cast("string"), F.lit("th"))), F.lit(" cousin")))
    return (
        F.when((up == 0) & (down == 0), F.lit(None).cast("string"))
        .when((down == 0) & (up == 1), by("father", "mother")).when(down == 0, F.concat(great(up), by("grandfather", "grandmother")))
        .when((up == 0) & (down == 1), by("son", "daughter")).when(up == 0, F.concat(great(down), by("grandson", "granddaughter")))
        .when((up == 1) & (down == 1), by("brother", "sister")).when(down == 1, F.concat(great(up), by("uncle", "aunt")))
        .when(up == 1, F.concat(great(down), by("nephew", "niece"))).when(up == down, cousin)
    )


def composed(relations: Column) -> Column:
    """The name of who is reached by relations in turn; null where no name is common.

    A fold over a table of steps: blood goes up, then down; a step down and up again
    or a spouse leaves the table, but for two steps of which one is a marriage.
    A sibling is a step up and one down.
    """
    steps = _table({**dict.fromkeys(UP, 10), **dict.fromkeys(DOWN, 1), **dict.fromkeys(SIBLING, 11)})
    begin = F.struct(F.lit(0).alias("up"), F.lit(0).alias("down"), F.lit(True).alias("blood"))

    def step(a: Column, r: Column) -> Column:
        u, d = F.floor(steps[r] / 10).cast("int"), (steps[r] % 10).cast("int")
        return F.struct((a["up"] + F.coalesce(u, F.lit(0))).cast("int").alias("up"), (a["down"] + F.coalesce(d, F.lit(0))).cast("int").alias("down"), (a["blood"] & steps[r].isNotNull() & ((F.coalesce(u, F.lit(0)) == 0) | (a["down"] == 0))).alias("blood"))

    sex = gender(F.element_at(relations, -1))
    blood = F.aggregate(relations, begin, step)
    plain = F.transform(relations, lambda r: F.when(r.isin(*SPOUSE), "spouse").otherwise(r))
    marriage = _table({"|".join(k): v for k, v in BY_MARRIAGE.items()})[F.array_join(plain, "|")]
    return F.coalesce(marriage, F.when(blood["blood"], term(blood["up"], blood["down"], sex)))


def relatives(facts: DataFrame, hops: int = 3) -> DataFrame:
    """(start, end, relations, term) of facts (s, r, o), "o is the r of s", for all simple chains of 2 to ``hops`` that have a name."""
    family = facts.where(F.col("r").isin(*UP, *DOWN, *SIBLING, *SPOUSE)).select("s", "r", "o").distinct()
    rows = family.select(F.array("s", "o").alias("nodes"), F.col("o").alias("s"), F.array("r").alias("relations"))
    out = None
    for _ in range(hops - 1):
        rows = rows.join(family, "s").where(~F.array_contains("nodes", F.col("o"))).select(F.array_append("nodes", F.col("o")).alias("nodes"), F.col("o").alias("s"), F.array_append("relations", F.col("r")).alias("relations"))
        out = rows if out is None else out.union(rows)
    named = out.select(F.col("nodes")[0].alias("start"), F.col("s").alias("end"), F.array_join("relations", ",").alias("relations"), composed(F.col("relations")).alias("term"))
    return named.where("term IS NOT NULL").distinct()
