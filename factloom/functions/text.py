"""Text functions, as expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .traits import NUMBER_WORDS

#: Fixed patterns.
TOKEN = r"[A-Za-z0-9_]+|[^\sA-Za-z0-9_]"
NEGATION = r"(?i)\b(?:not|isn'?t|aren'?t|never|nothing)\b"


def tokens(text: Column) -> Column:
    """Words and single signs, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), F.lit(1))


def detokenize(words: Column) -> Column:
    return F.regexp_replace(F.array_join(words, " "), r" ([.,!?;:)])", "$1")


def sentences(text: Column) -> Column:
    """Pieces that end with . ! or ? before white space."""
    marked = F.regexp_replace(F.trim(text), r"([.!?])\s+", "$1\u0001")
    return F.filter(F.split(marked, "\u0001"), lambda s: s != "")


def singular(word: Column) -> Column:
    n = F.length(word)
    cut = lambda k: F.substring(word, F.lit(1), n - k)
    return (
        F.when(n <= 3, word)
        .when(word.endswith("ies"), F.concat(cut(3), F.lit("y")))
        .when(word.rlike("[sxz]es$"), cut(2))
        .when(word.endswith("s") & ~word.endswith("ss"), cut(1))
        .otherwise(word)
    )


def number(text: Column) -> Column:
    """A number from digits with thousands commas, or from number words joined by space, _ or -; null if it is none."""
    clean = F.lower(F.trim(text))
    digits = F.regexp_replace(clean, ",", "").try_cast("double")
    words = F.split(clean, r"[_\s-]+")
    table = F.create_map(*[F.lit(x) for kv in NUMBER_WORDS.items() for x in (kv[0], float(kv[1]))])
    known = F.forall(words, lambda w: w.isin("hundred", "thousand", "million") | table[w].isNotNull())
    begin = F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("part"))

    def step(a: Column, w: Column) -> Column:
        unit = F.greatest(a["part"], F.lit(1.0))
        big = F.when(w == "million", 1e6).otherwise(1e3)
        total = F.when(w.isin("thousand", "million"), a["total"] + unit * big).otherwise(a["total"])
        part = F.when(w == "hundred", unit * 100).when(w.isin("thousand", "million"), 0.0).otherwise(a["part"] + F.coalesce(table[w], F.lit(0.0)))
        return F.struct(total.alias("total"), part.alias("part"))

    spelled = F.aggregate(words, begin, step, lambda a: a["total"] + a["part"])
    return F.coalesce(digits, F.when(known, spelled))


def arithmetic(text: Column) -> Column:
    """The value of "a op b", with or without "what is" before it; null for other texts and for division by 0."""
    pattern = r"(?i)^\s*(?:what\s+is\s+)?(-?\d+(?:\.\d+)?)\s*([-+*/])\s*(-?\d+(?:\.\d+)?)\s*\??\s*$"
    a, op, b = (F.regexp_extract(text, pattern, k) for k in (1, 2, 3))
    a, b = a.try_cast("double"), b.try_cast("double")
    return F.when(op == "+", a + b).when(op == "-", a - b).when(op == "*", a * b).when(op == "/", F.try_divide(a, b))


def is_prime(n: Column) -> Column:
    """For integers; false below 2."""
    odd = F.sequence(F.lit(2), F.greatest(F.lit(2), F.floor(F.sqrt(F.greatest(n, F.lit(0)))).cast("int")))
    return (n >= 2) & ~F.exists(odd, lambda d: (d < n) & (n % d == 0))


def lcm(a: Column, b: Column) -> Column:
    """0 if either number is 0."""
    return F.when((a == 0) | (b == 0), F.lit(0).cast("long")).otherwise(F.abs(a.cast("long") / gcd(a, b) * b).cast("long"))


def gcd(a: Column, b: Column) -> Column:
    """Euclid's steps; 64-bit numbers need fewer than 93."""
    begin = F.struct(F.abs(a).cast("long").alias("x"), F.abs(b).cast("long").alias("y"))
    step = lambda s, _: F.struct(F.when(s["y"] == 0, s["x"]).otherwise(s["y"]).alias("x"), F.when(s["y"] == 0, F.lit(0)).otherwise(F.try_mod(s["x"], s["y"])).cast("long").alias("y"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(93)), begin, step, lambda s: s["x"])


def has_negation(text: Column) -> Column:
    return text.rlike(NEGATION)


def strip_negation(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, NEGATION + r"\s*", ""))


def negated_question(text: Column) -> Column:
    """struct(question, negated): the positive question, and whether its verdict is to be turned."""
    return F.struct(F.when(has_negation(text), strip_negation(text)).otherwise(text).alias("question"), has_negation(text).alias("negated"))


def turned(verdict: Column, negated: Column) -> Column:
    """The verdict on a negated question; an open one stays open."""
    return F.when(negated, ~verdict).otherwise(verdict)


def cache_key(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def symbol(text: Column) -> Column:
    """A name as one word for sentences."""
    return F.regexp_replace(text, r"[^A-Za-z0-9]+", "_")


def factorial(n: Column) -> Column:
    """For integers from 0 to 20, beyond which it has more than 63 bits; null for others."""
    return F.factorial(n)
