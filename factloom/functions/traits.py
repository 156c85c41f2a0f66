"""What is known about relations, sources and words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pairs of inverse relations; a relation may be its own inverse.
INVERSES = (
    ("wrote", "author"), ("capital", "capitalof"), ("parent", "child"), ("spouse", "spouse"), ("sibling", "sibling"), ("friend", "friend"),
    ("partof", "haspart"), ("locatedin", "contains"), ("madeof", "componentof"), ("causes", "causedby"), ("isa", "hassubtype"), ("teaches", "studentof"),
    ("invented", "inventedby"), ("founded", "foundedby"), ("painted", "painter"), ("composed", "composer"), ("directed", "director"), ("starred_in", "starring"),
)
#: Relations of which two steps are a step.
TRANSITIVE = ("isa", "partof", "locatedin", "ancestorof", "hassubtype", "haspart", "contains", "descendantof")
#: Relations along which what holds of the end is lifted to the start.
LIFTING = ("isa", "partof", "locatedin", "memberof", "instanceof", "kind", "class", "subclass", "subtype", "category")
#: First relations of a chain, and last relations that they let through.
TRANSFERS = (
    (("isa", "class", "subclass", "subtype", "category", "kind", "instanceof", "memberof"), ("isa", "has", "kind", "class", "category")),
    (("partof",), ("locatedin", "madeof", "usedfor")),
    (("locatedin",), ("continent", "country", "region", "city")),
)
#: Relations with one object for a subject.
FUNCTIONAL = ("isa", "capital", "bornin", "gender", "color", "population", "currency", "language", "continent", "country", "founded_in", "located_in", "locatedin", "birthyear", "deathyear", "kind", "category", "type", "father", "mother")
#: Relations of which another value contradicts.
SINGLE_VALUED = ("color", "capital", "isa", "kind", "category", "size", "value", "field", "continent", "previousmonth", "version")
#: Relations that lead to an ancestor, in the order they are tried.
ANCESTOR_EDGES = ("isa", "kind", "category", "locatedin", "lives_in", "partof")
#: What an ancestor passes on.
INHERITED = ("has", "color", "madeof", "usedfor", "field", "category", "locatedin", "lives_in", "continent", "size", "isa")
#: Rank of sources when facts conflict; others have the rank of unknown.
SOURCE_PRIORITY = {"user": 100, "multi": 80, "external": 60, "induced": 40, "rule": 30, "unknown": 10}
#: Weights of a score by source; others have 1.
SOURCE_WEIGHT = {"user": 1.0, "multi": 1.05, "external": 0.85}
#: Sizes in order, and rings of names.
SIZES = ("tiny", "small", "medium", "large", "huge")
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
SEASONS = ("spring", "summer", "autumn", "winter")
#: Relations of direction, in the order they are tried.
DIRECTIONS = ("north_of", "south_of", "east_of", "west_of")
#: Number words.
NUMBER_WORDS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10,
    "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19,
    "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90,
}
NOT = "not_"


def lookup(values: dict, key: Column) -> Column:
    """The value of a key in a small fixed table, or null."""
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key]


def inverse(relation: Column) -> Column:
    """The inverse of a relation, or null."""
    both = {a: b for a, b in INVERSES} | {b: a for a, b in INVERSES}
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in both.items() for x in kv]), F.lower(relation))


def is_negative(relation: Column) -> Column:
    return relation.startswith(NOT)


def negate(relation: Column) -> Column:
    return F.when(is_negative(relation), relation).otherwise(F.concat(F.lit(NOT), relation))


def denegate(relation: Column) -> Column:
    return F.regexp_replace(relation, f"^{NOT}", "")


def rank_in(values: tuple[str, ...], key: Column) -> Column:
    """Place in a fixed list, from 1; null if it isn't there."""
    return F.nullif(F.array_position(F.array(*map(F.lit, values)), key), F.lit(0))
