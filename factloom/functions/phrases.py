"""Sentences from facts and answers, and names as they are stored."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .traits import lookup

#: A sentence for each relation; other relations have the last.
SENTENCES = {
    "color": "The {s} is {o}.", "is": "The {s} is {o}.", "isa": "A {s} is a {o}.", "kind": "A {s} is a {o}.", "has": "The {s} has {o}.", "wrote": "{s} wrote {o}.", "author": "{o} wrote {s}.", "capital": "The capital of {s} is {o}.",
    "lives_in": "{s} lives in {o}.", "locatedin": "{s} is in {o}.", "continent": "{s} is in {o}.", "madeof": "{s} is made of {o}.", "usedfor": "{s} is used for {o}.", "causes": "{s} causes {o}.", "field": "{s} worked in the field of {o}.",
    "value": "The value of {s} is {o}.", "partof": "{s} is part of {o}.", "category": "{s} is a {o}.", "version": "The version of {s} is {o}.",
}
OTHERWISE = "The {r} of {s} is {o}."
#: Least confidences of what one knows, thinks and guesses, and what is said then.
SAID = ((0.20, "I know it's {a}."), (0.10, "I think {a}, but I'm not certain."), (0.05, "I'm not really sure, but maybe {a}."))
UNKNOWN = "I don't know."
#: Other names of relations and of entities.
RELATIONS = {
    "hue": "color", "colour": "color", "shade": "color", "magnitude": "size", "owns": "has", "possesses": "has", "contains": "haspart", "has_part": "haspart", "writer": "author", "wrote_by": "author", "creator": "author", "created_by": "author", "writer_of": "author",
    "authored": "wrote", "written_by": "author", "in": "locatedin", "located_in": "locatedin", "situated_in": "locatedin", "found_in": "locatedin", "place": "locatedin", "resides_in": "lives_in", "lives": "lives_in", "capital_of": "capitalof", "material": "madeof", "made_of": "madeof",
    "consists_of": "madeof", "composition": "madeof", "purpose": "usedfor", "used_for": "usedfor", "function": "usedfor", "type": "isa", "kind": "isa", "class": "isa", "species": "isa", "category": "category", "preceded_by": "previousmonth", "comes_before": "previousmonth",
    "leads_to": "causes", "results_in": "causes", "caused_by": "causedby",
}
ENTITIES = {"uk": "england", "united_kingdom": "england", "britain": "england", "u.s.": "usa", "u.s.a.": "usa", "united_states": "usa", "america": "usa", "the_states": "usa", "deutschland": "germany", "espana": "spain", "nippon": "japan"}


def plain(name: Column) -> Column:
    return F.replace(name, F.lit("_"), F.lit(" "))


def say(shape: str, **parts: Column) -> Column:
    """A text with columns in the places of names in braces."""
    out = []
    for piece in shape.split("{"):
        name, closed, rest = piece.partition("}")
        out += [parts[name], F.lit(rest)] if closed else [F.lit(piece)]
    return F.concat(*out)


def sentence(s: Column, r: Column, o: Column) -> Column:
    """A fact as a sentence."""
    parts = {"s": plain(s), "o": plain(o), "r": r}
    by_shape: dict[str, list[str]] = {}
    for relation, shape in SENTENCES.items():
        by_shape.setdefault(shape, []).append(relation)
    out = None
    for shape, relations in by_shape.items():
        test = F.lower(r).isin(*relations)
        out = F.when(test, say(shape, **parts)) if out is None else out.when(test, say(shape, **parts))
    return out.otherwise(say(OTHERWISE, **parts))


def hedged(answer: Column, confidence: Column) -> Column:
    """An answer said as surely as its confidence allows."""
    out = F.when(answer.isNull(), UNKNOWN)
    for least, shape in SAID:
        out = out.when(confidence >= least, say(shape, a=answer))
    return out.otherwise(UNKNOWN)


def _stored(name: Column) -> Column:
    return F.replace(F.lower(F.trim(name)), F.lit(" "), F.lit("_"))


def relation_name(name: Column) -> Column:
    """The stored name of a relation, whatever it is called."""
    return F.coalesce(lookup(RELATIONS, _stored(name)), _stored(name))


def entity_name(name: Column) -> Column:
    return F.coalesce(lookup(ENTITIES, _stored(name)), _stored(name))
