"""What questions ask, as expressions over their words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import traits
from .text import singular, tokens

#: Question words and the relation that they ask for.
ASKED = {"what": "is", "who": "is", "where": "in", "when": "when", "why": "because", "how": "how", "which": "is"}
#: Words that aren't part of a name, and verbs of places.
STOP = ("a", "an", "the", "of", "do", "does", "did", "is", "are", "was", "were", "in", "on", "live", "lives", "located", "to")
PLACE_VERBS = ("live", "lives", "lived", "is", "are", "was", "were", "located", "stays")
#: Words that compare, those that compare sizes, and words that begin a question of yes or no.
COMPARING = ("bigger", "smaller", "larger", "younger", "older", "taller", "shorter")
LARGER = ("bigger", "larger", "huger", "taller")
YES_NO = ("is", "are", "does", "do", "was", "were", "has", "have", "can")
ARTICLES = ("a", "an", "the")
#: Words that stand for what was spoken of before.
PRONOUNS = ("it", "they", "them", "that", "this", "those", "these")
#: Relations that are tried after the one that is asked for.
ALIASES = {
    "have": ("has",), "lives_in": ("locatedin",), "kind": ("isa",), "type": ("isa", "kind"), "category": ("isa",), "is": ("isa",), "wrote": ("author",), "author": ("wrote",), "use": ("uses",),
}


def words(question: Column) -> Column:
    return F.filter(tokens(question), lambda t: ~t.isin("?", "."))


def _of(question: Column, tell) -> Column:
    """What is told of a question's words, which are taken apart once."""
    return F.get(F.transform(F.array(words(question)), tell), F.lit(0))


def _from(x: Column, begin) -> Column:
    """Words from a place on, counted from 1."""
    return F.slice(x, F.greatest(F.lit(begin), F.lit(1)) if isinstance(begin, int) else F.greatest(begin, F.lit(1)), F.size(x) + 1)


def _without(x: Column, stop) -> Column:
    return F.filter(x, lambda t: ~t.isin(*stop))


def _last(x: Column) -> Column:
    return F.try_element_at(x, F.lit(-1))


def _if(test: Column, **parts: Column) -> Column:
    """A struct of parts where a test holds and none of them is null."""
    for p in parts.values():
        test = test & p.isNotNull()
    return F.when(test, F.struct(*[p.alias(k) for k, p in parts.items()]))


def kind(question: Column) -> Column:
    """compare, boolean, enumerate or factual."""

    def tell(t: Column) -> Column:
        first = F.get(t, F.lit(0))
        lists = first.isin("list", "name") | (first.isin("what", "which") & (F.get(t, F.lit(1)) == "are")) | ((first == "what") & F.array_contains(F.slice(t, 1, 5), "are"))
        compares = F.array_contains(t, "than") | F.arrays_overlap(t, F.array(*map(F.lit, COMPARING)))
        return F.when(F.size(t) == 0, "factual").when(compares, "compare").when(first.isin(*YES_NO), "boolean").when(F.coalesce(lists, F.lit(False)), "enumerate").otherwise("factual")

    return _of(question, tell)


def factual(question: Column) -> Column:
    """struct(entity, relation) of what a question asks; null if it begins with no question word."""

    def tell(t: Column) -> Column:
        first, body = F.get(t, F.lit(0)), _from(t, 2)
        n, at = F.size(body), lambda k: F.get(body, F.lit(k))
        of, is_ = F.array_position(body, "of").cast("int"), F.array_position(body, "is").cast("int")
        what = first == "what"
        asks = lambda test, entity, relation: _if(test, entity=entity, relation=relation)
        plain = lambda x: _last(_without(x, STOP))
        between = F.slice(body, F.greatest(is_ + 1, F.lit(1)), F.greatest(of - is_ - 1, F.lit(0)))
        table = F.create_map(*[F.lit(x) for kv in ASKED.items() for x in kv])
        place = F.when(F.arrays_overlap(body, F.array(*map(F.lit, PLACE_VERBS))), "lives_in").otherwise("in")
        ways = (
            asks(first.isin("what", "which") & (n >= 4) & (at(1) == "is") & ~at(0).isin(*STOP), plain(_from(body, 3)), at(0)),
            asks(what & (of > 0) & (is_ > 0), plain(_from(body, of + 1)), plain(between)),
            asks((first == "who") & (n >= 2) & ~at(0).isin(*STOP), plain(_from(body, 2)), at(0)),
            asks(what & (n >= 3) & (at(0) == "does") & _last(body).isin("have", "has"), plain(F.slice(body, 2, F.greatest(n - 2, F.lit(0)))), F.lit("has")),
            asks(what & (n >= 3) & F.array_contains(body, "made") & (of > 0), _last(_without(body, (*ARTICLES, "is", "of", "made"))), F.lit("madeof")),
            asks(what & (n >= 2) & (at(0) == "causes"), plain(_from(body, 2)), F.lit("causedby")),
            asks((first == "where") & (n >= 2), _last(_without(body, (*STOP, *PLACE_VERBS))), place),
            asks(F.lit(True), plain(body), table[first]),
        )
        return F.when(first.isin(*ASKED), F.coalesce(*ways))

    return _of(question, tell)


def yes_no(question: Column) -> Column:
    """struct(s, r, o) of a question of yes or no, or null."""

    def tell(t: Column) -> Column:
        first, body = F.get(t, F.lit(0)), _without(_from(t, 2), ARTICLES)
        n, at = F.size(body), lambda k: F.get(body, F.lit(k))
        say = lambda test, r, o: _if(test, s=at(0), r=r, o=o)
        return F.coalesce(
            say(first.isin("is", "are", "was", "were") & (n >= 2), F.lit("isa"), _last(body)), say(first.isin("does", "do") & (n >= 3) & at(1).isin("have", "has"), F.lit("has"), at(2)),
            say(first.isin("does", "do") & (n >= 3), at(1), at(2)), say(first.isin("has", "have") & (n >= 2), F.lit("has"), at(1)),
        )

    return _of(question, tell)


def listed(question: Column) -> Column:
    """The kind of things that a question wants a list of, or null."""

    def tell(t: Column) -> Column:
        first, are = F.get(t, F.lit(0)), F.array_position(t, "are").cast("int")
        named = F.get(_without(_from(t, 2), ("all", "the")), F.lit(0))
        rest = _last(_without(_from(t, are + 1), ARTICLES))
        return singular(F.when(first.isin("list", "name"), named).when(first.isin("what", "which") & (are > 0), rest))

    return _of(question, tell)


def compared(question: Column) -> Column:
    """struct(a, b) of the two things whose sizes are compared, or null."""

    def tell(t: Column) -> Column:
        than = F.array_position(t, "than").cast("int")
        before = F.slice(t, 1, F.greatest(than - 1, F.lit(0)))
        return _if((than > 0) & F.arrays_overlap(t, F.array(*map(F.lit, LARGER))), a=_last(_without(before, (*ARTICLES, "is", "are", *LARGER))), b=_last(_without(_from(t, than + 1), ARTICLES)))

    return _of(question, tell)


def nested(question: Column) -> Column:
    """struct(outer, inner, entity) of "what is the outer of the inner of entity", or of "entity's inner"; null for others."""
    q = F.rtrim(F.lower(F.trim(question)), F.lit("?"))
    chain, own = r"^what\s+is\s+the\s+(\w+)\s+of\s+the\s+(\w+)\s+of\s+(?:the\s+)?(\w+)\s*$", r"^what\s+is\s+the\s+(\w+)\s+of\s+(\w+)'s\s+(\w+)\s*$"
    part = lambda p, k: F.regexp_extract(q, p, k)
    shape = lambda p, outer, inner, entity: F.when(q.rlike(p), F.struct(part(p, outer).alias("outer"), part(p, inner).alias("inner"), part(p, entity).alias("entity")))
    return F.coalesce(shape(chain, 1, 2, 3), shape(own, 1, 3, 2))


def tried(relation: Column) -> Column:
    """The relations to try for one, in order: itself, "is", its aliases, its inverse."""
    more = F.create_map(*[x for k, v in ALIASES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])[relation]
    none = F.array().cast("array<string>")
    inverse = traits.inverse(relation)
    return F.array_distinct(F.concat(F.array(relation, F.lit("is")), F.coalesce(more, none), F.when(inverse.isNotNull(), F.array(inverse)).otherwise(none)))


def follow_up(question: Column) -> Column:
    """The words after "what about", "and the", or a pronoun alone; null for other questions."""

    def tell(t: Column) -> Column:
        rest = _from(t, 3)
        rest = F.when((F.get(t, F.lit(0)) == "what") & (F.get(t, F.lit(1)) == "about"), F.when(F.get(rest, F.lit(0)) == "the", _from(rest, 2)).otherwise(rest)).when((F.get(t, F.lit(0)) == "and") & (F.get(t, F.lit(1)) == "the"), rest)
        alone = (F.size(t) == 1) & F.get(t, F.lit(0)).isin(*PRONOUNS)
        return F.when(F.coalesce(alone, F.lit(False)), t).when(F.size(rest) > 0, rest)

    return _of(question, tell)


def with_first(t: Column, replacement: Column) -> Column:
    """Words joined by spaces, the first pronoun replaced.

    Nothing is captured in a lambda that is made of the words, as it would be made
    again for each of them.
    """

    def tell(w: Column) -> Column:
        at = F.array_position(F.transform(w, lambda x: x.isin(*PRONOUNS)), True).cast("int")
        put = F.concat(F.slice(w, 1, at - 1), F.array(replacement), F.slice(w, at + 1, F.size(w)))
        return F.array_join(F.when(at > 0, put).otherwise(w), " ")

    return F.get(F.transform(F.array(t), tell), F.lit(0))


def has_pronoun(t: Column) -> Column:
    return F.exists(t, lambda w: w.isin(*PRONOUNS))
