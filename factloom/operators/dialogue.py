"""Questions in conversations, with what they refer to put in its place.

A turn's own entity and relation are told from its words; pronouns and follow-ups
("what about the X", "and the X") leave one of them open, which is then the last
one of the conversation. What a conversation has spoken of last is carried by
ranges of turns in batch, and by a state that ends in streams; both forms share
everything else. Without anything to refer to a question stays as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import questions, text
from ..plans import ranks
from .pattern import answers

#: Stands for the open entity while a question is read; no word of a question.
OPEN = "_open_"


def read(turns: DataFrame) -> DataFrame:
    """Adds own_entity and own_relation to turns (conv, turn, text); null where they are open or there are none."""
    rows = turns.withColumn("_rest", questions.follow_up(F.col("text"))).withColumn("_asked", questions.factual(questions.with_first(text.tokens(F.col("text")), F.lit(OPEN))))
    rest, asked = F.col("_rest"), F.col("_asked")
    begins_open = F.get(rest, F.lit(0)).isin(*questions.PRONOUNS)
    entity = F.when(rest.isNotNull(), F.when(~begins_open, F.try_element_at(rest, F.lit(-1)))).otherwise(F.nullif(asked["entity"], F.lit(OPEN)))
    rows = rows.withColumn("own_entity", entity).withColumn("own_relation", F.when(rest.isNull(), asked["relation"])).withColumn("asks", rest.isNotNull() | asked.isNotNull())
    return rows.drop("_rest", "_asked")


def written(rows: DataFrame) -> DataFrame:
    """(conv, turn, question, entity, relation) of read turns with last_entity and last_relation."""
    rows = rows.withColumn("_rest", questions.follow_up(F.col("text"))).withColumn("_t", text.tokens(F.col("text")))
    rest, t = F.col("_rest"), F.col("_t")
    last = F.col("last_entity")
    named = F.when(F.get(rest, F.lit(0)).isin(*questions.PRONOUNS) & last.isNotNull(), F.concat(F.array(last), F.slice(rest, 2, F.size(rest)))).otherwise(rest)
    again = F.concat(F.lit("what "), F.col("last_relation"), F.lit(" is the "), F.array_join(named, " "), F.lit("?"))
    resolved = F.when(rest.isNotNull() & F.col("last_relation").isNotNull(), again).when(questions.has_pronoun(t) & last.isNotNull(), questions.with_first(t, last)).otherwise(F.col("text"))
    both = F.when(F.col("asks"), F.coalesce("own_entity", "last_entity")), F.when(F.col("asks"), F.coalesce("own_relation", "last_relation"))
    return rows.select("conv", "turn", resolved.alias("question"), both[0].alias("entity"), both[1].alias("relation"))


def resolved(turns: DataFrame) -> DataFrame:
    """(conv, turn, question, entity, relation) of turns (conv, turn, text)."""
    rows = read(turns.select("conv", "turn", "text"))
    return written(ranks.carried(rows, "conv", "turn", {"last_entity": "own_entity", "last_relation": "own_relation"}))


def answered(facts: DataFrame, turns: DataFrame) -> DataFrame:
    """(conv, turn, question, entity, relation, answer, before): with the first answer, and the last one that the conversation had before."""
    own = answers(facts).select(F.col("s").alias("entity"), F.col("r").alias("relation"), "answer")
    rows = turns.join(own, ["entity", "relation"], "left")
    return ranks.carried(rows, "conv", "turn", {"before": "answer"}).select("conv", "turn", "question", "entity", "relation", "answer", "before")
