"""Sources and sinks of facts and records. Symbols are lower-cased on the way in; rows with an empty part are dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans import ranks

#: Relation names of the weighted graph source, and ours. Relations that it lacks are left out, as their meaning isn't known.
GRAPH_RELATIONS = {
    "IsA": "isa",
    "HasA": "has",
    "AtLocation": "locatedin",
    "Causes": "causes",
    "HasProperty": "is",
    "MadeOf": "madeof",
    "PartOf": "partof",
    "UsedFor": "usedfor",
    "CapableOf": "can",
    "Desires": "desires",
    "MotivatedByGoal": "motivated_by",
    "HasSubevent": "has_subevent",
    "HasPrerequisite": "requires",
    "CausesDesire": "causes_desire",
    "Synonym": "synonym",
    "Antonym": "antonym",
    "DerivedFrom": "derived_from",
    "HasContext": "has_context",
    "SimilarTo": "similar_to",
    "InstanceOf": "isa",
    "MemberOf": "memberof",
    "DefinedAs": "definedas",
    "Entails": "entails",
    "SymbolOf": "symbolof",
    "RelatedTo": "related_to",
    "FormOf": "form_of",
    "EtymologicallyRelatedTo": "etymologically_related_to",
    "Desire": "desires",
    "HasFirstSubevent": "first_subevent",
    "HasLastSubevent": "last_subevent",
    "NotHasProperty": "is_not",
    "NotCapableOf": "cannot",
    "NotDesires": "does_not_desire",
    "CreatedBy": "createdby",
    "ReceivesAction": "receives_action",
}


def clean(df: DataFrame) -> DataFrame:
    """(s, r, o), trimmed, in lower case, without empty or null parts; other columns are dropped."""
    part = lambda c: F.lower(F.trim(F.col(c).cast("string"))).alias(c)
    return df.select(part("s"), part("r"), part("o")).where("s != '' AND r != '' AND o != ''")


def numbered(df: DataFrame) -> DataFrame:
    """Adds seq by the order of s, r and o, so that it doesn't depend on partitions; equal facts are one row."""
    return ranks.numbered(df.select("s", "r", "o").distinct(), "s", "r", "o", out="seq").select("seq", "s", "r", "o")


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return clean(spark.read.schema("s string, r string, o string").json(path))


def read_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    return clean(spark.read.option("header", True).option("sep", sep).schema("s string, r string, o string").csv(path))


def read_weighted_graph(spark: SparkSession, path: str, language: str = "en", least: float = 1.0) -> DataFrame:
    """(s, r, o, weight, confidence) of tab-separated rows (uri, relation, start, end, weight or JSON with a weight)."""
    rows = spark.read.option("sep", "\t").option("quote", "").schema("uri string, rel string, start string, end string, meta string").csv(path)
    node = r"^/c/([a-z]+)/([^/]+)"
    weight = F.coalesce(F.col("meta").try_cast("double"), F.get_json_object("meta", "$.weight").try_cast("double"), F.lit(1.0))
    name = F.regexp_extract("rel", r"^/r/([A-Za-z]+)", 1)
    ours = F.try_element_at(F.create_map(*[F.lit(x) for kv in GRAPH_RELATIONS.items() for x in kv]), name)
    out = rows.select(F.regexp_extract("start", node, 2).alias("s"), ours.alias("r"), F.regexp_extract("end", node, 2).alias("o"), weight.alias("weight"), F.regexp_extract("start", node, 1).alias("l1"), F.regexp_extract("end", node, 1).alias("l2"))
    return out.where((F.col("l1") == language) & (F.col("l2") == language) & F.col("r").isNotNull() & (F.col("weight") >= least)).select("s", "r", "o", "weight", F.least(F.col("weight") / 4, F.lit(1.0)).alias("confidence"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(file, text): each file whole."""
    return spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("file"), F.col("value").alias("text"))


def html_text(html: Column) -> Column:
    """Tags and entities as spaces, white space collapsed."""
    out = F.regexp_replace(F.regexp_replace(html, r"<[^>]+>", " "), r"&[a-zA-Z#0-9]+;", " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


#: Fixed patterns of sentences, tried in order, and which groups, or which relation, give subject, relation and object.
CLAUSES = (
    (r"(?:the\s+)?(\w+)\s+of\s+(?:the\s+)?(\w+)\s+is\s+(\w+)", (2, 1, 3)),
    (r"(?:the\s+)?(\w+)\s+is\s+the\s+(\w+)\s+of\s+(\w+)", (3, 2, 1)),
    (r"(?:the\s+)?(\w+)\s+is\s+an?\s+(\w+)", (1, "isa", 2)),
    (r"(?:the\s+)?(\w+)\s+is\s+in\s+(?:the\s+)?(\w+)", (1, "locatedin", 2)),
    (r"(?:the\s+)?(\w+)\s+is\s+located\s+in\s+(?:the\s+)?(\w+)", (1, "locatedin", 2)),
    (r"(\w+)\s+lives\s+in\s+(?:the\s+)?(\w+)", (1, "lives_in", 2)),
    (r"(?:the\s+)?(\w+)\s+is\s+made\s+of\s+(\w+)", (1, "madeof", 2)),
    (r"(?:the\s+)?(\w+)\s+is\s+used\s+for\s+(\w+)", (1, "usedfor", 2)),
    (r"(?:the\s+)?(\w+)\s+causes\s+(?:the\s+)?(\w+)", (1, "causes", 2)),
    (r"(?:the\s+)?(\w+)\s+is\s+(\w+)", (1, "is", 2)),
    (r"(?:the\s+)?(\w+)\s+has\s+(?:an?\s+)?(\w+)", (1, "has", 2)),
    (r"(\w+)\s+(wrote|composed|painted|directed|invented|founded|discovered|designed)\s+(?:the\s+)?(\w+)", (1, 2, 3)),
)


def extract(sentence: Column) -> Column:
    """struct(s, r, o) by the first clause that the whole sentence fits, or null."""
    plain = F.regexp_replace(F.lower(F.trim(sentence)), r"\s*\.*$", "")
    out = None
    for clause, roles in CLAUSES:
        pattern = f"(?U)^{clause}$"
        fact = F.struct(*[(F.lit(x) if isinstance(x, str) else F.regexp_extract(plain, pattern, x)).alias(c) for c, x in zip("sro", roles, strict=True)])
        out = F.when(plain.rlike(pattern), fact) if out is None else out.when(plain.rlike(pattern), fact)
    return out


def extract_facts(texts: DataFrame, text: str, key: str) -> DataFrame:
    """(key, s, r, o): a fact at most for each sentence."""
    from ..functions.text import sentences

    found = texts.select(key, F.explode(sentences(F.col(text))).alias("sentence")).withColumn("f", extract(F.col("sentence")))
    return found.where("f IS NOT NULL").select(key, "f.s", "f.r", "f.o")


#: Fixed patterns of corrections, tried in order: subject, relation, new and old object, by group or as they are.
CORRECTIONS = (
    (r"(?:actually|no),?\s+(?:the\s+)?(\w+)\s+is\s+(\w+),?\s+not\s+(\w+)", (1, "is", 2, 3)),
    (r"(?:the\s+)?(\w+)\s+of\s+(\w+)\s+is\s+(\w+),?\s+not\s+(\w+)", (2, 1, 3, 4)),
    (r"(?:actually|no),?\s+(?:the\s+)?(\w+)\s+is\s+(\w+)", (1, "is", 2, None)),
    (r"(?:the\s+)?(\w+)\s+is\s+actually\s+(?:an?\s+)?(\w+)", (1, "is", 2, None)),
)


def corrections(texts: DataFrame, text: str) -> DataFrame:
    """(op, s, r, o) of corrections: the new object is stored, and the old one, if it is told, forgotten. Other texts give nothing."""
    plain, found = F.lower(F.trim(text)), None
    for clause, roles in CORRECTIONS:
        pattern = rf"(?U)^{clause}\s*\.?$"
        value = lambda x, p=pattern: F.lit(None).cast("string") if x is None else F.lit(x) if isinstance(x, str) else F.regexp_extract(plain, p, x)
        row = F.struct(*[value(x).alias(c) for c, x in zip(("s", "r", "o", "old"), roles, strict=True)])
        found = F.when(plain.rlike(pattern), row) if found is None else found.when(plain.rlike(pattern), row)
    rows = texts.select(found.alias("c")).where("c IS NOT NULL").select("c.*")
    both = F.array(F.struct(F.lit("store").alias("op"), F.col("o").alias("v")), F.struct(F.lit("forget").alias("op"), F.col("old").alias("v")))
    return rows.select("s", "r", F.explode(both).alias("x")).where("x.v IS NOT NULL").select("x.op", "s", "r", F.col("x.v").alias("o"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(seq, op, s, r, o) of log lines {"seq", "op", "fact": {"S", "R", "O"}}.

    A line that can't be read is dropped if none that can comes after it, as a
    torn end; elsewhere the read fails.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    at = lines.select("value", F.struct(F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("n")).alias("_at"), F.from_json("value", "seq long, op string, fact struct<S:string,R:string,O:string>").alias("x"))
    bad = F.col("x.op").isNull() | F.col("x.fact").isNull()
    last = at.agg(F.max(F.when(~bad, F.col("_at"))).alias("last"))
    broken = F.raise_error(F.concat(F.lit("a broken line within the log: "), "value")).cast("boolean")
    ok = at.join(F.broadcast(last)).where(F.when(bad & (F.col("_at") < F.col("last")), broken).otherwise(~bad))
    return ok.select("x.seq", "x.op", F.col("x.fact.S").alias("s"), F.col("x.fact.R").alias("r"), F.col("x.fact.O").alias("o"))


def write_log(rows: DataFrame, path: str) -> None:
    """Appends rows (seq, op, s, r, o) as log lines that read_log reads."""
    line = F.struct("seq", "op", F.struct(F.col("s").alias("S"), F.col("r").alias("R"), F.col("o").alias("O")).alias("fact"))
    rows.select(F.to_json(line).alias("value")).write.mode("append").text(path)


def recover(facts: DataFrame, upto: int, log: DataFrame) -> DataFrame:
    """(s, r, o, n): copies of each fact after the log's rows beyond ``upto`` have been applied, in the order of seq, to a snapshot's facts."""
    from ..operators.episodes import folded

    copy = F.row_number().over(W.partitionBy("s", "r", "o").orderBy(F.lit(0)))
    base = facts.select((F.lit(upto).cast("long") - copy).alias("seq"), F.lit("store").alias("op"), "s", "r", "o")  # equal copies, each at its own place
    return folded(base.union(log.where(F.col("seq") > upto).select("seq", "op", "s", "r", "o")))


def training_pairs(facts: DataFrame) -> DataFrame:
    """(task, draft, target): text pairs of each positive fact."""
    say = F.concat_ws(" ", "s", "r", "o")
    shapes = (("declare", say, F.concat(say, F.lit("."))), ("ask", F.concat(F.lit("what is the "), "r", F.lit(" of "), "s", F.lit("?")), F.col("o")), ("fill", F.concat("s", F.lit(" "), "r", F.lit(" ___")), F.col("o")), ("confirm", F.concat(F.lit("is it true that "), say, F.lit("?")), F.lit("yes")))
    rows = F.array(*[F.struct(F.lit(t).alias("task"), a.alias("draft"), b.alias("target")) for t, a, b in shapes])
    return facts.where("NOT startswith(r, 'not_')").select(F.explode(rows).alias("x")).select("x.*")
