"""Merkle manifest of a table: a leaf for each row, a subroot for each group, one root.

Leaves of a group ascend by id (nulls first, then by digest; equal rows are
interchangeable). While a group has several nodes, each ``FANOUT`` consecutive ones
are hashed into a parent; the last run may be shorter, even one node. What remains
is the group's subroot, a lone leaf itself. The subroots, ordered by group (null
first, then by UTF-8 bytes), make the root in the same way.

Levels are built one after the other as stored tables, each from the one below:
children are found by floor division of their places, so a run has at most
``FANOUT`` rows whatever a group's size, and a group that holds a third of all rows
is hashed by as many tasks as its share. Proofs go down the same levels: a parent's
siblings are joined to its run once and handed to its children, so that the joins
together touch half as many rows as there are leaves.

A null value is a mark of its own, other than an empty text. A row whose id is
null is never tampered with. Texts of any length are hashed in place and not moved.
An empty table gives no rows. Other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ranks import numbered
from . import scratch
from .components import near

FANOUT = 3
#: Equal rows are dealt to so many ranges at most.
SALTS = 1024
#: Paths are stored every so many levels, so that a plan has as many joins at most.
STORED = 4
#: The group of the tree of subroots.
TOP = -1


def digest(what: Column) -> Column:
    """SHA-256 as 32 bytes; nodes are hashed as the lower-case hex text of their children."""
    return F.unhex(F.sha2(what.cast("binary"), 256))


def hex_text(node: Column) -> Column:
    return F.lower(F.hex(node))


def field(value: Column) -> Column:
    """A value with its length in bytes before it, so that no two rows are written alike; null is "-"."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return digest(F.concat(*[field(v) for v in values]))


def _levels(most: int) -> int:
    """Levels above the leaves of a group of so many."""
    k = 0
    while FANOUT**k < most:
        k += 1
    return k


def _build(nodes: DataFrame, most: int) -> tuple[list[DataFrame], DataFrame]:
    """The runs (grp, size, i, kids, h) of each level, and the tops (grp, h), of nodes (grp, size, i, h, ...) of groups of at most ``most``."""
    tops, below, runs = nodes.where("size = 1").select("grp", "h"), nodes, []
    for k in range(1, _levels(most) + 1):
        due = below.where(F.col("size") > FANOUT ** (k - 1)).withColumn("parent", F.floor(F.col("i") / FANOUT))
        kid = F.struct("i", "h", *[c for c in below.columns if c not in ("grp", "size", "i", "h", "kids")])
        made = due.groupBy("grp", "size", "parent").agg(F.sort_array(F.collect_list(kid)).alias("kids"))
        made = made.select("grp", "size", F.col("parent").alias("i"), "kids", digest(F.array_join(F.transform("kids", lambda x: hex_text(x["h"])), "")).alias("h"))
        below = scratch.keep(made, "merkle-level")
        runs.append(below)
        tops = tops.union(below.where(F.col("size") <= FANOUT**k).select("grp", "h"))
    return runs, tops


def _proved(nodes: DataFrame, runs: list[DataFrame], groups: DataFrame) -> DataFrame:
    """Nodes (i, h, ..., path, subroot, root): what is known of their groups (grp, path, subroot, root), each path begun with the siblings below.

    A path is an array of (before, after): a run's digests at both sides, joined.
    """
    above = None
    for k in range(len(runs), 0, -1):
        here = runs[k - 1].select("grp", "size", "i", "kids")
        joined = here.where(F.col("size") <= FANOUT**k).join(groups, "grp")
        if above is not None:
            joined = joined.unionByName(here.where(F.col("size") > FANOUT**k).join(above, ["grp", "i"]))
        each = joined.select("grp", F.posexplode("kids").alias("at", "kid"), "kids", "path", "subroot", "root")
        side = lambda begin, n: F.unhex(F.array_join(F.transform(F.slice("kids", begin, n), lambda x: F.hex(x["h"])), ""))
        step = F.struct(side(F.lit(1), F.col("at")).alias("before"), side(F.col("at") + 2, F.lit(FANOUT)).alias("after"))
        above = each.select("grp", "kid.*", F.concat(F.array(step), "path").alias("path"), "subroot", "root")
        if k > 1:
            above = above.select("grp", "i", "path", "subroot", "root")
        if k > 1 and k % STORED == 1:
            above = scratch.keep(above, "merkle-paths")
    alone = nodes.where("size = 1").drop("size").join(groups, "grp")
    return alone if above is None else above.unionByName(alone.select(*above.columns))


def folded(node: Column, path: Column) -> Column:
    """The root that a node and its siblings give."""
    return F.aggregate(path, node, lambda h, x: digest(hex_text(F.concat(x["before"], h, x["after"]))))


def manifest(docs: DataFrame, tampered: Column | None = None, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", group: str = "source", text: str = "text") -> DataFrame:
    """(id, leaf, subroot, root, proof, folded), digests of 32 bytes: the proof is the digest of a leaf's siblings up to the root.

    ``tampered`` takes the place of the text, where it isn't null, in the leaf that
    ``folded`` begins with.
    """
    of = lambda t: leaf(*[t if c == text else F.col(c) for c in columns])
    changed = F.when(tampered.isNotNull(), of(tampered)) if tampered is not None else F.lit(None).cast("binary")
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))  # tells only equal rows apart, which are interchangeable
    leaves = scratch.keep(docs.select(F.col(group).alias("source"), F.col(id_col).alias("id"), of(F.col(text)).alias("h"), changed.alias("other"), salt.alias("salt")), "merkle-leaves")
    placed = scratch.keep(numbered(leaves, "source", "id", "h", "salt"), "merkle-placed")
    sources = scratch.keep(numbered(placed.groupBy("source").agg(F.min("place").alias("begin"), F.count("*").alias("size")), "source", out="grp"), "merkle-groups")
    sizes = sources.agg(F.coalesce(F.max("size"), F.lit(0)).alias("most"), F.count("*").alias("n")).first()
    own = placed.join(near(sources.withColumnRenamed("source", "own")), F.col("source").eqNullSafe(F.col("own")))
    nodes = scratch.keep(own.select("grp", "size", (F.col("place") - F.col("begin")).alias("i"), "h", "id", "other"), "merkle-nodes")
    runs, tops = _build(nodes, sizes["most"])
    tops = scratch.keep(tops.select(F.lit(TOP).cast("long").alias("grp"), F.lit(sizes["n"]).cast("long").alias("size"), F.col("grp").alias("i"), "h"), "merkle-subroots")
    top_runs, root = _build(tops, sizes["n"])
    none = F.array().cast("array<struct<before:binary,after:binary>>")
    whole = root.select("grp", none.alias("path"), F.col("h").alias("subroot"), F.col("h").alias("root"))
    groups = scratch.keep(_proved(tops, top_runs, whole).select(F.col("i").alias("grp"), "path", F.col("h").alias("subroot"), "root"), "merkle-proofs")
    proof = digest(F.array_join(F.transform("path", lambda x: hex_text(F.concat(x["before"], x["after"]))), ""))
    out = _proved(nodes, runs, groups)
    return out.select(F.col("id").alias(id_col), F.col("h").alias("leaf"), "subroot", "root", proof.alias("proof"), folded(F.coalesce("other", "h"), F.col("path")).alias("folded"))
