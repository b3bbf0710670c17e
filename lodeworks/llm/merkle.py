"""Merkle manifest of a table: butterfly exchange of subtree roots.

A row's leaf is the SHA-256 of its fields. Per source the leaves, by ascending id, are hashed
in runs of ``fanout`` until one node, the subroot, remains; the subroots, by source, are hashed
to the root in the same way. A proof lists what stands beside a node in its run, level by level.

The leaves of a source are cut into aligned blocks of ``fanout ** levels``, hashed in one task
each. Above them no tree is built top down. In round ``r`` the blocks whose numbers agree in
all digits but the ``r``-th (base ``fanout``) swap the roots they hold and every one of them
hashes the parent itself, so after the last round each block holds the subroot and all that
stands beside its ancestors. The last subtree of a level may have fewer blocks than the
others: its blocks stand in for the missing ones. A swap never meets more than ``fanout``
rows, whatever the size of a source; the sources are then the blocks of the upper tree.

Defined cases: null fields count as ``-``; a null id comes first, as does a null source; rows
that share an id lie in the order of their leaves (of equal rows any order gives the same
digests); a table without rows has no root and gives no rows; columns other than the five
fields are not read. Texts of any length are hashed whole.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.llm.common import store
from lodeworks.operators.ranking import rank_by_ranges

FANOUT = 16
# Levels hashed inside a block; a block has ``FANOUT ** BLOCK_LEVELS`` leaves at most.
BLOCK_LEVELS = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

STEPS = "array<struct<before:string,after:string>>"


def field(value: Column) -> Column:
    """A field with its UTF-8 byte count, so that two fields never read as one."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column, fields=FIELDS) -> Column:
    """The digest of a row with ``text`` in the place of its last field."""
    return F.sha2(F.concat(*[field(F.col(c)) for c in fields[:-1]], field(text)), 256)


def height(n: Column, fanout: int, most: int) -> Column:
    """Levels above ``n`` nodes until one remains, ``most`` at most."""
    return sum(((n > fanout**level).cast("int") for level in range(most)), F.lit(0))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def climb(nodes: list[str], levels: int, fanout: int) -> list[list[str]]:
    """The nodes of each level, from the leaves of a block to its root."""
    out = [nodes]
    for _ in range(levels):
        below = out[-1]
        out.append([digest("".join(below[i : i + fanout])) for i in range(0, len(below), fanout)])
    return out


def beside(levels: list[list[str]], at: int, fanout: int) -> list[tuple[str, str]]:
    """What stands before and after the ancestors of leaf ``at`` in their runs."""
    out = []
    for nodes in levels[:-1]:
        first = at - at % fanout
        out.append(("".join(nodes[first:at]), "".join(nodes[at + 1 : first + fanout])))
        at //= fanout
    return out


def fold(node: str, steps) -> str:
    """The root that a leaf and what stands beside its ancestors lead to."""
    for before, after in steps:
        node = digest(before + node + after)
    return node


def butterfly(nodes: DataFrame, group: str, most: int, fanout: int = FANOUT) -> DataFrame:
    """Adds to each node the root of its group and the steps that lead there.

    ``nodes``: ``group``, ``idx`` (0, 1, ... without gaps), ``n`` (nodes of the group, at most
    ``most``), ``digest``. Every round deals each node once, and the few blocks of a ragged
    last subtree as often as they stand in for missing ones: no more rows than a full subtree.
    """
    state = nodes.withColumn("steps", F.array().cast(STEPS))
    width = 1
    while width < most:
        tree = F.floor(F.col("idx") / width)
        low = F.col("idx") % width
        members = F.least(F.lit(width), F.col("n") - tree * width)
        # A ragged subtree serves the places it has no block for, if there are others to serve.
        serves = F.when(
            (members < width) & (tree % fanout > 0),
            F.sequence(low, F.lit(width - 1).cast("long"), members.cast("long")),
        ).otherwise(F.array(low))
        sent = state.select(
            "*",
            F.floor(tree / fanout).alias("run"),
            (tree % fanout).alias("slot"),
            low.alias("low"),
            F.explode(serves).alias("to"),
        )
        here = F.struct("slot", "idx", "n", "steps")
        swapped = sent.groupBy(group, "run", "to").agg(
            F.array_sort(F.collect_list(F.struct("slot", "digest"))).alias("nodes"),
            F.collect_list(F.when(F.col("to") == F.col("low"), here)).alias("own"),
        )
        apart = swapped.select(group, "nodes", F.explode("own").alias("o")).select(
            group, "nodes", "o.slot", "o.idx", "o.n", "o.steps"
        )

        def text(keep, found="nodes"):
            return F.array_join(F.transform(F.filter(found, keep), lambda x: x["digest"]), "")

        grows = F.col("n") > width
        step = F.struct(
            text(lambda x: x["slot"] < F.col("slot")).alias("before"),
            text(lambda x: x["slot"] > F.col("slot")).alias("after"),
        )
        # A group that has come to its root waits for the others.
        state = apart.select(
            group,
            "idx",
            "n",
            F.when(grows, F.sha2(text(lambda x: F.lit(True)), 256))
            .otherwise(F.col("nodes")[0]["digest"])
            .alias("digest"),
            F.when(grows, F.concat("steps", F.array(step))).otherwise(F.col("steps")).alias("steps"),
        )
        width *= fanout
    return state


def block_roots(fanout: int):
    """One row per block: its root."""

    def hashed(key, block):
        rows = block.sort_by("position")
        root = climb(rows.column("leaf").to_pylist(), rows.column("levels")[0].as_py(), fanout)[-1]
        return pa.table(
            [pa.array([v.as_py()], v.type) for v in (*key, rows.column("n")[0])] + [pa.array(root)],
            ["source_key", "block", "n", "digest"],
        )

    return hashed


def prove(fanout: int, with_steps: bool):
    """One row per leaf: its proof, and the root its (tampered) row folds to."""

    def proofs(key, block, above):
        rows = block.sort_by("position")
        leaves = rows.column("leaf").to_pylist()
        levels = climb(leaves, rows.column("levels")[0].as_py(), fanout)
        upper = [(s["before"], s["after"]) for s in above.column("steps")[0].as_py()]
        hashes, folded, listed = [], [], []
        for at, node in enumerate(rows.column("checked").to_pylist()):
            steps = beside(levels, at, fanout) + upper
            hashes.append(digest("".join(b + a for b, a in steps)))
            folded.append(fold(node, steps))
            listed.append([{"before": b, "after": a} for b, a in steps] if with_steps else None)
        subroot, root = (pa.array(above.column(c).to_pylist() * len(leaves)) for c in ("subroot", "root"))
        step = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
        return pa.table(
            [rows.column("doc_id"), rows.column("leaf"), subroot, root, pa.array(hashes),
             pa.array(folded), pa.array(listed, step)],
            ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "steps"],
        )

    return proofs


def manifest(
    documents: DataFrame,
    checked_text: Column | None = None,
    fanout: int = FANOUT,
    levels: int = BLOCK_LEVELS,
    with_steps: bool = False,
) -> DataFrame:
    """One row per row of ``documents``: ``doc_id, leaf, subroot, root, proof_sha256,
    folded_root, verified, steps``.

    ``checked_text`` is the text as it is found later (default: as it is now); the row is
    verified if it and its stored proof fold to the root. ``steps`` lists the proof if
    ``with_steps``, else it is null.
    """
    known = leaf(F.col("text"))
    # The prefix keeps the order of sources and puts null, as "-", first.
    named = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-")).alias("source_key")
    leaves = documents.select(
        "doc_id",
        named,
        known.alias("leaf"),
        (known if checked_text is None else leaf(checked_text)).alias("checked"),
    )
    ranked = rank_by_ranges(
        store(leaves, "leaves"),
        [F.asc("doc_id"), F.asc("leaf")],
        ["source_key"],
        keep=lambda df: store(df, "sorted-leaves"),
    )
    counts = store(ranked.groupBy("source_key").agg(F.max("position").alias("n")), "source-counts")
    size = fanout**levels
    blocks = store(
        ranked.join(counts, "source_key")
        .withColumn("block", F.floor((F.col("position") - 1) / size))
        .withColumn("levels", height(F.col("n"), fanout, levels)),
        "blocks",
    )
    kind = documents.schema["doc_id"].dataType.simpleString()
    roots = blocks.select("source_key", "block", "position", "leaf", "n", "levels")
    roots = roots.groupBy("source_key", "block").applyInArrow(
        block_roots(fanout), "source_key string, block long, n long, digest string"
    )
    most = counts.agg(F.max("n")).first()[0] or 0
    inner = butterfly(
        store(roots, "block-roots").select(
            "source_key",
            F.col("block").alias("idx"),
            F.ceil(F.col("n") / size).alias("n"),
            "digest",
        ),
        "source_key",
        -(-most // size),
        fanout,
    )
    inner = store(inner, "block-proofs")
    # One subroot per source, as the block numbered 0 holds it.
    tops = rank_by_ranges(
        inner.filter(F.col("idx") == 0).select("source_key", F.col("digest")),
        [F.asc("source_key")],
        keep=lambda df: store(df, "sorted-sources"),
    )
    sources = counts.count()
    outer = butterfly(
        tops.select(
            F.lit(0).alias("all"), "source_key", (F.col("position") - 1).alias("idx"), F.lit(sources).alias("n"), "digest"
        ).drop("source_key"),
        "all",
        sources,
        fanout,
    )
    placed = tops.select("source_key", (F.col("position") - 1).alias("idx"))
    outer = placed.join(outer.select("idx", F.col("steps").alias("upper"), F.col("digest").alias("root")), "idx")
    above = inner.join(outer.drop("idx"), "source_key").select(
        "source_key",
        F.col("idx").alias("block"),
        F.concat("steps", "upper").alias("steps"),
        F.col("digest").alias("subroot"),
        "root",
    )
    needed = blocks.select("source_key", "block", "position", "doc_id", "leaf", "checked", "levels")
    proofs = (
        needed.groupBy("source_key", "block")
        .cogroup(above.groupBy("source_key", "block"))
        .applyInArrow(
            prove(fanout, with_steps),
            f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, "
            f"folded_root string, steps {STEPS}",
        )
    )
    return proofs.withColumn("verified", F.col("folded_root") == F.col("root"))
