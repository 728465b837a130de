"""Merkle manifest of a dataset: a tree per source, a tree over the sources, and a proof for each row.

Rows become leaves and are dealt out in order (by tree, then key), so that each partition holds an unbroken
range of leaves of each of its trees; counts of partitions, summed up along each tree, give all
leaves their index without gathering them.  A partition then keeps a mountain range for each tree: as many open runs, one a level, as
there are levels.  A node joins the open run of its level; where the run is full (``FANOUT`` children, or the last ones of their
level), the run is hashed and its node carries to the next level.  Completed nodes are written; runs
that began in another partition, or end in one, can't be completed and leave their nodes as unaligned edges.

Edges are merged level by level: those of one run are at most FANOUT rows, a handful for each
partition and level, so merging is small next to the leaves.  A last run is hashed as it is, without padding.

Proofs go down the same way: each run gets the runs above it, by one join a level (of sixteen times fewer rows each), and a
task turns a run of leaves and what is above it into one row per leaf.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, scratch

FANOUT = 16
#: Leaves of one partition, about: what a task holds at once.
PART_LEAVES = 50_000
HEX = 64
#: Rows are tampered with where this divides the CRC-32 of the id.
TAMPERED = 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    """A value with its length before it, so that no two rows read alike; ``-`` for null."""
    shown = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def indexed(rows: DataFrame, tree: str, order: list[Column], total: int) -> DataFrame:
    """``rows`` with part, index (of a leaf in its tree) and size (of the tree): rows dealt out in order, each partition a range.

    Ties of ``order`` fall by where a row stood, so that equal rows are spread like others.
    """
    parts = max(1, -(-total // PART_LEAVES))
    dealt = rows.withColumn("_row", F.monotonically_increasing_id())
    keys = [F.col(tree).asc_nulls_first(), *order, F.col("_row")]
    dealt = dealt.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("_row")
    # The place inside a partition is fixed when the table is written: what reads it later need not keep its order.
    dealt = materialize(dealt.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")), "merkle-dealt")
    counts = dealt.groupBy(tree, "part").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    own = f"PARTITION BY `{tree}`"
    offsets = counts.select(tree, "part", F.expr(f"sum(n) OVER ({own} ORDER BY part) - n - first").alias("_shift"), F.expr(f"sum(n) OVER ({own})").alias("size"))
    return dealt.join(offsets, [tree, "part"]).withColumn("index", F.col("place") + F.col("_shift")).drop("_shift", "place")


def sizes_of_levels(size: int) -> list[int]:
    """Nodes of each level, from the leaves to the root."""
    found = [size]
    while found[-1] > 1:
        found.append(-(-found[-1] // FANOUT))
    return found


class Mountains:
    """The open runs of one tree in one partition; nodes come in the order of their leaves."""

    def __init__(self, size: int, first: int):
        self.sizes = sizes_of_levels(size)
        self.open: list[list[str]] = [[] for _ in self.sizes]
        #: The index that the next node of each level has.
        self.next = [-(-first // FANOUT**level) for level in range(len(self.sizes))]
        self.runs: list[tuple[int, int, str]] = []
        self.edges: list[tuple[int, int, str]] = []

    def add(self, node: str, level: int = 0) -> None:
        while level < len(self.sizes) - 1:
            at = self.next[level]
            self.next[level] += 1
            self.open[level].append(node)
            if (at + 1) % FANOUT and at + 1 < self.sizes[level]:
                return
            children, self.open[level] = self.open[level], []
            if len(children) <= at % FANOUT:  # the run began in another partition
                self.edges += [(level, at - len(children) + 1 + k, x) for k, x in enumerate(children)]
                return
            run = "".join(children)
            self.runs.append((level, at // FANOUT, run))
            node, level = digest(run), level + 1
        self.edges.append((level, 0, node))  # the root

    def close(self) -> None:
        """What is still open goes on in another partition."""
        for level, children in enumerate(self.open):
            self.edges += [(level, self.next[level] - len(children) + k, x) for k, x in enumerate(children)]


def _ranges(tree: str):
    """For one partition: its completed runs, and the nodes of runs that it can't complete."""
    names = [tree, "level", "index", "run", "node"]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("index")
        trees, rows = table[tree].to_pylist(), {}
        for k, t in enumerate(trees):
            rows.setdefault(t, []).append(k)
        leaves, index, size = (table[c].to_pylist() for c in ("leaf", "index", "size"))
        out = []
        for t, own in rows.items():
            mountains = Mountains(size[own[0]], index[own[0]])
            for k in own:
                mountains.add(leaves[k])
            mountains.close()
            out += [(t, level, at, run, None) for level, at, run in mountains.runs] + [(t, level, at, None, node) for level, at, node in mountains.edges]
        kinds = (table.schema.field(tree).type, pa.int32(), pa.int64(), pa.string(), pa.string())
        return pa.table({name: pa.array([x[k] for x in out], kind) for k, (name, kind) in enumerate(zip(names, kinds, strict=True))})

    return run


def forest(leaves: DataFrame, tree: str) -> tuple[DataFrame, DataFrame, int]:
    """Runs (tree, level, index, run) and roots (tree, node) of all trees, and how many levels the tallest has.

    ``leaves`` has the tree's name (of a type that equality joins take, without nulls), leaf, part, index and size.
    """
    kind = dict(leaves.dtypes)[tree]
    found = leaves.select(tree, "leaf", "part", "index", "size").groupBy("part").applyInArrow(_ranges(tree), f"`{tree}` {kind}, level int, index long, run string, node string")
    found = materialize(found, "merkle-ranges")
    most = leaves.agg(F.max("size")).first()[0] or 1
    levels = len(sizes_of_levels(most)) - 1
    runs = found.where("run IS NOT NULL").select(tree, "level", "index", "run")
    edges = found.where("node IS NOT NULL").select(tree, "level", "index", "node")
    size = leaves.groupBy(tree).agg(F.max("size").alias("size"))
    # Roots stay as they are; all other edges of a level belong to runs whose nodes are all known by now.
    top = F.expr(f"aggregate(sequence(1, {max(levels, 1)}), named_struct('n', size, 'l', 0), (s, k) -> if(s.n > 1, named_struct('n', (s.n + {FANOUT - 1}) div {FANOUT}, 'l', s.l + 1), s)).l")
    tops = materialize(size.select(tree, top.alias("top")), "merkle-heights")
    waiting = edges.join(tops, tree)
    roots = waiting.where("level = top").select(tree, "node")
    current = None
    for level in range(levels):
        here = waiting.where(f"level = {level} AND level < top").select(tree, "top", "index", "node")
        here = here if current is None else here.unionByName(current.where("top > %d" % level))
        merged = here.groupBy(tree, "top", F.floor(F.col("index") / FANOUT).cast("long").alias("index")).agg(F.array_sort(F.collect_list(F.struct(F.col("index").alias("i"), "node"))).alias("x"))
        merged = materialize(merged.select(tree, "top", "index", F.array_join("x.node", "").alias("run")), "merkle-merged")
        runs = runs.unionByName(merged.select(tree, F.lit(level).alias("level"), "index", "run"))
        current = merged.select(tree, "top", "index", F.sha2("run", 256).alias("node"))
        roots = roots.unionByName(current.where(f"top = {level + 1}").select(tree, "node"))
    return runs, roots, levels


def chains(runs: DataFrame, tree: str, levels: int) -> DataFrame:
    """(tree, index, chain) of each run of leaves: [run, place of the node in it] of the run itself and all above it, from below."""
    above = None
    for level in range(levels - 1, -1, -1):
        own = runs.where(F.col("level") == level).select(tree, "index", "run")
        if above is None:
            made = own.withColumn("chain", F.array().cast("array<struct<run:string,place:int>>"))
        else:
            made = own.withColumn("_up", F.floor(F.col("index") / FANOUT).cast("long"))
            made = made.join(above.withColumnRenamed("index", "_up"), [tree, "_up"], "left").drop("_up")
            place = F.struct(F.col("up").alias("run"), F.pmod(F.col("index"), F.lit(FANOUT)).cast("int").alias("place"))
            made = made.withColumn("chain", F.when(F.col("up").isNull(), F.array().cast("array<struct<run:string,place:int>>")).otherwise(F.concat(F.array(place), F.col("chain_up"))))
            made = made.drop("up", "chain_up")
        if level:
            above = made.select(tree, "index", F.col("run").alias("up"), F.col("chain").alias("chain_up"))
    return made if levels else runs.select(tree, "index", "run", F.array().cast("array<struct<run:string,place:int>>").alias("chain"))


def _proved(batches):
    """One row per leaf of a run: its proof, and the root that its tampered leaf folds to."""
    names = ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            upper = [(x["run"], x["place"]) for x in row["chain"] or []]
            above = "".join(run[: HEX * k] + run[HEX * (k + 1) :] for run, k in upper)

            def fold(node: str, upper=upper) -> str:
                for run, k in upper:
                    node = digest(run[: HEX * k] + node + run[HEX * (k + 1) :])
                return node

            for x in row["leaves"]:
                node, siblings, k = x["tampered"], "", x["place"]
                if row["run"] is not None:
                    siblings = row["run"][: HEX * k] + row["run"][HEX * (k + 1) :]
                    node = digest(row["run"][: HEX * k] + node + row["run"][HEX * (k + 1) :])
                folded = fold(node)
                out.append((x["id"], x["leaf"], row["subroot"], row["root"], digest(siblings + above), folded, folded == row["root"]))
        kinds = (pa.int64(), *[pa.string()] * 5, pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], names=names)


def merkle_manifest(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", tree_column: str = "source", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), tamper: bool = True) -> DataFrame:
    """One row per input row: id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf is the SHA-256 of ``fields`` in order, each with its length before it.  Leaves of one ``tree_column`` ascend by id (null ids last, ties by leaf); every
    FANOUT consecutive nodes become the hash of them, the last run whatever it has, until one is left: the subroot.  Subroots ascend by name
    (null first, bytewise) and become the root likewise.  The proof holds all siblings from the leaf to the root.  ``folded_root`` is what the
    proof gives with the row as tampered with: with ``tamper``, texts are in lower case (A-Z) where TAMPERED divides the CRC-32 of the id's digits
    (null ids are never chosen).  ``verified`` tells whether that is the root.

    Nulls in any column have a form of their own.  Rows that repeat each other are leaves of their own.  Very long texts are hashed
    where they are read and never moved.  A tree may hold any share of the rows.  Other columns are ignored, whatever their names; an empty table gives an empty result.
    """
    ident, text = F.col(id_column).cast("long"), F.col(text_column).cast("string")
    columns = {f: text if f == text_column else F.col(f"`{f}`") for f in fields}
    chosen = F.coalesce(F.crc32(ident.cast("string").cast("binary")) % TAMPERED == 0, F.lit(False)) & F.lit(tamper)
    other = leaf_of(*({**columns, text_column: F.translate(text, _UPPER, _LOWER)}).values())
    name = F.coalesce(F.concat(F.lit("="), F.col(tree_column).cast("string")), F.lit(""))
    leaves = docs.select(ident.alias("id"), name.alias("tree"), leaf_of(*columns.values()).alias("leaf"), F.when(chosen, other).alias("tampered")).withColumn("tampered", F.coalesce("tampered", "leaf"))
    spark = docs.sparkSession
    with scratch(spark) as keep:
        leaves = materialize(leaves, "merkle-leaves")
        leaves = materialize(indexed(leaves, "tree", [F.col("id").asc_nulls_last(), F.col("leaf")], leaves.count()), "merkle-indexed")
        runs, roots, levels = forest(leaves, "tree")
        runs, roots = materialize(runs, "merkle-runs"), materialize(roots, "merkle-roots")
        # The roots of all trees are the leaves of one more.
        tops = roots.select(F.lit(0).alias("all"), F.col("tree").alias("name"), F.col("node").alias("leaf"))
        tops = materialize(indexed(tops, "all", [F.col("name")], roots.count()), "merkle-tops")
        top_runs, top_root, top_levels = forest(tops, "all")
        upper = materialize(chains(materialize(top_runs, "merkle-top-runs"), "all", top_levels), "merkle-top-chains")
        place = lambda column: F.pmod(F.col(column), F.lit(FANOUT)).cast("int")
        run_of = F.floor(F.col("index") / FANOUT).cast("long")
        tops = tops.select("all", F.col("name").alias("tree"), F.col("leaf").alias("subroot"), run_of.alias("_run"), place("index").alias("_place"))
        upper = upper.select("all", F.col("index").alias("_run"), F.concat(F.array(F.struct("run", F.lit(None).cast("int").alias("place"))), "chain").alias("_upper"))
        tops = tops.join(upper, ["all", "_run"], "left").join(top_root.withColumnRenamed("node", "root"), "all")
        first = F.transform("_upper", lambda x, k: F.struct(x["run"].alias("run"), F.when(k == 0, F.col("_place")).otherwise(x["place"]).alias("place")))
        tops = materialize(tops.select("tree", "subroot", "root", F.coalesce(first, F.array().cast("array<struct<run:string,place:int>>")).alias("upper")), "merkle-upper")
        rows = leaves.groupBy("tree", run_of.alias("index")).agg(F.collect_list(F.struct(place("index").alias("place"), "id", "leaf", "tampered")).alias("leaves"))
        rows = rows.join(chains(runs, "tree", levels), ["tree", "index"], "left").join(tops, "tree")
        chain = F.concat(F.coalesce("chain", F.array().cast("array<struct<run:string,place:int>>")), "upper")
        out = rows.select("leaves", "run", "subroot", "root", chain.alias("chain")).mapInArrow(_proved, "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
        return keep(out, "merkle-proved")
