"""Merkle dataset manifest: a tree of digests for each source, one over the sources, proofs by descent from the root."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import free_name, small_batches, stored

FAN = 3
#: Levels that one block covers: FAN ** LEVELS members, whose records one task holds at a time.
LEVELS = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(fields: list[Column]) -> Column:
    """sha256 over the fields' texts, each as its UTF-8 byte count, a colon and the text; ``-`` for null."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*[part(c.cast("string")) for c in fields]).cast("binary"), 256)


def height(size: int) -> int:
    """Levels over so many members."""
    n = 0
    while size > 1:
        size, n = -(-size // FAN), n + 1
    return n


def ranked(rows: DataFrame, tree: str, order: list[str], name: str) -> DataFrame:
    """rows with ``rank`` (from 0, inside each tree) and ``size`` (rows of the tree); trees are not null.

    Rows are dealt out by ranges of (tree, order), so a hot tree is spread over many tasks; a row's rank is its place in
    its range's part of the tree plus the rows of the parts before. ``order`` has to be unique in a tree; its nulls come
    first.
    """
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    parts = stored(rows.repartitionByRange(n, tree, *order).withColumn("_part", F.spark_partition_id()), name)
    held = parts.groupBy(tree, "_part").agg(F.count("*").alias("_held"))
    spot = held.select(
        F.col(tree).alias("_tree"), F.col("_part").alias("_spot"),
        F.expr(f"sum(_held) over (partition by {tree} order by _part) - _held as _before"),
        F.expr(f"sum(_held) over (partition by {tree}) as size"),
    )
    local = parts.withColumn("_place", F.expr(f"row_number() over (partition by {tree}, _part order by {', '.join(order)}) - 1"))
    joined = local.join(spot, (F.col(tree) == F.col("_tree")) & (F.col("_part") == F.col("_spot")))
    return joined.withColumn("rank", F.col("_before") + F.col("_place")).drop("_tree", "_spot", "_before", "_place", "_part")


def contract(members: list[str], levels: int) -> tuple[str, list[tuple[str, list[str]]]]:
    """Digest over the members after so many levels, and the records (digest, children) of all nodes on the way."""
    records = []
    for _ in range(levels):
        above = []
        for i in range(0, len(members), FAN):
            children = members[i : i + FAN]
            above.append(digest("".join(children)))
            records.append((above[-1], children))
        members = above
    return members[0], records


def _contract_blocks(levels: int):
    """Rows sorted by (tree, block, rank): one row for each block. Holds one block at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, members, out = None, [], []

        def close() -> None:
            if now:
                (tree, block), size = now
                root, records = contract(members, min(height(size), levels))
                out.append((tree, block, size, root, [{"digest": d, "children": c} for d, c in records]))

        def emit() -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("digest", pa.string()), ("children", pa.list_(pa.string()))]))]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["tree", "block", "size", "root", "records"])

        for b in batches:
            for tree, block, size, leaf in zip(*(b.column(c).to_pylist() for c in ("tree", "block", "size", "digest"))):
                if now is None or now[0] != (tree, block):
                    close()
                    now, members = ((tree, block), size), []
                members.append(leaf)
                if len(out) >= 64:
                    yield emit()
                    out.clear()
        close()
        if out:
            yield emit()

    return run


def _in_blocks(rows: DataFrame, *order: str) -> DataFrame:
    """Whole blocks in one task each, in order; a block has a bounded number of rows whatever the tree's size."""
    return rows.repartition(F.col("tree"), F.col("block")).sortWithinPartitions("tree", "block", *order)


@dataclass
class Forest:
    """Trees over ranked members. steps: (members, blocks) from the leaves upwards; the members of a step are the block
    digests of the step before. roots: (tree, size, root)."""

    steps: list[tuple[DataFrame, DataFrame]]
    roots: DataFrame
    levels: int

    @classmethod
    def over(cls, members: DataFrame, name: str, levels: int = LEVELS) -> Forest:
        """members: tree, rank, size, digest (more columns stay with the first step's members)."""
        steps, roots, most = [], [], FAN**levels
        members = members.withColumn("block", F.expr(f"rank div {most}"))
        while True:
            slim = _in_blocks(members.select("tree", "block", "rank", "size", "digest"), "rank")
            records = "array<struct<digest: string, children: array<string>>>"
            blocks = stored(slim.mapInArrow(_contract_blocks(levels), f"tree string, block long, size long, root string, records {records}"), name)
            steps.append((members, blocks))
            done = blocks.where(F.col("size") <= most).select("tree", "root")
            roots.append(done)
            rest = blocks.where(F.col("size") > most)
            if not rest.take(1):
                break
            members = rest.select("tree", F.col("block").alias("rank"), F.ceil(F.col("size") / most).cast("long").alias("size"), F.col("root").alias("digest"))
            members = members.withColumn("block", F.expr(f"rank div {most}"))
        found = roots[0]
        for r in roots[1:]:
            found = found.unionByName(r)
        return cls(steps, found, levels)

    def records(self) -> DataFrame:
        """The store: (digest, children) of every node, each digest once."""
        found = None
        for _, blocks in self.steps:
            own = blocks.select(F.explode("records").alias("r")).select("r.digest", "r.children")
            found = own if found is None else found.unionByName(own)
        return found.dropDuplicates(["digest"])

    def paths(self, above: DataFrame, finish: Callable | None = None, schema: str = "", extra: tuple[str, ...] = ()) -> DataFrame:
        """The members' paths: tree, rank, digits, siblings (upwards, above's path of the tree last).

        Requests go down from the roots block by block: a step's blocks get the path of their block root and hand it to
        their members, each of which descends by the digits of its rank. ``finish`` turns the lowest members into rows
        of ``schema`` inside the task, so that long paths need not be written.
        """
        down = above.select("tree", F.lit(0).cast("long").alias("rank"), "digits", "siblings")
        for k in reversed(range(len(self.steps))):
            members, blocks = self.steps[k]
            tops = blocks.where(F.col("size") <= FAN**self.levels).select(F.col("tree").alias("_tree"), F.lit(0).cast("long").alias("_rank"))
            top = above.join(tops, F.col("tree") == F.col("_tree")).select("tree", F.col("_rank").alias("rank"), "digits", "siblings")
            down = top if k == len(self.steps) - 1 else down.select("tree", "rank", "digits", "siblings").unionByName(top)
            over = down.select(F.col("tree").alias("_tree"), F.col("rank").alias("_rank"), "digits", "siblings")
            heads = blocks.join(over, (F.col("tree") == F.col("_tree")) & (F.col("block") == F.col("_rank"))).drop("_tree", "_rank", "size")
            last = k == 0 and finish is not None
            names = extra if last else ()
            rows = members.select("tree", "block", "rank", "size", "digest", *names)
            both = _in_blocks(heads.unionByName(rows, allowMissingColumns=True).withColumn("_head", F.col("rank").isNotNull()), "_head", "rank")
            down = small_batches(both).mapInArrow(_descend(self.levels, finish if last else None, names), schema if last else "tree string, rank long, digits array<int>, siblings array<string>")
        return down


def descent(root: str, place: int, levels: int, records: dict[str, list[str]]) -> tuple[str, list[tuple[int, list[str]]]]:
    """Digest found below root by the digits of ``place``, with (digit, unselected children) of each level, lowest first."""
    path, now = [], root
    for k in reversed(range(levels)):
        digit, children = place // FAN**k % FAN, records[now]
        path.append((digit, children[:digit] + children[digit + 1 :]))
        now = children[digit]
    return now, path[::-1]


def _descend(levels: int, finish: Callable | None, extra: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, records, above = None, {}, ([], [])
        for b in batches:
            names = ("tree", "rank", "size", "digest", "root", "records", "digits", "siblings", *extra)
            found = []
            for tree, rank, size, own, head, held, digits, siblings, *rest in zip(*(b.column(c).to_pylist() for c in names)):
                if rank is None:
                    root, above = head, (digits, siblings)
                    records = {r["digest"]: r["children"] for r in held}
                    continue
                at, path = descent(root, rank % FAN**levels, min(height(size), levels), records)
                if at != own:
                    raise ValueError(f"the store leads to {at}, not to {own}")
                found.append((tree, rank, [d for d, _ in path] + above[0], ["".join(s) for _, s in path] + above[1], own, *rest))
            if found and finish:
                yield finish(found)
            elif found:
                kinds = [pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*found))[:4], kinds)], names=["tree", "rank", "digits", "siblings"])

    return run


def fold(leaf: str, digits: list[int], siblings: list[str]) -> str:
    """The root that follows from a leaf; siblings holds the joined digests of a level's others."""
    for digit, others in zip(digits, siblings):
        leaf = digest(others[: 64 * digit] + leaf + others[64 * digit :])
    return leaf


class Manifest:
    """The manifest of docs: a leaf for each row, a tree for each source, and a tree over the sources' roots.

    Leaves of a source ascend by id (nulls first; equal ids by their leaf digest, equal leaves as stored); sources
    ascend by their UTF-8 bytes, null first. ``root`` is None for an empty table. The store of records (``store()``)
    and all tables lie in the shared folder; only the root reaches the driver. A null field counts as ``-`` in its leaf.
    """

    def __init__(self, docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", fields: tuple[str, ...] = FIELDS, levels: int = LEVELS, **more: Column):
        """more: columns, by name, that stay with the leaves."""
        own = free_name(docs, "_row")
        rows = docs.withColumn(own, F.monotonically_increasing_id()).select(
            F.coalesce(F.concat(F.lit("1"), F.col(source_col).cast("string")), F.lit("0")).alias("tree"),
            F.col(id_col).cast("long").alias("doc_id"),
            leaf_of([F.col(f) for f in fields]).alias("digest"),
            F.col(own).alias("_row"),
            *[c.alias(n) for n, c in more.items()],
        )
        self.extra = ("doc_id", *more)
        leaves = ranked(stored(rows, "leaves"), "tree", ["doc_id", "digest", "_row"], "ranges").drop("_row")
        self.sources = Forest.over(stored(leaves, "ranked"), "blocks", levels)
        subroots = self.sources.roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("digest"))
        self.top = Forest.over(stored(ranked(stored(subroots, "subroots"), "tree", ["name"], "ranges"), "ranked"), "blocks", levels)
        found = self.top.roots.collect()
        self.root: str | None = found[0]["root"] if found else None

    def store(self) -> DataFrame:
        return self.sources.records().unionByName(self.top.records()).dropDuplicates(["digest"])

    def _above(self) -> DataFrame:
        """Of each source's tree the path from its subroot to the root."""
        none = self.top.roots.select("tree", F.expr("cast(array() as array<int>) as digits"), F.expr("cast(array() as array<string>) as siblings"))
        paths = self.top.paths(none)
        names = self.top.steps[0][0].select(F.col("rank").alias("_rank"), F.col("name").alias("_name"))
        return paths.join(names, F.col("rank") == F.col("_rank")).select(F.col("_name").alias("tree"), "digits", "siblings")

    def proofs(self) -> DataFrame:
        """tree, rank, digits, siblings of every leaf: the siblings of each level upwards, joined from left to right."""
        return self.sources.paths(self._above())

    def audit(self) -> DataFrame:
        """doc_id, tree, leaf, digest of the proof, root that follows from the column ``found`` (null: the leaf itself)."""

        def finish(rows: list[tuple]) -> pa.RecordBatch:
            out = []
            for tree, _, digits, siblings, leaf, doc_id, found in rows:
                out.append((tree, doc_id, leaf, digest("".join(siblings)), fold(found or leaf, digits, siblings)))
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["tree", "doc_id", "leaf", "proof_sha256", "folded_root"])

        return self.sources.paths(self._above(), finish, "tree string, doc_id long, leaf string, proof_sha256 string, folded_root string", ("doc_id", "found"))


def audited(docs: DataFrame, levels: int = LEVELS, **columns: Column) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row of docs.

    columns replaces fields of docs (by name) in the rows that are checked against the manifest of docs: each row's
    leaf is made anew from them and folded with the siblings that the manifest's store gives. A row is verified if
    that leads to the root. Repeated rows have a leaf each; an empty table gives an empty result.
    """
    manifest = Manifest(docs, levels=levels, found=leaf_of([columns.get(f, F.col(f)) for f in FIELDS]))
    subroots = manifest.sources.roots.select(F.col("tree").alias("_tree"), F.col("root").alias("subroot"))
    rows = manifest.audit().join(subroots, F.col("tree") == F.col("_tree"))
    root = F.lit(manifest.root).cast("string")
    return rows.select("doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))
