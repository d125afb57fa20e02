"""Parent-child rows to full hierarchies of any depth, with cycles told apart (problem 5).

Method. Leaves are peeled, which exposes the cycles, and the links among nodes on cycles are cut.
The Euler tour of all nodes is laid out as linked lists and ranked in parallel by pointer jumping,
which gives every node its entry and exit, depth and root. Paths, and with them ancestors and
descendants, come from the intervals: in order of entry a node's ancestors are the last nodes
before it of each smaller depth.

Nodes are numbered in order of their ids and worked on in blocks of consecutive numbers. Peeling
and ranking go through each block first: what lies in one block costs no exchange. A tour that
leaves a block is cut there into pieces; the pieces' list is ranked over all blocks by the same
pointer jumping, as joins of whole numbers, each round written to the shared folder. Where ids
begin like their parents' few tours leave a block; where they don't, every link does, with the
same result. Rounds grow with the logarithm of the number of pieces of a tour, not with its depth.
A block holds a fixed number of nodes, so a parent of a third of all nodes fills many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from guideloom.plans.ordering import batches, partition_no, range_sorted
from guideloom.plans.scratch import Scratch

CYCLE = "cycle"
#: A block holds two to the power of this many nodes.
BLOCK_BITS = 16
#: Peeling over all blocks goes on while a round takes at least this part of the nodes that are left; then links are doubled.
WORTH_PEELING = 0.25
BLANKS = " \t\r\n\v\f"

NODE, PORT, ON_CYCLE = range(3)  # rows of a block: its nodes, those with children in other blocks, those on cycles
ROOT_PIECE, GROUP_PIECE, LEAVE_PIECE = range(1, 4)  # beside NODE, rows of a block's result: pieces of tours, by what they begin with


def latest_links(df: DataFrame, ident: str, parent: str, order: list[str]) -> DataFrame:
    """(id, parent_id): of several rows with one id the one that is last by ``order``; blanks around parent stripped, empty is null."""
    trimmed = F.btrim(F.col(parent).cast("string"), F.lit(BLANKS))
    rows = df.select(
        F.col(ident).cast("string").alias("id"), F.struct(*(F.col(o).alias(f"o{i}") for i, o in enumerate(order)), F.nullif(trimmed, F.lit("")).alias("p")).alias("r")
    ).where("id is not null")
    return rows.groupBy("id").agg(F.max("r").alias("r")).select("id", F.col("r.p").alias("parent_id"))


class Block:
    """The nodes of one block in order of their numbers, with their links inside it."""

    def __init__(self, rows: pa.Table, bits: int):
        kind, num, par = (rows.column(c).to_numpy() for c in ("kind", "num", "par"))
        own = kind == NODE
        self.num, self.par, self.n = num[own], par[own], int(own.sum())
        self.rows = rows.filter(pa.array(own))
        self.port, self.cyclic = (self._marked(num[kind == k]) for k in (PORT, ON_CYCLE))
        self.par = np.where(self.cyclic, -1, self.par)  # links of nodes on cycles are cut
        here = (self.par >= 0) & (self.par >> bits == self.num[0] >> bits)
        self.up = np.where(here, np.searchsorted(self.num, self.par), -1)  # place of the parent, if it lies in the block

    def _marked(self, numbers: np.ndarray) -> np.ndarray:
        mask = np.zeros(self.n, dtype=bool)
        mask[np.searchsorted(self.num, numbers)] = True
        return mask

    def not_peeled(self) -> np.ndarray:
        """Mask of nodes that stay when leaves are taken away until there are none; a node with children elsewhere stays."""
        kids = np.bincount(self.up[self.up >= 0], minlength=self.n)
        stay = np.ones(self.n, dtype=bool)
        leaves = np.flatnonzero((kids == 0) & ~self.port)
        while len(leaves):
            stay[leaves] = False
            above, gone = np.unique(self.up[leaves], return_counts=True)
            above, gone = above[above >= 0], gone[above >= 0]
            kids[above] -= gone
            leaves = above[(kids[above] == 0) & ~self.port[above]]
        return stay

    def tours(self) -> tuple[np.ndarray, ...]:
        """Of all elements (2 i enters node i, 2 i + 1 leaves it): the element its piece begins with, elements and height before it, the one that precedes it, and of nodes the last sibling.

        A piece begins where a node has no sibling before it and no parent in the block, and at the
        leaving of a node with children elsewhere, whose tours come before it.
        """
        node = np.arange(self.n)
        order = np.argsort(self.par, kind="stable")
        order = order[self.par[order] >= 0]
        first = np.ones(len(order), dtype=bool)
        first[1:] = self.par[order][1:] != self.par[order][:-1]
        sibling = np.full(self.n, -1)
        sibling[order[1:]] = np.where(first[1:], -1, order[:-1])
        ends = np.append(np.flatnonzero(first)[1:], len(order)) - 1
        last = node.copy()
        last[order] = order[ends[np.cumsum(first) - 1]] if len(order) else order
        last_child = np.full(self.n, -1)
        inside = order[self.up[order] >= 0]
        last_child[self.up[inside]] = last[inside]

        previous = np.empty(2 * self.n, dtype=np.int64)
        previous[::2] = np.where(sibling >= 0, 2 * sibling + 1, np.where(self.up >= 0, 2 * self.up, -1))
        previous[1::2] = np.where(last_child >= 0, 2 * last_child + 1, 2 * node)
        linked = previous.copy()
        linked[1::2][self.port] = -1
        step = np.where(np.arange(2 * self.n) % 2 == 0, 1, -1)
        head = np.where(linked >= 0, linked, np.arange(2 * self.n))
        before, height = (linked >= 0).astype(np.int64), np.where(linked >= 0, step[head], 0)
        while (further := head[head]).tobytes() != head.tobytes():
            before, height, head = before + before[head], height + height[head], further
        return head, before, height, previous, last


def _by_block(work: Callable[[pa.Table], pa.RecordBatch]):
    """Applies ``work`` to the rows of each block of a partition that is sorted by block."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches(it):
            block = batch.column("block").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if held and held[0].column("block")[0].as_py() != int(block[a]):
                    yield work(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield work(pa.Table.from_batches(held))

    return run


def _in_blocks(rows: DataFrame, bits: int) -> DataFrame:
    """Rows (kind, num, ...) with those of one block in one partition, in order."""
    return rows.withColumn("block", F.shiftright("num", bits)).repartition("block").sortWithinPartitions("block", "num", "kind")


def _peel(bits: int, schema: pa.Schema):
    def work(rows: pa.Table) -> pa.RecordBatch:
        block = Block(rows, bits)
        stay = block.not_peeled()
        par = block.par[stay]
        return pa.RecordBatch.from_arrays([pa.array(block.num[stay]), pa.array(par, mask=par < 0)], schema=schema)

    return _by_block(work)


PLACED = T.StructType(
    [T.StructField("kind", T.IntegerType()), T.StructField("num", T.LongType()), T.StructField("id", T.StringType()), T.StructField("root_id", T.StringType())]
    + [T.StructField(x, T.BooleanType()) for x in ("known", "cyc")]
    + [T.StructField(x, T.LongType()) for x in ("piece", "entry", "depth", "exit_piece", "exit")]
)


def _tour(bits: int, schema: pa.Schema):
    """Ranks the tours inside each block: its nodes with their places in pieces, and the pieces of tours that lead out of it.

    A node is ``known`` if it is entered and left in the piece that begins its tree. A piece has its number
    in num, its elements in entry, its rise in depth; in piece the node whose children or leaving it
    begins with, and in exit_piece for a group of siblings the piece they end in, for a leaving the piece before.
    """

    def work(rows: pa.Table) -> pa.RecordBatch:
        block = Block(rows, bits)
        head, before, height, previous, last = block.tours()
        number = 2 * np.repeat(block.num, 2) + np.tile([0, 1], block.n)  # of an element, over all blocks
        is_root = np.zeros(2 * block.n, dtype=bool)
        is_root[::2] = block.par < 0
        size = np.bincount(head, minlength=2 * block.n)
        rise = np.bincount(head, weights=np.tile([1, -1], block.n), minlength=2 * block.n).astype(np.int64)

        ids = rows_ids(block.rows)
        entered, left = head[::2], head[1::2]
        known = is_root[entered] & (entered == left)
        cyc = is_root[entered] & block.cyclic[entered >> 1]
        root = ids.take(pa.array(np.where(is_root[entered], entered >> 1, 0), mask=~is_root[entered]))
        nodes = [
            np.full(block.n, NODE), block.num, ids, root, known, cyc, number[entered], before[::2], height[::2], number[left], before[1::2],
        ]

        begins = np.flatnonzero(head == np.arange(2 * block.n))
        leave = begins[begins % 2 == 1]
        group = begins[(begins % 2 == 0) & ~is_root[begins]]
        roots = np.unique(head[previous[leave]])
        roots = roots[is_root[roots]]
        at = np.concatenate([roots, group, leave])
        none = np.full(len(roots), -1)
        pieces = [
            np.repeat([ROOT_PIECE, GROUP_PIECE, LEAVE_PIECE], [len(roots), len(group), len(leave)]), number[at], pa.nulls(len(at), pa.string()), pa.nulls(len(at), pa.string()), np.zeros(len(at), bool),
            block.cyclic[at >> 1] & is_root[at], np.concatenate([none, block.par[group >> 1], block.num[leave >> 1]]), size[at], rise[at],
            np.concatenate([none, number[head[2 * last[group >> 1] + 1]], number[head[previous[leave]]]]), np.zeros(len(at), np.int64),
        ]
        columns = [pa.chunked_array([pa.array(x).cast(f.type) if isinstance(x, np.ndarray) else x for x in pair]).combine_chunks() for pair, f in zip(zip(nodes, pieces, strict=True), schema, strict=True)]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def rows_ids(rows: pa.Table) -> pa.Array:
        return pa.concat_arrays(rows.column("id").chunks) if rows.num_rows else pa.array([], pa.string())

    return _by_block(work)


def _on_cycles(core: DataFrame, left: int, scratch: Scratch) -> tuple[DataFrame, int]:
    """(num) of the nodes on cycles among (num, par), what peeling the blocks left, and their number.

    Leaves are peeled further; where a round takes too few, links are doubled until the set of nodes reached no longer shrinks.
    """
    while left:
        rest, now = scratch.counted(core.join(core.where("par is not null").select(F.col("par").alias("num")).distinct(), "num", "left_semi"))
        if now == left or not now:
            return rest.select("num"), now
        taken, core, left = left - now, rest, now
        if taken < WORTH_PEELING * (left + taken):
            break
    if not left:
        return core.select("num"), 0
    jump, reached = core.where("par is not null").select("num", F.col("par").alias("anc")), -1
    old = None
    while True:
        jump = scratch.written(jump)
        ends, now = scratch.counted(jump.select(F.col("anc").alias("num")).distinct())
        scratch.drop(old)
        if now in (0, reached):
            return ends, now
        reached, old = now, jump
        jump = jump.join(jump.select(F.col("num").alias("anc"), F.col("anc").alias("further")), "anc").select("num", F.col("further").alias("anc"))


def _ranked_pieces(pieces: DataFrame, scratch: Scratch) -> DataFrame:
    """(num, root, root_cyc, base, base_depth) of the pieces of tours over all blocks: elements and height before each."""
    groups = pieces.where(F.col("kind") == GROUP_PIECE).select("num", F.col("piece").alias("node"), F.col("entry").alias("n"), F.col("depth").alias("h"), F.col("exit_piece").alias("tail"))
    leaves = pieces.where(F.col("kind") == LEAVE_PIECE).select("num", F.col("piece").alias("node"), F.col("entry").alias("n"), F.col("depth").alias("h"), F.col("exit_piece").alias("pre"))
    # A node has at most one group of children in a block, so that its groups are few beside its children.
    groups = groups.withColumn("prev", F.lag("tail").over(Window.partitionBy("node").orderBy("num"))).join(leaves.select("node", "pre"), "node")
    tails = groups.groupBy("node").agg(F.max_by("tail", "num").alias("tail"))
    leaves = leaves.join(tails, "node", "left")
    none = F.lit(None)
    chain = (
        pieces.where(F.col("kind") == ROOT_PIECE)
        .select("num", none.cast("long").alias("ptr"), F.col("entry").alias("n"), F.col("depth").alias("h"), F.shiftright("num", 1).alias("root"), "cyc")
        .unionByName(groups.select("num", F.coalesce("prev", "pre").alias("ptr"), "n", "h", none.cast("long").alias("root"), none.cast("boolean").alias("cyc")))
        .unionByName(leaves.select("num", F.coalesce("tail", "pre").alias("ptr"), "n", "h", none.cast("long").alias("root"), none.cast("boolean").alias("cyc")))
        .withColumns({"sum": F.col("n"), "rise": F.col("h")})
    )
    old = None
    while True:
        chain, going = scratch.counted(chain, F.col("ptr").isNotNull())
        scratch.drop(old)
        if not going:
            return chain.select("num", "root", F.col("cyc").alias("root_cyc"), (F.col("sum") - F.col("n")).alias("base"), (F.col("rise") - F.col("h")).alias("base_depth"))
        old = chain
        ahead = chain.select(F.col("num").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("root").alias("root2"), F.col("cyc").alias("cyc2"), F.col("sum").alias("sum2"), F.col("rise").alias("rise2"))
        moved = chain.where("ptr is not null").join(ahead, "ptr")
        moved = moved.select("num", F.col("ptr2").alias("ptr"), "n", "h", F.col("root2").alias("root"), F.col("cyc2").alias("cyc"), (F.col("sum") + F.col("sum2")).alias("sum"), (F.col("rise") + F.col("rise2")).alias("rise"))
        chain = chain.where("ptr is null").unionByName(moved)


def hierarchy(df: DataFrame, ident: str, parent: str, order: list[str], paths: bool = False, block_bits: int = BLOCK_BITS) -> DataFrame:
    """Columns id, root_id, node_depth, entry, exit, descendants and, with ``paths``, path (array of ids from the root).

    One row per distinct non-null id: of several rows the last by ``order`` counts (nulls first).
    A null or empty parent, or one that is no id of the table, makes a root (depth 0). Where
    following the parents never ends, root_id is `cycle`, node_depth -1 and the rest null. A node
    x is a descendant of y if they share root_id and y.entry < x.entry < y.exit; positions run
    from 0 in each tree. Empty tables give no rows; other columns are not read.
    """
    scratch = Scratch(df.sparkSession, "hierarchy")
    named = scratch.written(range_sorted(latest_links(df, ident, parent, order), "id").withColumn("num", F.monotonically_increasing_id()))
    of_parent = named.select(F.col("id").alias("parent_id"), F.col("num").alias("par"))
    links = scratch.written(named.join(of_parent, "parent_id", "left").select("num", "id", F.coalesce("par", F.lit(-1).cast("long")).alias("par")))

    def marks(kind: int, numbers: DataFrame) -> DataFrame:
        return numbers.select(F.lit(kind).alias("kind"), "num", F.lit(-1).cast("long").alias("par"))

    abroad = links.where((F.col("par") >= 0) & (F.shiftright("par", block_bits) != F.shiftright("num", block_bits)))
    nodes = links.select(F.lit(NODE).alias("kind"), "num", "par", "id")
    ports = scratch.written(marks(PORT, abroad.select(F.col("par").alias("num")).distinct()))
    core_type = T.StructType([T.StructField("num", T.LongType()), T.StructField("par", T.LongType())])
    core, left = scratch.counted(_in_blocks(nodes.drop("id").unionByName(ports), block_bits).mapInArrow(_peel(block_bits, to_arrow_schema(core_type)), core_type))
    cyclic, _ = _on_cycles(core, left, scratch)

    rows = nodes.unionByName(ports.unionByName(marks(ON_CYCLE, cyclic)), allowMissingColumns=True)
    placed, n_pieces = scratch.counted(_in_blocks(rows, block_bits).mapInArrow(_tour(block_bits, to_arrow_schema(PLACED)), PLACED), F.col("kind") != NODE)
    columns = ["id", "root_id", "cyc", "entry", "depth", "exit"]
    full = placed.where(F.col("kind") == NODE)
    if n_pieces:
        ranked = scratch.written(_ranked_pieces(placed.where(F.col("kind") != NODE), scratch))
        roots = scratch.written(named.select(F.col("num").alias("root"), F.col("id").alias("root_name")).join(ranked.select("root").distinct(), "root", "left_semi"))
        begun = ranked.join(roots, "root").select(F.col("num").alias("piece"), "root_name", "root_cyc", "base", "base_depth")
        ended = ranked.select(F.col("num").alias("exit_piece"), F.col("base").alias("exit_base"))
        split = full.where("not known").join(begun, "piece").join(ended, "exit_piece")
        split = split.select("id", F.col("root_name").alias("root_id"), F.col("root_cyc").alias("cyc"), (F.col("entry") + F.col("base")).alias("entry"), (F.col("depth") + F.col("base_depth")).alias("depth"), (F.col("exit") + F.col("exit_base")).alias("exit"))
        full = full.where("known").select(*columns).unionByName(split)
    full = full.select(*columns)
    if paths:
        full = _with_paths(scratch.written(full), scratch)
    sound = ~F.col("cyc")

    def unless_cycle(value: Column) -> Column:
        return F.when(sound, value)

    return full.select(
        "id",
        F.when(sound, F.col("root_id")).otherwise(CYCLE).alias("root_id"),
        F.when(sound, F.col("depth")).otherwise(-1).cast("int").alias("node_depth"),
        unless_cycle(F.col("entry")).alias("entry"),
        unless_cycle(F.col("exit")).alias("exit"),
        unless_cycle(F.shiftright(F.col("exit") - F.col("entry") - 1, 1)).alias("descendants"),
        *([unless_cycle(F.col("path")).alias("path")] if paths else []),
    )


def _sweep(schema: pa.Schema):
    """Streams rows (root_id, entry, depth, id, exit) in order of entry: the known end of each row's path.

    Of the partition's first tree the upper ``missing`` levels lie in earlier partitions. The last row of a partition is marked.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = partition_no()
        root, path, missing = None, pa.array([], pa.string()), 0  # of the row before
        waiting: pa.RecordBatch | None = None
        first = True
        for batch in batches(it):
            roots, depth, ids = batch.column("root_id"), batch.column("depth").to_numpy(zero_copy_only=False), batch.column("id")
            # The path of the row before stands in front, one row a level.
            k = len(path) if root == roots[0].as_py() else 0
            level = np.concatenate([np.arange(missing, missing + k), depth])
            names = pa.concat_arrays([path[len(path) - k :], ids])
            code = roots.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            tree = np.concatenate([np.full(k, code[0]), code])
            lacks = np.zeros(len(level), dtype=np.int64)
            own = tree == tree[0]
            if first or (k and missing):
                lacks[own] = np.minimum.accumulate(level[own])
            first = False
            offset = np.concatenate([[0], np.cumsum(level - lacks + 1)])
            flat = np.zeros(offset[-1], dtype=np.int64)
            rows = np.arange(len(level))
            for j in range(int(level.max()) + 1):
                rows = rows[level[rows] >= j]
                at = np.maximum.accumulate(np.where(level[rows] == j, rows, -1))
                seen = lacks[rows] <= j
                flat[offset[rows[seen]] + j - lacks[rows[seen]]] = at[seen]
            lists = pa.ListArray.from_arrays(pa.array((offset[k:] - offset[k]).astype(np.int32)), names.take(pa.array(flat[offset[k] :])))
            n = len(depth)
            made = [*batch.columns, lists.cast(schema.field("path").type), pa.array(lacks[k:]), pa.array(np.full(n, pid, np.int32)), pa.array(np.zeros(n, bool)), pa.array(np.arange(n) == 0)]
            if waiting is not None:
                made[-1] = pa.array(np.zeros(n, bool))
                yield waiting
            waiting = pa.RecordBatch.from_arrays(made, schema=schema)
            root, path, missing = roots[n - 1].as_py(), lists[n - 1].values, int(lacks[-1])
        if waiting is not None:
            n = waiting.num_rows
            yield waiting.set_column(schema.get_field_index("last"), schema.field("last"), pa.array(np.arange(n) == n - 1))

    return run


def _with_paths(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """``nodes`` with path, from their places: one sort by tree and entry, and a sweep that keeps the last node of each depth."""
    sorted_type = T.StructType([nodes.schema[c] for c in ("root_id", "entry", "depth", "id", "exit")])
    swept_type = T.StructType(
        [*sorted_type, T.StructField("path", T.ArrayType(T.StringType())), T.StructField("missing", T.LongType()), T.StructField("pid", T.IntegerType())]
        + [T.StructField(x, T.BooleanType()) for x in ("last", "first")]
    )
    ordered = range_sorted(nodes.where("not cyc").select(*sorted_type.names), "root_id", "entry")
    swept = scratch.written(ordered.mapInArrow(_sweep(to_arrow_schema(swept_type)), swept_type))
    # What a partition's first tree lacks: for each level the last node of the partitions before. One row a level and partition.
    open_levels = swept.where("last").select("root_id", "pid", F.posexplode("path").alias("at", "node"), "missing").select("root_id", "pid", (F.col("at") + F.col("missing")).alias("level"), "node", F.lit(False).alias("asks"))
    asked = swept.where("first and missing > 0").select("root_id", "pid", F.explode(F.sequence(F.lit(0).cast("long"), F.col("missing") - 1)).alias("level"), F.lit(None).cast("string").alias("node"), F.lit(True).alias("asks"))
    earlier = Window.partitionBy("root_id", "level").orderBy("pid").rangeBetween(Window.unboundedPreceding, -1)
    known = open_levels.unionByName(asked).withColumn("node", F.last("node", ignorenulls=True).over(earlier)).where("asks")
    above = known.groupBy("pid").agg(F.transform(F.sort_array(F.collect_list(F.struct("level", "node"))), lambda x: x["node"]).alias("above"))
    cut = swept.where("missing > 0").join(above, "pid").withColumn("path", F.concat(F.slice("above", F.lit(1), F.col("missing").cast("int")), F.col("path")))
    columns = ["id", "root_id", "cyc", "entry", "depth", "exit", "path"]
    whole = swept.where("missing = 0").unionByName(cut.drop("above")).withColumn("cyc", F.lit(False))
    return whole.select(*columns).unionByName(nodes.where("cyc").select(*columns[:-1], F.lit(None).cast("array<string>").alias("path")))


def descendant_pairs(nodes: DataFrame) -> DataFrame:
    """(ancestor_id, id, distance) for every node and each of its ancestors, of a hierarchy with paths; as many rows as the depths add up to."""
    up = nodes.where("path is not null").select("id", F.col("node_depth").alias("d"), F.posexplode("path").alias("at", "ancestor_id"))
    return up.where("at < d").select("ancestor_id", "id", (F.col("d") - F.col("at")).alias("distance"))
