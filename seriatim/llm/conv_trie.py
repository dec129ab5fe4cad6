"""Prefix trie of conversations: succinct level-order tries by prefix shard, heavy upper levels apart.

Each conversation is rebuilt (``rebuilt``) and becomes a path of turns.  A turn's label is two hashes of its role and
text; a node is named by its depth and two sums of the labels up to it, each label times a power of its place.  Turns
are numbered and summed in one sort by range, a conversation that lies over several tasks being carried on by a row a
task, so the longest conversation is as well spread as any.

Nodes with more than ``HEAVY`` turns below or in them are heavy, the others hang below them in subtrees of a bounded
size.  A task takes many such subtrees at once: numpy builds their levels, a LOUDS bit vector and the label arrays, and
adds up leaves and tokens from the last level to the first.  Heavy nodes are a table; what hangs below them is added by
doubling the distance to their ancestors, so a long heavy path takes few steps.  Hashes of members that end in a heavy
node are made from sorted chunks of ids, which one task a node streams through, as such a hash can only be made in order.

Defined cases: rows with a null conv_id take no part; turns come by number, null first, and those of one number by their
labels (equal rows are equal either way); a null role or text is empty; texts are taken whole; a conversation without
turns is a member of the root alone; other columns, whatever their names, are left out; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriatim.llm.common import Staging, keyed_broadcast

#: Conversations that share their first turns with the first of them, and turns that they share at most.
GROUP, SHARED = 100, 5
#: Turns in and below a node from which it is heavy.
HEAVY = 4096
#: Turns whose tries a task builds at once, and ids in a chunk.
TURNS_AT_ONCE, CHUNK = 200_000, 20_000
POWERS = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9)
WORD = (1 << 64) - 1
NOTHING = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def labels(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, la, lb and n (code points of the text)."""
    d = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return d.filter("conv_id is not null").select("conv_id", "turn", F.xxhash64("role", "text").alias("la"), F.xxhash64("text", F.lit("role"), "role").alias("lb"), F.length("text").cast("long").alias("n"))


class Run:
    """Numbers and sums of the turns of one conversation after the other, in batches."""

    def __init__(self) -> None:
        self.conv, self.count, self.sums, self.whole = None, 0, [0, 0], None

    def add(self, conv: np.ndarray, head: np.ndarray, whole: np.ndarray, found: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Number (from 1; of a head the one before), length (-1: not told here), sums, and their last terms."""
        starts = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
        sizes = np.diff(np.append(starts, len(conv)))
        on = self.conv is not None and conv[0] == self.conv
        counted = np.cumsum(~head)
        before = np.repeat((counted - ~head)[starts], sizes)
        place = counted - before  # within the batch
        first = np.zeros(len(conv), bool)
        first[: sizes[0]] = on
        number = place + np.where(first, self.count, 0)
        told = np.where(head[starts], whole[starts], -1)
        if on:
            told[0] = -1 if self.whole is None else self.whole
        length = np.repeat(told, sizes)
        sums, terms = [], []
        for k, power in enumerate(POWERS):
            powers = np.full(int(place.max()) + 1, power, np.uint64)
            powers[0] = 1
            powers = np.cumprod(powers, dtype=np.uint64)
            term = np.where(head, np.uint64(0), found[k].view(np.uint64) * powers[place])
            if on:
                term[: sizes[0]] *= np.uint64(pow(power, self.count, WORD + 1))
            total = np.cumsum(term, dtype=np.uint64)
            own = total - np.repeat((total - term)[starts], sizes)
            if on:
                own[: sizes[0]] += np.uint64(self.sums[k])
            sums.append(own)
            terms.append(term)
        self.conv, self.count, self.sums = int(conv[-1]), int(number[-1]), [int(s[-1]) for s in sums]
        self.whole = None if length[-1] < 0 else int(length[-1])
        return number, length, sums, terms


_SCANNED = "part int, conv_id long, head boolean, la long, lb long, n long, number long, length long, sa long, sb long, ta long, tb long"


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    run, part = Run(), TaskContext.get().partitionId()
    for batch in batches:
        if batch.num_rows:
            conv, la, lb = (batch.column(c).to_numpy() for c in ("conv_id", "la", "lb"))
            head = batch.column("head").to_numpy(zero_copy_only=False)
            number, length, (sa, sb), (ta, tb) = run.add(conv, head, batch.column("whole").to_numpy(), (la, lb))
            columns = {"part": np.full(len(conv), part, np.int32), "conv_id": conv, "head": head, "la": la, "lb": lb, "n": batch.column("n").to_numpy(), "number": number, "length": length, "sa": sa.view(np.int64), "sb": sb.view(np.int64), "ta": ta.view(np.int64), "tb": tb.view(np.int64)}
            yield pa.RecordBatch.from_pydict(columns)


def carries(ends: list[tuple[int, int, tuple]]) -> dict[int, tuple[int, int, tuple[int, int], int]]:
    """By part: the conversation that it goes on with, its turns, sums and length so far.

    ``ends``: part, its first conversation, and conversation, number, sums and length (-1: not told) of its last row.
    """
    out: dict[int, tuple] = {}
    last: tuple | None = None
    for part, first, (conv, number, sa, sb, length) in sorted(ends):
        carry = last if last is not None and last[0] == first else None
        if carry:
            out[part] = carry
        sums = (sa & WORD, sb & WORD)
        if carry and conv == first:
            sums = tuple((c + s * pow(p, carry[1], WORD + 1)) & WORD for c, s, p in zip(carry[2], sums, POWERS, strict=True))
            number, length = number + carry[1], carry[3]
        last = (conv, number, sums, length)
    return out


def scanned(rows: DataFrame, order: list[Column], stage: Staging, name: str) -> DataFrame:
    """conv_id, head, la, lb, n, depth, length, and a, b (the sums up to a turn) and pa, pb (before it).

    ``rows``: conv_id, head (a row that is no turn but tells its conversation's length ``whole``), la, lb, n, and the
    columns of ``order``, which with equal rows aside is unique in a conversation.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.asc("conv_id"), *order]
    local = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).select("conv_id", "head", "la", "lb", "n", "whole").mapInArrow(_local, _SCANNED)
    local = stage(local, name)
    ends = local.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "number", "sa", "sb", "length")).alias("last")).collect()  # a row a partition
    going_on = carries([(r["part"], r["first"], tuple(r["last"])) for r in ends])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
            part, conv, number, length = get("part"), get("conv_id"), get("number").copy(), get("length").copy()
            sums, terms = [get(c).view(np.uint64).copy() for c in ("sa", "sb")], [get(c).view(np.uint64).copy() for c in ("ta", "tb")]
            for p in np.unique(part).tolist():
                if p in going_on:
                    c, count, before, whole = going_on[p]
                    on = (part == p) & (conv == c)
                    number[on] += count
                    length[on] = whole
                    for k, power in enumerate(POWERS):
                        scale = np.uint64(pow(power, count, WORD + 1))
                        terms[k][on] *= scale
                        sums[k][on] = sums[k][on] * scale + np.uint64(before[k])
            before = [(s - t).view(np.int64) for s, t in zip(sums, terms, strict=True)]
            yield pa.RecordBatch.from_pydict({"conv_id": conv, "head": batch.column("head"), "la": batch.column("la"), "lb": batch.column("lb"), "n": batch.column("n"), "depth": number, "length": length, "a": sums[0].view(np.int64), "b": sums[1].view(np.int64), "pa": before[0], "pb": before[1]})

    return local.mapInArrow(run, "conv_id long, head boolean, la long, lb long, n long, depth long, length long, a long, b long, pa long, pb long")


def rebuilt(conversations: DataFrame, stage: Staging) -> DataFrame:
    """Turns of the rebuilt conversations as ``scanned`` gives them, and a head of each.

    Of conversation c the first h turns come from the first of its hundred (as many as that has), and those after its
    own first h follow; h is the crc32 of c's decimal form by six.
    """
    rows = labels(conversations).withColumns({"head": F.lit(False), "whole": F.lit(-1).cast("long")})
    own = stage(scanned(rows, [F.asc_nulls_first("turn"), F.asc("la"), F.asc("lb")], stage, "turns").select("conv_id", "la", "lb", "n", F.col("depth").alias("pos")), "numbered")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (SHARED + 1)).alias("h")
    counts = own.groupBy("conv_id").agg(F.count("*").alias("own"))
    first = F.col("conv_id") - F.col("conv_id") % GROUP
    convs = counts.select("conv_id", "own", h, first.alias("base"))
    convs = convs.join(counts.select(F.col("conv_id").alias("base"), F.col("own").alias("has")), "base", "left")
    convs = stage(convs.withColumn("has", F.least("h", F.coalesce("has", F.lit(0)))), "conversations")
    bases = own.filter((F.col("conv_id") % GROUP == 0) & (F.col("pos") <= SHARED)).select(F.col("conv_id").alias("base"), "la", "lb", "n", "pos")
    none = F.lit(0).cast("long")
    heads = convs.select("conv_id", F.lit(True).alias("head"), none.alias("la"), none.alias("lb"), none.alias("n"), (F.col("has") + F.greatest(F.col("own") - F.col("h"), none)).alias("whole"), F.lit(-1).alias("role"), none.alias("pos"))
    no = F.lit(-1).cast("long").alias("whole")
    taken = convs.join(bases, "base").filter(F.col("pos") <= F.col("h")).select("conv_id", F.lit(False).alias("head"), "la", "lb", "n", no, F.lit(0).alias("role"), "pos")
    rest = own.withColumn("h", h).filter(F.col("pos") > F.col("h")).select("conv_id", F.lit(False).alias("head"), "la", "lb", "n", no, F.lit(1).alias("role"), "pos")
    return stage(scanned(heads.unionByName(taken).unionByName(rest), [F.asc("role"), F.asc("pos")], stage, "paths"), "rebuilt")


class Louds:
    """A forest in level order: the roots' number in ones and a zero, then each node's children in ones and a zero."""

    def __init__(self, children: np.ndarray, roots: int) -> None:
        degree = np.concatenate([[roots], children])
        self.bits = np.ones(int(degree.sum()) + len(degree), bool)
        self.bits[np.cumsum(degree + 1) - 1] = False

    def parents(self) -> np.ndarray:
        """Of every node, by the zeros before its one; -1 of a root."""
        ones = np.flatnonzero(self.bits)
        return ones - np.arange(len(ones)) - 1

    def children(self) -> np.ndarray:
        return np.diff(np.flatnonzero(~self.bits)) - 1


class Forest:
    """The tries of some subtrees' paths: conversations ``ids``, the subtree of each, and their labels and lengths from its top on."""

    def __init__(self, ids: np.ndarray, tree: np.ndarray, ends: np.ndarray, la: np.ndarray, lb: np.ndarray, n: np.ndarray) -> None:
        size, starts = np.diff(ends), ends[:-1]
        at, alive = tree.copy(), np.arange(len(ids))  # the node that each conversation has come to
        self.levels = [0, int(tree.max()) + 1]
        above, self.la, self.lb, self.n, members, enders = [], [], [], [], [], []
        depth = 0
        while len(alive):
            if depth:
                order = np.lexsort((lb[starts[alive] + depth], la[starts[alive] + depth], at[alive]))
                a, p = alive[order], at[alive[order]]
                x, y = la[starts[a] + depth], lb[starts[a] + depth]
                new = np.concatenate([[True], (p[1:] != p[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
                at[a] = self.levels[-1] + np.cumsum(new) - 1
                above.append(p[new])
                self.levels.append(self.levels[-1] + int(new.sum()))
            spot, one = np.unique(at[alive], return_index=True)
            sample = starts[alive[one]] + depth
            self.la.append(la[sample])
            self.lb.append(lb[sample])
            self.n.append(n[sample])
            members.append((at[alive], ids[alive]))
            last = alive[size[alive] == depth + 1]
            enders.append((at[last], ids[last]))
            depth += 1
            alive = alive[size[alive] > depth]
        roots, total = self.levels[1], self.levels[-1]
        above = np.concatenate([np.zeros(0, np.int64), *above])
        self.louds = Louds(np.bincount(above, minlength=total), roots)
        self.la, self.lb, self.n = (np.concatenate(c) for c in (self.la, self.lb, self.n))
        node, conv = (np.concatenate(c) for c in zip(*members, strict=True))
        self.convs = np.bincount(node, minlength=total)
        self.least = np.full(total, np.iinfo(np.int64).max)
        np.minimum.at(self.least, node, conv)
        node, conv = (np.concatenate(c) for c in zip(*enders, strict=True))
        order = np.lexsort((conv, node))
        cuts = np.searchsorted(node[order], np.arange(total + 1))
        conv = conv[order]
        self.hashes = [hashlib.sha256(",".join(map(str, conv[lo:hi].tolist())).encode()).hexdigest() if lo < hi else NOTHING for lo, hi in zip(cuts, cuts[1:], strict=False)]

    def rolled(self, values: np.ndarray) -> np.ndarray:
        """Each node's value and all below it, from the last level to the first."""
        out, parents = values.astype(np.int64).copy(), self.louds.parents()
        for lo, hi in reversed(list(zip(self.levels[1:], self.levels[2:], strict=False))):
            np.add.at(out, parents[lo:hi], out[lo:hi])
        return out

    def depths(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.levels) - 1), np.diff(self.levels))


def _tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of subtrees, whose conversations come one subtree after the other."""
    held: list[tuple] = []
    rows = 0

    def told() -> pa.RecordBatch:
        keys = [h[0] for h in held]
        tree = np.cumsum([0, *(x != y for x, y in zip(keys, keys[1:], strict=False))])
        ends = np.cumsum([0, *(len(h[2]) for h in held)])
        f = Forest(np.array([h[1] for h in held], np.int64), tree, ends, *(np.concatenate([h[k] for h in held]) for k in (2, 3, 4)))
        first = np.flatnonzero(np.concatenate([[True], tree[1:] != tree[:-1]]))
        parents, children, depth = f.louds.parents(), f.louds.children(), f.depths()
        root = np.arange(len(parents))
        for lo, hi in zip(f.levels[1:], f.levels[2:], strict=False):
            root[lo:hi] = root[parents[lo:hi]]
        top = [keys[i] for i in first]
        start = np.array([k[0] for k in top], np.int64)
        is_top = parents < 0
        above = np.where(is_top, 0, f.least[np.maximum(parents, 0)])
        columns = {"conv_id": f.least, "depth": depth + start[root], "parent_conv_id": pa.array(above, mask=is_top), "n_convs": f.convs, "n_children": children, "n_leaves": f.rolled(children == 0), "saved_tokens": f.rolled((f.convs - 1) * f.n), "ends_sha256": f.hashes, "top": is_top}
        for i, c in ((3, "pa"), (4, "pb")):
            columns[c] = np.where(is_top, np.array([k[i] for k in top], np.int64)[root], 0)
        return pa.RecordBatch.from_pydict(columns)

    for batch in batches:
        path = batch.column("path")
        cuts = np.concatenate([[0], np.cumsum(path.value_lengths().to_numpy())])
        fields = dict(zip(("depth", "la", "lb", "n"), (c.to_numpy() for c in path.flatten().flatten()), strict=True))
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("depth", "a", "b", "pa", "pb")), strict=True))
        for i, conv in enumerate(batch.column("conv_id").to_pylist()):
            if held and rows >= TURNS_AT_ONCE and keys[i] != held[-1][0]:
                yield told()
                held, rows = [], 0
            own = slice(cuts[i], cuts[i + 1])
            order = np.argsort(fields["depth"][own])
            held.append((keys[i], conv, *(fields[c][own][order] for c in ("la", "lb", "n"))))
            rows += len(order)
    if held:
        yield told()


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, depth, first, ids: up to ``CHUNK`` ids of sorted rows (node, depth, conv_id) in one text."""
    at, ids = None, []

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"node": pa.array([at[0]], pa.int64()), "depth": pa.array([at[1]], pa.int64()), "first": pa.array([ids[0]], pa.int64()), "ids": [",".join(map(str, ids))]})

    for batch in batches:
        for node, depth, conv in zip(*(batch.column(c).to_pylist() for c in ("node", "depth", "conv_id")), strict=True):
            if ids and (at != (node, depth) or len(ids) == CHUNK):
                yield told()
                ids = []
            at = (node, depth)
            ids.append(conv)
    if ids:
        yield told()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, depth and the hash of all its chunks, which come in order, one node after the other."""
    at, state = None, None

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"node": pa.array([at[0]], pa.int64()), "depth": pa.array([at[1]], pa.int64()), "ends": [state.hexdigest()]})

    for batch in batches:
        for node, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("node", "depth", "ids")), strict=True):
            if at != (node, depth):
                if state:
                    yield told()
                at, state = (node, depth), hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
    if state:
        yield told()


def ends_hashes(ends: DataFrame) -> DataFrame:
    """node, depth, ends: the hash of the ids of ``ends`` (node, depth, conv_id), in order."""
    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ("node", "depth", "conv_id")
    chunks = ends.select(*keys).repartitionByRange(n, *keys).sortWithinPartitions(*keys).mapInArrow(_chunks, "node long, depth long, first long, ids string")
    return chunks.repartition(n, "node", "depth").sortWithinPartitions("node", "depth", "first").select("node", "depth", "ids").mapInArrow(_hashed, "node long, depth long, ends string")


def rolled_up(upper: DataFrame, deepest: int, stage: Staging) -> DataFrame:
    """conv_id, depth, n_leaves, saved_tokens of ``upper`` (also parent) with all upper nodes below: after a step each node has what hangs within twice the distance."""
    t, step = upper.select("conv_id", "depth", F.col("parent_conv_id").alias("up"), "n_leaves", "saved_tokens"), 1
    while step <= deepest:
        more = t.filter("up is not null").groupBy(F.col("up").alias("conv_id"), (F.col("depth") - step).alias("depth")).agg(F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
        hop = t.select(F.col("conv_id").alias("up"), (F.col("depth") + step).alias("depth"), F.col("up").alias("over"))
        t = t.join(more, ["conv_id", "depth"], "left").join(hop, ["up", "depth"], "left")
        t = stage(t.select("conv_id", "depth", F.col("over").alias("up"), (F.col("n_leaves") + F.coalesce("l", F.lit(0))).alias("n_leaves"), (F.col("saved_tokens") + F.coalesce("s", F.lit(0))).alias("saved_tokens")), "rolled")
        step *= 2
    return t.select("conv_id", "depth", "n_leaves", "saved_tokens")


def trie(conversations: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every node."""
    stage = Staging(conversations.sparkSession, "trie")
    rows = rebuilt(conversations, stage)
    turns, node = rows.filter("not head"), ["depth", "a", "b"]
    none = F.lit(0).cast("long")
    measured = turns.groupBy(*node).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("n").alias("n"), F.max("pa").alias("pa"), F.max("pb").alias("pb"), F.sum(F.col("length") - F.col("depth") + 1).alias("below"))
    top = rows.filter("head").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).filter("n_convs > 0")
    top = top.select(none.alias("depth"), none.alias("a"), none.alias("b"), "n_convs", "conv_id", none.alias("n"), none.alias("pa"), none.alias("pb"))
    upper = stage(measured.filter(F.col("below") > heavy).drop("below").unionByName(top), "upper")
    count, deepest, root = upper.agg(F.count("*"), F.coalesce(F.max("depth"), none), F.min("conv_id")).first()  # the root has the least
    keys = keyed_broadcast(upper.select(*node, F.col("conv_id").alias("node")), count)

    paths = turns.join(keys, node, "left_anti").groupBy("conv_id").agg(F.min(F.struct(*node, "pa", "pb")).alias("f"), F.collect_list(F.struct("depth", "la", "lb", "n")).alias("path"))  # ``heavy`` turns at most
    n = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    paths = paths.select("conv_id", "f.*", "path").repartition(n, *node).sortWithinPartitions(*node)
    lower = stage(paths.mapInArrow(_tries, f"{NODE}, top boolean, pa long, pb long"), "lower")

    parents = keys.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("node").alias("parent"))
    lower = lower.join(parents, ["depth", "pa", "pb"], "left").withColumn("parent_conv_id", F.when(F.col("top"), F.col("parent")).otherwise(F.col("parent_conv_id")))
    hung = lower.filter("top").groupBy(F.col("parent").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("tops"), F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
    upper = upper.join(parents, ["depth", "pa", "pb"], "left").withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.col("parent")))
    heavier = upper.filter("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("more"))
    upper = upper.join(hung, ["conv_id", "depth"], "left").join(heavier, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("tops", none) + F.coalesce("more", none))
    upper = stage(upper.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.coalesce("l", none) + F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("n") + F.coalesce("s", none)).alias("saved_tokens")), "hung")

    last = turns.filter("depth = length").join(keys, node).select("node", "depth", "conv_id")
    turnless = rows.filter("head and length = 0").select(F.lit(root).cast("long").alias("node"), none.alias("depth"), "conv_id")
    hashes = ends_hashes(last.unionByName(turnless)).withColumnRenamed("node", "conv_id")
    found = upper.drop("n_leaves", "saved_tokens").join(rolled_up(upper, deepest, stage), ["conv_id", "depth"]).join(hashes, ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends", F.lit(NOTHING)))
    columns = [x.split()[0] for x in NODE.split(", ")]
    out = stage(found.select(*columns).unionByName(lower.select(*columns)), "nodes")
    stage.clear("nodes")
    return out
