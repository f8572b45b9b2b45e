"""Conversation prefix trie: Z-fast tries over dealt batches, merged by prefix hash.

A node is a distinct sequence of first turns; it is named by 128 bits, the exclusive-or of
hashes of (depth, role, text) of its turns.  Exclusive-or lets prefix names be continued
across tasks like prefix sums.  Texts are hashed where they are scanned; only narrow rows
move.

1. ``rank_turns`` sorts all turns by conversation and turn over all tasks; a conversation
   may span many of them.  Ranks are counted in each task and continued by what the tasks
   before hold (a row a task reaches the driver).
2. Each task holds a stretch of conversations in ascending order.  It inserts them in
   batches of about ``BATCH_TURNS`` turns into a Z-fast trie (``ZFastTrie``): compacted
   nodes are hashed by the name of their handle, the prefix at the two-fattest depth on
   their edge; a conversation's exit node is located by fat binary search, and its edge
   split.  Members are summed up the trie, and its edges expanded to one row a depth.
3. Rows of equal names are summed over all batches: each node's members, its smallest
   member (its owner) and the members' total length.
4. Subtree sums need no walk down: a conversation owns the nodes from some depth on, so
   all nodes below a node are shared out among its members.  A second round of tries adds
   up what each member owns.

With ``n`` members, ``sum (n - 1) * length`` over a subtree is the members' total length
from the node's depth on, less the length of the distinct nodes, which is what the members
own.  Leaves are counted alike.

Hot groups: sorting splits a conversation of any length, and rows given many times; sums
are partial before they move; a parent with very many children is joined by broadcast
(at most ``HOT_PARENTS``).  The hash of a node's members' ids is one stream by definition:
it is fed, in constant memory, blocks of ids that the batches have joined.

Defined results: rows without a conversation id are left out; a null role or text is
empty; turns of one number are ordered by the hashes of role and text, and a row given
twice is two turns; an empty table has no node, not even a root; extra columns are not
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casefile.llm.common import materialize, partitions

#: Turns inserted into one trie.
BATCH_TURNS = 200_000
#: Parents with very many children that are broadcast, at most.
HOT_PARENTS = 50_000
#: Children from which a parent may count as hot.
HOT_CHILDREN = 10_000

_TURN = "part int, conv_id long, depth long, m1 long, m2 long, chars long"
_NODE = ("k1 long, k2 long, depth long, p1 long, p2 long, chars long, before long, owner long, owner_chars long, "
         "n long, sum_chars long, part int, batch long, ends string")
_SHARE = "k1 long, k2 long, owned_chars long, leaves long"


def fattest(low: int, high: int) -> int:
    """The number in (low, high] with most trailing zero bits."""
    return high & (-1 << ((low ^ high).bit_length() - 1))


class ZFastTrie:
    """A compacted trie of sequences given as rows of prefix names.

    ``names[row]`` names a prefix; a sequence is an offset to which its depths are added.  ``base`` is the
    depth of the root, which is node 0.  Sequences are inserted in ascending order of their owners' ids, so that a
    node's first sequence, ``at``, is that of its smallest member.
    """

    def __init__(self, names: list, base: int, at: int):
        self.names = names
        self.extent, self.parent, self.at = [base], [-1], [at]
        self.handles: dict = {}
        self.edges: dict = {}

    def _handle(self, node: int):
        return self.names[self.at[node] + fattest(self.extent[self.parent[node]], self.extent[node])]

    def _add(self, parent: int, extent: int, at: int) -> int:
        node = len(self.extent)
        self.extent.append(extent)
        self.parent.append(parent)
        self.at.append(at)
        self.handles[self._handle(node)] = node
        self.edges[self.names[at + self.extent[parent] + 1]] = node
        return node

    def locate(self, at: int, length: int) -> tuple[int, int | None]:
        """Fat binary search: the deepest node that is a prefix, and the child on whose edge the sequence leaves, if any."""
        names, extent = self.names, self.extent
        node, low, high = 0, extent[0], length
        while low < high:
            middle = fattest(low, high)
            found = self.handles.get(names[at + middle])
            if found is None:
                high = middle - 1
                continue
            deep = extent[found]
            if deep > length or names[at + deep] != names[self.at[found] + deep]:
                return self.parent[found], found
            node, low = found, deep
        return node, self.edges.get(names[at + extent[node] + 1]) if extent[node] < length else None

    def insert(self, at: int, length: int) -> int:
        """Add the sequence down to depth ``length``; returns its last node."""
        node, child = self.locate(at, length)
        if child is not None:
            names, other = self.names, self.at[child]
            low, high = self.extent[node] + 1, min(self.extent[child], length)
            while low < high:  # the last depth at which both agree
                middle = (low + high + 1) // 2
                if names[at + middle] == names[other + middle]:
                    low = middle
                else:
                    high = middle - 1
            if low == self.extent[child]:  # cannot be: ``locate`` would have gone on
                raise AssertionError("two prefixes of one name at different nodes")
            old = self._handle(child)
            split = len(self.extent)
            del self.handles[old]
            self.extent.append(low)
            self.parent.append(node)
            self.at.append(other)
            self.parent[child] = split
            self.handles[self._handle(child)] = child
            self.handles[self._handle(split)] = split
            self.edges[names[other + self.extent[node] + 1]] = split
            self.edges[names[other + low + 1]] = child
            node = split
        return node if self.extent[node] == length else self._add(node, length, at)

    def sums(self, *columns: dict[int, int]) -> list[np.ndarray]:
        """Each column's values, given by node, summed over subtrees."""
        out = [np.zeros(len(self.extent), np.int64) for _ in columns]
        for total, given in zip(out, columns):
            total[list(given)] = list(given.values())
        for node in np.argsort(np.array(self.extent), kind="stable")[::-1].tolist():
            if self.parent[node] >= 0:
                for total in out:
                    total[self.parent[node]] += total[node]
        return out

    def expanded(self, root: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, node, whether it is the node's last depth) for each depth on each edge, and for the root if asked."""
        extent, parent, at = np.array(self.extent), np.array(self.parent), np.array(self.at)
        first = np.where(parent >= 0, extent[parent] + 1, extent)
        many = extent - first + 1
        if not root:
            many[0] = 0
        node = np.repeat(np.arange(len(extent)), many)
        depth = first[node] + np.arange(len(node)) - np.repeat(np.cumsum(many) - many, many)
        return at[node] + depth, node, depth == extent[node]


class _Batch:
    """Dealt rows of a stretch of conversations, sorted by conversation and depth, as arrays.

    ``carries`` has, by (part, conversation) of those that span parts: the name and length before this part,
    the whole length, and whether the conversation ends here.
    """

    def __init__(self, part: int, columns: dict[str, np.ndarray], carries: dict):
        control = columns["depth"] < 0
        self.control = {c: (int(d), int(w), int(leaf)) for c, d, w, leaf in zip(
            *(columns[n][control].tolist() for n in ("conv_id", "chars", "m1", "m2")))}
        conv, depth, m1, m2, chars = (columns[n][~control] for n in ("conv_id", "depth", "m1", "m2", "chars"))
        start = np.flatnonzero(np.diff(conv, prepend=conv[:1] - 1)) if len(conv) else np.zeros(0, np.int64)
        size = np.diff(start, append=len(conv))
        self.conv, self.depth, self.m1, self.m2, self.chars = conv, depth, m1, m2, chars
        self.ids, self.start, self.stop = conv[start].tolist(), start.tolist(), (start + size).tolist()
        found = [carries.get((part, c)) for c in self.ids]

        def running(values, add, carried):
            """Values combined from each conversation's beginning on."""
            whole = add.accumulate(values) if len(values) else values
            before = np.concatenate([np.zeros(1, np.int64), whole])[start]
            carry = np.array(carried, np.int64)
            return (whole ^ np.repeat(before ^ carry, size)) if add is np.bitwise_xor \
                else whole + np.repeat(carry - before, size)

        self.k1 = running(m1, np.bitwise_xor, [f[0] if f else 0 for f in found])
        self.k2 = running(m2, np.bitwise_xor, [f[1] if f else 0 for f in found])
        through = running(chars, np.add, [f[2] if f else 0 for f in found])
        self.before = through - chars
        self.total = [f[3] if f else int(through[e - 1]) for f, e in zip(found, self.stop)]
        self.ends = [f[4] if f else True for f in found]
        self.total_of = np.repeat(np.array(self.total, np.int64), size)
        self.names = list(zip(self.k1.tolist(), self.k2.tolist()))

    def tries(self) -> Iterator[tuple[ZFastTrie, list[int]]]:
        """The conversations by the depth at which their rows begin: all whole ones in one trie."""
        groups: dict[int, list[int]] = {}
        for n, s in enumerate(self.start):
            groups.setdefault(max(int(self.depth[s]) - 1, 0), []).append(n)
        for base, members in groups.items():
            first = self.start[members[0]]
            yield ZFastTrie(self.names, base, first - int(self.depth[first])), members

    def offset(self, n: int) -> int:
        return self.start[n] - int(self.depth[self.start[n]])

    def deepest(self, n: int) -> int:
        return int(self.depth[self.stop[n] - 1])


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])


def _nodes(batch: _Batch, part: int, number: int) -> Iterator[pa.RecordBatch]:
    """Insert a batch, sum members up, expand edges."""
    for trie, members in batch.tries():
        last = {n: trie.insert(batch.offset(n), batch.deepest(n)) for n in members}
        count, length, ended = {}, {}, {}
        for n, node in last.items():
            count[node] = count.get(node, 0) + 1
            length[node] = length.get(node, 0) + batch.total[n]
            if batch.ends[n]:
                ended.setdefault(node, []).append(str(batch.ids[n]))
        n_members, sum_chars = trie.sums(count, length)
        first = batch.start[members[0]]
        row, node, is_last = trie.expanded(root=batch.depth[first] == 0)
        blocks = [",".join(ended[x]) if x in ended and e else None for x, e in zip(node.tolist(), is_last.tolist())]
        top = batch.depth[row] == 0
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (batch.k1[row], batch.k2[row], batch.depth[row])]
            + [pa.array(k[row] ^ m[row], mask=top) for k, m in ((batch.k1, batch.m1), (batch.k2, batch.m2))]
            + [pa.array(x) for x in (batch.chars[row], batch.before[row], batch.conv[row], batch.total_of[row],
                                     n_members[node], sum_chars[node], np.full(len(row), part, np.int32),
                                     np.full(len(row), number, np.int64))] + [pa.array(blocks, pa.string())],
            schema=_arrow(_NODE))


def _shares(batch: _Batch, part: int, number: int) -> Iterator[pa.RecordBatch]:
    """What each node's members own at or below it.

    A conversation with control values (depth from which it owns nodes, their length, whether it ends in a
    leaf) gives them to all nodes above, and to each own node what it owns from there on.
    """
    known = [batch.control.get(c) for c in batch.ids]
    keep = np.zeros(len(batch.conv), bool)
    leaf = np.zeros(len(batch.conv), np.int64)
    for n, control in enumerate(known):
        if control:
            low = max(batch.start[n], batch.offset(n) + control[0])
            keep[low:batch.stop[n]] = True
            leaf[low:batch.stop[n]] = control[2]
    own = np.flatnonzero(keep)
    yield pa.RecordBatch.from_arrays(
        [pa.array(x) for x in (batch.k1[own], batch.k2[own], (batch.total_of - batch.before)[own], leaf[own])],
        schema=_arrow(_SHARE))
    for trie, members in batch.tries():
        chars, leaves = {}, {}
        for n in members:
            if known[n] and known[n][0] > batch.depth[batch.start[n]]:
                node = trie.insert(batch.offset(n), min(known[n][0] - 1, batch.deepest(n)))
                chars[node] = chars.get(node, 0) + known[n][1]
                leaves[node] = leaves.get(node, 0) + known[n][2]
        if chars:
            owned, many = trie.sums(chars, leaves)
            row, node, _ = trie.expanded(root=batch.depth[batch.start[members[0]]] == 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (batch.k1[row], batch.k2[row], owned[node], many[node])], schema=_arrow(_SHARE))


def _in_batches(rows: DataFrame, parts: int, carries: dict, make, ddl: str) -> DataFrame:
    """Give each part's rows, sorted, to ``make`` in batches that do not cut a conversation."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, part, number = [], 0, None, 0

        def cut(columns, upto):
            return {n: c[:upto] for n, c in columns.items()}, {n: c[upto:] for n, c in columns.items()}

        def joined():
            return {f.name: np.concatenate([b[f.name] for b in held]) for f in _arrow(_TURN)}

        for batch in batches:
            held.append({n: c.to_numpy() for n, c in zip(batch.schema.names, batch.columns)})
            count += batch.num_rows
            if count < BATCH_TURNS:
                continue
            columns = joined()
            last = np.flatnonzero((columns["conv_id"] != columns["conv_id"][-1]) | (columns["part"] != columns["part"][-1]))
            ready, rest = cut(columns, last[-1] + 1 if len(last) else 0)
            for part, piece in _by_part(ready):
                yield from make(_Batch(part, piece, carries), part, number)
                number += 1
            held, count = [rest], len(rest["part"])
        if held:
            for part, piece in _by_part(joined()):
                yield from make(_Batch(part, piece, carries), part, number)
                number += 1

    dealt = rows.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "conv_id", "depth")
    return dealt.mapInArrow(run, ddl)


def _by_part(columns: dict[str, np.ndarray]):
    edges = np.flatnonzero(np.diff(columns["part"])) + 1
    size = len(columns["part"])
    for low, high in zip([0, *edges], [*edges, size] if size else []):
        yield int(columns["part"][low]), {n: c[low:high] for n, c in columns.items()}


def rank_turns(conversations: DataFrame, block: int = 100) -> tuple[DataFrame, list[int]]:
    """Number each conversation's turns, however many tasks they span.

    Returns (part, conv_id, rank, block_turns, a, b, chars) and the conversations that span parts.
    ``block_turns`` counts the turns, so far, of the conversation that begins the row's block of ids.
    """
    spark = conversations.sparkSession
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    narrow = materialize(conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit(1), text, role).alias("b"),
        F.char_length(text).cast("long").alias("chars")), "turns")
    order = ["conv_id", "turn", "a", "b", "row"]
    dealt = (narrow.withColumn("row", F.monotonically_increasing_id())  # deals out equal rows, too
             .repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
             .select("conv_id", "a", "b", "chars"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        conv, seen, opened, begun = None, 0, None, 0  # of the last row: its id and rank; its block and what began it
        for batch in batches:
            ids = batch.column("conv_id").to_numpy()
            if not len(ids):
                continue
            at = np.arange(len(ids))
            fresh = np.diff(ids, prepend=ids[0] - 1) != 0
            fresh[0] = ids[0] != conv
            local = at - np.maximum.accumulate(np.where(fresh, at, 0))
            local[:int(np.argmax(fresh)) if fresh.any() else len(ids)] += 0 if conv is None else seen + 1
            blocks = ids - ids % block
            first = blocks == ids
            new = np.diff(blocks, prepend=blocks[0] - 1) != 0
            new[0] = blocks[0] != opened
            counted = np.cumsum(first)
            turns = counted - np.maximum.accumulate(np.where(new, counted - first, 0))
            turns[:int(np.argmax(new)) if new.any() else len(ids)] += begun
            conv, seen, opened, begun = int(ids[-1]), int(local[-1]), int(blocks[-1]), int(turns[-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), part, np.int32)), batch.column("conv_id"), pa.array(local),
                 pa.array(turns.astype(np.int64)), *(batch.column(n) for n in ("a", "b", "chars"))], schema=arrow)

    ddl = "part int, conv_id long, rank long, block_turns long, a long, b long, chars long"
    arrow = _arrow(ddl)
    ranked = materialize(dealt.mapInArrow(number, ddl), "ranked-turns")
    edge = F.struct("conv_id", "rank")
    stats = sorted(ranked.groupBy("part").agg(  # one row a part
        F.min("conv_id").alias("first"), F.max(edge).alias("last"),
        F.max_by("block_turns", edge).alias("turns")).collect())
    carried, spanning, before = [], [], None
    for s in stats:
        rank = turns = 0
        if before is not None:
            last, its_rank, its_turns = before
            if s.first == last:
                rank = its_rank + 1
                spanning.append(s.first)
            if s.first - s.first % block == last - last % block:
                turns = its_turns
        carried.append((s.part, s.first, rank, turns))
        same = s.first == s.last.conv_id
        same_block = s.first - s.first % block == s.last.conv_id - s.last.conv_id % block
        before = (s.last.conv_id, s.last["rank"] + (rank if same else 0), s.turns + (turns if same_block else 0))
    table = spark.createDataFrame(carried, "part int, first long, rank_before long, turns_before long")
    joined = ranked.join(F.broadcast(table), "part")  # one row a part
    in_block = F.col("conv_id") - F.pmod("conv_id", F.lit(block)) == F.col("first") - F.pmod("first", F.lit(block))
    return joined.select(
        "part", "conv_id", (F.col("rank") + F.when(F.col("conv_id") == F.col("first"), F.col("rank_before")).otherwise(0)).alias("rank"),
        (F.col("block_turns") + F.when(in_block, F.col("turns_before")).otherwise(0)).alias("block_turns"),
        "a", "b", "chars"), sorted(set(spanning))


def id_hash(conv_id: Column, below: int) -> Column:
    """The CRC-32 of the decimal id, modulo ``below``."""
    return F.crc32(conv_id.cast("string").cast("binary")) % below


def dealt_turns(conversations: DataFrame, heads: int = 0, block: int = 100) -> tuple[DataFrame, list[int]]:
    """(part, conv_id, depth, m1, m2, chars): each turn at its depth, and a row of depth 0 for each conversation.

    With ``heads``, a conversation begins with the first h turns of that which begins its block of ids, in
    place of its own first h; h is ``id_hash`` below ``heads``.  Without, conversations stay as they are.
    """
    ranked, spanning = rank_turns(conversations, block)
    h = id_hash(F.col("conv_id"), heads) if heads else F.lit(0)
    opener = F.col("conv_id") - F.pmod("conv_id", F.lit(block))
    leads = F.col("conv_id") == opener
    kept = ranked.where(leads | (F.col("rank") >= h))
    depth = F.when(leads, F.col("rank")).otherwise(F.least(h, F.col("block_turns")) + F.col("rank") - h) + 1
    value = [F.xxhash64("depth", "a", "b").alias("m1"), F.xxhash64(F.lit(2), "b", "a", "depth").alias("m2")]
    turns = kept.select("part", "conv_id", depth.alias("depth"), "a", "b", "chars").select(
        "part", "conv_id", "depth", *value, "chars")
    firsts = ranked.where("rank = 0").select("part", "conv_id")
    zero = F.lit(0).cast("long")
    rows = turns.unionByName(firsts.select("part", "conv_id", zero.alias("depth"), zero.alias("m1"), zero.alias("m2"),
                                           zero.alias("chars")))
    if heads:
        shared = ranked.where(leads & (F.col("rank") < heads)).select(
            F.col("conv_id").alias("opener"), (F.col("rank") + 1).alias("depth"), "a", "b", "chars")
        begun = firsts.withColumn("opener", opener).where(~leads).join(shared, "opener")
        rows = rows.unionByName(begun.where(F.col("depth") <= h).select("part", "conv_id", "depth", *value, "chars"))
    return materialize(rows, "dealt-turns"), spanning


def _carries(rows: DataFrame, spanning: list[int]) -> dict:
    """What the parts of the conversations that span several must know of the others; a row a part."""
    if not spanning:
        return {}
    spark = rows.sparkSession
    few = F.broadcast(spark.createDataFrame([(c,) for c in spanning], "conv_id long"))
    pieces = sorted(rows.join(few, "conv_id").groupBy("conv_id", "part").agg(
        F.bit_xor("m1").alias("m1"), F.bit_xor("m2").alias("m2"), F.sum("chars").alias("chars")).collect())
    out, name = {}, (None, 0, 0, 0)
    total, last = {}, {}
    for p in pieces:
        total[p.conv_id] = total.get(p.conv_id, 0) + p.chars
        last[p.conv_id] = p.part
    for p in pieces:
        conv, x1, x2, chars = name if name[0] == p.conv_id else (p.conv_id, 0, 0, 0)
        out[(p.part, conv)] = (x1, x2, chars, total[conv], last[conv] == p.part)
        name = (conv, x1 ^ p.m1, x2 ^ p.m2, chars + p.chars)
    return out


def _ends_hash(blocks: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256): SHA-256 of the blocks of ids joined by commas, in order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None

        def row():
            return pa.RecordBatch.from_pylist([{"k1": node[0], "k2": node[1], "ends_sha256": state.hexdigest()}], arrow)

        for batch in batches:
            done = []
            for k1, k2, ids in zip(*(batch.column(n).to_pylist() for n in ("k1", "k2", "ends"))):
                if (k1, k2) == node:
                    state.update(b",")
                else:
                    if node:
                        done.append(row())
                    node, state = (k1, k2), hashlib.sha256()
                state.update(ids.encode())
            yield from done
        if node:
            yield row()

    arrow = _arrow("k1 long, k2 long, ends_sha256 string")
    dealt = blocks.repartition(partitions(blocks.sparkSession), "k1", "k2").sortWithinPartitions("k1", "k2", "part", "batch")
    return dealt.select("k1", "k2", "ends").mapInArrow(run, "k1 long, k2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, heads: int = 0, block: int = 100) -> DataFrame:
    """Return (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), a row a node.

    ``conversations`` has conv_id, turn, role and text; ``heads`` and ``block`` as in ``dealt_turns``.
    """
    parts = partitions(conversations.sparkSession)
    rows, spanning = dealt_turns(conversations, heads, block)
    carries = _carries(rows, spanning)
    local = materialize(_in_batches(rows, parts, carries, _nodes, _NODE), "local-nodes")
    merged = materialize(local.groupBy("k1", "k2", "depth", "p1", "p2", "chars", "before").agg(
        F.min(F.struct("owner", "owner_chars")).alias("own"), F.sum("n").alias("n"),
        F.sum("sum_chars").alias("sum_chars")).select("*", "own.*").drop("own"), "nodes")
    children = merged.where("p1 is not null").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(
        F.count("*").alias("n_children"))
    nodes = materialize(merged.join(children, ["k1", "k2"], "left").fillna(0, ["n_children"]), "nodes-with-children")

    owners = nodes.groupBy(F.col("owner").alias("conv_id")).agg(
        F.min("depth").alias("chars"), (F.max("owner_chars") - F.min("before")).alias("m1"),
        F.max((F.col("n_children") == 0).cast("long")).alias("m2"))
    control = rows.select("part", "conv_id").distinct().join(owners, "conv_id").select(
        "part", "conv_id", F.lit(-1).cast("long").alias("depth"), "m1", "m2", "chars")
    shares = _in_batches(rows.unionByName(control), parts, carries, _shares, _SHARE).groupBy("k1", "k2").agg(
        F.sum("owned_chars").alias("owned_chars"), F.sum("leaves").alias("n_leaves"))
    ends = _ends_hash(local.where("ends is not null").select("k1", "k2", "part", "batch", "ends"))
    full = materialize(nodes.join(shares, ["k1", "k2"]).join(ends, ["k1", "k2"], "left"), "trie")

    parents = full.where("n_children > 0").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), "n_children",
                                                  F.col("owner").alias("parent_conv_id"))
    # fewer than HOT_PARENTS parents can have more children than this
    hot_from = max(HOT_CHILDREN, full.count() // HOT_PARENTS)
    hot = F.broadcast(parents.where(F.col("n_children") > hot_from).drop("n_children"))
    cold = parents.where(F.col("n_children") <= hot_from).drop("n_children")
    below_hot = full.join(hot, ["p1", "p2"])
    others = full.join(hot, ["p1", "p2"], "left_anti").join(cold, ["p1", "p2"], "left")
    saved = F.col("sum_chars") - F.col("n") * F.col("before") - F.col("owned_chars")
    return below_hot.unionByName(others).select(
        F.col("owner").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves",
        saved.alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"))
