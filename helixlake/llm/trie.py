"""Prefix trie of conversations in ternary search trees (operator 11).

A conversation becomes one row: the digests of its turns (16 bytes each), one after another, and their word
counts. These paths are range-partitioned together with the conversation id, so a range shard holds
neighbours of the trie and a path that many conversations share spreads over many shards. A shard is
taken in pieces of CODES turns at most. In each piece the digests are dictionary-encoded by rank and its distinct
paths go into a ternary search tree, the median first, which keeps the trees of siblings balanced; an iterative
traversal adds up members, children, leaves and savings.

Only nodes on the first or last path of a piece can have members in another piece. These boundary nodes carry a
chained digest of their path; their parts are added up by it, and the sums over subtrees follow by
doubling the reach of parent pointers. Ids of conversations that end at a boundary node stand in blocks,
in order, and are hashed one block after another, never gathered.

Edge cases: turns stand in the order of turn (null first), then role, then text, so repeated rows are turns
of their own; null roles and texts are empty; rows without conv_id belong to no conversation; a
conversation without turns is a member of the root; an empty table gives no nodes; other columns are
ignored. Of a long text only the digest moves; a conversation's digests are one row, and a longer one is a piece by itself.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixlake.llm import kernel as K
from helixlake.llm.shared import saved, table

#: Turns in one piece of a shard at most, but for a single longer conversation.
CODES = 60_000
#: Conversations whose ids differ by less share the beginnings of the first; SHARED is the number of beginnings that occur.
BLOCK, SHARED = 20, 4
ROOT_KEY, NOTHING = bytes(16), hashlib.sha256(b"").hexdigest()
NODE = "shard long, key binary, parent_key binary, parent long, conv_id long, depth long, n long, children long, leaves long, saved long, words long, first_end long, ends string"


def turns_of(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, tie, digest, words) of rows(conv_id, turn, role, text); tie orders rows of one turn by role and text."""
    said = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    said = said.where("conv_id is not null")
    digest = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    out = said.withColumn("digest", digest)
    tied = said.groupBy("conv_id", "turn").agg(F.count("*").alias("m")).where("m > 1").select(F.col("conv_id").alias("tc"), F.col("turn").alias("tt"))
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("int").alias("words")
    if tied.isEmpty():
        return out.select("conv_id", "turn", F.lit(0).alias("tie"), "digest", words)
    at = (F.col("conv_id") == F.col("tc")) & F.col("turn").eqNullSafe(F.col("tt"))
    both = out.join(tied, at, "left").withColumn("alone", F.col("tc").isNull())
    rank = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    some = both.where("not alone").select("conv_id", "turn", rank.alias("tie"), "digest", words)
    return both.where("alone").select("conv_id", "turn", F.lit(0).alias("tie"), "digest", words).union(some)


def rebuilt(rows: DataFrame) -> DataFrame:
    """(path, conv_id, words): each conversation behind the beginning that it shares with others of its block."""
    turns = turns_of(rows).withColumn("base", F.col("conv_id") - F.col("conv_id") % BLOCK).repartition("base")
    packed = F.sort_array(F.collect_list(F.struct(F.col("turn").isNotNull().alias("known"), "turn", "tie", F.hex("digest").alias("d"), "words")))
    own = turns.groupBy("base", "conv_id").agg(F.transform(packed, lambda t: F.struct(t["d"].alias("d"), t["words"].alias("words"))).alias("own"))
    heads = own.where("conv_id = base").select("base", F.slice("own", 1, SHARED - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED).cast("int")
    both = own.join(heads, "base", "left").withColumn("h", h)
    empty = F.slice("own", 1, 0)
    now = F.concat(F.slice(F.coalesce("head", empty), F.lit(1), F.col("h")), F.slice("own", F.col("h") + 1, F.greatest(F.size("own") - F.col("h"), F.lit(0))))
    both = both.select("conv_id", now.alias("now"))
    return both.select(F.unhex(F.array_join("now.d", "")).alias("path"), "conv_id", F.col("now.words").alias("words"))


class SearchTree:
    """A ternary search tree: siblings are a binary search tree by code (lo, hi), eq leads to the children. Node 0 is the root of the trie."""

    def __init__(self) -> None:
        self.code, self.lo, self.eq, self.hi = [-1], [-1], [-1], [-1]
        self.members, self.first, self.words, self.ends = [0], [None], [0], [None]

    def _new(self, code: int, words: int) -> int:
        for x, v in ((self.code, code), (self.lo, -1), (self.eq, -1), (self.hi, -1), (self.members, 0), (self.first, None), (self.words, words), (self.ends, None)):
            x.append(v)
        return len(self.code) - 1

    def child(self, node: int, code: int, words: int | None = None) -> int:
        """The child of a trie node by code; made where it is missing if words are given, else -1."""
        at, links = node, self.eq
        while (next_ := links[at]) >= 0:
            at = next_
            if code == self.code[at]:
                return at
            links = self.lo if code < self.code[at] else self.hi
        if words is None:
            return -1
        links[at] = self._new(code, words)
        return links[at]

    def insert(self, codes: list[int], words: list[int], ids: list[int]) -> None:
        """One distinct path with the ascending ids of the conversations that are it."""
        node, m, low = 0, len(ids), ids[0]
        for k in range(len(codes) + 1):
            self.members[node] += m
            if self.first[node] is None or low < self.first[node]:
                self.first[node] = low
            if k < len(codes):
                node = self.child(node, codes[k], words[k])
        self.ends[node] = ids

    def traversal(self) -> list[tuple[int, int, int]]:
        """(node, parent, depth), each node after its parent."""
        out, stack = [(0, -1, 0)], [(self.eq[0], 0, 1)]
        while stack:
            node, parent, depth = stack.pop()
            if node >= 0:
                out.append((node, parent, depth))
                stack += ((self.lo[node], parent, depth), (self.hi[node], parent, depth), (self.eq[node], node, depth + 1))
        return out


def balanced(tree: SearchTree, paths: list[tuple[list[int], list[int], list[int]]]) -> None:
    """Inserts ascending paths, the median of each stretch before those on either side."""
    stack = [(0, len(paths))]
    while stack:
        a, b = stack.pop()
        if a < b:
            mid = (a + b) // 2
            tree.insert(*paths[mid])
            stack += ((a, mid), (mid + 1, b))


def piece_nodes(shard: int, digests: np.ndarray, counts: np.ndarray, words: np.ndarray, ids: list[int]) -> pa.RecordBatch:
    """The nodes of one piece: rows in ascending order of path and id; digests has 16 bytes a turn, counts the turns of each row."""
    halves = digests.view(">u8").reshape(-1, 2).astype(np.uint64)
    order = np.lexsort((halves[:, 1], halves[:, 0]))
    new = np.zeros(len(order), dtype=np.int64)
    new[1:] = (halves[order[1:]] != halves[order[:-1]]).any(axis=1)
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.cumsum(new)
    ends = np.cumsum(counts)
    codes, sizes = rank.tolist(), words.tolist()
    paths: list[tuple[list[int], list[int], list[int]]] = []
    for i, e in enumerate(ends.tolist()):
        path = codes[e - int(counts[i]) : e]
        if paths and paths[-1][0] == path:
            paths[-1][2].append(ids[i])
        else:
            paths.append((path, sizes[e - int(counts[i]) : e], [ids[i]]))
    tree = SearchTree()
    balanced(tree, paths)
    keys = {0: ROOT_KEY}
    raw = digests.tobytes()
    for i in (0, len(ids) - 1):
        node, key, at = 0, ROOT_KEY, int(ends[i] - counts[i])
        for k in range(at, at + int(counts[i])):
            node, key = tree.child(node, codes[k]), hashlib.md5(key + raw[16 * k : 16 * k + 16], usedforsecurity=False).digest()
            keys[node] = key
    seen = tree.traversal()
    n = len(tree.code)
    children, leaves, saving = [0] * n, [0] * n, [0] * n
    cols: dict[str, list] = {x.split()[0]: [] for x in NODE.split(", ")}
    for node, parent, depth in reversed(seen):
        edge, last = node in keys, tree.ends[node]
        if not edge:
            leaves[node] += not children[node]
            saving[node] += (tree.members[node] - 1) * tree.words[node]
            children[parent] += 1
            leaves[parent] += leaves[node]
            saving[parent] += saving[node]
        text = None if last is None else ",".join(map(str, last))
        row = (
            shard, keys.get(node), keys.get(parent), None if parent in keys or parent < 0 else tree.first[parent], tree.first[node], depth, tree.members[node], children[node], leaves[node], saving[node], tree.words[node],
            last[0] if last and edge else None, text if edge else hashlib.sha256((text or "").encode()).hexdigest(),
        )
        for c, v in zip(cols.values(), row):
            c.append(v)
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    return pa.RecordBatch.from_pydict({x.split()[0]: pa.array(cols[x.split()[0]], kinds[x.split()[1]]) for x in NODE.split(", ")})


def shard_nodes(batches, most: int):
    """Nodes of one range shard, a piece of at most that many turns at a time."""
    shard = TaskContext.get().partitionId() << 32
    for batch in batches:
        path = batch.column(0).cast(pa.large_binary())
        bounds = np.frombuffer(path.buffers()[1], dtype=np.int64)[path.offset : path.offset + len(path) + 1]
        data = path.buffers()[2]
        flat = np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
        bounds = (bounds - bounds[0]) // 16
        ids, words = batch.column(1).to_pylist(), np.asarray(batch.column(2).flatten())
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, side="right")) - 1)
            a, b = int(bounds[at]), int(bounds[to])
            yield piece_nodes(shard, np.ascontiguousarray(flat[16 * a : 16 * b]), np.diff(bounds[at : to + 1]), words[a:b], ids[at:to])
            shard, at = shard + 1, to
    K.release()


def joined_ends(blocks: DataFrame) -> DataFrame:
    """(key, digest) of blocks(key, first_end, ends): blocks of a key in order, comma-joined, hashed as they come."""

    def run(batches):
        key, state, keys, out = None, None, [], []
        for batch in batches:
            for k, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if k != key:
                    if state is not None:
                        keys.append(key)
                        out.append(state.hexdigest())
                    key, state = k, hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(out, pa.string())], ["key", "digest"])
            keys, out = [], []
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], ["key", "digest"])

    return blocks.select("key", "first_end", "ends").repartition("key").sortWithinPartitions("key", "first_end").mapInArrow(run, "key binary, digest string")


def subtree_sums(nodes: DataFrame, depth: int) -> DataFrame:
    """(key, leaves, saved) of nodes(key, parent_key, leaves, saved) with the values of all nodes below added: parent pointers reach 1, 2, 4, ... up."""
    now, reach = nodes.select("key", F.col("parent_key").alias("up"), "leaves", "saved"), 1
    while reach <= depth:
        below = now.where("up is not null").groupBy(F.col("up").alias("b_key")).agg(F.sum("leaves").alias("b_leaves"), F.sum("saved").alias("b_saved"))
        above = now.select(F.col("key").alias("a_key"), F.col("up").alias("a_up"))
        far = now.join(below, now.key == F.col("b_key"), "left").join(above, now.up == F.col("a_key"), "left")
        plus = lambda c: (F.col(c) + F.coalesce(f"b_{c}", F.lit(0))).alias(c)
        now, reach = saved(far.select("key", F.col("a_up").alias("up"), plus("leaves"), plus("saved")), "reach"), 2 * reach
    return now.drop("up")


def conversation_trie(rows: DataFrame, most: int = CODES) -> DataFrame:
    """A row for each node of the trie of rows(conv_id, turn, role, text); most: turns in a piece."""
    ranged = rebuilt(rows).repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    nodes = saved(ranged.mapInArrow(lambda batches: shard_nodes(batches, most), NODE), "nodes")
    edge = nodes.where("key is not null")
    parts = edge.groupBy("key").agg(F.first("parent_key").alias("parent_key"), F.first("depth").alias("depth"), F.first("words").alias("words"), F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")))
    parts = saved(parts, "edges")
    kids = parts.where("parent_key is not null").groupBy(F.col("parent_key").alias("k_key")).agg(F.count("*").alias("kids"))
    total = F.col("children") + F.coalesce("kids", F.lit(0))
    whole = parts.join(kids, parts.key == F.col("k_key"), "left").withColumn("children", total)
    whole = saved(whole.withColumn("leaves", F.col("leaves") + (total == 0).cast("long")).withColumn("saved", F.col("saved") + (F.col("n") - 1) * F.col("words")).drop("k_key", "kids"), "edges")
    sums = subtree_sums(whole, whole.agg(F.max("depth")).first()[0] or 0)
    above = parts.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    ends = joined_ends(edge.where("ends is not null"))
    out = ["conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256")]
    edges = whole.drop("leaves", "saved").join(sums, "key").join(above, "parent_key", "left").join(ends, "key", "left").withColumn("ends", F.coalesce("digest", F.lit(NOTHING))).select(*out)
    inner = nodes.where("key is null")
    own = edge.select("shard", "key").join(parts.select("key", F.col("conv_id").alias("parent_conv_id")), "key").withColumnRenamed("key", "parent_key")
    under = inner.where("parent_key is not null").join(own, ["shard", "parent_key"]).select(*out)
    return inner.where("parent_key is null").withColumn("parent_conv_id", F.col("parent")).select(*out).union(under).union(edges)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


#: DuckDB has no crc32: it is folded over the digits of the id.
_CRC = "xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, length(s) + 1), lambda i: ascii(s[i])::BIGINT), lambda a, x: list_reduce([xor(a, x)] || range(8), lambda b, i: xor(b >> 1, 3988292384 * (b & 1)))), 4294967295)"
OP11_SQL = rf"""
WITH t AS (SELECT CAST(conv_id AS BIGINT) AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
      row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
    FROM conversations WHERE conv_id IS NOT NULL),
  h AS (SELECT c, c - c % 20 AS base, {_CRC} % 4 AS h FROM (SELECT DISTINCT c, CAST(c AS VARCHAR) AS s FROM t)),
  r AS (SELECT h.c, t.pos, t.role, t.text FROM h JOIN t ON t.c = h.base AND t.pos <= h.h
    UNION ALL SELECT h.c, t.pos, t.role, t.text FROM h JOIN t ON t.c = h.c AND t.pos > h.h),
  n AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY pos) AS d, md5(length(role) || ':' || role || text) AS m,
      CAST(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS BIGINT) AS words FROM r),
  p AS (SELECT c, d, words, string_agg(m, '') OVER (PARTITION BY c ORDER BY d) AS k FROM n
    UNION ALL SELECT c, 0, 0, '' FROM h),
  ends AS (SELECT k, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM (SELECT c, arg_max(k, d) AS k FROM p GROUP BY c) GROUP BY k),
  node AS (SELECT k, min(c) AS c, any_value(d) AS d, any_value(words) AS words, count(*) AS m FROM p GROUP BY k),
  kids AS (SELECT substr(k, 1, length(k) - 32) AS pk, count(*) AS n FROM node WHERE d > 0 GROUP BY 1),
  leafy AS (SELECT node.*, coalesce(kids.n, 0) AS n_children FROM node LEFT JOIN kids ON kids.pk = node.k),
  sums AS (SELECT p.k, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((leafy.m - 1) * leafy.words) AS saved
    FROM leafy JOIN p ON p.c = leafy.c AND p.d <= leafy.d GROUP BY p.k)
SELECT leafy.c AS conv_id, CAST(leafy.d AS BIGINT) AS depth, up.c AS parent_conv_id, leafy.m AS n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM leafy JOIN sums ON sums.k = leafy.k LEFT JOIN ends ON ends.k = leafy.k
LEFT JOIN node AS up ON leafy.d > 0 AND up.k = substr(leafy.k, 1, length(leafy.k) - 32)
"""
