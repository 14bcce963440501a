"""The prefix trie of conversations, by ROLLUP over positional turn-id columns.

A turn's id is a digest of role and text (with the text's length behind it), so
texts leave the plan in the first map task. A conversation is cut into blocks of
``WIDTH`` turns, one row a block with the turn ids in positional columns t1 ...
and the node that the block before it ends in. One
``GROUP BY block, prior, ROLLUP(t1, ...)`` aggregates all prefixes of all blocks
together; ``grouping_id`` tells the depth in the block. Long conversations are
more rows, never longer ones, and take no further round: a node's key is the sum
of the hashes of its (position, turn) pairs, so a running sum over a
conversation's blocks is the key of every block's prior node.

What a subtree sums up is made additive over conversations, so ROLLUP can do it:

* Every node is owned by its smallest member. A conversation owns the nodes of
  its own path from some depth on; a first ROLLUP finds that depth, and whether
  the conversation's end is a leaf.
* Turns above that depth are saved: a subtree's saving is the sum of its
  members' saved turns below the node's parent.
* A subtree's leaves are its members that own a leaf.

A second ROLLUP sums these. All groups are aggregated before the shuffle, so a
first turn that a third of all conversations share is one row a task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

WIDTH = 8
_KEY = "decimal(38,0)"
_HALF = 1 << 60
#: Members of one node that are joined into one piece of text before they are digested.
PIECE = 4096


def _hash_half(hexs: Column, at: int) -> Column:
    return F.conv(F.substring(hexs, at, 15), 16, 10).cast("long")


def _turn_hash(position: Column, turn_id: Column) -> tuple[Column, Column]:
    """Two 60-bit numbers of a turn at its place (from 0)."""
    hexs = F.sha2(F.concat(position.cast("string"), F.lit(":"), F.hex(turn_id)), 256)
    return _hash_half(hexs, 1), _hash_half(hexs, 16)


def _key(a: Column, b: Column) -> Column:
    return (a.cast(_KEY) % _HALF * _HALF + b.cast(_KEY) % _HALF).cast(_KEY)


def turn_bytes(turn_id: Column) -> Column:
    """UTF-8 length of the turn's text."""
    return F.conv(F.hex(F.substring(turn_id, 17, 8)), 16, 10).cast("long")


def turn_id(role: str = "role", text: str = "text") -> Column:
    """16 bytes of SHA-256 over role and text, then the text's length in 8 bytes; null counts as empty."""
    r, t = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    size = F.octet_length(t)
    digest = F.sha2(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t), 256)
    return F.unhex(F.concat(F.substring(digest, 1, 32), F.lpad(F.hex(size.cast("long")), 16, "0")))


def ordered_turns(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                  text_col: str = "text") -> DataFrame:
    """(conv long, pos long from 0, tid binary): turns by ``turn_col``, null
    first, ties by the turn's id. Rows without a conversation id belong to none."""
    rows = turns.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), turn_id(role_col, text_col).alias("tid"))
    nth = F.row_number().over(Window.partitionBy("conv").orderBy("turn", "tid"))
    return written(rows.select("conv", (nth - 1).cast("long").alias("pos"), "tid"), "trie-turns")


def with_shared_heads(turns: DataFrame, group: int = 5, limit: int = 9) -> DataFrame:
    """Conversations rebuilt from ``turns`` (conv, pos, tid): each takes the first
    h turns of the first conversation of its ``group``, then its own from turn h
    on, with h = crc32(decimal id) % ``limit``. (conv, pos, tid); a conversation
    without a turn is one row with null pos and tid."""
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % limit).cast("int")
    donor = F.col("conv") - F.col("conv") % group
    heads = (turns.filter((F.col("conv") % group == 0) & (F.col("pos") < limit - 1)).groupBy("conv")
             .agg(F.sort_array(F.collect_list(F.struct("pos", "tid"))).alias("head")))  # limit - 1 turns at most
    convs = turns.groupBy("conv").agg(F.max("pos").alias("last")).withColumns({"h": h, "donor": donor})
    plans = (convs.join(heads.select(F.col("conv").alias("donor"), "head"), "donor", "left")
             .withColumn("head", F.slice(F.coalesce("head", F.array().cast("array<struct<pos: bigint, tid: binary>>")), F.lit(1), F.col("h"))))
    plans = written(plans.select("conv", "h", "head", "last"), "trie-heads")
    taken = plans.filter((F.size("head") > 0) | (F.col("last") < F.col("h"))).select("conv", F.explode_outer("head").alias("t"))
    own = (turns.join(plans.select("conv", "h", F.size("head").alias("n")), "conv").filter(F.col("pos") >= F.col("h"))
           .select("conv", (F.col("pos") - F.col("h") + F.col("n")).alias("pos"), "tid"))
    return taken.select("conv", "t.pos", "t.tid").unionByName(own)


def _blocks(turns: DataFrame, width: int) -> DataFrame:
    """(conv, len, block, prior_a, prior_b, prior_bytes, t1 ...): a row a block;
    a conversation without turns has one block without ids."""
    a, b = _turn_hash(F.col("pos"), F.col("tid"))
    block = F.coalesce(F.expr(f"pos div {width}"), F.lit(0)).cast("long")
    place = F.col("pos") % width
    rows = turns.groupBy("conv", block.alias("block")).agg(
        *[F.max(F.when(place == k, F.col("tid"))).alias(f"t{k + 1}") for k in range(width)], F.count("pos").alias("n"),
        F.coalesce(F.sum(a.cast(_KEY)), F.lit(0)).alias("a"), F.coalesce(F.sum(b.cast(_KEY)), F.lit(0)).alias("b"),
        F.coalesce(F.sum(turn_bytes(F.col("tid"))), F.lit(0)).alias("bytes"))
    whole = Window.partitionBy("conv")
    before = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a running sum
    prior = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    return rows.select("conv", F.sum("n").over(whole).alias("len"), "block", (prior("a") % _HALF).cast("long").alias("prior_a"),
                       (prior("b") % _HALF).cast("long").alias("prior_b"), prior("bytes").cast("long").alias("prior_bytes"),
                       *[f"t{k + 1}" for k in range(width)])


def _rollup(blocks: DataFrame, width: int, sums: str) -> DataFrame:
    """All prefixes of all blocks: (block, prior_a, prior_b, prior_bytes, t1 ..., step, <sums>);
    step is the depth inside the block."""
    ids = ", ".join(f"t{k + 1}" for k in range(width))
    # grouping_id has a bit for every column rolled up
    step = f"{width} - bit_count(grouping_id())"
    last = " ".join(f"WHEN {k} THEN t{k} IS NOT NULL" for k in range(1, width + 1))
    return blocks.sparkSession.sql(
        f"""SELECT * FROM (SELECT block, prior_a, prior_b, prior_bytes, {ids}, {step} AS step, {sums} FROM {{rows}}
            GROUP BY block, prior_a, prior_b, prior_bytes, ROLLUP({ids}))
            WHERE CASE step WHEN 0 THEN block = 0 {last} END""", rows=blocks)


def _path_key(width: int, steps: Column) -> Column:
    """The key of the node ``steps`` turns into the row's block."""
    hashes = [_turn_hash(F.col("block") * width + k, F.col(f"t{k + 1}")) for k in range(width)]
    half = lambda prior, i: sum((F.when(steps > k, hashes[k][i]).otherwise(0).cast(_KEY) for k in range(width)), F.col(prior).cast(_KEY))
    return _key(half("prior_a", 0), half("prior_b", 1))


def _path_bytes(width: int, steps: Column) -> Column:
    return sum((F.when(steps > k, turn_bytes(F.col(f"t{k + 1}"))).otherwise(0) for k in range(width)), F.lit(0).cast("long"))


@dataclass
class Trie:
    """``nodes``: key, depth, conv (smallest member), parent_conv (null for the
    root), n_convs, n_children, n_leaves, saved_bytes, turn_id (null for the root).
    ``ends``: key, conv of the node where each conversation ends."""
    nodes: DataFrame
    ends: DataFrame


def prefix_trie(turns: DataFrame, width: int = WIDTH) -> Trie:
    """The trie of conversations given as ``turns`` (conv long, pos long from 0
    without gaps, tid from :func:`turn_id`; null pos: no turn).

    saved_bytes is the text that a store of the subtree's nodes spares: members
    less one, times the node's text. An empty table gives empty tables.
    """
    depth = (F.col("block") * width + F.col("step")).alias("depth")
    blocks = written(_blocks(turns, width), "trie-blocks")
    first = _rollup(blocks, width, "min(conv) AS owner, max(len) AS longest, count(*) AS n_convs")
    first = written(first.select(_path_key(width, F.col("step")).alias("key"), depth, "owner", "longest", "n_convs"), "trie-first")
    owners = written(first.groupBy(F.col("owner").alias("conv")).agg(F.min("depth").alias("since"),
                                                                    F.max(F.col("longest") == F.col("depth")).alias("leaf")), "trie-owners")

    # where a conversation's own nodes begin: it owns none of the nodes above
    blocks = blocks.join(owners, "conv", "left").withColumn("own", F.coalesce("since", F.col("len") + 1))
    above = F.least(F.greatest(F.col("own") - 1 - F.col("block") * width, F.lit(0)), F.lit(width))
    start = (F.col("own") >= 1) & (F.col("own") <= F.col("len")) & (F.expr(f"(own - 1) div {width}") == F.col("block"))
    branches = written(blocks.filter(start).select("conv", _path_key(width, above).alias("parent")), "trie-branches")
    counts = written(branches.groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("branches")), "trie-counts")
    n_last = F.col("len") - F.col("block") * width
    ends = written(blocks.filter((n_last <= width) & ((n_last > 0) | (F.col("len") == 0)))
                   .select(_path_key(width, n_last).alias("key"), "conv"), "trie-ends")

    # what each conversation adds to the nodes it is a member of
    shared = (blocks.groupBy("conv").agg(F.sum(_path_bytes(width, above)).alias("saved"),
                                         F.max(F.coalesce("leaf", F.lit(False)).cast("long")).alias("leaves"))
              .join(_parents(branches, counts, first.filter("n_convs > 1")), "conv", "left"))
    rows = blocks.drop("since", "leaf").join(shared, "conv")
    nodes = _rollup(rows, width, "min(struct(conv, own, len, saved, adopter)) AS least, count(*) AS n_convs, sum(saved) AS saved, "
                                 "sum(leaves) AS n_leaves")
    spared = F.col("saved") - F.col("least.saved")
    path = F.col("prior_bytes") + _path_bytes(width, F.col("step") - 1)  # bytes above the node
    parent = F.when(F.col("least.own") < F.col("depth"), F.col("least.conv")).otherwise(F.col("least.adopter"))
    ids = F.array(*[f"t{k + 1}" for k in range(width)])
    nodes = nodes.withColumn("depth", depth).select(
        _path_key(width, F.col("step")).alias("key"), "depth", F.col("least.conv").alias("conv"),
        F.when(F.col("depth") > 0, parent).alias("parent_conv"), "n_convs", (F.col("least.len") > F.col("depth")).cast("long").alias("goes_on"),
        "n_leaves", F.when(F.col("depth") == 0, spared).otherwise(spared - (F.col("n_convs") - 1) * path).alias("saved_bytes"),
        F.when(F.col("step") > 0, F.element_at(ids, F.greatest(F.col("step"), F.lit(1)))).alias("turn_id"))
    nodes = written(nodes, "trie-nodes").join(counts, "key", "left").withColumn("n_children", F.coalesce("branches", F.lit(0)) + F.col("goes_on"))
    return Trie(nodes.select("key", "depth", "conv", "parent_conv", "n_convs", "n_children", "n_leaves", "saved_bytes", "turn_id"), ends)


def _parents(branches: DataFrame, counts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(conv, adopter): the owner of the node a conversation branches from.

    A node with more than a thousandth of all branches is one of fewer than
    1,000 nodes, so these are broadcast; the rest join by shuffle, where no key
    has more than a thousandth of the rows.
    """
    total = counts.agg(F.sum("branches")).first()[0] or 0
    owner = nodes.select(F.col("key").alias("parent"), F.col("owner").alias("adopter"))
    hot = counts.filter(F.col("branches") * 1000 > total).select(F.col("key").alias("parent"))
    hot = written(owner.join(F.broadcast(hot), "parent"), "trie-hot")
    by_hot = branches.join(F.broadcast(hot), "parent").select("conv", "adopter")
    rest = branches.join(F.broadcast(hot.select("parent")), "parent", "left_anti").join(owner, "parent").select("conv", "adopter")
    return by_hot.unionByName(rest)


def ends_digest(ends: DataFrame, piece: int = PIECE) -> DataFrame:
    """``ends`` (key, conv) -> (key, ends_sha256): SHA-256 of each node's ids,
    ascending, as decimals joined by commas.

    Rows are range partitioned by (key, conv), so a hot node spreads over tasks,
    which join up to ``piece`` ids into one piece of text. A node's pieces are
    then digested in order as a stream; no node is held whole.
    """
    def pieces(batches):
        import pyarrow as pa
        key, ids, out, size = None, [], [], 0

        def batch():
            columns = list(zip(*out)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.decimal128(38, 0), pa.int64(), pa.string()))],
                                              names=["key", "first", "ids"])

        for rows in batches:
            for k, conv in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                if ids and (k != key or len(ids) == piece):
                    out.append((key, ids[0], ",".join(map(str, ids))))
                    size += len(ids)
                    ids = []
                key = k
                ids.append(conv)
            if size >= 4 * piece:
                yield batch()
                out, size = [], 0
        if ids:
            out.append((key, ids[0], ",".join(map(str, ids))))
        yield batch()

    def digests(batches):
        import hashlib

        import pyarrow as pa
        kind = pa.decimal128(38, 0)
        key, state = None, None
        for rows in batches:
            done = ([], [])
            for k, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                if k != key:
                    if state is not None:
                        done[0].append(key)
                        done[1].append(state.hexdigest())
                    key, state = k, hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            yield pa.RecordBatch.from_arrays([pa.array(done[0], kind), pa.array(done[1], pa.string())], names=["key", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], kind), pa.array([state.hexdigest()])], names=["key", "ends_sha256"])

    text = (ends.repartitionByRange("key", "conv").sortWithinPartitions("key", "conv").select("key", "conv")
            .mapInArrow(pieces, f"key {_KEY}, first long, ids string"))
    text = written(text, "trie-end-pieces")
    return (text.repartition("key").sortWithinPartitions("key", "first").select("key", "ids")
            .mapInArrow(digests, f"key {_KEY}, ends_sha256 string"))


def turn_texts(turns: DataFrame, role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(turn_id, role, text) of each distinct turn, to name a trie's nodes."""
    return (turns.groupBy(turn_id(role_col, text_col).alias("turn_id"))
            .agg(F.coalesce(F.min(role_col), F.lit("")).alias("role"), F.coalesce(F.min(text_col), F.lit("")).alias("text")))


#: The same in DuckDB SQL for the production parameters, over ``conversations``.
SQL = """
WITH turns AS (
  SELECT conv_id AS c, strlen(r) || ':' || r || x AS t, strlen(x) AS b, row_number() OVER (
           PARTITION BY conv_id ORDER BY turn NULLS FIRST, substr(sha256(strlen(r) || ':' || r || x), 1, 32), strlen(x)) AS n
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)),
lists AS (SELECT c, list(t ORDER BY n) AS ts, list(b ORDER BY n) AS bs FROM turns GROUP BY c),
plans AS (
  SELECT *, c - c % 5 AS donor, xor(4294967295, list_reduce(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT)),
           lambda crc, b: list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda v, k: xor(v >> 1, 3988292384 * (v & 1)), xor(crc, b)),
           CAST(4294967295 AS BIGINT))) % 9 AS h
  FROM lists),
rebuilt AS (
  SELECT p.c, coalesce(d.ts[1:p.h], []) || p.ts[p.h + 1:] AS ts, coalesce(d.bs[1:p.h], []) || p.bs[p.h + 1:] AS bs
  FROM plans p LEFT JOIN lists d ON d.c = p.donor),
members AS (SELECT c, d AS depth, ts[1:d] AS p, CASE WHEN d = 0 THEN 0 ELSE bs[d] END AS b FROM (
  SELECT *, unnest(range(0, len(ts) + 1)) AS d FROM rebuilt)),
nodes AS (SELECT depth, p, min(c) AS conv_id, count(*) AS n_convs, max(b) AS b FROM members GROUP BY depth, p),
children AS (SELECT p[1:depth - 1] AS p, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
ends AS (SELECT ts AS p, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS ends FROM rebuilt GROUP BY ts),
full_nodes AS (SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.p = n.p),
subtrees AS (
  SELECT p[1:k] AS p, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * b) AS saved
  FROM (SELECT *, unnest(range(0, depth + 1)) AS k FROM full_nodes) GROUP BY ALL)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, n.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves,
       CAST(s.saved AS BIGINT) AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM full_nodes n JOIN subtrees s ON s.p = n.p LEFT JOIN nodes u ON n.depth > 0 AND u.depth = n.depth - 1 AND u.p = n.p[1:n.depth - 1]
LEFT JOIN ends e ON e.p = n.p
"""
