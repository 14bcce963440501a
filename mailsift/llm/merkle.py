"""A Merkle manifest of a table, by time-forward processing.

Every row is a leaf. The leaves of a group, in order, form a tree in which
``FAN`` consecutive nodes become the digest of their joined hex digests, until
one node is left, the group's subroot; the subroots in group order form a tree
of the same kind, whose top is the root.

Time-forward processing visits nodes in label order (level, position), and a
priority queue ordered by label carries what a node sends to a later one. Here
the queue is external in two steps. Inside a range of ``FAN ** SPAN`` aligned
leaves, one task keeps a heap: it takes the least label, joins the children's
digests delivered to it and sends its own to its parent. What leaves the range,
one message a range, goes to a written table that Spark sorts by label and deals
to the ranges of the next round, a factor 4,096 smaller, until every group has
one node. The sweep back visits labels in falling order: a node sends each
child its own proof suffix with the child's siblings put before it, so that
each leaf ends up with its whole proof. No task sees more than one range, and
the driver sees none.
"""

from __future__ import annotations

import hashlib
import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.rank import distributed_rank
from .common import written

FAN, SPAN = 8, 4
_PATH = "array<struct<left: string, right: string>>"


def field_text(column: str | Column) -> Column:
    """``-`` for null, else ``<UTF-8 bytes>:<value>``, so that joined fields can't be confused."""
    value = (F.col(column) if isinstance(column, str) else column).cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def row_digest(*columns: str | Column) -> Column:
    """Lowercase hex SHA-256 of the joined fields."""
    return F.sha2(F.concat(*[field_text(c) for c in columns]), 256)


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


class NodeQueue:
    """Messages to tree nodes, received in label order."""

    def __init__(self):
        self.heap: list[tuple] = []

    def send(self, label: tuple[int, int], slot: int, message) -> None:
        heapq.heappush(self.heap, (label, slot, message))

    def receive(self) -> tuple[tuple[int, int], list]:
        """The least label and its messages by slot."""
        label, _, message = heapq.heappop(self.heap)
        messages = [message]
        while self.heap and self.heap[0][0] == label:
            messages.append(heapq.heappop(self.heap)[2])
        return label, messages

    def __bool__(self) -> bool:
        return bool(self.heap)


def height(n: int) -> int:
    """Levels above ``n`` leaves until one node is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def sweep_up(digests: list[str], levels: int) -> dict[tuple[int, int], list[str]]:
    """The children's digests that each inner node (level, position) received."""
    queue, inner = NodeQueue(), {}
    if levels:
        for at, d in enumerate(digests):
            queue.send((1, at // FAN), at % FAN, d)
    while queue:
        (level, at), children = queue.receive()
        inner[level, at] = children
        if level < levels:
            queue.send((level + 1, at // FAN), at % FAN, digest(children))
    return inner


def sweep_down(inner: dict, levels: int, suffix: list) -> list[list[tuple[str, str]]]:
    """The proof of each leaf, lowest level first, ending with ``suffix``:
    digests left and right of the node on its way to the top."""
    if not levels:
        return [suffix]
    queue, proofs = NodeQueue(), {}
    queue.send((-levels, 0), 0, suffix)
    while queue:
        (level, at), (above,) = queue.receive()
        children = inner[-level, -at]
        for slot in range(len(children)):
            own = [("".join(children[:slot]), "".join(children[slot + 1:])), *above]
            child = -at * FAN + slot
            if level == -1:
                proofs[child] = own
            else:
                queue.send((level + 1, -child), 0, own)
    return [proofs[at] for at in range(len(proofs))]


def _range_of(span: int) -> Column:
    return F.expr(f"_at div {FAN ** span}").alias("_range")


def _up(nodes: DataFrame, kind: str, span: int) -> DataFrame:
    """``nodes`` (_group, _at, full, alone) -> one such row a range. ``full`` is
    the range's node ``span`` levels up, for a group that goes on; ``alone`` is its
    top where the range is its group's only one."""
    def run(key, table):
        import pyarrow as pa
        order = table["_at"].to_numpy().argsort()
        rows = table.take(pa.array(order))
        at = key[1].as_py()
        if rows.num_rows == 1 and at == 0:  # the group is down to one node
            full = alone = rows["alone"][0].as_py()
        else:
            digests = rows["full"].to_pylist()
            inner = sweep_up(digests, span)
            top = height(len(digests))
            full = digest(inner[span, 0])
            alone = digest(inner[top, 0]) if top else full
        return pa.table([pa.array([key[0].as_py()], table.schema.field("_group").type), pa.array([at], pa.int64()),
                         pa.array([full], pa.string()), pa.array([alone], pa.string())], names=["_group", "_at", "full", "alone"])

    return (nodes.select("_group", "_at", "full", "alone").groupBy("_group", _range_of(span))
            .applyInArrow(run, f"_group {kind}, _at long, full string, alone string"))


def _down(nodes: DataFrame, messages: DataFrame, span: int) -> DataFrame:
    """Delivers the proofs of the ranges' tops to ``nodes``: its columns but
    ``full`` and ``alone``, then (only boolean, subroot, root, path)."""
    fields = [f for f in nodes.schema.fields if f.name not in ("full", "alone")]
    kept = [f.name for f in fields]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def run(key, left, right):
        import pyarrow as pa
        rows = left.take(pa.array(left["_at"].to_numpy().argsort()))
        message = right.slice(0, 1).to_pylist()[0]
        suffix = [(s["left"], s["right"]) for s in message["path"]]
        n = rows.num_rows
        single = n == 1 and key[1].as_py() == 0  # the group is down to this node
        levels = 0 if single else height(n) if message["only"] else span
        proofs = sweep_down(sweep_up(rows["full"].to_pylist(), levels), levels, suffix)
        steps, depth = [s for p in proofs for s in p], len(proofs[0])
        path = pa.ListArray.from_arrays(
            pa.array([k * depth for k in range(n + 1)], pa.int32()),
            pa.StructArray.from_arrays([pa.array([s[k] for s in steps], pa.string()) for k in (0, 1)], names=["left", "right"]))
        return pa.table([*[rows[c] for c in kept], pa.array([single] * n), pa.array([message["subroot"]] * n, pa.string()),
                         pa.array([message["root"]] * n, pa.string()), path], names=[*kept, "only", "subroot", "root", "path"])

    return (nodes.groupBy("_group", _range_of(span)).cogroup(messages.groupBy("_group", F.col("_at").alias("_range")))
            .applyInArrow(run, f"{ddl}, only boolean, subroot string, root string, path {_PATH}"))


def _rounds(leaves: DataFrame, kind: str, span: int) -> list[DataFrame]:
    """``leaves`` and the tables of the rounds above them; the last has one row a group."""
    rounds = [leaves]
    while True:
        rounds.append(written(_up(rounds[-1], kind, span), "merkle-up"))
        if (rounds[-1].agg(F.max("_at")).first()[0] or 0) == 0:
            return rounds


def manifest(rows: DataFrame, group: str, order: list[str], leaf: str = "leaf", span: int = SPAN) -> DataFrame:
    """``rows`` with subroot, root (hex) and path (left and right siblings, lowest level first).

    ``leaf`` is each row's hex digest; leaves of a ``group`` are ordered by
    ``order``, nulls first, ties by digest; groups go null first, then by value
    (strings by UTF-8 bytes). Null groups are a group. Rows that repeat are
    leaves of their own. An empty table gives an empty table. ``rows`` should
    be narrow, and its columns must not bear the result's names.
    """
    taken = {"subroot", "root", "path", "only", "full", "alone", "_group", "_at", "_range"} & {c.lower() for c in rows.columns}
    if taken:
        raise ValueError(f"columns named like the manifest's own: {sorted(taken)}")
    kind = rows.schema[group].dataType.simpleString()
    rows = written(rows, "merkle-leaves")  # else the range partitioning's sample digests all texts once more
    ranked = distributed_rank(rows, [*[F.col(f"`{c}`") for c in order], F.col(f"`{leaf}`")], within=[group], name="_nth")
    leaves = ranked.withColumn("_group", F.col(f"`{group}`")).withColumn("_at", F.col("_nth") - 1).drop("_nth")
    leaves = leaves.withColumn("full", F.col(f"`{leaf}`")).withColumn("alone", F.col("full"))
    rounds = _rounds(leaves, kind, span)

    tops = distributed_rank(rounds[-1].select(F.col("_group").alias("_name"), "alone"), ["_name"], name="_nth")
    tops = tops.select("_name", F.lit(0).alias("_group"), (F.col("_nth") - 1).alias("_at"), F.col("alone").alias("full"), "alone")
    above = _rounds(tops, "int", span)
    path = F.array().cast(_PATH)
    sent = above[-1].select("_group", "_at", F.lit(True).alias("only"), F.col("alone").alias("subroot"), F.col("alone").alias("root"),
                            path.alias("path"))
    for nodes in reversed(above[:-1]):
        sent = written(_down(nodes, sent, span), "merkle-down")
    named = sent.select(F.col("_name").alias("_group"), F.lit(0).cast("long").alias("_at"), F.lit(True).alias("only"), "root", "path")
    first = rounds[-1].select(F.col("_group").alias("_g"), F.col("alone").alias("subroot"))
    sent = named.join(first, named["_group"].eqNullSafe(first["_g"])).select("_group", "_at", "only", "subroot", "root", "path")
    for nodes in reversed(rounds[1:-1]):
        sent = written(_down(nodes, sent, span), "merkle-down")
    return _down(leaves, sent, span).drop("_group", "_at", "only")


def proof_text(path: str = "path") -> Column:
    """The siblings' digests, level by level to the root, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def folded(leaf: str | Column, path: str = "path") -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(path, F.col(leaf) if isinstance(leaf, str) else leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


#: The same in DuckDB SQL, over ``documents``.
SQL = """
WITH RECURSIVE plain AS (
  SELECT doc_id, source, lang, n_chars, text,
         doc_id IS NOT NULL AND xor(4294967295, list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT)),
           lambda crc, b: list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda c, k: xor(c >> 1, 3988292384 * (c & 1)), xor(crc, b)),
           CAST(4294967295 AS BIGINT))) % 3 = 0 AS tampered
  FROM documents),
fields AS (
  SELECT doc_id, lang, concat(
           coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
           coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-')) AS head,
         coalesce(strlen(text) || ':' || text, '-') AS body, tampered,
         coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-') AS low FROM plain),
leaves AS (
  SELECT doc_id, lang, leaf, changed, nth - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) AS nth FROM (
      SELECT doc_id, lang, sha256(head || body) AS leaf, sha256(head || CASE WHEN tampered THEN low ELSE body END) AS changed FROM fields))),
up(lang, level, pos, h, n) AS (
  SELECT lang, 0, pos, leaf, n FROM leaves
  UNION ALL
  SELECT lang, level + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (n + 7) // 8 FROM up WHERE n > 1 GROUP BY lang, level, pos // 8, n),
subroots AS (SELECT lang, h AS subroot, level AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n
             FROM up WHERE n = 1),
top(level, pos, h, n) AS (
  SELECT 0, pos, subroot, n FROM subroots
  UNION ALL
  SELECT level + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (n + 7) // 8 FROM top WHERE n > 1 GROUP BY level, pos // 8, n),
root AS (SELECT h AS root FROM top WHERE n = 1),
spots AS (
  SELECT l.doc_id, l.leaf, l.changed, l.lang, l.pos, s.subroot, s.height, s.pos AS group_pos, row_number() OVER () AS spot
  FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang),
steps AS (
  SELECT p.spot, u.level AS step, u.pos = p.pos // CAST(pow(8, u.level) AS BIGINT) AS own, u.pos, u.h
  FROM spots p JOIN up u ON u.lang IS NOT DISTINCT FROM p.lang AND u.n > 1 AND u.pos // 8 = p.pos // CAST(pow(8, u.level + 1) AS BIGINT)
  UNION ALL
  SELECT p.spot, p.height + t.level, t.pos = p.group_pos // CAST(pow(8, t.level) AS BIGINT), t.pos, t.h
  FROM spots p JOIN top t ON t.n > 1 AND t.pos // 8 = p.group_pos // CAST(pow(8, t.level + 1) AS BIGINT)),
own AS (SELECT spot, step, pos FROM steps WHERE own),
sides AS (
  SELECT s.spot, s.step, coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (WHERE s.pos < o.pos), '') AS l,
         coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (WHERE s.pos > o.pos), '') AS r
  FROM steps s JOIN own o ON s.spot = o.spot AND s.step = o.step GROUP BY s.spot, s.step),
proofs AS (SELECT spot, string_agg(l || r, '' ORDER BY step) AS proof, count(*) AS depth FROM sides GROUP BY spot),
fold(spot, step, h) AS (
  SELECT spot, 0, changed FROM spots
  UNION ALL
  SELECT f.spot, f.step + 1, sha256(s.l || f.h || s.r) FROM fold f JOIN sides s ON s.spot = f.spot AND s.step = f.step)
SELECT p.doc_id, p.leaf, p.subroot, root.root, sha256(coalesce(q.proof, '')) AS proof_sha256, f.h AS folded_root, f.h = root.root AS verified
FROM spots p CROSS JOIN root LEFT JOIN proofs q ON q.spot = p.spot JOIN fold f ON f.spot = p.spot AND f.step = coalesce(q.depth, 0)
"""
