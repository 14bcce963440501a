"""The trie against one built node by node in plain Python."""
import hashlib
import random
import zlib

import pytest

from mailsift.llm import prefix_trie as pt

COLUMNS = "conv_id long, turn long, role string, text string"


def brute_rebuilt(rows):
    convs = {}
    key = lambda r, x: hashlib.sha256(f"{len(r.encode())}:{r}{x}".encode()).hexdigest()[:32]
    for conv, turn, role, text in rows:
        if conv is not None:
            r, x = role or "", text or ""
            convs.setdefault(conv, []).append(((turn is not None, turn or 0, key(r, x), len(x.encode())), (r, x)))
    convs = {c: [t for _, t in sorted(v)] for c, v in convs.items()}
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    return out


def brute_trie(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    nodes = {}
    for path, inside in members.items():
        under = [p for p in members if p[:len(path)] == path]
        ends = ",".join(str(c) for c in sorted(inside) if tuple(convs[c]) == path)
        nodes[path] = (min(inside), len(path), min(members[path[:-1]]) if path else None, len(inside),
                       sum(len(p) == len(path) + 1 for p in under), sum(all(q[:-1] != p for q in members) for p in under),
                       sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in under if p), hashlib.sha256(ends.encode()).hexdigest())
    return sorted(nodes.values(), key=str)


def got(spark, turns, width, piece=3):
    trie = pt.prefix_trie(turns, width)
    ends = {r["key"]: r["ends_sha256"] for r in pt.ends_digest(trie.ends, piece).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    return sorted([(r["conv"], r["depth"], r["parent_conv"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_bytes"], ends.get(r["key"], empty))
                   for r in trie.nodes.collect()], key=str)


def some_rows(n, seed):
    rnd = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rnd.choice([1, 2, 3, 5, 9, 23])):
            rows.append((c, t, rnd.choice(["user", "assistant"]), rnd.choice(["a", "bé", "hello"])))
    return rows


@pytest.mark.parametrize("width", [2, 8])
def test_equals_the_brute_force(spark, width):
    rows = some_rows(60, 4)
    rows += [(c, t, "user", f"same {t}") for c in (200, 201, 205, 210, 215) for t in range(3)]  # copies of one conversation
    rows += [(300 + c, 0, "system", "one common first turn") for c in range(20)]
    rows += [(400 + c, 0, "user", "no donor") for c in (1, 2, 3, 4, 6, 7)]
    df = spark.createDataFrame(rows, COLUMNS).repartition(4)
    want = brute_rebuilt(rows)
    assert any(not turns for turns in want.values())  # turnless conversations are members of the root
    assert got(spark, pt.with_shared_heads(pt.ordered_turns(df)), width) == brute_trie(want)


def test_nulls_ties_repeats_and_no_donor(spark):
    rows = [(None, 0, "user", "lost"), (7, None, None, None), (7, 3, "user", "x"), (7, 3, "assistant", "y"), (7, 3, "user", "x"), (7, 1, None, "z"),
            (11, 0, "user", ""), (-3, 0, "user", "below"), (-5, 0, "user", "below")]
    df = spark.createDataFrame(rows, COLUMNS).withColumn("conv", pt.F.lit("clash")).withColumn("pos", pt.F.lit(1))
    plain = brute_rebuilt(rows)
    plain[-3] = [("user", "below")][:0] + [("user", "below")][zlib.crc32(b"-3") % 9:]  # SQL's remainder keeps the sign: its donor is 0
    assert got(spark, pt.with_shared_heads(pt.ordered_turns(df)), 8) == brute_trie(plain)


def test_one_long_conversation_and_its_copy(spark):
    rows = [(c, t, "user", f"t{t % 7}") for c in (5, 10) for t in range(100)] + [(10, 100, "user", "more")]
    df = spark.createDataFrame(rows, COLUMNS)
    turns = pt.ordered_turns(df)  # not rebuilt
    convs = {5: [("user", f"t{t % 7}") for t in range(100)], 10: [("user", f"t{t % 7}") for t in range(100)] + [("user", "more")]}
    assert got(spark, turns, 8) == brute_trie(convs)
    names = {r["turn_id"]: r["text"] for r in pt.turn_texts(df).collect()}
    assert {names[r["turn_id"]] for r in pt.prefix_trie(turns).nodes.collect() if r["depth"] == 101} == {"more"}


def test_empty(spark):
    turns = pt.with_shared_heads(pt.ordered_turns(spark.createDataFrame([], COLUMNS)))
    assert got(spark, turns, 8) == []


def test_a_rollup_aggregates_all_blocks_together(spark):
    df = spark.createDataFrame(some_rows(20, 1), COLUMNS)
    blocks = pt._blocks(pt.ordered_turns(df), 8)
    plan = pt._rollup(blocks, 8, "count(*) AS n")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Expand") == 1
