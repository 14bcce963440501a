import numpy as np
import xxhash

from mailsift.llm.components import connected_components
from mailsift.llm.simhash import BKTree, fingerprint_hex, fingerprint_links, near_duplicates, shard_links


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(len(words) - 2, 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, names, radius=2):
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(values)):
        least[find(i)] = min(least.get(find(i), names[i]), names[i])
    return [least[find(i)] for i in range(len(values))]


def near_values(n, seed):
    rnd = np.random.default_rng(seed)
    base = rnd.integers(0, 1 << 63, 5, dtype=np.uint64)
    out = []
    for i in range(n):
        x = int(base[i % 5])
        for b in rnd.integers(0, 64, rnd.integers(0, 5)):
            x ^= 1 << int(b)
        out.append(x)
    return out


def test_tree_finds_all_within_the_radius():
    values = np.array(sorted(set(near_values(300, 1))), np.uint64)
    found = {(int(a), int(b)) for q, n in BKTree(values).within(values, 2) for a, b in zip(q, n)}
    want = {(i, j) for i in range(len(values)) for j in range(len(values)) if int(values[i] ^ values[j]).bit_count() <= 2}
    assert found == want
    assert len(set(shard_links(values, 2).tolist())) == len(set(brute_components([int(v) for v in values], list(range(len(values))))))


def test_links_with_hot_shards(spark):
    values = sorted(set(near_values(400, 2)))
    rows = [(v - (1 << 64) if v >> 63 else v, 1000 + i) for i, v in enumerate(values)]
    nodes = spark.createDataFrame(rows, "fp long, node long")
    want = brute_components(values, [1000 + i for i in range(len(values))])
    for hot in (4096, 8):
        got = {r.node: r.component for r in connected_components(fingerprint_links(nodes, 2, hot)).collect()}
        assert [got.get(1000 + i, 1000 + i) for i in range(len(values))] == want


def test_documents_equal_brute_force(spark):
    rnd = np.random.default_rng(3)
    words = [f"w{i}" for i in range(300)]
    rows = [(5, None), (6, ""), (7, " \t\n"), (8, "One Two"), (9, "one two"), (10, "É x y"), (11, "w " * 30_000)]
    for i in range(20, 80):
        text = " ".join(rnd.choice(words, 150))
        rows.append((i, text))
        if i % 3 == 0:
            rows.append((i + 100, text.upper() + (" extra" if i % 2 else "")))
    rows.append((20, rows[7][1]))  # a repeated row
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fp int")
    got = near_duplicates(docs).select("doc_id", fingerprint_hex().alias("f"), "component_id").collect()
    values = [brute_fingerprint(t) for _, t in rows]
    want = sorted(zip([i for i, _ in rows], [f"{v:016x}" for v in values], brute_components(values, [i for i, _ in rows])))
    assert sorted(map(tuple, got)) == want


def test_path_star_and_odd_graphs(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 140)] + [(7, 7), (200, 201), (201, 200), (201, 200)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[i] == 100 for i in range(100, 140)) and got[201] == 200
    assert len(got) == 61 + 40 + 2


def test_empty_tables(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rows_without_an_id_stay_and_link(spark):
    words = [f"w{i}" for i in range(400)]
    near = [" ".join(words[:k] + ["x"] + words[k + 1:]) for k in (0, 399)]
    rows = [(None, "only without id"), (None, "only without id"), (None, " ".join(words)), (9, near[0]), (4, near[1]), (4, near[1]), (30, "far away")]
    got = sorted((str(r.doc_id), r.fp, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    prints = [brute_fingerprint(t) for _, t in rows]
    ids = [10**6 + k if i is None else i for k, (i, _) in enumerate(rows)]
    least = [c if c < 10**6 else None for c in brute_components(prints, ids)]
    signed = [f - (1 << 64) if f >> 63 else f for f in prints]
    assert got == sorted((str(i), f, c) for (i, _), f, c in zip(rows, signed, least))
