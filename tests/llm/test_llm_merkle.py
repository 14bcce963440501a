"""The manifest against a layer-by-layer tree built in plain Python."""
import hashlib
import random

import pytest

from mailsift.llm import merkle

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def brute_tree(leaves):
    """(top, proof steps of each leaf)"""
    layers, proofs = [leaves], [[] for _ in leaves]
    while len(layers[-1]) > 1:
        now = layers[-1]
        for i in range(len(leaves)):
            at = i // 8 ** (len(layers) - 1)
            run = now[at // 8 * 8:at // 8 * 8 + 8]
            proofs[i].append(("".join(run[:at % 8]), "".join(run[at % 8 + 1:])))
        layers.append([sha("".join(now[k:k + 8])) for k in range(0, len(now), 8)])
    return layers[-1][0], proofs


def brute(rows):
    by = {}
    for doc_id, lang, leaf in sorted(rows, key=lambda r: (r[1] is not None, (r[1] or "").encode(), r[0] is not None, r[0] or 0, r[2])):
        by.setdefault(lang, []).append((doc_id, leaf))
    trees = {lang: brute_tree([leaf for _, leaf in group]) for lang, group in by.items()}
    root, above = brute_tree([trees[lang][0] for lang in by])
    out = []
    for k, (lang, group) in enumerate(by.items()):
        for (doc_id, leaf), proof in zip(group, trees[lang][1]):
            out.append((doc_id, lang, leaf, trees[lang][0], root, tuple(proof + above[k])))
    return sorted(out, key=str)


def run(spark, rows, span=merkle.SPAN):
    df = spark.createDataFrame(rows, "doc_id long, lang string, leaf string").repartition(5)
    got = merkle.manifest(df, "lang", ["doc_id"], span=span).withColumn("folded", merkle.folded("leaf")).collect()
    assert all(r["folded"] == r["root"] for r in got)
    return sorted([(r["doc_id"], r["lang"], r["leaf"], r["subroot"], r["root"], tuple((s["left"], s["right"]) for s in r["path"])) for r in got], key=str)


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 8, None: 1}, {"a": 4097, "b": 4096, "é": 3, None: 20}])
def test_equals_the_layers(spark, sizes):
    rows = [(i, lang, sha(f"{lang}{i}")) for lang, n in sizes.items() for i in range(n)]
    random.Random(1).shuffle(rows)
    assert run(spark, rows) == brute(rows)


def test_many_groups_and_rounds(spark):
    rows = [(i, None if i % 90 == 0 else f"l{i % 70}" if i % 3 else "hot", sha(str(i))) for i in range(700)]
    assert run(spark, rows, span=1) == brute(rows)  # ranges of 8 leaves: several rounds on a small table


def test_null_ids_ties_and_repeated_rows(spark):
    rows = [(None, "a", sha("x")), (None, "a", sha("y")), (3, "a", sha("z"))] + [(3, "a", sha("z"))] * 9 + [(3, "a", sha("q"))]
    assert run(spark, rows) == brute(rows)


def test_empty_and_clashing_names(spark):
    empty = spark.createDataFrame([], "doc_id long, lang string, leaf string")
    assert merkle.manifest(empty, "lang", ["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        merkle.manifest(empty.withColumnRenamed("doc_id", "root"), "lang", ["root"])


def test_fields_cannot_be_confused(spark):
    df = spark.createDataFrame([("a", "bc", None), ("ab", "c", None), ("", None, "é")], "x string, y string, z string")
    got = [r[0] for r in df.select(merkle.row_digest("x", "y", "z")).collect()]
    assert got == [sha("1:a2:bc-"), sha("2:ab1:c-"), sha("0:-2:é")]


def test_sweeps_visit_labels_in_order():
    leaves = [sha(str(i)) for i in range(100)]
    inner = merkle.sweep_up(leaves, merkle.height(100))
    assert list(inner) == sorted(inner) and len(inner) == 13 + 2 + 1
    top, proofs = brute_tree(leaves)
    assert merkle.digest(inner[3, 0]) == top
    assert merkle.sweep_down(inner, 3, [("l", "r")]) == [p + [("l", "r")] for p in proofs]
