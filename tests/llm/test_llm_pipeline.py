import collections
import zlib

import numpy as np
from test_llm_simhash import brute_components, brute_fingerprint

import corpus_pipeline as pipeline
from mailsift.llm.common import load, written
from mailsift.llm.tokens import ChunkEncoder

SF = "/root/testdata/sf0.001"


def check_stages(spark, docs, sf):
    """Every stage against what it must do to the rows of the one before."""
    columns, encoder = docs.columns, ChunkEncoder()
    rows = docs.collect()
    for name, stage in pipeline.STAGES:
        out = written(stage(spark, docs, sf), "test-stage")
        after = out.collect()
        if name != "best_fit_packing":
            assert out.columns == columns
        if name == "language_id":
            assert collections.Counter(after) <= collections.Counter(rows)
        elif name == "simhash_near_duplicates":
            # one row of each group stays: of the smallest id, or one without an id where no row has any
            groups = brute_components([brute_fingerprint(r.text) for r in rows], list(range(len(rows))))
            least = {}
            for r, group in zip(rows, groups):
                least[group] = min(least.get(group, (True, 0)), (r.doc_id is None, r.doc_id or 0))
            assert sorted(map(str, (r.doc_id for r in after))) == sorted(str(None if none else i) for none, i in least.values())
        elif name == "secret_scan":
            assert sorted(str(r.doc_id) for r in after) == sorted(str(r.doc_id) for r in rows)
            assert all("token =" not in (r.text or "") for r in after)
        elif name == "mix_sources":
            assert set(after) <= set(rows)
            words = sum(len((r.text or "").encode().split()) for r in rows)
            taken = sum(len((r.text or "").encode().split()) for r in after)
            assert abs(taken - 1.5 * words) <= 0.02 * words + max((len((r.text or "").split()) for r in rows), default=0)
            assert max(collections.Counter(after).values(), default=0) <= 2 * max(collections.Counter(rows).values(), default=1)
        else:
            want = collections.Counter()
            for r in rows:
                ids = np.frombuffer(encoder.encode([r.text or ""])[0], "<u4").tolist() + [1]
                for k in range(0, len(ids), 4096):
                    part = ids[k:k + 4096]
                    want[r.doc_id, k // 4096, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
            assert want == collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in after)
            bins = collections.defaultdict(list)
            for r in after:
                bins[r.sequence_id].append((r.offset, r.length))
            for spans in bins.values():
                spans.sort()
                assert [o for o, _ in spans] == [0, *np.cumsum([n for _, n in spans])[:-1].tolist()] and sum(n for _, n in spans) <= 4096
            assert len(bins) <= -(-sum(r.length for r in after) // 4096) + 1
        docs, rows = out, after
    return rows


def test_stages_on_the_small_table(spark):
    assert len(check_stages(spark, load(spark, SF, "documents"), SF)) > 100


def test_stages_on_odd_rows(spark):
    base = load(spark, SF, "documents").limit(40)
    odd = spark.createDataFrame([(1000, None, "en", "s", 0), (1001, "", None, None, None), (None, "a text with some words", "en", None, 3),
                                 (1002, "the same words again", "en", "s", 1), (1002, "the same words again", "en", "s", 1),
                                 (1003, "w " * 20_000, "en", "s", 1), (None, "a text with some words", "en", "t", 4),
                                 (None, "The same words again", "en", "s", 1)], base.schema)
    check_stages(spark, written(base.unionByName(odd), "odd"), SF)


def test_empty_table(spark):
    docs = load(spark, SF, "documents").limit(0)
    for _, stage in pipeline.STAGES:
        docs = written(stage(spark, docs, SF), "none")
        assert docs.count() == 0
