import hashlib
import random

import numpy as np

from mailsift.llm.repeats import _scan, named_windows, remove_repeats


def brute(rows, least=100):
    """rows: (id, text) in order -> per row (bytes, removed, spans, sha of the rest)."""
    seen, out = set(), []
    for _, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - least + 1):
            w = raw[s:s + least]
            if w in seen:
                gone[s:s + least] = True
            seen.add(w)
        runs = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(raw) else 0
        out.append((len(raw), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def fixture():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(40), prose(60), prose(25), "x" * 99, "y" * 100]
    rows = [(0, None), (1, ""), (2, "a" * 500), (3, "ab" * 200), (4, "a" * 120), (5, shared[0][:100]), (6, shared[0][1:100])]
    for i in range(7, 60):
        rows.append((i, prose(rnd.randint(0, 60)) + " ".join(rnd.sample(shared, rnd.randint(0, 3))) + prose(rnd.randint(0, 30))))
    for i in range(60, 75):  # exact and near copies
        text = rows[rnd.randint(7, 40)][1]
        at = rnd.randint(0, len(text))
        rows.append((i, text if i % 2 else text[:at] + "#" + text[at:]))
    rows += [(75, (prose(30) + "\n") * 5), (76, "\0" * 150), (77, "\0" * 130 + "b")]
    return rows


def test_equals_brute_force(spark):
    rows = fixture()
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, pack int, kept string").repartition(3)
    for how in ({}, {"pack_bytes": 1500, "bucket_bytes": 700}):
        got = {r.doc_id: r for r in remove_repeats(docs, **how).collect()}
        for (i, _), want in zip(rows, brute(rows)):
            r = got[i]
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want, i
            assert hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256
        assert len(got) == len(rows)


def test_repeated_rows_and_null_ids(spark):
    text = "some words that go on for a while " * 4
    docs = spark.createDataFrame([(7, text), (7, text), (7, text + "!"), (None, text), (3, "short"), (3, "short")], "doc_id long, text string")
    out = sorted((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in remove_repeats(docs).collect())
    whole = len(text)
    assert [x[:2] for x in out] == [(False, 3), (False, 3), (False, 7), (False, 7), (False, 7), (True, 0)]
    assert [x[2] for x in out][:2] == [0, 0] and out[-1][2] == whole
    assert sum(x[2] == whole for x in out[2:5]) >= 1


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_stack_scan_gives_all_common_prefix_intervals():
    rnd = random.Random(2)
    for _ in range(200):
        lcp = [rnd.randint(0, 5) for _ in range(rnd.randint(1, 12))]
        want = set()
        for a in range(len(lcp)):
            for b in range(a, len(lcp)):
                low = min(lcp[a:b + 1])
                if low >= 2 and (a == 0 or lcp[a - 1] < low) and (b == len(lcp) - 1 or lcp[b + 1] < low):
                    want.add((low, a, b + 1))
        assert set(_scan(lcp, 2)) == want


def test_every_window_is_named_once_and_alike():
    rnd = random.Random(9)
    a = bytes(rnd.choice(b"abc ") for _ in range(700))
    raws = [a, b"zz" + a[100:400], b"short", a[:99], a[:100]]
    doc, first, last, hashes = named_windows(raws)
    names = {}
    for d, s, e, h in zip(doc.tolist(), first.tolist(), last.tolist(), hashes.tolist()):
        for w in range(s, e + 1):
            assert (d, w) not in names
            names[d, w] = (h, raws[d][w:w + 100])
    assert set(names) == {(d, w) for d, r in enumerate(raws) for w in range(len(r) - 99)}
    by_window = {}
    for h, w in names.values():
        assert by_window.setdefault(w, h) == h


def phrase_rows(n, length):
    """Documents of noise around one phrase, so that each has contexts of its own; some share a longer passage."""
    rnd = random.Random(11)
    noise = lambda k: "".join(rnd.choice("0123456789abcdef") for _ in range(k))
    phrase, passage = noise(length), noise(170)
    return [(i, noise(110) + phrase + noise(110) + (passage + noise(20) if i % 3 == 0 else "")) for i in range(n)]


def test_hot_hashes_equal_brute_force(spark):
    rows = fixture() + [(100 + i, t) for i, t in phrase_rows(60, 60)] + [(200 + i, t) for i, t in phrase_rows(30, 120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (0, 4):
        got = {r.doc_id: r for r in remove_repeats(docs, pack_bytes=6000, bucket_bytes=9000, keep_text=False, most=most).collect()}
        for (i, _), want in zip(rows, brute(rows)):
            assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == want, (most, i)


def test_a_frequent_phrase_never_meets_in_one_suffix_array(monkeypatch):
    import pyarrow as pa

    from mailsift.llm import repeats
    rows = phrase_rows(4800, 90)  # more contexts of one substring than a suffix array should see
    packs = [pa.table({"id": pa.array([i for i, _ in part], pa.int64()), "text": [t for _, t in part]}) for part in (rows[:2400], rows[2400:])]
    note = lambda blobs: pa.table({"id": pa.nulls(len(blobs), pa.int64()), "sha": pa.nulls(len(blobs), pa.binary()),
                                   "data": pa.array(blobs, pa.binary())})
    listed = [(k, data) for k, p in enumerate(packs) for _, data in repeats._cut(p, note([]), 1, 100, 32, False)]
    answers = repeats._bucket_answers([k for k, _ in listed], [d for _, d in listed])
    found = [(k, *row) for k, p in enumerate(packs) for row in repeats._cut(p, note([d for o, d in answers if o == k]), 1, 100, 32, True)]
    sizes = []
    whole = repeats.repeat_spans

    def seen(contexts, group, *rest):
        sizes.append(int(np.bincount(group).max()))
        return whole(contexts, group, *rest)

    monkeypatch.setattr(repeats, "repeat_spans", seen)
    cold = [(k, d) for k, b, d in found if b is not None and b >= 0]
    repeats._bucket_spans([k for k, _ in cold], [d for _, d in cold], 100)
    assert max(sizes, default=0) <= 3000
