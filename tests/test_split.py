from pyspark.sql import functions as F

from mailsift.operators import split as SP


def test_anchor_quota():
    q = SP.split_quotas({"legitimate": 46722, "phishing": 29935})
    assert q == {"legitimate": 9345, "phishing": 5987} and sum(q.values()) == 15332


def _data(spark, n_legit=613, n_phish=211, parts=5):
    rows = [(i, "phishing" if i % 4 == 0 and i < n_phish * 4 else "legitimate") for i in range(n_legit + n_phish)]
    return spark.createDataFrame(rows, "row_id long, label string").repartition(parts)


def test_split_exact_disjoint_and_partition_independent(spark):
    df = _data(spark)
    counts = {r[0]: r[1] for r in df.groupBy("label").count().collect()}
    want = SP.split_quotas(counts)
    a = SP.stratified_split(df)
    got = {(r.label, r.part): r["count"] for r in a.groupBy("label", "part").count().collect()}
    for c, k in want.items():
        assert got[(c, "test")] == k
        assert got[(c, "test")] + got[(c, "train")] == counts[c]
    b = SP.stratified_split(df.coalesce(1))
    assert sorted(a.select("row_id", "part").collect()) == sorted(b.select("row_id", "part").collect())


def test_cutoffs_match_row_number(spark):
    from pyspark.sql import Window
    df = _data(spark).withColumn("_h", SP.order_hash("row_id", 7))
    n_ph = df.filter(F.col("label") == "phishing").count()
    tg = spark.createDataFrame([("legitimate", 0, 1), ("legitimate", 1, 300), ("phishing", 2, n_ph)],
                               "label string, target_id int, k long")
    cuts = {r.target_id: (r.cut_key, r.cut_tie) for r in SP.exact_cutoffs(df, ["label"], tg).collect()}
    rn = df.withColumn("rn", F.row_number().over(Window.partitionBy("label").orderBy("_h", "row_id")))
    for tid, lab, k in ((0, "legitimate", 1), (1, "legitimate", 300), (2, "phishing", n_ph)):
        r = rn.filter((F.col("label") == lab) & (F.col("rn") == k)).first()
        assert cuts[tid] == (r["_h"], r["row_id"])


def test_folds_balanced_and_prefixes_nested(spark):
    f = SP.stratified_folds(_data(spark), k=5)
    sizes = {(r.label, r.fold): r["count"] for r in f.groupBy("label", "fold").count().collect()}
    for lab in ("legitimate", "phishing"):
        vals = [sizes.get((lab, k), 0) for k in range(5)]
        assert max(vals) - min(vals) <= 1
    p = SP.train_prefixes(f)
    rows = p.groupBy("fold", "size").count().collect()
    train_n = {fo: f.filter(F.col("fold") != fo).count() for fo in range(5)}
    assert all(r["count"] == min(r["size"], train_n[r["fold"]]) for r in rows)
    sets = {}
    for r in p.collect():
        sets.setdefault((r.fold, r.size), set()).add(r.row_id)
    for fold in range(5):
        ks = sorted(s for (fo, s) in sets if fo == fold)
        for a, b in zip(ks, ks[1:]):
            assert sets[(fold, a)] <= sets[(fold, b)]


def test_grouped_split_is_the_split_of_every_group(spark):
    rows = [(f"{k % 3}:{k}", "phishing" if k % 4 == 0 else "legitimate", list(range(k % 3 + 1, 4))) for k in range(60)]
    rows += [rows[5], ("9:9", "other", [3]), ("8:8", "legitimate", [])]
    df = spark.createDataFrame(rows, "row_id string, label string, groups array<int>")
    got = SP.grouped_split(df, "groups")
    assert got.count() == len(rows)
    for g in (1, 2, 3):
        alone = SP.stratified_split(df.filter(F.array_contains("groups", g)))
        for part in ("train", "test"):
            assert (sorted(r.row_id for r in got.filter(F.array_contains(part, g)).collect())
                    == sorted(r.row_id for r in alone.filter(F.col("part") == part).collect()))
