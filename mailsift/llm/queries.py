"""The queries of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blockjoin, merkle, pivots, prefix_trie, quality_rules
from .common import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


@query("op1_best_fit_packing")
def op1(spark, sf_dir):
    from .packing import pack_documents
    crc = F.crc32("token_ids").alias("ids_crc32")
    return pack_documents(load(spark, sf_dir, "documents"), keep=[crc]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op7_simhash_bktree")
def op7(spark, sf_dir):
    from .simhash import fingerprint_hex, near_duplicates
    return near_duplicates(load(spark, sf_dir, "documents")).select(
        "doc_id", fingerprint_hex().alias("fingerprint"), "component_id")


@query("op4_subset_sum_mixing")
def op4(spark, sf_dir):
    from .mixing import mix
    rows = mix(load(spark, sf_dir, "documents"))
    nth = rows.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    taken = F.col("size") * (F.col("whole") + F.when(F.col("nth") <= F.col("extra"), 1).otherwise(0))
    return nth.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


@query("op10_randomness_secrets")
def op10(spark, sf_dir):
    from .secrets import fit, scan
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, fit(docs))
    joined = lambda spans: F.concat_ws(",", F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    base = F.filter("spans", lambda s: s["kind"] != "random")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
                        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


@query("op9_bigru_language")
def op9(spark, sf_dir):
    from .common import crc_bucket
    from .langid import fit, identify
    docs = load(spark, sf_dir, "documents")
    held = crc_bucket("doc_id", 5) == 0
    model = fit(docs.filter(~held))
    return identify(docs, model, keep=["doc_id"]).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query("op3_line_first_rules", quality_rules.SQL)
def op3(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    return quality_rules.quality_rules(docs, keep=["doc_id"], clean_text=False).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lines_removed", "kept")


@query("op6_factorisation_quality")
def op6(spark, sf_dir):
    from .common import crc_bucket
    from .factorisation import KEEP, fit, score
    docs = load(spark, sf_dir, "documents")
    held = crc_bucket("doc_id", 4) == 2
    labels = load(spark, sf_dir, "labels").filter(~held)
    return score(docs, fit(docs, labels)).select(
        "doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= KEEP).cast("int").alias("predicted"))


@query("op8_block_matrix_neighbours", blockjoin.SQL)
def op8(spark, sf_dir):
    return blockjoin.nearest(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op2_interval_tree_dedup")
def op2(spark, sf_dir):
    from .repeats import remove_repeats
    return remove_repeats(load(spark, sf_dir, "documents"), keep_text=False)


@query("op5_hmm_transcripts")
def op5(spark, sf_dir):
    from .chat import fit, format_chats, transcripts
    from .common import crc_bucket, written
    texts = written(transcripts(load(spark, sf_dir, "conversations")), "transcripts")
    model = fit(texts.filter(crc_bucket("conv_id", 5) != 0))
    return format_chats(texts, model, ["conv_id"], segment="segment").select(
        "conv_id", "segment", F.size("turns").alias("n_turns"), F.array_join(F.transform("turns", lambda t: t["role"]), ",").alias("roles"),
        "chat")


@query("op12_time_forward_manifest", merkle.SQL)
def op12(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    head, upper = ["doc_id", "source", "lang", "n_chars"], "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    rows = docs.select("doc_id", "lang", merkle.row_digest(*head, "text").alias("leaf"),
                       F.when(tampered, merkle.row_digest(*head, F.translate("text", upper, upper.lower()))).alias("changed"))
    found = merkle.manifest(rows, "lang", ["doc_id"])
    root = merkle.folded(F.coalesce("changed", "leaf"))
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.proof_text(), 256).alias("proof_sha256"),
                        root.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


@query("op11_rollup_prefix_trie", prefix_trie.SQL)
def op11(spark, sf_dir):
    turns = prefix_trie.with_shared_heads(prefix_trie.ordered_turns(load(spark, sf_dir, "conversations")))
    trie = prefix_trie.prefix_trie(turns)
    ends = prefix_trie.ends_digest(trie.ends)
    return trie.nodes.join(ends, "key", "left").select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        F.col("saved_bytes").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


@query("op13_pivot_permutation_near_vectors", pivots.SQL)
def op13(spark, sf_dir):
    return pivots.near_vectors(load(spark, sf_dir, "embeddings"))
