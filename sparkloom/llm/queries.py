"""The pN_ queries, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import encoding, leakage, lookalike, mixing, neardup, packing, quality


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.duplicate_pairs(_table(spark, sf_dir, "documents"))


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.duplicate_groups(_table(spark, sf_dir, "documents"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.not_prose(*(_table(spark, sf_dir, t) for t in ("documents", "doc_labels", "common_words")))


def p2_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.text_quality(*(_table(spark, sf_dir, t) for t in ("documents", "doc_labels", "common_words")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(_table(spark, sf_dir, "pack_records"), _table(spark, sf_dir, "pack_limits"))
    return packed.where("pieces > 1").select("record_id").distinct()


def p3_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "pack_records"), _table(spark, sf_dir, "pack_limits"))


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_report(p3_packed(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, report = mixing.mix(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "mix_targets"))
    return report.where("not reachable").select("source")


def p4_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "mix_targets"))[0]


def p4_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "mix_targets"))[1]


def p5_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.encode_corpus(_table(spark, sf_dir, "documents"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaking_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_items"))


def p6_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_items"))


def p6_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.clean(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_items")).select("doc_id")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.look_alike_pairs(_table(spark, sf_dir, "documents"))


def p7_one_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.normalized(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "one_form")


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_groups, p2_found, p2_stats, p3_found, p3_packed, p3_report, p4_found, p4_uses, p4_shares, p5_ids, p6_found, p6_matches, p6_clean, p7_found, p7_one_form)
}
ORACLES: dict[str, str] = {
    "p3_found": """
        SELECT DISTINCT record_id FROM pack_records JOIN pack_limits USING (tool)
        WHERE len(input_ids) > max_length""",
    "p4_found": r"""
        WITH d AS (SELECT lower(regexp_replace(source, '^\s+|\s+$', '', 'g')) AS source, length(text) AS n FROM documents),
        s AS (SELECT t.source, t.weight, t.max_repeats, coalesce(sum(d.n), 0) AS chars FROM mix_targets t LEFT JOIN d USING (source) GROUP BY ALL)
        SELECT source FROM s
        WHERE max_repeats * chars < weight / (SELECT sum(weight) FROM s) * (SELECT sum(chars) FROM s)""",
}
