"""The registered queries of this package, over whole tables, and their SQL."""

from __future__ import annotations

from nightloom.llm import centroids, filter_audit, lines, oracles
from nightloom.llm.centroids import cluster_vectors
from nightloom.llm.common import table
from nightloom.llm.filter_audit import audit_filters
from nightloom.llm.histogram_packing import pack_by_histogram
from nightloom.llm.licenses import scan_licenses
from nightloom.llm.media import media_columns, media_digest
from nightloom.llm.mixing import mix_sources
from nightloom.llm.ngram_join import near_duplicates
from nightloom.llm.packing import pack
from nightloom.llm.secrets import scan_secrets
from nightloom.llm.topk import top_inner_products
from nightloom.llm.toxicity import held_out, score_toxicity
from nightloom.llm.url_filter import RULES, judge_urls


def op1_ngram_jaccard_join(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_line_dedup(spark, sf_dir):
    return lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "n_lines", "n_removed", "text")


def op3_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_toxicity(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic")).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op4_license_scans(spark, sf_dir):
    return scan_licenses(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_url_filters(spark, sf_dir):
    return judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op7_mix_sources(spark, sf_dir):
    return mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op8_secret_scans(spark, sf_dir):
    return scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op9_media_columns(spark, sf_dir):
    return media_digest(media_columns(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op10_top_inner_products(spark, sf_dir):
    return top_inner_products(table(spark, sf_dir, "embeddings"))


def op11_histogram_packing(spark, sf_dir):
    return pack_by_histogram(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_centroid_clustering(spark, sf_dir):
    return cluster_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op13_filter_audit(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return audit_filters(docs, table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join,
        op2_line_dedup,
        op3_toxicity,
        op4_license_scans,
        op5_best_fit_packing,
        op6_url_filters,
        op7_mix_sources,
        op8_secret_scans,
        op9_media_columns,
        op10_top_inner_products,
        op11_histogram_packing,
        op12_centroid_clustering,
        op13_filter_audit,
    )
}

ORACLE = {
    "op1_ngram_jaccard_join": oracles.NGRAM_JOIN,
    "op2_line_dedup": lines.SQL,
    "op6_url_filters": oracles.url_filters(RULES),
    "op7_mix_sources": oracles.MIX_SOURCES,
    "op10_top_inner_products": oracles.TOP_INNER_PRODUCTS,
    "op12_centroid_clustering": centroids.sql(),
    "op13_filter_audit": filter_audit.SQL,
}
