"""The registered queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import langid, lattice, mixing, ogg, packing, pii, secrets, simhash, sql, tokens, urls
from .common import table

#: (host, path, verdict) of the url contract.
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
#: The same as the registered SQL has them: it blocks net/de/, against the contract, and is left unchanged until its owner decides (REPLY_r03.md).
SQL_URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "block"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def near_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(table(spark, sf_dir, "embeddings"), 0.93)


def mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), (3, 1, 2), 1.5, 2).select("doc_id", "size", "source_size", "target", "taken")


def pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), 2048)


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), 1024)


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def base_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can check of op5: all its columns but the spans that its method adds."""
    return personal_data(spark, sf_dir).drop("spans")


def language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learn = langid.may_learn()
    model = langid.fit(docs.where(learn))
    return langid.identify(docs, model).select("doc_id", (~learn).alias("held_out"), "lang_pred", "score", "ambiguous")


def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.media_columns(table(spark, sf_dir, "documents"))


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find(table(spark, sf_dir, "documents")))


def near_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, distance=2)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lattice_embeddings": near_embeddings,
    "op2_entropy_mix": mix,
    "op3_complement_pack": pack,
    "op4_token_counts": token_counts,
    "op5_bootstrap_pii": personal_data,
    "op6_ecoc_language": language,
    "op7_url_filter": url_filter,
    "op8_ogg_media": media,
    "op9_trigram_secrets": secret_scan,
    "op10_gray_simhash": near_documents,
    "base_personal_data": base_personal_data,
}

ORACLE: dict[str, str] = {
    "op7_url_filter": sql.url_filter(SQL_URL_RULES),
    "op9_trigram_secrets": sql.SECRETS,
    "base_personal_data": sql.BASE_PERSONAL_DATA,
    "op1_lattice_embeddings": """
        WITH RECURSIVE v AS (
          SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
          WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL),
        unit AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v),
        links AS (
          SELECT a.vec_id AS a, b.vec_id AS b FROM unit a JOIN unit b ON a.label = b.label AND a.vec_id <> b.vec_id
          WHERE a.n > 0 AND b.n > 0 AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.93),
        reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
        comp AS (SELECT a, min(b) AS c FROM reach GROUP BY a),
        deg AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT e.vec_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_links, least(e.vec_id, coalesce(c.c, e.vec_id)) AS component_id,
               e.vec_id = least(e.vec_id, coalesce(c.c, e.vec_id)) AS kept
        FROM embeddings e LEFT JOIN deg d ON e.vec_id = d.a LEFT JOIN comp c ON e.vec_id = c.a""",
}

