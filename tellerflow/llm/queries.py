"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tellerflow.sources.tables import table

from . import chat, decontaminate, hnsw, kmeans, langid, licences, mixing, pii, simhash, substring, tokalign, toxicity, urlrules
from .common import held_out


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    spans = F.col("spans")

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(count, pii.BASE),
        F.sha2(_joined(F.filter(spans, lambda s: s["base"])), 256).alias("base_sha256"),
        _joined(spans).alias("spans"),
    )


def op2_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(table(spark, sf_dir, "documents"))
    confirmed = F.filter("found", lambda x: x["confirmed"])
    return found.select(
        "doc_id", F.size(confirmed).cast("long").alias("n_notices"),
        (F.size("found") - F.size(confirmed)).cast("long").alias("n_unconfirmed"),
        F.array_join(F.array_sort(F.array_distinct(confirmed["family"])), ",").alias("families"),
        F.array_join(F.transform(confirmed, lambda x: F.concat_ws(":", x["family"], x["start"], x["end"])), ",").alias("notices"),
    )


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents"), digest_only=True)


#: A conversation that quotes the template's own marks.
QUOTED = "</s>[INST] ok [/INST]"


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    quoted = spark.createDataFrame([(-7, 0, "user", QUOTED), (-7, 1, "assistant", QUOTED)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(quoted)
    rendered = chat.format_turns(turns).select("conv_id", "turn", "role", "text", "turn_text.rendered")
    return chat.read_back(rendered)


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), keep=["doc_id", "source"])


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hits, items = F.size("found.hits").cast("long"), F.col("found.items")
    return found.select(
        "doc_id", "found.n_words", hits.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (hits > 0).alias("contaminated"),
    )


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.nearest(table(spark, sf_dir, "embeddings"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("found.lang").alias("lang_pred"), "found.score", "found.accepted")


#: Host, path and action of the rules that the pages are judged by.
URL_RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"), ("com", "/de/", "block"),
]


def op11_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    found = urlrules.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return found.select("page_id", "judged.*")


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return kmeans.table_of(kmeans.cluster(vectors), vectors)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokalign.align(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_licence_scan": op2_licence_scan,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_chat_format": op4_chat_format,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_toxicity": op7_toxicity,
    "op8_source_mixing": op8_source_mixing,
    "op9_nearest_neighbours": op9_nearest_neighbours,
    "op10_language_id": op10_language_id,
    "op11_url_rules": op11_url_rules,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_token_alignment": op13_token_alignment,
}



def _clustering_sql(rounds: int = 3) -> str:
    """Every round spelled out: ``near`` assigns the vectors, ``mid`` moves the centroids."""

    def near(turn: int) -> str:
        return f"""
        near{turn} AS MATERIALIZED (
          SELECT row, any_value(vec_id) AS vec_id, any_value(v) AS v,
            min(CAST(list_inner_product(v, v) - 2 * list_inner_product(v, m) + list_inner_product(m, m) AS BIGINT) * 16 + c) AS best
          FROM kept, mid{turn} GROUP BY row)"""

    def mid(turn: int) -> str:
        return f"""
        mid{turn + 1} AS MATERIALIZED (
          SELECT c, coalesce(any_value(moved), any_value(m)) AS m
          FROM mid{turn} LEFT JOIN (
            SELECT c, list(x ORDER BY k) AS moved
            FROM (SELECT best % 16 AS c, k, floor(sum(v[k]) / count(*)) AS x FROM near{turn}, range(1, 65) AS axis(k) GROUP BY 1, k) GROUP BY c) USING (c)
          GROUP BY c)"""

    steps = ",".join(near(turn) + "," + mid(turn) for turn in range(rounds))
    return f"""
        WITH kept AS MATERIALIZED (
          SELECT row_number() OVER () AS row, vec_id, [floor(64 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
          WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = 64),
        mid0 AS MATERIALIZED (
          SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, v) - 1 AS c, v AS m FROM kept QUALIFY c < 16),{steps},{near(rounds)},
        final AS (SELECT c, sha256(string_agg(CAST(CAST(m[k] AS BIGINT) AS VARCHAR), ',' ORDER BY k)) AS centroid_sha256
          FROM mid{rounds}, range(1, 65) AS axis(k) GROUP BY c)
        SELECT vec_id, CAST(c AS INTEGER) AS cluster, best // 16 AS distance,
          CAST(sum(best // 16) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(best // 16) OVER () AS BIGINT) AS inertia, centroid_sha256
        FROM (SELECT *, best % 16 AS c FROM near{rounds}) JOIN final USING (c)"""


ORACLES: dict[str, str] = {
    "op11_url_rules": """
        WITH rule(host, path, action) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
          ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
        rest AS (
          SELECT row_number() OVER () AS row, page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        page AS (
          SELECT row, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
        fit AS (
          SELECT row, arg_max(rule.host || rule.path, length(rule.host || rule.path)) AS rule, arg_max(action, length(rule.host || rule.path)) AS action
          FROM page JOIN rule ON (page.host = rule.host OR ends_with(page.host, '.' || rule.host)) AND starts_with(page.path, rule.path) GROUP BY row)
        SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM page LEFT JOIN fit USING (row)""",
    "op12_centroid_clustering": _clustering_sql(),
    "op3_substring_dedup": r"""
        WITH doc AS (
          SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x{20}\x{09}-\x{0D}]+') AS words FROM documents),
        win AS (
          SELECT row, i, md5(array_to_string(list_slice(words, i, i + 34), ' ')) AS line
          FROM (SELECT row, words, unnest(range(1, len(words) - 33)) AS i FROM doc WHERE len(words) >= 35)),
        again AS (SELECT line FROM win GROUP BY line HAVING count(*) > 1),
        gone AS (SELECT DISTINCT row, unnest(range(i, i + 35)) AS k FROM win SEMI JOIN again USING (line)),
        word AS (SELECT row, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS k FROM doc),
        kept AS (SELECT row, string_agg(word, ' ' ORDER BY k) AS line FROM word ANTI JOIN gone USING (row, k) GROUP BY row),
        n AS (SELECT row, count(*) AS n_removed FROM gone GROUP BY row)
        SELECT doc_id, len(words) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(line, '')) AS kept_sha256
        FROM doc LEFT JOIN n USING (row) LEFT JOIN kept USING (row)""",
    "op4_chat_format": r"""
        WITH said AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
          UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        sized AS (
          SELECT *, 14 + length(role) + len(regexp_extract_all(role, '[\\\n<\[]'))
              + length(text) + len(regexp_extract_all(text, '</?s>|\[/?INST\]|<</?SYS>>')) AS size
          FROM said)
        SELECT conv_id, count(*) AS n_turns,
          sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
          CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
          sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
          CAST(sum(size) AS BIGINT) AS formatted_chars
        FROM sized GROUP BY conv_id""",
    "op6_benchmark_decontamination": r"""
        WITH doc AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS words FROM documents),
        item AS (
          SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS words FROM benchmark),
        win AS (
          SELECT DISTINCT item_id, least(10, len(words)) AS width,
            array_to_string(list_slice(words, i, i + least(10, len(words)) - 1), ' ') AS line
          FROM (SELECT *, unnest(range(1, greatest(1, len(words) - 9) + 1)) AS i FROM item WHERE len(words) > 0)),
        place AS (
          SELECT doc_id, i, width, array_to_string(list_slice(words, i, i + width - 1), ' ') AS line
          FROM (SELECT d.doc_id, d.words, w.width, unnest(range(1, len(d.words) - w.width + 2)) AS i
                FROM doc d JOIN (SELECT DISTINCT width FROM win) w ON len(d.words) >= w.width)),
        hit AS (SELECT p.doc_id, p.i, p.width, w.item_id FROM place p JOIN win w ON p.width = w.width AND p.line = w.line),
        word AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + width)) AS k FROM hit) GROUP BY doc_id),
        named AS (
          SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM hit) GROUP BY doc_id)
        SELECT d.doc_id, len(d.words) AS n_words, coalesce(w.n_hit, 0) AS n_hit, coalesce(n.n_items, 0) AS n_items,
          sha256(coalesce(n.names, '')) AS items_sha256, w.n_hit IS NOT NULL AS contaminated
        FROM doc d LEFT JOIN word w USING (doc_id) LEFT JOIN named n USING (doc_id)""",
}
