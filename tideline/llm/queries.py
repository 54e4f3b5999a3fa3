"""The queries of this subpackage's operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.llm.chat_format import format_chats, read_back
from tideline.llm.decontaminate import decontaminate
from tideline.llm.exact_dedup import exact_dedup
from tideline.llm.html_extract import extract_main_text
from tideline.llm.mixing import mix_sources
from tideline.llm.near_dup import near_dup
from tideline.llm.quality import score_quality
from tideline.llm.secrets_scan import scan_secrets
from tideline.llm.substring_dedup import substring_dedup
from tideline.llm.suffix_dedup import suffix_dedup
from tideline.llm.toxicity import score_toxicity
from tideline.llm.turn_repair import damaged, repair_turns
from tideline.llm.vector_codes import compress_vectors

QUERIES = {}
ORACLES = {}


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


@_query(
    "op6_exact_dedup",
    """
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
    """,
)
def op6(spark, sf_dir):
    return exact_dedup(_read(spark, sf_dir, "documents"))


@_query(
    "op8_decontaminate",
    r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    p AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS k FROM
            (SELECT item_id, w, least(13, len(w)) AS m, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
    m AS (SELECT DISTINCT m FROM p),
    x AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS k FROM
            (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, m WHERE len(w) >= m)),
    o AS (SELECT doc_id, x.m, i, item_id FROM x JOIN p ON x.m = p.m AND x.k = p.k),
    h AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM
            (SELECT DISTINCT doc_id, unnest(range(i, i + m)) AS pos FROM o) GROUP BY doc_id),
    n AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM
            (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM o) GROUP BY doc_id)
    SELECT d.doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
           CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) AS contaminated
    FROM d LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)
    """,
)
def op8(spark, sf_dir):
    return decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


@_query("op9_near_dup")
def op9(spark, sf_dir):
    return near_dup(_read(spark, sf_dir, "documents"))


@_query(
    "op4_substring_dedup",
    r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    x AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS k FROM
            (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
    l AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM x) WHERE r > 1),
    c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM l),
    s AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d),
    k AS (SELECT s.doc_id, count(*) AS n, string_agg(s.w[s.p], ' ' ORDER BY s.p) AS t FROM s ANTI JOIN c ON s.doc_id = c.doc_id AND s.p = c.p GROUP BY s.doc_id)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
    FROM d LEFT JOIN k USING (doc_id)
    """,
)
def op4(spark, sf_dir):
    return substring_dedup(_read(spark, sf_dir, "documents")).drop("kept_text")


@_query("op5_mixing")
def op5(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").withColumn("_members", F.array("source"))
    return mix_sources(docs, "_members").drop("members")


@_query(
    "op10_chat_format",
    r"""
    WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
               UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
    p AS (SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS l,
          length('### : </turn>') + 1 + length(replace(replace(replace(replace(role, '\', '\\'), '#', '\#'), '<', '\<'), ':', '\:'))
            + length(replace(replace(replace(text, '\', '\\'), '#', '\#'), '<', '\<')) AS n FROM c)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           CAST(sum(length(l)) AS BIGINT) AS loss_chars, sha256(string_agg(l, '' ORDER BY turn, role, text)) AS loss_sha256,
           CAST(sum(n) AS BIGINT) AS formatted_chars
    FROM p GROUP BY conv_id
    """,
)
def op10(spark, sf_dir):
    say = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", say), (-7, 1, "assistant", say)], "conv_id long, turn long, role string, text string")
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    rows = rows.withColumn("record", F.to_json(F.struct("turn", "role", "text")))
    return read_back(format_chats(rows, "conv_id", ["turn"], "record"))


@_query("op3_secrets_scan")
def op3(spark, sf_dir):
    return scan_secrets(_read(spark, sf_dir, "documents"))


@_query("op2_html_extract")
def op2(spark, sf_dir):
    return extract_main_text(_read(spark, sf_dir, "pages"))


@_query("op1_toxicity")
def op1(spark, sf_dir):
    return score_toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


@_query("op7_quality")
def op7(spark, sf_dir):
    return score_quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


@_query("op11_vector_codes")
def op11(spark, sf_dir):
    return compress_vectors(_read(spark, sf_dir, "embeddings"))[0]


@_query("op12_turn_repair")
def op12(spark, sf_dir):
    found = repair_turns(damaged(_read(spark, sf_dir, "conversations")))
    return found.withColumnRenamed("conv", "conv_id").withColumnRenamed("digest", "repaired_sha256")


@_query("op13_suffix_dedup")
def op13(spark, sf_dir):
    return suffix_dedup(_read(spark, sf_dir, "documents")).drop("kept")
