"""Scalar functions over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import display, text
from lodestone.functions.metadata import MetadataField, reconstruct, rejected_keys, with_slots
from lodestone.functions.pricing import embed_cost, llm_cost
from lodestone.operators.skew import spread
from lodestone.sources.adapters import order_slots, table
from queries.common import Query, rounded

FIELDS = (
    MetadataField("priority", "str", 1),
    MetadataField("total", "num", 1),
    MetadataField("open", "bool", 1),
    MetadataField("ordered", "date", 1),
    MetadataField("tags", "arr", 1),
    MetadataField("bad", "num", 2),
)


def _slugs(spark, sf) -> DataFrame:
    name = F.concat_ws(" / ", "p_name", "p_brand", "p_type")
    return table(spark, sf, "part").select(
        "p_partkey",
        text.slugify(name).alias("slug"),
        text.slugify_ascii(name).alias("ascii_slug"),
        text.table_name(F.col("p_name"), F.sha2(F.col("p_partkey").cast("string"), 256)).alias("table_name"),
    )


def _names(spark, sf) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", text.name_from_uri(F.col("url")).alias("name"))


def _keys(spark, sf) -> DataFrame:
    return table(spark, sf, "customer").select(
        "c_custkey", text.hash_api_key(F.col("c_name")).alias("key_hash"), text.key_hint(F.col("c_name")).alias("key_hint")
    )


def _costs(spark, sf) -> DataFrame:
    n = F.col("o_orderkey")
    models = F.array(
        *[F.lit(m) for m in ("gpt-4o", "gpt-4o-mini", "gpt-4o-mini-20240718", "local-model", "unknown-model", "text-embedding-3-large")]
    )
    model = F.element_at(models, (n % 6 + 1).cast("int"))
    rows = table(spark, sf, "orders").select(
        "o_orderkey",
        embed_cost(model, n, ["local-model"]).alias("embed_usd"),
        llm_cost(model, n, n * 2, ["local-model"]).alias("llm_usd"),
    )
    return rounded(rows, 8, "embed_usd", "llm_usd")


def _prompts(spark, sf) -> DataFrame:
    turns = table(spark, sf, "conversations")
    header = F.when(F.col("turn") % 2 == 0, text.breadcrumb(F.concat(F.lit("# "), "role", F.lit("\n### Part ##x\n# "))))
    block = text.context_block(F.col("turn") + 1, F.col("role"), header, F.col("text"))
    prompt = text.render_prompt(F.lit("C: {{context}} Q: {{question}}"), block, F.col("role"))
    return turns.select("conv_id", "turn", prompt.alias("prompt"), text.embedded_text(header, F.col("text")).alias("embedded"))


def _labels(spark, sf) -> DataFrame:
    rows = table(spark, sf, "lineitem")
    seconds = F.col("l_partkey") % 50 * 1800 + F.lit(1800)
    mimes = F.array(*[F.lit(m) for m in ("application/pdf", "text/xml", "image/png", "plain")])
    return rows.select(
        "l_orderkey",
        "l_linenumber",
        display.mime_label(F.element_at(mimes, (F.col("l_partkey") % 4 + 1).cast("int"))).alias("mime"),
        display.interval_text(seconds).alias("every"),
        display.percent((F.col("l_linenumber") / F.lit(8.0))).alias("share"),
        display.friendly_uri(F.concat(F.lit("upload://"), "l_returnflag")).alias("uri"),
    )


def _time_ago(spark, sf) -> DataFrame:
    now = F.lit("1998-08-03 00:00:00").cast("timestamp")
    stamp = F.col("o_orderdate").cast("timestamp")
    return table(spark, sf, "orders").select("o_orderkey", display.time_ago(stamp, now).alias("ago"))


def _metadata_json():
    return F.concat(
        F.lit('{"priority":"'), "o_orderpriority", F.lit('","total":"'), F.col("o_orderkey"), F.lit('.5","open":"'),
        F.when(F.col("o_orderstatus") == "O", "Yes").otherwise("no"), F.lit('","ordered":"'),
        F.date_format("o_orderdate", "MM/dd/yyyy"), F.lit('","tags":["a","'), "o_orderstatus",
        F.lit('"],"bad":[1],"extra":{"x":1}}'),
    )


def _routed(spark, sf) -> DataFrame:
    rows = spread(table(spark, sf, "orders"), "o_orderkey").select("o_orderkey", _metadata_json().alias("metadata"))
    rows = with_slots(rows, "metadata", FIELDS)
    return rows.select(
        "o_orderkey",
        *[F.col(f.column).alias(f.name) for f in FIELDS if f.type != "arr"],
        F.array_join("metadata_arr_1", ",").alias("tags"),
        F.array_join(rejected_keys("metadata", FIELDS), ",").alias("rejected"),
    )


def _reconstructed(spark, sf) -> DataFrame:
    shown = [f for f in FIELDS if f.name in ("priority", "open", "ordered")]
    return order_slots(spark, sf).select("o_orderkey", reconstruct(shown).alias("metadata"))


QUERIES = {
    "slugs": Query(
        _slugs,
        """WITH p AS (SELECT *, p_name || ' / ' || p_brand || ' / ' || p_type AS name FROM part)
           SELECT p_partkey, trim(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '_') AS slug,
                  lower(trim(regexp_replace(name, '[^a-zA-Z0-9]+', '_', 'g'), '_')) AS ascii_slug,
                  trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_') || '_'
                    || left(sha256(CAST(p_partkey AS VARCHAR)), 8) AS table_name FROM p""",
    ),
    "name_from_uri": Query(
        _names,
        r"""SELECT page_id, regexp_replace(regexp_extract(regexp_replace(url, '/+$', ''), '([^/]*)$', 1), '\.[^.]*$', '') AS name
            FROM pages""",
    ),
    "api_key_hash": Query(
        _keys, "SELECT c_custkey, sha256(c_name) AS key_hash, right(c_name, 4) AS key_hint FROM customer"
    ),
    "token_cost": Query(
        _costs,
        """SELECT o_orderkey,
             round(CASE o_orderkey % 6 WHEN 3 THEN 0e0 WHEN 5 THEN o_orderkey / 1e6 * 0.13e0 END, 8) AS embed_usd,
             round(CASE o_orderkey % 6 WHEN 0 THEN o_orderkey / 1e6 * 2.5e0 + o_orderkey * 2 / 1e6 * 10e0
                        WHEN 1 THEN o_orderkey / 1e6 * 0.15e0 + o_orderkey * 2 / 1e6 * 0.6e0
                        WHEN 2 THEN o_orderkey / 1e6 * 0.15e0 + o_orderkey * 2 / 1e6 * 0.6e0
                        WHEN 3 THEN 0e0 END, 8) AS llm_usd FROM orders""",
    ),
    "prompt_text": Query(
        _prompts,
        """WITH t AS (SELECT *, CASE WHEN turn % 2 = 0 THEN role || ' > Part ##x' END AS header FROM conversations)
           SELECT conv_id, turn,
                  replace('C: [Source ' || (turn + 1) || ': ' || role || ']' || chr(10)
                    || coalesce('[Section: ' || header || ']' || chr(10), '') || text || ' Q: {{question}}', '{{question}}', role) AS prompt,
                  coalesce(header || chr(10), '') || text AS embedded FROM t""",
    ),
    "display_labels": Query(
        _labels,
        """WITH l AS (SELECT *, l_partkey % 50 * 1800 + 1800 AS s FROM lineitem)
           SELECT l_orderkey, l_linenumber,
             CASE l_partkey % 4 WHEN 0 THEN 'PDF' WHEN 1 THEN 'XML' WHEN 2 THEN 'png' ELSE 'plain' END AS mime,
             CASE WHEN s % 86400 = 0 THEN (s // 86400) || ' day' || CASE WHEN s // 86400 = 1 THEN '' ELSE 's' END
                  WHEN s % 3600 = 0 THEN (s // 3600) || ' hour' || CASE WHEN s // 3600 = 1 THEN '' ELSE 's' END
                  ELSE (s // 60) || ' minutes' END AS every,
             printf('%.1f', l_linenumber / 8.0 * 100) || '%' AS share, l_returnflag AS uri FROM l""",
    ),
    "time_ago": Query(
        _time_ago,
        """WITH o AS (SELECT o_orderkey, o_orderdate,
                      (epoch(TIMESTAMP '1998-08-03') - epoch(o_orderdate)) / 60 AS m FROM orders)
           SELECT o_orderkey, CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN CAST(floor(m) AS BIGINT) || 'm ago'
             WHEN m < 1440 THEN CAST(floor(m / 60) AS BIGINT) || 'h ago'
             WHEN m < 10080 THEN CAST(floor(m / 1440) AS BIGINT) || 'd ago'
             ELSE strftime(o_orderdate, '%b %-d, %Y') END AS ago FROM o""",
    ),
    "metadata_routing": Query(
        _routed,
        """SELECT o_orderkey, o_orderpriority AS priority, o_orderkey + 0.5e0 AS total, o_orderstatus = 'O' AS open,
                  CAST(epoch(o_orderdate) AS BIGINT) AS ordered, CAST(NULL AS DOUBLE) AS bad,
                  'a,' || o_orderstatus AS tags, 'bad,extra' AS rejected FROM orders""",
    ),
    "metadata_reconstruction": Query(
        _reconstructed,
        """SELECT o_orderkey, '{"open":' || CAST(o_orderstatus = 'O' AS VARCHAR) || ',"ordered":"'
             || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') || '"'
             || CASE WHEN o_orderstatus <> 'P' THEN ',"priority":"' || o_orderpriority || '"' ELSE '' END || '}' AS metadata
           FROM orders""",
    ),
}
