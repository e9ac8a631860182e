"""Registered queries of the catalogue engine and their DuckDB equivalents.

The driver tables hold no assets, so each query applies an operator to tables of the same
shape: documents stand for contents, parts for variants of a family, and so on.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithos.functions import intervals as iv
from lithos.functions import names as fn
from lithos.operators import dedup, placement, records, search, selection
from lithos.plans import catalog
from lithos.sources import files, samples
from lithos.sources.settings import toggled
from lithos.storage import shared_dir
from lithos.streaming import incremental
from lithos.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL where there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as assets: fingerprint of the text, id as path."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return dedup.fingerprint(docs, "text")


def _variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as variants: brand and type name the family, a third of them is in the catalog."""
    p = table(spark, sf_dir, "part")
    return p.select(
        "p_brand", "p_type", (F.col("p_partkey") % 3 == 0).alias("is_existing"), (F.col("p_size") % 5 + 1).cast("int").alias("prio"),
        (F.floor(F.col("p_retailprice") / 100) / 4).alias("version"), F.floor("p_retailprice").cast("int").alias("glyphs"), F.length("p_name").alias("coverage_n"),
        (F.col("p_partkey") % 9).cast("int").alias("metadata"), (F.col("p_partkey") % 7 == 0).alias("is_variable"), (F.col("p_partkey") % 1000).alias("crc32"),
        F.lpad(F.col("p_partkey").cast("string"), 10, "0").alias("path"),
    )


_VARIANTS = """v AS (SELECT p_brand, p_type, p_partkey % 3 = 0 AS is_existing, p_size % 5 + 1 AS prio, floor(p_retailprice / 100) / 4 AS version,
    CAST(floor(p_retailprice) AS INT) AS glyphs, length(p_name) AS coverage_n, p_partkey % 9 AS metadata, p_partkey % 7 = 0 AS is_variable,
    p_partkey % 1000 AS crc32, lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS path FROM part)"""
_BEST_FIRST = "prio DESC, version DESC, glyphs DESC, coverage_n DESC, metadata DESC, crc32, path"
#: The selection rule stated by windows, independent of the aggregates in the operator.
_SELECTED = f"""{_VARIANTS},
    r AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type, is_existing ORDER BY {_BEST_FIRST}) AS rk FROM v),
    k AS (SELECT p_brand, p_type, prio AS kp, version AS kv, glyphs AS kg, coverage_n AS kc, metadata AS km, crc32 AS kx, path AS kpath FROM r WHERE is_existing AND rk = 1),
    c AS (SELECT p_brand, p_type, prio AS cp, version AS cv, glyphs AS cg, coverage_n AS cc, metadata AS cm, crc32 AS cx, path AS cpath, is_variable AS cvar FROM r WHERE NOT is_existing AND rk = 1),
    g AS (SELECT p_brand, p_type, bool_or(is_existing AND is_variable) AS old_var FROM v GROUP BY ALL),
    j AS (SELECT r.*, k.*  EXCLUDE (p_brand, p_type), c.* EXCLUDE (p_brand, p_type), old_var,
            cpath IS NOT NULL AND (kpath IS NULL OR (cp, cv, cg, cc, cm, -cx) > (kp, kv, kg, kc, km, -kx)) AS top_new
          FROM r JOIN g USING (p_brand, p_type) LEFT JOIN k USING (p_brand, p_type) LEFT JOIN c USING (p_brand, p_type)),
    b AS (SELECT *, CASE WHEN top_new THEN cp ELSE kp END AS bp, CASE WHEN top_new THEN cv ELSE kv END AS bv, CASE WHEN top_new THEN cg ELSE kg END AS bg,
            CASE WHEN top_new THEN cc ELSE kc END AS bc, CASE WHEN top_new THEN cm ELSE km END AS bm, CASE WHEN top_new THEN cpath ELSE kpath END AS winner FROM j),
    w AS (SELECT *, coalesce(bool_or(is_variable AND prio < bp) OVER (PARTITION BY p_brand, p_type, is_existing ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS earlier_var FROM b),
    s AS (SELECT p_brand, p_type, path, is_existing, winner, is_existing OR (top_new AND rk = 1)
            OR (prio < bp AND (version > bv OR glyphs > bg OR coverage_n > bc OR metadata > bm
                OR (is_variable AND NOT old_var AND NOT (top_new AND cvar) AND NOT earlier_var))) AS kept FROM w)"""


@query("SELECT min(doc_id) AS representative, count(*) AS copies, array_to_string(list_sort(list(doc_id)), ',') AS paths FROM documents GROUP BY text")
def exact_dedup(spark, sf_dir):
    groups = dedup.exact_groups(_contents(spark, sf_dir), ["file_size", "crc32", "sha256"], "doc_id")
    return groups.select("representative", "copies", F.array_join(F.col("paths").cast("array<string>"), ",").alias("paths"))


@query("SELECT n.doc_id, min(e.doc_id) AS matched FROM documents n JOIN documents e ON n.text = e.text WHERE n.doc_id % 2 = 1 AND e.doc_id % 2 = 0 GROUP BY n.doc_id")
def match_existing(spark, sf_dir):
    c = _contents(spark, sf_dir)
    return dedup.match_existing(c.filter("doc_id % 2 = 1"), c.filter("doc_id % 2 = 0"), ["file_size", "crc32", "sha256"], "doc_id").select("doc_id", "matched")


@query("SELECT doc_id FROM documents WHERE doc_id % 2 = 1 AND text NOT IN (SELECT text FROM documents WHERE doc_id % 2 = 0)")
def unmatched_new(spark, sf_dir):
    c = _contents(spark, sf_dir)
    return dedup.unmatched(c.filter("doc_id % 2 = 1"), c.filter("doc_id % 2 = 0"), ["file_size", "crc32", "sha256"]).select("doc_id")


@query("SELECT c_name AS path FROM customer WHERE upper(c_name) NOT IN (SELECT upper(c_name) FROM customer WHERE c_nationkey < 10)")
def resume_anti(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    done = c.filter("c_nationkey < 10").select(F.lower("c_name").alias("path"))
    return dedup.not_yet_done(c.select(F.col("c_name").alias("path")), done, "path")


@query(f"WITH {_VARIANTS} SELECT * EXCLUDE (rk) FROM (SELECT p_brand, p_type, path, prio, version, glyphs, coverage_n, metadata, count(*) OVER (PARTITION BY p_brand, p_type) AS variants, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY {_BEST_FIRST}) AS rk FROM v) WHERE rk = 1")
def best_version(spark, sf_dir):
    return selection.best_version(_variants(spark, sf_dir), ["p_brand", "p_type"])


@query(f"WITH {_SELECTED} SELECT p_brand, p_type, path, is_existing, winner, kept FROM s")
def best_version_additive(spark, sf_dir):
    return selection.additive_selection(_variants(spark, sf_dir), ["p_brand", "p_type"]).select("p_brand", "p_type", "path", "is_existing", "winner", "kept")


@query(f"WITH {_SELECTED} SELECT p_brand, p_type, winner, array_to_string(list_sort(list(path) FILTER (NOT kept)), ',') AS merged, count(*) FILTER (NOT kept) AS losers FROM s GROUP BY p_brand, p_type, winner HAVING count(*) FILTER (NOT kept) > 0")
def loser_paths_merge(spark, sf_dir):
    chosen = selection.additive_selection(_variants(spark, sf_dir), ["p_brand", "p_type"])
    merged = selection.merged_paths(chosen, ["p_brand", "p_type"]).filter("losers > 0")
    return merged.select("p_brand", "p_type", "winner", F.array_join("merged", ",").alias("merged"), "losers")


@query("""WITH f AS (SELECT CASE WHEN length(text) < 12 THEN 'too small' WHEN length(text) > 4000 THEN 'too large' WHEN row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 THEN 'duplicate' ELSE 'added' END AS reason FROM documents)
    SELECT reason, count(*) AS n FROM f GROUP BY reason""")
def rejection_accounting(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("size"), F.sha2("text", 256).alias("sha"))
    sized = d.withColumn("reason", F.when(F.col("size") < 12, "too small").when(F.col("size") > 4000, "too large"))
    first = d.groupBy("sha").agg(F.min("doc_id").alias("first"))
    told = sized.join(first, "sha").withColumn("reason", F.coalesce("reason", F.when(F.col("doc_id") > F.col("first"), "duplicate"), F.lit("added")))
    return dedup.rejections(told, "reason")


@query("SELECT p_partkey FROM part WHERE contains(lower(concat_ws(chr(10), p_name, p_brand, p_type)), 'brand#2')")
def search_substring(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.filter(search.has_text([F.col("p_name"), F.col("p_brand"), F.col("p_type")], "  Brand#2 ")).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_partkey % 7 = 0 AND p_size % 3 <> 0 AND p_brand <> 'x' AND p_type LIKE '%E%' AND contains(lower(p_type), 'o')")
def search_combined(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumns({"is_variable": F.col("p_partkey") % 7 == 0, "install_state": F.col("p_size") % 3, "ext": F.when(F.contains("p_type", F.lit("E")), "otf").otherwise("ttf")})
    request = search.Request(needle="O", ext="otf", variable_only=True, installed_only=True)
    return search.matching(p, request, ["p_type"]).select("p_partkey")


def _families_sql(order: str) -> str:
    return f"SELECT upper(p_brand) AS family_key, min(p_brand) AS family, count(*) AS variants, max(p_size) AS max_glyphs FROM part GROUP BY 1 ORDER BY {order}"


def _families(spark, sf_dir, sort):
    return search.search(table(spark, sf_dir, "part"), search.Request(sort=sort), [], "p_brand", "p_size", "p_partkey")


@query(_families_sql("1"))
def family_by_name(spark, sf_dir):
    return _families(spark, sf_dir, "name")


@query(_families_sql("4 DESC, 1"))
def family_by_max(spark, sf_dir):
    return _families(spark, sf_dir, "glyphs")


@query(_families_sql("3 DESC, 1"))
def family_by_count(spark, sf_dir):
    return _families(spark, sf_dir, "variants")


@query("SELECT upper(p_brand) AS family_key, min(p_brand) AS family, count(*) AS variants, max(p_size) AS max_glyphs, true AS is_favourite FROM part WHERE p_brand IN (SELECT p_brand FROM part WHERE p_size = 50 AND p_partkey % 4 = 0) GROUP BY 1")
def favourites_only(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    liked = p.filter("p_size = 50 and p_partkey % 4 = 0").select(F.lower("p_brand").alias("p_brand"))
    return search.search(p, search.Request(favourites_only=True), [], "p_brand", "p_size", "p_partkey", liked)


@query("SELECT count(*) FILTER (contains(lower(concat_ws(chr(10), p_name, p_type)), 'large')) AS visible, count(*) AS total FROM part")
def visible_total(spark, sf_dir):
    return search.visible_total(table(spark, sf_dir, "part"), search.Request(needle="Large"), ["p_name", "p_type"])


# The wording, stated apart from the engine's lists.
_LICENCE = """CASE WHEN len(list_filter(['open font license', 'openfontlicense', 'ofl.txt', 'scripts.sil.org/ofl', 'apache license', 'gnu general public',
        'gnu lesser general public', 'gpl', 'ubuntu font licence', 'ubuntu font license', 'creative commons', 'cc0', 'public domain', 'mit license',
        'the unlicense', 'wtfpl'], lambda x: contains(lower(text), x))) > 0 THEN 'Free' WHEN doc_id % 50 = 7 THEN 'Paid'
    WHEN len(list_filter(['all rights reserved', 'may not be', 'is not permitted', 'without permission', 'commercial', 'purchase', 'eula',
        'end user license', 'end-user license', 'license agreement', 'licensed to', 'proprietary', 'unauthorized', 'unauthorised', 'is prohibited'],
        lambda x: contains(lower(text), x))) > 0 THEN 'Paid' ELSE 'Unknown' END"""


@query(f"SELECT doc_id, {_LICENCE} AS licence FROM documents")
def licence_class(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    bit = F.when(F.col("doc_id") % 50 == 7, 2).otherwise(0)
    return d.select("doc_id", fn.licence_class(F.lit(""), F.col("text"), F.lit(""), bit).alias("licence"))


@query(r"SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(lower('  ' || p_name || ' ' || p_type), ' '), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) > 0), ' ') AS key FROM part")
def norm_key(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", fn.normal_name(F.concat(F.lit("  "), "p_name", F.lit(" "), "p_type")).alias("key"))


@query(r"""SELECT page_id, CASE WHEN length(x) > 0 THEN x ELSE '-' END AS component FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '[\x00-\x1f"<>|:*?\\/]', '-', 'g'), '[. ]+$', ''), '^\s+|\s+$', '', 'g') AS x FROM pages)""")
def sanitize(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", fn.path_component(F.col("url")).alias("component"))


@query("SELECT p_partkey, upper(substr(p_name, 1, 1)) || '/' || p_name || '/' || replace(p_name, '_', '-') || '_' || replace(p_type, '_', '-') || '_v' || p_size || '_g' || p_partkey || '.otf' AS target FROM part WHERE regexp_matches(p_name, '^[A-Za-z]') UNION ALL SELECT p_partkey, '#/' || p_name || '/' || replace(p_name, '_', '-') || '_' || replace(p_type, '_', '-') || '_v' || p_size || '_g' || p_partkey || '.otf' FROM part WHERE NOT regexp_matches(p_name, '^[A-Za-z]')")
def build_path(spark, sf_dir):
    path = fn.vault_path(F.col("p_name"), F.col("p_type"), F.col("p_size").cast("string"), F.col("p_partkey"), F.lit("otf"))
    return table(spark, sf_dir, "part").select("p_partkey", path.alias("target"))


@query("SELECT doc_id, CASE WHEN regexp_matches(upper(substr(strip_accents(text), 1, 1)), '^[A-Z]$') THEN upper(substr(strip_accents(text), 1, 1)) ELSE '#' END AS letter FROM documents")
def first_letter(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fn.sorting_letter(F.col("text")).alias("letter"))


@query(r"SELECT page_id, coalesce(try_cast(regexp_extract(url, '[0-9]+(\.[0-9]+)?') AS DOUBLE), 0.0) AS version FROM pages")
def version_number(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", fn.version_number(F.col("url")).alias("version"))


#: One file named after the other, in the order of its key, against the names used so far.
_NAMED = """WITH RECURSIVE b AS (SELECT c_custkey, c_custkey // 40 AS g, row_number() OVER (PARTITION BY c_custkey // 40 ORDER BY c_custkey) AS n,
        CASE WHEN c_custkey % 2 = 0 THEN 'Group' || c_custkey // 40 ELSE 'GROUP' || c_custkey // 40 || CASE WHEN c_custkey % 3 = 0 THEN '_c' || c_custkey % 5 ELSE '' END END AS stem,
        '_c' || c_custkey % 5 AS suffix FROM customer),
    o AS (SELECT g, n, stem || '.otf' AS name, 0 AS at FROM b UNION ALL SELECT g, n, stem || suffix || '.otf', 1 FROM b
          UNION ALL SELECT g, n, stem || suffix || '_' || k || '.otf', k FROM b, (SELECT unnest(range(2, 42)) AS k)),
    w(g, n, used, target) AS (SELECT DISTINCT g, CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), '' FROM b
        UNION ALL SELECT g, n + 1, list_append(used, upper(name)), name FROM (
            SELECT w.g, w.n, w.used, arg_min(o.name, o.at) AS name FROM w JOIN o ON o.g = w.g AND o.n = w.n + 1 AND NOT list_contains(w.used, upper(o.name)) GROUP BY ALL))
    SELECT c_custkey, target FROM b JOIN w USING (g, n)"""


@query(_NAMED)
def path_collision(spark, sf_dir):
    """Forty customers a group, whose names differ in case or are others' names with a suffix."""
    c = table(spark, sf_dir, "customer").withColumn("no", F.floor(F.col("c_custkey") / 40).cast("string"))
    marked = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("_c"), (F.col("c_custkey") % 5).cast("string"))).otherwise("")
    base = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("Group"), "no")).otherwise(F.concat(F.lit("GROUP"), "no", marked))
    suffix = F.concat(F.lit("_c"), (F.col("c_custkey") % 5).cast("string"))
    return placement.resolve_collisions(c.select("c_custkey", F.concat(base, F.lit(".otf")).alias("base")), "base", suffix, "c_custkey").select("c_custkey", "target")


@query("""SELECT doc_id, CAST((length(text) > 0)::INT + (length(lang) > 0)::INT + (length(source) > 0)::INT + (quality IS NOT NULL)::INT AS INT) AS score
    FROM documents LEFT JOIN labels USING (doc_id)""")
def metadata_score(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.select("doc_id", fn.metadata_score([F.col("text"), F.col("lang"), F.col("source")], F.col("quality").isNotNull()).cast("int").alias("score"))


@query(r"""SELECT conv_id, name FROM (SELECT conv_id, trim(text) AS name, row_number() OVER (PARTITION BY conv_id ORDER BY CASE role WHEN 'assistant' THEN 4 WHEN 'user' THEN 3 ELSE 1 END DESC, turn) AS k
    FROM (SELECT conv_id, turn, role, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM conversations) WHERE length(text) > 0) WHERE k = 1""")
def best_name_record(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    rank = F.when(F.col("role") == "assistant", 4).when(F.col("role") == "user", 3).otherwise(1)
    return records.best_names(c, ["conv_id"], rank, "text", "turn")


_POINTS = "p AS (SELECT DISTINCT doc_id, unnest(list_transform(string_split(text, ''), lambda x: unicode(x))) AS cp FROM documents WHERE length(text) > 0)"
_RUNS = f"{_POINTS}, q AS (SELECT doc_id, cp, cp - row_number() OVER (PARTITION BY doc_id ORDER BY cp) AS k FROM p), i AS (SELECT doc_id, CAST(min(cp) AS INT) AS \"start\", CAST(max(cp) AS INT) AS \"end\" FROM q GROUP BY doc_id, k)"


def _coverage(spark, sf_dir):
    """(doc_id, coverage) of documents with text, within the row: nothing is shuffled."""
    d = table(spark, sf_dir, "documents").filter(F.length("text") > 0)
    return d.select("doc_id", iv.runs_of(fn.distinct_codepoints(F.col("text"))).alias("coverage"))


@query(f"WITH {_RUNS} SELECT doc_id, \"start\", \"end\" FROM i")
def codepoint_intervals(spark, sf_dir):
    return _coverage(spark, sf_dir).select("doc_id", F.inline("coverage"))


@query(f"WITH {_RUNS} SELECT doc_id, CAST(sum(\"end\" - \"start\" + 1) AS BIGINT) AS covered FROM i GROUP BY doc_id")
def coverage_count(spark, sf_dir):
    return _coverage(spark, sf_dir).select("doc_id", iv.covered(F.col("coverage")).alias("covered"))


_BLOCKS = "bl(block_start, block_end, block) AS (VALUES " + ", ".join(f"({a}, {b}, '{n}')" for a, b, n in iv.BLOCKS) + ")"
_COVER = f"{_RUNS}, {_BLOCKS}, d AS (SELECT DISTINCT doc_id FROM i), c AS (SELECT d.doc_id, block_start, block, block_end - block_start + 1 AS size, CAST(coalesce(sum(CASE WHEN \"start\" IS NOT NULL THEN least(\"end\", block_end) - greatest(\"start\", block_start) + 1 END), 0) AS BIGINT) AS present FROM d CROSS JOIN bl LEFT JOIN i ON i.doc_id = d.doc_id AND \"start\" <= block_end AND \"end\" >= block_start GROUP BY ALL)"


@query(f"WITH {_COVER} SELECT doc_id, block_start, block, size, present FROM c")
def block_coverage(spark, sf_dir):
    return iv.presence(_block_counts(spark, sf_dir), "counts", ["doc_id"])


def _block_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter(F.length("text") > 0)
    return d.select("doc_id", iv.block_counts(fn.distinct_codepoints(F.col("text"))).alias("counts"))


@query(f"WITH {_COVER} SELECT doc_id, arg_min(block, (CASE WHEN present = 0 THEN 1 ELSE 0 END) * 10000000 + block_start) AS block FROM c GROUP BY doc_id")
def first_block(spark, sf_dir):
    return _block_counts(spark, sf_dir).select("doc_id", iv.first_of(F.col("counts")).alias("block"))


@query("SELECT doc_id, contains(text, 'é') AS has_e_acute FROM documents WHERE length(text) > 0")
def point_in_interval(spark, sf_dir):
    return _coverage(spark, sf_dir).select("doc_id", iv.contains_point(F.col("coverage"), F.lit(0xE9)).alias("has_e_acute"))


@query(f"""WITH {_POINTS}, r AS (SELECT doc_id, cp, row_number() OVER (PARTITION BY doc_id ORDER BY cp) - 1 AS k FROM p)
    SELECT doc_id, CAST(k // 16 AS INT) AS row_no, array_to_string(list_resize(list(cp ORDER BY cp), 16, -1), ',') AS cells FROM r GROUP BY doc_id, k // 16""")
def grid_rows(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(iv.rows_of(fn.distinct_codepoints(F.col("text")))).alias("row_no", "cells"))
    return d.select("doc_id", "row_no", F.array_join(F.col("cells").cast("array<string>"), ",").alias("cells"))


@query("""WITH s AS (SELECT user_id, CAST(floor(epoch(ts) / 60) AS BIGINT) AS a, CAST(floor(epoch(ts) / 60) AS BIGINT) + CAST(floor(value) AS BIGINT) % 240 AS b FROM events),
    o AS (SELECT *, coalesce(CAST(a > max(b) OVER w + 1 AS INT), 1) AS n FROM s WINDOW w AS (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    g AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM o)
    SELECT user_id, min(a) AS "start", max(b) AS "end" FROM g GROUP BY user_id, k""")
def interval_merge(spark, sf_dir):
    minute = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 60)
    e = table(spark, sf_dir, "events").select("user_id", minute.alias("start"), (minute + F.floor("value") % 240).alias("end"))
    return iv.merge(e, ["user_id"])


def _states(spark, sf_dir):
    c, keys = _contents(spark, sf_dir), ["file_size", "crc32", "sha256"]
    own = c.filter("doc_id % 10 = 3").select(*keys)
    system = c.filter("doc_id % 10 in (4, 5)").select(*keys)
    return placement.install_states(c, own, system)


_STATES = """st AS (SELECT doc_id, lang, CASE WHEN text IN (SELECT text FROM documents WHERE doc_id % 10 = 3) THEN 1 WHEN text IN (SELECT text FROM documents WHERE doc_id % 10 IN (4, 5)) THEN 2 ELSE 0 END AS install_state FROM documents)"""


@query(f"WITH {_STATES} SELECT doc_id, install_state FROM st")
def install_state(spark, sf_dir):
    return _states(spark, sf_dir).select("doc_id", "install_state")


@query(f"WITH {_STATES} SELECT lang, count(*) FILTER (install_state <> 0) AS installed, count(*) AS members, bool_and(install_state <> 0) AS all_installed FROM st GROUP BY lang")
def install_summary(spark, sf_dir):
    return placement.install_summary(_states(spark, sf_dir), ["lang"])


@query("SELECT count(*) AS catalog_files, CAST(sum(n_chars) AS BIGINT) AS catalog_bytes, count(*) AS disk_files, CAST(sum(length(text)) AS BIGINT) AS disk_bytes, sum(n_chars) = sum(length(text)) AS valid FROM documents")
def catalog_validation(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return catalog.validate(d.select(F.col("n_chars").alias("file_size")), d.select(F.length("text").cast("bigint").alias("file_size")))


@query(r"SELECT doc_id, CASE WHEN n < 1024 THEN n || 'B' WHEN n < 1048576 THEN regexp_replace(CAST(round(n / 1024.0, 1) AS DOUBLE)::VARCHAR, '\.0$', '') || 'KB' WHEN n < 1073741824 THEN regexp_replace(CAST(round(n / 1048576.0, 1) AS DOUBLE)::VARCHAR, '\.0$', '') || 'MB' ELSE regexp_replace(CAST(round(n / 1073741824.0, 1) AS DOUBLE)::VARCHAR, '\.0$', '') || 'GB' END AS shown FROM (SELECT doc_id, n_chars * n_chars AS n FROM documents)")
def human_size(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fn.human_size(F.col("n_chars") * F.col("n_chars")).alias("shown"))


@query("""SELECT p_partkey, CASE WHEN contains(s, 'extrabold') OR contains(s, 'ultrabold') THEN 800 WHEN contains(s, 'semibold') OR contains(s, 'demi') THEN 600 WHEN contains(s, 'black') OR contains(s, 'heavy') THEN 900
    WHEN contains(s, 'bold') THEN 700 WHEN contains(s, 'extralight') OR contains(s, 'ultralight') THEN 200 WHEN contains(s, 'light') THEN 300 WHEN contains(s, 'medium') THEN 500 WHEN contains(s, 'thin') THEN 100 ELSE 400 END AS weight,
    CASE WHEN contains(s, 'italic') OR contains(s, 'oblique') THEN 'Italic' ELSE 'Normal' END AS slant
    FROM (SELECT p_partkey, lower(p_type || CASE p_size % 8 WHEN 0 THEN ' DemiBold' WHEN 1 THEN ' Black Italic' WHEN 2 THEN ' Bold' WHEN 3 THEN ' UltraLight' WHEN 4 THEN ' Light Oblique' WHEN 5 THEN ' Thin' WHEN 6 THEN ' ExtraBold' ELSE '' END) AS s FROM part)""")
def weight_from_style(spark, sf_dir):
    words = F.element_at(F.array(*[F.lit(w) for w in (" DemiBold", " Black Italic", " Bold", " UltraLight", " Light Oblique", " Thin", " ExtraBold", "")]), F.col("p_size") % 8 + 1)
    style = F.concat("p_type", words)
    return table(spark, sf_dir, "part").select("p_partkey", fn.style_weight(style).alias("weight"), fn.style_slant(style).alias("slant"))


@query("SELECT conv_id, array_to_string(list(role ORDER BY t), ',') AS tags FROM (SELECT conv_id, role, min(turn) AS t FROM conversations GROUP BY ALL) GROUP BY conv_id")
def feature_distinct(spark, sf_dir):
    tags = records.distinct_in_order(table(spark, sf_dir, "conversations"), ["conv_id"], "role", "turn")
    return tags.select("conv_id", F.array_join("tags", ",").alias("tags"))


@query("SELECT o_orderstatus AS tag, count(DISTINCT o_orderkey) AS lookup_count, string_agg(DISTINCT o_orderpriority, ', ' ORDER BY o_orderpriority) AS lookup_types FROM orders GROUP BY 1")
def feature_summary(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("tag"), F.col("o_orderkey").alias("lookup"), F.col("o_orderpriority").alias("kind"))
    return records.feature_summary(o, [])


@query("SELECT l_suppkey, glyph, components FROM (SELECT l_suppkey, l_linenumber AS glyph, l_returnflag || l_linestatus AS components, row_number() OVER (PARTITION BY l_suppkey ORDER BY min(l_orderkey), l_linenumber, l_returnflag || l_linestatus) AS k FROM lineitem GROUP BY 1, 2, 3) WHERE k <= 20")
def ligature_report(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_linenumber").alias("glyph"), F.concat("l_returnflag", "l_linestatus").alias("components"), F.col("l_orderkey").alias("ord"))
    return records.distinct_ligatures(rows, ["l_suppkey"], most=20)


@query("SELECT l_suppkey AS glyph, arg_min(l_partkey, (l_orderkey * 10 + l_linenumber) * 1000000000 + l_partkey) AS codepoint FROM lineitem WHERE l_suppkey <> 0 GROUP BY 1")
def glyph_map(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("glyph"), F.col("l_partkey").alias("codepoint"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return records.glyph_to_codepoint(rows, [])


@query("WITH f AS (SELECT doc_id, text, source || '/' || lang AS target, min(doc_id) OVER (PARTITION BY text) AS first FROM documents) SELECT doc_id, CASE WHEN doc_id <> first THEN 'delete' WHEN doc_id % 5 = 0 THEN 'keep' ELSE 'move' END AS action FROM f")
def repair_actions(spark, sf_dir):
    d = _contents(spark, sf_dir).withColumn("path", F.col("doc_id"))
    target = F.when(F.col("doc_id") % 5 == 0, F.col("doc_id")).otherwise(-1)
    return placement.repair_plan(d.withColumn("target", target), "path", "sha256", "target").select("doc_id", "action")


@query("SELECT c_custkey, CAST(CASE c_custkey % 3 WHEN 0 THEN c_custkey % 65536 WHEN 1 THEN 98 ELSE -1 END AS INT) AS codepoint FROM customer")
def glyph_names(spark, sf_dir):
    kind, code = F.col("c_custkey") % 3, F.lpad(F.hex(F.col("c_custkey") % 65536), 4, "0")
    name = F.when(kind == 0, F.concat(F.lit("uni"), code)).when(kind == 1, "b.alt").otherwise("zzz")
    listed = spark.createDataFrame([("b", 98)], "glyph_name string, codepoint int")
    return records.name_to_codepoint(table(spark, sf_dir, "customer").select("c_custkey", name.alias("name")), listed, "name").select("c_custkey", "codepoint")


@query("SELECT c_custkey, c_custkey AS crc FROM customer")
def marker_round_trip(spark, sf_dir):
    name = fn.marker_name(F.col("c_name"), F.lit("Regular"), F.col("c_custkey"), F.lit("ttf"))
    return table(spark, sf_dir, "customer").select("c_custkey", fn.marker_crc(name).alias("crc"))


@query("SELECT p_partkey, CASE WHEN upper(p_brand) = upper(p_name) THEN p_brand || '|' || p_type ELSE p_brand || '|' || p_type || '|' || p_name END AS paths FROM part")
def paths_union(spark, sf_dir):
    both = dedup.union_ignoring_case(F.array("p_brand", "p_type"), F.array(F.lower("p_type"), "p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(both, "|").alias("paths"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    out = incremental.windowed_counts(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("SELECT source, count(*) AS n, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs FROM documents GROUP BY source")
def import_available_now(spark, sf_dir):
    """Documents through a checkpointed stream that takes what is there and stops."""
    at = f"{shared_dir(spark).rstrip('/')}/import-{uuid.uuid4().hex}"
    path = f"{sf_dir.rstrip('/')}/documents.parquet"
    schema = spark.read.parquet(path).schema
    # A stream lists a folder or a pattern, not one plain file; this pattern is the path itself.
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(f"{path[:-1]}[{path[-1]}]")
    run = source.select("doc_id", "lang", "source").writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    rows = spark.read.parquet(f"{at}/out")
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_type ELSE p_brand END AS style, CASE WHEN p_size % 4 = 0 THEN 'Regular' ELSE p_type END AS filled FROM part")
def effective_styles(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    sub, own = F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_brand")), F.when(F.col("p_size") % 4 == 0, "").otherwise(F.col("p_type"))
    return part.select("p_partkey", fn.effective_style(sub, F.col("p_type")).alias("style"), fn.style_or_regular(own).alias("filled"))


_EXTS = ("otf", "TTF", "woff2", "Woff", "eot", "pdf", "")


@query("""SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'otf' WHEN 1 THEN 'ttf' WHEN 2 THEN 'woff2' WHEN 3 THEN 'woff' WHEN 4 THEN 'eot' END AS ext,
    CASE p_partkey % 7 WHEN 0 THEN 5 WHEN 1 THEN 4 WHEN 2 THEN 3 WHEN 3 THEN 2 WHEN 4 THEN 1 ELSE 0 END AS priority FROM part""")
def extensions(spark, sf_dir):
    ext = F.element_at(F.array(*[F.lit(e) for e in _EXTS]), (F.col("p_partkey") % 7 + 1).cast("int"))
    path = F.concat(F.lit("a.b/"), "p_name", F.when(ext == "", "").otherwise(F.concat(F.lit("."), ext)))
    return table(spark, sf_dir, "part").select("p_partkey", fn.known_extension(path).alias("ext"), fn.format_priority(ext).alias("priority"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 3 THEN NULL WHEN p_size % 2 = 0 THEN p_name WHEN p_size % 3 = 0 THEN p_brand ELSE p_type END AS shown FROM part")
def display_names(spark, sf_dir):
    size, some = F.col("p_size"), F.col("p_size") % 4 != 3
    shown = fn.display_name(F.when(size % 2 == 0, F.col("p_name")).otherwise(""), F.when(some & (size % 3 == 0), F.col("p_brand")), F.when(some, F.col("p_type")).otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", shown.alias("shown"))


@query("""SELECT p_partkey, CASE p_size % 8 WHEN 0 THEN 600 WHEN 1 THEN 900 WHEN 2 THEN 700 WHEN 3 THEN 200 WHEN 4 THEN 300 WHEN 5 THEN 100 WHEN 6 THEN 800 ELSE 400 END AS weight,
    p_size % 8 IN (0, 1, 2, 6) AS bold FROM part""")
def declared_weights(spark, sf_dir):
    word = F.element_at(F.array(*[F.lit(w) for w in ("DemiBold", "Black", "Bold", "UltraLight", "Light", "Thin", "ExtraBold", "Book")]), (F.col("p_size") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", fn.declared_weight(word).alias("weight"), fn.is_bold(word).alias("bold"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN '#' || c_custkey WHEN c_custkey % 256 <= 32 OR c_custkey % 256 BETWEEN 127 AND 160 THEN 'U+' || printf('%04X', c_custkey % 256) ELSE chr(CAST(c_custkey % 256 AS INT)) END AS label,
    c_name || ' - U+' || printf('%04X', c_custkey) || '..U+' || printf('%04X', c_custkey + 15) || ' (' || c_custkey % 16 || '/16)' AS block, CASE WHEN c_custkey % 3 = 0 THEN '#' ELSE 'C' END AS chip FROM customer""")
def labels_shown(spark, sf_dir):
    key = F.col("c_custkey")
    label = fn.glyph_label(F.when(key % 5 != 0, (key % 256).cast("int")), key)
    block = F.replace(fn.block_label(F.col("c_name"), key, key + 15, key % 16), F.lit("\u2014"), F.lit("-"))
    return table(spark, sf_dir, "customer").select("c_custkey", label.alias("label"), block.alias("block"), fn.chip_letter(F.when(key % 3 != 0, F.lower("c_name")).otherwise("")).alias("chip"))


@query("SELECT p_partkey, p_size % 3 <> 0 AS has FROM part")
def has_ligatures(spark, sf_dir):
    tags = F.array(F.lit("kern"), F.when(F.col("p_size") % 3 == 1, "dlig").when(F.col("p_size") % 3 == 2, "liga").otherwise("smcp"))
    return table(spark, sf_dir, "part").select("p_partkey", fn.has_ligatures(tags).alias("has"))


@query("""WITH l AS (SELECT l_suppkey, l_returnflag AS tag, l_linenumber AS glyph, l_linestatus AS components, l_orderkey * 10 + l_linenumber AS ord FROM lineitem),
    f AS (SELECT l_suppkey, tag, row_number() OVER (PARTITION BY l_suppkey, glyph, components ORDER BY ord, tag) AS k FROM l)
    SELECT l_suppkey, tag, count(*) FILTER (k = 1) AS new_ligatures FROM f GROUP BY ALL""")
def new_ligatures(spark, sf_dir):
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_returnflag").alias("tag"), F.col("l_linenumber").alias("glyph"), F.col("l_linestatus").alias("components"), key.alias("ord"))
    return records.new_ligatures(rows, ["l_suppkey"])


@query("SELECT upper(p_brand) AS family_key, min(p_brand) AS family, count(*) AS variants, max(p_size) AS max_glyphs FROM part GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 1")
def first_family(spark, sf_dir):
    """The family that is selected at first: a limit is the feature."""
    return search.first_family(search.families(table(spark, sf_dir, "part"), "p_brand", "p_size", "p_partkey"), "variants")


@query("SELECT p_partkey FROM part WHERE p_name || '.otf' IN (SELECT p_name || '.otf' FROM part WHERE p_size % 2 = 0)")
def drag_paths(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    path = F.concat("p_name", F.lit(".otf"))
    return placement.still_there(part.select("p_partkey", path.alias("at")), part.filter("p_size % 2 = 0").select(path.alias("path")), "at").select("p_partkey")


@query("SELECT p_partkey FROM part WHERE contains(lower(p_type), 'o') AND p_size % 4 = 1")
def search_licence(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumn("licence", F.when(F.col("p_size") % 4 == 1, "Free").otherwise("Paid"))
    return search.matching(rows, search.Request(needle=" O", licence="Free"), ["p_type"]).select("p_partkey")


@query("SELECT count(*) FILTER (p_partkey % 7 = 0 AND p_size % 4 = 1 AND contains(lower(p_type), 'o')) AS visible, count(*) AS total FROM part")
def visible_combined(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumns({"is_variable": F.col("p_partkey") % 7 == 0, "licence": F.when(F.col("p_size") % 4 == 1, "Free").otherwise("Paid")})
    return search.visible_total(rows, search.Request(needle="o", licence="Free", variable_only=True), ["p_type"])


@query("SELECT family FROM (SELECT DISTINCT p_brand AS family FROM part WHERE p_size % 2 = 0) WHERE family NOT IN (SELECT p_brand FROM part WHERE p_size = 7) UNION SELECT p_brand FROM part WHERE p_size = 7 AND p_brand NOT IN (SELECT p_brand FROM part WHERE p_size % 2 = 0)")
def favourites_toggled(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return toggled(part.filter("p_size % 2 = 0").select(F.col("p_brand").alias("family")).distinct(), part.filter("p_size = 7").select(F.col("p_brand").alias("family")).distinct())


@query("SELECT count(*) AS processed, count(*) FILTER (length(text) > 4000) AS errors, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents")
def live_counters(spark, sf_dir):
    """Counters that an action on other rows leaves behind."""
    d = table(spark, sf_dir, "documents").select(F.when(F.length("text") > 4000, "rejected").otherwise("ok").alias("status"), F.col("n_chars").alias("file_size"))
    rows, seen = catalog.counted(d)
    rows.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([tuple(seen.get[k] for k in ("processed", "errors", "bytes"))], "processed bigint, errors bigint, bytes bigint")


@query("""SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'asset' WHEN 1 THEN 'asset' WHEN 2 THEN 'sidecar' WHEN 3 THEN 'archive' WHEN 4 THEN 'archive' WHEN 5 THEN 'asset' ELSE 'ignore' END AS route FROM part""")
def file_routes(spark, sf_dir):
    name = F.element_at(F.array(*[F.lit(n) for n in ("x.TTF", ".y/_z.woff2", "._x.ttf", "a.ZIP", "b.7z", "c.pfb", "note.txt", "ttf")]), (F.col("p_partkey") % 8 + 1).cast("int"))
    return files.routed(table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("/in/"), name).alias("path"))).select("p_partkey", "route")


def _wrapped(kind: str, key: int, tables: dict) -> tuple[str, bytes]:
    """(path, content) of an asset with the given tables in a container."""
    font = samples.sfnt(tables)
    if kind == "woff":
        return f"{key}.woff", samples.woff(tables, packed=key % 2 == 0)
    if kind == "eot":
        return f"{key}.eot", samples.eot(font, xor=key % 2 == 0)
    if kind == "szdd":
        return f"{key}.ttf", samples.szdd(font)
    if kind == "zip":
        return f"{key}.zip", samples.zipped([("a/b.ttf", font), ("readme.txt", b"x"), ("._b.ttf", font), ("../c.ttf", font)])
    return f"{key}.ttf", font


def _tables(key: int, name: str, kind: str, size: int) -> dict:
    """The tables of a part: names, glyphs and code points by its columns; every other one is variable."""
    licence = ("under the SIL Open Font License", "All rights reserved", "")[size % 3]
    names = [(1, 0, 0, 1, "never"), (3, 1, 0x409, 1, name), (3, 1, 0x409, 2, kind), (3, 1, 0x409, 5, f"Version {size}.5"), (3, 1, 0x409, 13, licence)]
    cmap = samples.cmap_table([(3, 1, samples.cmap4([(65, 66, 0)])), (3, 10, samples.cmap12([(65, 65 + size % 26, 1), (0x1F600, 0x1F600, 90)]))])
    more = {}
    if key % 2:
        more["fvar"] = struct.pack(">IHHHHHH", 0x00010000, 16, 2, 1, 20, 0, 0) + b"wght" + struct.pack(">3iHH", 100 << 16, size << 16, 900 << 16, 0, 0)
    if size % 2:
        more["GSUB"] = samples.gsub_table([("liga", [0]), ("kern", [0])], [(4, samples.ligature_sub(5, [(9, [6])]))])
    return samples.tables(names, size, cmap=cmap, **more)


def _built(spark, sf_dir, kind: str):
    """Decoded assets, one container for each part."""

    def build(batches):
        for b in batches:
            rows = [_wrapped(kind, r["p_partkey"], _tables(r["p_partkey"], r["p_name"], r["p_type"], r["p_size"])) for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows]), pa.array([c for _, c in rows], pa.binary())], names=["path", "content"])

    part = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("bigint"), "p_name", "p_type", F.col("p_size").cast("int"))
    rows = files.decoded(files.routed(part.mapInArrow(build, "path string, content binary")))
    return rows.withColumn("p_partkey", F.regexp_extract("path", r"^([0-9]+)", 1).cast("bigint"))


_RECORD = """p_partkey, p_name AS display_name, p_type AS style, p_size || '.5' AS version, CAST(p_size AS INT) AS glyph_count, CAST(p_size % 26 + 2 AS BIGINT) AS covered, 3 AS score,
    CASE p_size % 3 WHEN 0 THEN 'Free' WHEN 1 THEN 'Paid' ELSE 'Unknown' END AS licence, p_partkey % 2 = 1 AS is_variable, 'TrueType' AS outline"""


def _record(rows):
    return rows.select("p_partkey", "display_name", "style", "version", "glyph_count", iv.covered(F.col("coverage")).alias("covered"), F.col("metadata_score").alias("score"), F.col("license").alias("licence"), "is_variable", "outline", "ext")


@query(f"SELECT {_RECORD}, 'ttf' AS ext FROM part")
def decode_plain(spark, sf_dir):
    return _record(_built(spark, sf_dir, "plain"))


@query(f"SELECT {_RECORD}, 'woff' AS ext FROM part")
def decode_woff(spark, sf_dir):
    return _record(_built(spark, sf_dir, "woff"))


@query(f"SELECT {_RECORD}, 'eot' AS ext FROM part")
def decode_eot(spark, sf_dir):
    return _record(_built(spark, sf_dir, "eot"))


@query(f"SELECT {_RECORD}, 'ttf' AS ext FROM part")
def decode_szdd(spark, sf_dir):
    return _record(_built(spark, sf_dir, "szdd"))


@query("SELECT p_partkey, p_partkey || '.zip!a/b.ttf' AS path, 'ok' AS status, p_name AS display_name, NULL AS error FROM part UNION ALL SELECT p_partkey, p_partkey || '.zip!../c.ttf', 'rejected', NULL, 'path leaves the archive' FROM part")
def decode_zip(spark, sf_dir):
    return _built(spark, sf_dir, "zip").select("p_partkey", "path", "status", "display_name", "error")


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 1 THEN 'wght 100 ' || p_size || ' 900' ELSE '' END AS axes, CASE WHEN p_size % 2 = 1 THEN 'liga,kern' ELSE '' END AS features, p_size % 2 = 1 AS ligatures FROM part")
def decode_axes_features(spark, sf_dir):
    whole = lambda x: x.cast("int").cast("string")
    axes = F.array_join(F.transform("axes", lambda a: F.concat_ws(" ", a["tag"], whole(a["min"]), whole(a["default"]), whole(a["max"]))), ",")
    return _built(spark, sf_dir, "plain").select("p_partkey", axes.alias("axes"), F.array_join("features", ",").alias("features"), fn.has_ligatures(F.col("features")).alias("ligatures"))


@query("SELECT p_partkey, 'Old ' || p_partkey AS display_name, 'Bold Italic' AS style, '3.5' AS version, 3 AS glyph_count, CAST(2 AS BIGINT) AS covered, 'otf' AS ext FROM part")
def decode_type1(spark, sf_dir):
    def build(batches):
        for b in batches:
            keys = b.column("p_partkey").to_pylist()
            kinds = ["pfb" if k % 2 else "pfa" for k in keys]
            yield pa.RecordBatch.from_arrays([pa.array([f"{k}.{e}" for k, e in zip(keys, kinds, strict=True)]), pa.array([samples.type1(e, f"Old {k}") for k, e in zip(keys, kinds, strict=True)], pa.binary())], names=["path", "content"])

    rows = files.decoded(files.routed(table(spark, sf_dir, "part").select("p_partkey").mapInArrow(build, "path string, content binary")))
    return rows.select(F.regexp_extract("path", r"^([0-9]+)", 1).cast("bigint").alias("p_partkey"), "display_name", "style", "version", "glyph_count", iv.covered(F.col("coverage")).alias("covered"), "ext")


#: Contents that no decoder takes, by kind.
_BROKEN = (("ttf", b"tiny"), ("ttf", b"nonsense nonsense"), ("ttf", samples.sfnt(version=0x74746366)), ("eot", samples.eot(samples.sfnt(), flags=4)), ("woff", samples.woff()[:60]), ("zip", b"junk that is no archive"), ("rar", b"no reader for this one"), ("otf", samples.szdd(samples.sfnt())[:-9]))


@query("SELECT p_partkey, 'rejected' AS status, true AS told, CASE WHEN p_partkey % 8 = 0 THEN 'size out of bounds' WHEN p_partkey % 8 = 6 THEN 'no reader for .rar archives' END AS reason FROM part")
def decode_rejects(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 8).cast("int").alias("k"))
    kinds = spark.createDataFrame([(k, e, c) for k, (e, c) in enumerate(_BROKEN)], "k int, e string, content binary")
    rows = part.join(F.broadcast(kinds), "k").select(F.concat(F.col("p_partkey").cast("string"), F.lit("."), "e").alias("path"), "content")
    out = files.decoded(files.routed(rows)).withColumn("p_partkey", F.regexp_extract("path", r"^([0-9]+)", 1).cast("bigint"))
    return out.select("p_partkey", "status", (F.length("error") > 0).alias("told"), F.when((F.col("p_partkey") % 8).isin(0, 6), F.col("error")).alias("reason"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'sidecar' WHEN p_partkey % 3 = 1 THEN 'asset' ELSE 'ignore' END AS route, CASE WHEN p_partkey % 3 = 1 THEN CAST(length(p_name) AS BIGINT) END AS bytes_read FROM part")
def tree_listing(spark, sf_dir):
    """A tree with a file for each part, two folders deep, hidden names among them, listed and read."""
    root = f"{shared_dir(spark).removeprefix('file:').rstrip('/')}/tree-{uuid.uuid4().hex}"

    def put(batches):
        import os

        for b in batches:
            for r in b.to_pylist():
                k = r["p_partkey"]
                at = f"{root}/.h{k % 5}/_{k % 2}"
                os.makedirs(at, exist_ok=True)
                with open(f"{at}/{('._{}.ttf', '_{}.TTF', '{}.txt')[k % 3].format(k)}", "w") as f:
                    f.write(r["p_name"])
            yield b.select(["p_partkey"])

    table(spark, sf_dir, "part").select("p_partkey", "p_name").mapInArrow(put, "p_partkey bigint").count()
    rows = files.routed(files.read_trees(spark, [f"{root}/.h{k}" for k in range(5)]))
    return rows.select(F.regexp_extract("path", r"([0-9]+)\.[A-Za-z]+$", 1).cast("bigint").alias("p_partkey"), "route", F.octet_length("content").cast("bigint").alias("bytes_read"))


@query("SELECT p_partkey, p_name AS display_name, CAST(p_size % 26 + 2 AS BIGINT) AS covered, p_partkey || '.ttf' AS original FROM part")
def catalog_round_trip(spark, sf_dir):
    """Published and loaded again, in catalog order, heavy columns on their own."""
    root = f"{shared_dir(spark).rstrip('/')}/catalog-{uuid.uuid4().hex}"
    built = _built(spark, sf_dir, "plain")
    catalog.publish(built.withColumn("original_paths", F.array("path")).drop("p_partkey"), root)
    heavy = catalog.heavy(catalog.load(spark, root), F.lit(True)).select(F.element_at("original_paths", 1).alias("path"), "coverage", "original_paths")
    light = catalog.load(spark, root).select("display_name", "path")
    return light.join(heavy, "path").select(F.regexp_extract("path", r"^([0-9]+)", 1).cast("bigint").alias("p_partkey"), "display_name", iv.covered(F.col("coverage")).alias("covered"), F.element_at("original_paths", 1).alias("original"))


@query(f"""WITH d AS (SELECT min(doc_id) AS doc_id, min_by(lang, doc_id) AS lang, min_by(source, doc_id) AS source, text, count(*) AS copies FROM documents GROUP BY text),
    l AS (SELECT doc_id, lang, source, copies, length(text) AS size, {_LICENCE.replace("doc_id % 50 = 7", "false")} AS licence FROM d)
    SELECT lang, source, doc_id, size, licence, copies, variants FROM (SELECT *, count(*) OVER (PARTITION BY lang, source) AS variants, row_number() OVER (PARTITION BY lang, source ORDER BY size DESC, copies DESC, doc_id) AS k FROM l) WHERE k = 1""")
def flagship(spark, sf_dir):
    """Fingerprint, exact dedup, licence class and best variant per (lang, source), sorted."""
    d = table(spark, sf_dir, "documents")
    rows = d.select("doc_id", "lang", "source", F.sha2("text", 256).alias("sha256"), F.length("text").alias("size"), fn.licence_class(F.lit(""), F.col("text"), F.lit(""), F.lit(0)).alias("licence"))
    firsts = rows.groupBy("sha256").agg(F.min_by(F.struct("doc_id", "lang", "source", "size", "licence"), "doc_id").alias("r"), F.count(F.lit(1)).alias("copies")).select("r.*", "copies")
    best = firsts.groupBy("lang", "source").agg(F.min(F.struct((-F.col("size")).alias("s"), (-F.col("copies")).alias("c"), "doc_id", "size", "licence", "copies")).alias("b"), F.count(F.lit(1)).alias("variants"))
    return best.select("lang", "source", "b.doc_id", "b.size", "b.licence", "b.copies", "variants").orderBy("lang", "source")
