"""Catalog queries: paths, manifests, joins, caches, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import missing_as_zero, natural_key
from ..operators import joins
from ..operators.ordering import numbered
from ..sources.views import frames, table, with_views
from .registry import query, rounded


@query(f"""{with_views("frames")} SELECT r.scene, r.frame_idx FROM frames r JOIN frames d ON r.scene = d.scene AND r.frame_idx = d.frame_idx WHERE NOT r.err AND d.depth > 20""")
def id_intersection_join(spark, sf_dir):
    """Frames with a good image and a usable depth: the intersection of two id lists."""
    f = frames(spark, sf_dir)
    return f.where("NOT err").select("scene", "frame_idx").join(f.where("depth > 20").select("scene", "frame_idx"), ["scene", "frame_idx"])


@query(f"""{with_views("frames")}, a AS (SELECT scene, event_id AS rgb_id, row_number() OVER (PARTITION BY scene ORDER BY frame_idx) - 1 AS pos FROM frames WHERE event_type = 'view'),
b AS (SELECT scene, event_id AS depth_id, row_number() OVER (PARTITION BY scene ORDER BY frame_idx) - 1 AS pos FROM frames WHERE event_type = 'click')
SELECT scene, pos, rgb_id, depth_id FROM a JOIN b USING (scene, pos)""")
def positional_zip_join(spark, sf_dir):
    """Two sorted streams paired by position, to the end of the shorter."""
    side = lambda kind, name: frames(spark, sf_dir).where(F.col("event_type") == kind).select("scene", F.col("event_id").alias(name), F.col("frame_idx").alias(f"{name}_order"))
    return joins.zip_by_position(side("view", "rgb_id"), side("click", "depth_id"), ["scene"], ["rgb_id_order"], ["depth_id_order"]).select("scene", "pos", "rgb_id", "depth_id")


@query("""SELECT n_name AS scene, r_name AS variant, camera, n_name || '/' || r_name || '/cam' || camera AS path FROM nation CROSS JOIN region CROSS JOIN (SELECT unnest([0, 1]::BIGINT[]) AS camera)""")
def dim_cross_catalog(spark, sf_dir):
    """The static catalog scene x variant x camera; the dimensions are fixed lists."""
    dims = table(spark, sf_dir, "nation").select(F.col("n_name").alias("scene")).crossJoin(table(spark, sf_dir, "region").select(F.col("r_name").alias("variant")))
    rows = dims.withColumn("camera", F.explode(F.array(F.lit(0), F.lit(1)).cast("array<bigint>")))
    return rows.withColumn("path", F.concat_ws("/", "scene", "variant", F.concat(F.lit("cam"), F.col("camera").cast("string"))))


@query("""WITH s AS (SELECT url, page_id, CASE WHEN page_id % 2 = 0 THEN 'left' ELSE 'right' END AS side, page_id // 2 AS pair FROM pages)
SELECT a.page_id, b.page_id AS partner FROM s a JOIN s b ON a.pair = b.pair AND a.side <> b.side""")
def partner_self_join(spark, sf_dir):
    """Each view's stereo partner, found by swapping the side in its name."""
    named = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("shot_"), F.floor(F.col("page_id") / 2).cast("string"), F.when(F.col("page_id") % 2 == 0, "_left").otherwise("_right")).alias("name"))
    other = F.when(F.col("name").endswith("_left"), F.regexp_replace("name", "_left$", "_right")).otherwise(F.regexp_replace("name", "_right$", "_left"))
    return named.withColumn("other", other).join(named.select(F.col("page_id").alias("partner"), F.col("name").alias("other")), "other").select("page_id", "partner")


_T = "epoch_us(ts) / 1e6"


@query(f"""{with_views("frames")}, r AS (SELECT scene, event_id, {_T} AS t FROM frames WHERE event_type = 'view'), d AS (SELECT DISTINCT scene, {_T} AS t FROM frames WHERE event_type = 'click'),
m AS (SELECT r.scene, event_id, r.t, d.t AS match_t, row_number() OVER (PARTITION BY r.scene, event_id ORDER BY abs(d.t - r.t), d.t) AS rn FROM r JOIN d ON r.scene = d.scene AND abs(d.t - r.t) < 86400)
SELECT scene, event_id, t, match_t FROM m WHERE rn = 1""")
def nearest_asof_tolerance(spark, sf_dir):
    """Each view's nearest click of its scene, less than a day away."""
    t = (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t")
    f = frames(spark, sf_dir)
    left = f.where("event_type = 'view'").select("scene", "event_id", t)
    return joins.nearest_within(left, f.where("event_type = 'click'").select("scene", t), ["scene"], "t", 86400.0).select("scene", "event_id", "t", "match_t")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def bake_worklist_anti(spark, sf_dir):
    """Sequences that are not baked yet."""
    return joins.anti(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("""SELECT source, count(*) AS n_required, count(*) FILTER (WHERE l.doc_id IS NULL) AS n_missing, count(*) FILTER (WHERE l.doc_id IS NULL) = 0 AS complete
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY source""")
def cache_coverage_universal(spark, sf_dir):
    """Datasets all of whose sequences are cached."""
    return joins.covered(table(spark, sf_dir, "documents").select("source", "doc_id"), table(spark, sf_dir, "labels"), ["source"], ["doc_id"])


@query("""SELECT conv_id AS clip, bool_and(l.doc_id IS NOT NULL) AS all_hit, round(avg(CASE WHEN l.doc_id IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS hit_rate
FROM conversations c LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = c.conv_id + c.turn GROUP BY conv_id""")
def cache_hit_by_clip(spark, sf_dir):
    """Whether every frame of a clip finds its cached latent, and what share does."""
    keyed = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("clip"), (F.col("conv_id") + F.col("turn")).alias("doc_id"))
    hit = keyed.join(table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("hit", F.lit(True)), "doc_id", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    return rounded(hit.groupBy("clip").agg(F.bool_and("hit").alias("all_hit"), F.avg(F.col("hit").cast("double")).alias("hit_rate")))


@query("""SELECT doc_id, CAST(quality AS BIGINT) AS v FROM labels UNION ALL SELECT doc_id, CAST(-1 AS BIGINT) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def idempotent_insert(spark, sf_dir):
    """Put-if-absent into a cache table."""
    cache = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("long").alias("v"))
    new = table(spark, sf_dir, "documents").select("doc_id", F.lit(-1).cast("long").alias("v"))
    return joins.insert_absent(cache, new, ["doc_id"])


@query(r"""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, regexp_extract(url, '([^/]+)$', 1) AS name, TRY_CAST(regexp_extract(url, '(\d+)[^\d]*$', 1) AS BIGINT) AS frame, lpad(CAST(page_id AS VARCHAR), 8, '0') AS member, regexp_replace(url, '_(\d+)', '.\1') AS dotted FROM pages""")
def path_parse(spark, sf_dir):
    """Shot, frame and derived names from a path."""
    return table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), F.regexp_extract("url", "([^/]+)$", 1).alias("name"), F.regexp_extract("url", r"(\d+)[^\d]*$", 1).try_cast("bigint").alias("frame"),
        F.lpad(F.col("page_id").cast("string"), 8, "0").alias("member"), F.regexp_replace("url", r"_(\d+)", ".$1").alias("dotted"),
    )


@query(r"""WITH k AS (SELECT c_custkey, 'f' || (c_custkey % 120) || '_' || c_custkey AS name FROM customer),
t AS (SELECT c_custkey, name, array_to_string(list_transform(regexp_extract_all(name, '\d+|\D'), lambda x: CASE WHEN regexp_matches(x, '^\d') THEN lpad(x, 20, '0') ELSE x END), '') AS key FROM k)
SELECT c_custkey, name, row_number() OVER (ORDER BY key) AS place FROM t""")
def natural_sort(spark, sf_dir):
    """File names in natural order: 2 before 10."""
    name = F.concat(F.lit("f"), (F.col("c_custkey") % 120).cast("string"), F.lit("_"), F.col("c_custkey").cast("string"))
    named = table(spark, sf_dir, "customer").select("c_custkey", name.alias("name"))
    return numbered(named.withColumn("key", natural_key(F.col("name"))), ["key"], "place").drop("key")


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'pred_' || p_partkey WHEN 1 THEN 'pred_' || split_part(p_brand, '#', 2) || '_' || p_partkey WHEN 2 THEN replace(p_name, ' ', '_') || '_depth' ELSE split_part(p_name, ' ', 1) || '.npy' END AS pred_name FROM part""")
def pred_name_modes(spark, sf_dir):
    """The prediction's file name in four naming modes."""
    key, mode = F.col("p_partkey").cast("string"), F.col("p_size") % 4
    brand = F.split_part("p_brand", F.lit("#"), F.lit(2))
    name = F.when(mode == 0, F.concat(F.lit("pred_"), key)).when(mode == 1, F.concat(F.lit("pred_"), brand, F.lit("_"), key))
    name = name.when(mode == 2, F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_depth"))).otherwise(F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit(".npy")))
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("pred_name"))


@query("""SELECT 'customer' AS dataset, c_custkey AS key, c_name AS name, c_acctbal AS balance FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name, s_acctbal FROM supplier""")
def schema_intersection_union(spark, sf_dir):
    """Heterogeneous records reduced to the columns that all have."""
    a = table(spark, sf_dir, "customer").withColumnsRenamed({"c_custkey": "key", "c_name": "name", "c_acctbal": "balance", "c_nationkey": "nation"}).withColumn("dataset", F.lit("customer"))
    b = table(spark, sf_dir, "supplier").withColumnsRenamed({"s_suppkey": "key", "s_name": "name", "s_acctbal": "balance", "s_nationkey": "site"}).withColumn("dataset", F.lit("supplier"))
    common = [c for c in ("dataset", *a.columns) if c in b.columns]
    return a.select(*dict.fromkeys(common)).unionByName(b.select(*dict.fromkeys(common)))


@query("""SELECT source AS dataset, max(path) AS shard_path, count(*) AS n_members, sum(CAST(n_chars AS BIGINT))::BIGINT AS bytes, array_to_string(list_sort(list(member)), ',') AS members
FROM (SELECT source, n_chars, 'shard-' || source AS path, lpad(CAST(doc_id AS VARCHAR), 8, '0') AS member FROM documents) GROUP BY source""")
def shard_manifest_map(spark, sf_dir):
    """The shard index by dataset: its members as a map from name to (offset, size), here summed and listed."""
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("dataset"), F.concat(F.lit("shard-"), "source").alias("shard_path"), F.lpad(F.col("doc_id").cast("string"), 8, "0").alias("member"), F.col("n_chars").alias("size"))
    index = rows.groupBy("dataset").agg(F.max("shard_path").alias("shard_path"), F.map_from_entries(F.collect_list(F.struct("member", "size"))).alias("index"))
    return index.select("dataset", "shard_path", F.size("index").cast("long").alias("n_members"), F.aggregate(F.map_values("index"), F.lit(0).cast("long"), lambda t, x: t + x).alias("bytes"), F.array_join(F.sort_array(F.map_keys("index")), ",").alias("members"))


@query("""SELECT doc_id, source AS ds, lang, n_chars AS n_frames, n_chars % 2 = 0 AS contiguous FROM documents""")
def meta_json_roundtrip(spark, sf_dir):
    """Sequence metadata through JSON and back; a malformed text would give nulls."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.to_json(F.struct(F.col("source").alias("ds"), "lang", F.col("n_chars").alias("n_frames"), (F.col("n_chars") % 2 == 0).alias("contiguous"))).alias("meta"))
    return rows.select("doc_id", F.from_json("meta", "ds string, lang string, n_frames bigint, contiguous boolean").alias("m")).select("doc_id", "m.*")


@query("""SELECT event_id, coalesce(TRY_CAST(CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN 'n/a' ELSE CAST(event_id AS VARCHAR) END AS DOUBLE), 0.0) AS v FROM events""")
def missing_as_zero_cells(spark, sf_dir):
    """Numeric cells of a CSV, where empty and malformed ones count as 0."""
    cell = F.when(F.col("event_id") % 3 == 0, "").when(F.col("event_id") % 3 == 1, "n/a").otherwise(F.col("event_id").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", missing_as_zero(cell).alias("v"))


@query("""SELECT c_custkey AS key FROM customer EXCEPT SELECT o_custkey FROM orders""")
def key_difference(spark, sf_dir):
    """Keys of one side that the other lacks."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")).subtract(table(spark, sf_dir, "orders").select("o_custkey"))


@query("""SELECT p_partkey AS key FROM part INTERSECT SELECT l_partkey FROM lineitem""")
def key_intersection(spark, sf_dir):
    """Keys that both sides have."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key")).intersect(table(spark, sf_dir, "lineitem").select("l_partkey"))


@query(f"""{with_views("frames")} SELECT scene, frame_idx, depth * 2 AS doubled FROM frames WHERE scene IN (1, 2, 3) AND depth > 50 AND NOT err""")
def filter_spec(spark, sf_dir):
    """A filter specification: bound predicate, row function, then the columns to write."""
    wanted = [1, 2, 3]
    rows = frames(spark, sf_dir).where(F.col("scene").isin(wanted)).where("depth > 50 AND NOT err")
    return rows.withColumn("doubled", F.col("depth") * 2).select("scene", "frame_idx", "doubled")
