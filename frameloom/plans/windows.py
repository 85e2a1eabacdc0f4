"""Window, tile and clip queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import next_4n_plus_1, pad_to_multiple
from ..operators import windows
from ..operators.ordering import running_total
from ..sources.views import frames, table, with_views
from .registry import query

_LENGTHS = "lengths AS (SELECT scene, count(*) AS n FROM frames GROUP BY scene)"


def _lengths(spark, sf_dir):
    return frames(spark, sf_dir).groupBy("scene").agg(F.count("*").alias("n"))


def _windows_sql(tail: str) -> str:
    last = "greatest(0, n - 21)" if tail == "snapped" else "m * 16"
    return f"""{with_views("frames")}, {_LENGTHS}, w AS (SELECT *, CAST(ceil(greatest(n - 21, 0) / 16.0) AS BIGINT) AS m FROM lengths), i AS (SELECT *, unnest(range(m + 1)) AS i FROM w)
SELECT scene, CAST(CASE WHEN i < m THEN i * 16 ELSE {last} END AS BIGINT) AS "start", CAST(CASE WHEN i < m THEN i * 16 + 21 ELSE n END AS BIGINT) AS "end" FROM i"""


@query(_windows_sql("short"))
def windows_short_tail(spark, sf_dir):
    """Windows of 21 frames overlapping by 5; the last one may be shorter."""
    return _lengths(spark, sf_dir).select("scene", F.inline(windows.windows(F.col("n"), 21, 5, "short")))


@query(_windows_sql("snapped"))
def windows_snapped_tail(spark, sf_dir):
    """Windows of 21 frames overlapping by at least 5; the last one is moved back to full size."""
    return _lengths(spark, sf_dir).select("scene", F.inline(windows.windows(F.col("n"), 21, 5, "snapped")))


@query(f"""{with_views("frames")}, {_LENGTHS}, w AS (SELECT *, n % 8 AS rest, (n + 8 - n % 8 + 20 - 8 - 20) // 8 AS m FROM lengths), i AS (SELECT *, unnest(range(m + 1)) AS i FROM w)
SELECT scene, i * 8 AS "start", CAST(6 AS BIGINT) AS "first", least(20, CASE WHEN i = m THEN 6 + rest ELSE 14 END)::BIGINT AS "last" FROM i""")
def padded_windows(spark, sf_dir):
    """Windows of 20 over the padded sequence, 8 frames kept of each."""
    return _lengths(spark, sf_dir).select("scene", F.inline(windows.padded_windows(F.col("n"), 20, 8)))


@query("""WITH p AS (SELECT p_partkey, CAST(p_size * 13 + 7 AS BIGINT) AS n FROM part), w AS (SELECT *, CAST(ceil(greatest(n - 60, 0) / 40.0) AS BIGINT) AS m FROM p), i AS (SELECT *, unnest(range(m + 1)) AS i FROM w)
SELECT p_partkey, CASE WHEN i < m THEN i * 40 ELSE greatest(0, n - 60) END AS "start", CASE WHEN i < m THEN i * 40 + 60 ELSE n END AS "end" FROM i""")
def spatial_tiles(spark, sf_dir):
    """Tiles of 60 along an axis, overlapping by 20."""
    return table(spark, sf_dir, "part").select("p_partkey", F.inline(windows.windows((F.col("p_size") * 13 + 7).cast("long"), 60, 20)))


@query("""WITH p AS (SELECT p_partkey, CAST(p_size + 10 AS BIGINT) AS hh, CAST(p_size * 2 + 5 AS BIGINT) AS ww FROM part),
y AS (SELECT *, unnest(range(0, hh, 12)) AS y FROM p), x AS (SELECT *, unnest(range(0, ww, 10)) AS x FROM y)
SELECT p_partkey, y, x FROM x WHERE NOT (y - 12 >= 0 AND y - 12 + 20 >= hh) AND NOT (x - 10 >= 0 AND x - 10 + 18 >= ww)""")
def vae_tile_tasks(spark, sf_dir):
    """Tile corners of a plane; tiles that their predecessor already covers are left out."""
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.inline(windows.tile_tasks((F.col("p_size") + 10).cast("long"), (F.col("p_size") * 2 + 5).cast("long"), (20, 18), (12, 10))))


@query("""WITH c AS (SELECT conv_id, turn AS start, list(turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS clip FROM conversations)
SELECT conv_id, start, array_to_string(clip, ',') AS clip FROM c WHERE len(clip) = 4""")
def contiguous_clips(spark, sf_dir):
    """Every clip of 4 consecutive turns."""
    clips = windows.contiguous_clips(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", 4)
    return clips.select("conv_id", "start", F.array_join(F.transform("clip", lambda x: x.cast("string")), ",").alias("clip"))


@query("""WITH n AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT conv_id, turn FROM n WHERE n > 1 AND pos >= 1 AND pos < 1 + least(3, n - 1)""")
def shot_slices(spark, sf_dir):
    """Whole shots from the second frame on, at most 3 frames."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id")
    n = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.row_number().over(w.orderBy("turn")) - 1).alias("pos"), F.count("*").over(w).alias("n"))
    return n.where((F.col("n") > 1) & (F.col("pos") >= 1) & (F.col("pos") < 1 + F.least(F.lit(3), F.col("n") - 1))).select("conv_id", "turn")


@query("""WITH s AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id) SELECT conv_id, n, CAST(sum(n) OVER (ORDER BY conv_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n AS BIGINT) AS first_index FROM s""")
def shot_frame_index(spark, sf_dir):
    """Cumulative frame counts: the global index at which each shot begins."""
    s = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    return running_total(s, ["conv_id"], F.col("n"), "upto").select("conv_id", "n", (F.col("upto") - F.col("n")).alias("first_index"))


@query("""WITH s AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id), f AS (SELECT conv_id, n, sum(n) OVER (ORDER BY conv_id) - n AS first FROM s), i AS (SELECT unnest(range((SELECT sum(n)::BIGINT FROM s))) AS idx)
SELECT idx, conv_id, CAST(idx - first AS BIGINT) AS frame FROM i JOIN f ON idx >= first AND idx < first + n""")
def index_to_shot_frame(spark, sf_dir):
    """Global index to (shot, frame): each shot generates its range, so no range join is needed."""
    first = shot_frame_index(spark, sf_dir)
    return first.select("conv_id", "first_index", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("frame")).select((F.col("first_index") + F.col("frame")).alias("idx"), "conv_id", "frame")


@query("""SELECT p_partkey, p_size, CAST(p_size + ((1 - p_size) % 4 + 4) % 4 AS BIGINT) AS padded, CAST(floor(((-p_size) % 32 + 32) % 32 / 2) AS BIGINT) AS pad_before, CAST(((-p_size) % 32 + 32) % 32 - floor(((-p_size) % 32 + 32) % 32 / 2) AS BIGINT) AS pad_behind FROM part""")
def pad_lengths(spark, sf_dir):
    """Temporal padding to 4n + 1 and centred padding to a multiple of 32."""
    before, behind = pad_to_multiple(F.col("p_size"), 32)
    return table(spark, sf_dir, "part").select("p_partkey", "p_size", next_4n_plus_1(F.col("p_size")).cast("long").alias("padded"), before.cast("long").alias("pad_before"), behind.cast("long").alias("pad_behind"))


@query("""WITH b AS (SELECT p_partkey, p_size + 200 AS h, p_size * 3 + 300 AS w FROM part), r AS (SELECT *, greatest(480.0 / h, 640.0 / w) AS ratio FROM b), s AS (SELECT p_partkey, (CAST(ceil(h * ratio) AS BIGINT) + 15) // 16 * 16 AS new_h, (CAST(ceil(w * ratio) AS BIGINT) + 15) // 16 * 16 AS new_w FROM r)
SELECT new_h, new_w, count(*) AS n, min(p_partkey) AS first_key FROM s GROUP BY new_h, new_w""")
def size_ladder_dedupe(spark, sf_dir):
    """Covering sizes aligned to 16; equal ones are run once."""
    h, w = (F.col("p_size") + 200).cast("double"), (F.col("p_size") * 3 + 300).cast("double")
    ratio = F.greatest(480.0 / h, 640.0 / w)
    aligned = lambda x: (F.floor((F.ceil(x * ratio) + 15) / 16) * 16).cast("long")
    return table(spark, sf_dir, "part").select("p_partkey", aligned(h).alias("new_h"), aligned(w).alias("new_w")).groupBy("new_h", "new_w").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_key"))
