"""Images drawn from order lines: one bar for each atom, as high as its line number."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..operators import sheets, vision
from .carriers import table
from .catalogue import register

HEIGHT = 16
#: Images drawn at a time.
AT_ONCE = 1000
IMAGES_ARROW = pa.schema([("image_id", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("pixels", pa.binary())])


def images(spark, sf_dir):
    """(image_id, width, height, pixels) of each order: bars 4 wide and 6 apart, with a brightness by part."""
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("image_id")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("bars"))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(at, AT_ONCE)
                bars = batch.column("bars")
                count = np.diff(bars.offsets.to_numpy())
                line, part = (c.to_numpy().astype(np.int64) for c in bars.flatten().flatten())
                width = 6 * count + 2
                start = np.cumsum(HEIGHT * width) - HEIGHT * width
                image = np.repeat(np.arange(len(count)), count)
                left = start[image] + 2 + 6 * sheets.ranges(count)
                grey = np.zeros(int((HEIGHT * width).sum()), np.uint8)
                for y in range(2, HEIGHT):
                    tall = np.flatnonzero(line + 3 > y)
                    grey[(left[tall] + y * width[image[tall]])[:, None] + np.arange(4)] = (100 + part[tall] % 150)[:, None]
                pixels = sheets.cut_out(np.repeat(grey, 3), slice(None), 3 * HEIGHT * width)
                yield sheets.record(IMAGES_ARROW, batch.column("image_id"), width, np.full(len(width), HEIGHT), pixels)

    return items.mapInArrow(draw, "image_id long, width int, height int, pixels binary")


@register("""
SELECT l_orderkey AS image_id, sum(CASE WHEN 100 + l_partkey % 150 >= 128 THEN 4 * (1 + l_linenumber) ELSE 0 END)::BIGINT AS ink FROM lineitem GROUP BY 1""")
def foreground_mask(spark, sf_dir):
    return vision.masks_of_images(images(spark, sf_dir)).select("image_id", "ink")


@register("""
SELECT l_orderkey AS image_id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY i) - 1)::BIGINT AS comp, (2 + 6 * (i - 1))::BIGINT AS x, 2::BIGINT AS y, 4::BIGINT AS w, (1 + l_linenumber)::BIGINT AS h, (4 * (1 + l_linenumber))::BIGINT AS ink
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS i FROM lineitem) WHERE 100 + l_partkey % 150 >= 128""")
def image_components(spark, sf_dir):
    out = vision.glyphs_of_images(images(spark, sf_dir))
    return out.select("image_id", *(F.col(c).cast("long").alias(c) for c in ("comp", "x", "y", "w", "h", "ink")))


@register()
def glyph_normalize(spark, sf_dir):
    out = vision.glyphs_of_images(images(spark, sf_dir))
    return out.select("image_id", "comp", F.sha2("glyph", 256).alias("glyph_sha256"))
