"""Hidden text: spans against the fills and images drawn on the same page.

Every join has the page as its equal key and the geometry as a residual, so that no pair of relations is ever crossed.
Fills are reduced to the latest one by aggregation, not by collecting them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.render import luminance

OPACITY, SIZE, CONTRAST = 0.05, 4.0, 0.12


def contains(outer: str, inner: str) -> Column:
    o, i = (lambda c: F.col(f"{outer}.{c}")), (lambda c: F.col(f"{inner}.{c}"))
    return (i("x0") <= i("x1")) & (i("y0") <= i("y1")) & (o("x0") <= i("x0")) & (i("x1") <= o("x1")) & (o("y0") <= i("y0")) & (i("y1") <= o("y1"))


def touches(one: str, other: str) -> Column:
    a, b = (lambda c: F.col(f"{one}.{c}")), (lambda c: F.col(f"{other}.{c}"))
    solid = lambda x: (x("x0") < x("x1")) & (x("y0") < x("y1"))
    return solid(a) & solid(b) & (a("x0") < b("x1")) & (b("x0") < a("x1")) & (a("y0") < b("y1")) & (b("y0") < a("y1"))


def backgrounds(spans: DataFrame, fills: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, seq, background, behind): luminance and place of the last fill before a span that contains it; white."""
    s, f = spans.alias("s"), fills.alias("f")
    on = [F.col(f"s.{k}") == F.col(f"f.{k}") for k in keys] + [F.col("f.seq") < F.col("s.seq"), contains("f", "s")]
    last = s.join(f, on).groupBy(*[F.col(f"s.{k}").alias(k) for k in keys], F.col("s.seq").alias("seq")).agg(F.max(F.struct(F.col("f.seq").alias("seq"), luminance(F.col("f.color")).alias("l"))).alias("last"))
    return spans.select(*keys, "seq").join(last, [*keys, "seq"], "left").select(*keys, "seq", F.coalesce("last.l", F.lit(1.0)).alias("background"), F.col("last.seq").alias("behind"))


def last_under(spans: DataFrame, images: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, seq, image): place of the last image before a span that touches it; -1."""
    s, i = spans.alias("s"), images.alias("i")
    on = [F.col(f"s.{k}") == F.col(f"i.{k}") for k in keys] + [F.col("i.seq") < F.col("s.seq"), touches("s", "i")]
    last = s.join(i, on).groupBy(*[F.col(f"s.{k}").alias(k) for k in keys], F.col("s.seq").alias("seq")).agg(F.max("i.seq").alias("image"))
    return spans.select(*keys, "seq").join(last, [*keys, "seq"], "left").select(*keys, "seq", F.coalesce("image", F.lit(-1)).alias("image"))


def covered(spans: DataFrame, covers: DataFrame, keys: list[str]) -> DataFrame:
    """Spans that a later fill contains."""
    s, f = spans.alias("s"), covers.alias("f")
    on = [F.col(f"s.{k}") == F.col(f"f.{k}") for k in keys] + [F.col("f.seq") > F.col("s.seq"), contains("f", "s")]
    return s.join(f, on, "left_semi")


def two(x: Column) -> Column:
    """Two decimals, half to even."""
    cents = F.rint(x * 100).cast("long")
    return F.concat(F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))


def hidden(spans: DataFrame, fills: DataFrame, images: DataFrame, keys: list[str], page: tuple[float, float, float, float]) -> DataFrame:
    """(keys, seq, text, reasons, color, background) of spans that a reader doesn't see."""
    gone = covered(spans, fills, keys).select(*keys, "seq", F.lit(True).alias("over"))
    own = spans.join(backgrounds(spans, fills, keys), [*keys, "seq"]).join(last_under(spans, images, keys), [*keys, "seq"]).join(gone, [*keys, "seq"], "left")
    fg, gap = luminance(F.col("color")), F.abs(luminance(F.col("color")) - F.col("background"))
    pictured = (F.col("image") >= 0) & (F.col("behind").isNull() | (F.col("image") > F.col("behind")))
    off = ~((F.col("x0") < page[2]) & (page[0] < F.col("x1")) & (F.col("y0") < page[3]) & (page[1] < F.col("y1")))
    reasons = F.array_compact(
        F.array(
            F.when(F.col("type") == 3, "render mode 3"), F.when(F.col("opacity") < OPACITY, F.concat(F.lit("opacity "), two(F.col("opacity")))), F.when(F.col("size") < SIZE, F.concat(F.lit("size "), F.bround("size", 1).cast("string"), F.lit("pt"))),
            F.when(off, "off page"), F.when(~pictured & (gap < CONTRAST), F.concat(F.lit("color matches background by "), two(gap))), F.when(F.col("over"), "covered by a later fill"),
        )
    )
    return own.where(F.trim("text") != "").withColumn("reasons", reasons).where(F.size("reasons") > 0).select(*keys, "seq", "text", "reasons", F.rint(fg * 100).alias("color_cents"), F.rint(F.col("background") * 100).alias("background_cents"))
