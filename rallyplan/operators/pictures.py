"""What pictures tell without a decoder: median background and clothing colours, out of array columns of pixels.

Defined results: null pixels are left out; a crop of fewer than ``LEAST_PIXELS`` pixels has
a look of zeros; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bins of hue (of 180) and saturation (from GREY to 256); value under which a pixel is dark, saturation under which a bright one is light.
HUES, SATURATIONS, DARK, GREY = 12, 4, 50, 40
LOOK = HUES * SATURATIONS + 2
LEAST_PIXELS = 4


def background(frames: DataFrame, by: list[str], pixels: str) -> DataFrame:
    """by, background (array): the median of each pixel over the frames, cut to a whole number.

    A pixel's buffer is a count of each of its 256 values, so frames are summed up where
    they are read and merged by one shuffle of (pixel, counts), however many there are.
    """
    each = frames.select(*by, F.posexplode(pixels).alias("at", "value"))
    found = each.groupBy(*by, "at").agg(F.floor(F.median("value")).cast("int").alias("value"))
    return found.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]).alias("background"))


def hsv(b: Column, g: Column, r: Column) -> tuple[Column, Column, Column]:
    """Hue (0 to 179), saturation and value (0 to 255) of a pixel, rounded half up."""
    top, low = F.greatest(b, g, r), F.least(b, g, r)
    span = (top - low).cast("double")
    hue = F.when(span == 0, 0.0).when(top == r, 30 * (g - b) / span).when(top == g, 60 + 30 * (b - r) / span).otherwise(120 + 30 * (r - g) / span)
    hue = F.floor(F.when(hue < 0, hue + 180).otherwise(hue) + 0.5)
    return F.when(hue == 180, 0).otherwise(hue), F.when(top == 0, 0).otherwise(F.floor(255 * span / top + 0.5)), top


def look_bin(b: Column, g: Column, r: Column) -> Column:
    """Place of a pixel in the look: hue and saturation bins, then dark, then light."""
    hue, saturation, value = hsv(b, g, r)
    bin_ = F.floor(hue / (180 // HUES)) * SATURATIONS + F.floor((saturation - GREY) / ((256 - GREY) // SATURATIONS))
    return F.when(value < DARK, LOOK - 2).when(saturation < GREY, LOOK - 1).otherwise(bin_).cast("int")


def looks(crops: DataFrame, key: str, pixels: str = "pixels") -> DataFrame:
    """key, look (array of LOOK shares) of crops whose pixels are structs b, g, r; pixels are counted by bin before they are shuffled."""
    known = crops.select(key, F.filter(pixels, lambda p: p["b"].isNotNull() & p["g"].isNotNull() & p["r"].isNotNull()).alias("p"))
    known = known.select(key, F.when(F.size("p") >= LEAST_PIXELS, F.col("p")).alias("p"))
    each = known.select(key, F.explode_outer("p").alias("p")).select(key, look_bin(*(F.col(f"p.{c}").cast("int") for c in "bgr")).alias("bin"))
    counts = each.groupBy(key, "bin").agg(F.count("bin").alias("n"))
    own = F.map_from_entries(F.collect_list(F.when(F.col("bin").isNotNull(), F.struct("bin", "n"))))
    table = counts.groupBy(key).agg(own.alias("of"), F.sum("n").alias("all"))
    share = lambda i: F.coalesce(F.try_element_at("of", i.cast("int")) / F.col("all"), F.lit(0.0))
    return table.select(key, F.transform(F.sequence(F.lit(0), F.lit(LOOK - 1)), share).alias("look"))
