"""Images laid in place of a document's placeholders: each placeholder in turn takes the best image that is left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import written

#: How far an image's shape may be off, and the least sides of a placeholder that asks by shape.
SHAPE, LEAST = 0.35, 64


def preferences(places: DataFrame, images: DataFrame, shape: float = SHAPE, least: int = LEAST) -> DataFrame:
    """(doc_id, place, image, wish): the images each placeholder would take, the least wish first.

    places (doc_id, place, width, height, page), images (doc_id, image, width, height, page). With both sides, a
    placeholder takes the image whose shape is off least, by `shape` at most, and none if a side is under `least`; with a
    page, the first one of that page; else the first there is. A document's images are few: `image_budget` caps them.
    """
    i = images.select(F.col("doc_id").alias("_d"), "image", *[F.col(c).alias(f"_{c}") for c in ("width", "height", "page")])
    both = places.join(i, F.col("doc_id") == F.col("_d"))
    sided = F.coalesce((F.col("width") > 0) & (F.col("height") > 0), F.lit(False))
    aspect = F.col("width") / F.col("height")
    off = F.when((F.col("_width") > 0) & (F.col("_height") > 0), F.abs(F.col("_width") / F.col("_height") - aspect) / aspect)
    fits = F.when(sided, (F.col("width") >= least) & (F.col("height") >= least) & (off <= shape)).when(F.col("page").isNotNull(), F.col("_page") == F.col("page")).otherwise(True)
    wish: Column = F.struct(F.when(sided, off).otherwise(0.0).alias("off"), F.col("image").alias("nth"))
    return both.where(fits).select("doc_id", "place", "image", wish.alias("wish"))


def matched(wishes: DataFrame) -> DataFrame:
    """(doc_id, place, image) as if the placeholders of each document, in order of place, took their first wish that is left.

    All documents at once, in rounds: every placeholder asks for its first wish; of those that ask for one image the
    earliest holds it and the others strike it off. When none is struck off, what is held is the result: all images
    prefer earlier placeholders, so there is one stable outcome, that of taking turns. Placeholders whose wishes are all
    struck off get none.
    """
    left = written(wishes)
    while True:
        asked = left.groupBy("doc_id", "place").agg(F.min("wish").alias("wish")).select("doc_id", "place", F.col("wish.nth").alias("image"))
        held = asked.groupBy("doc_id", "image").agg(F.min("place").alias("first"))
        judged = written(asked.join(held, ["doc_id", "image"]))
        struck = judged.where("place <> first").select("doc_id", "place", "image")
        if struck.isEmpty():
            return judged.select("doc_id", "place", "image")
        left = written(left.join(struck, ["doc_id", "place", "image"], "left_anti"))
