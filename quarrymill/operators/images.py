"""Descriptions of disk images, put together from the parts that a reader met."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IMAGE, SYSTEM, VOLUME, FILES = "image", "volume_system", "volume", "file_system"


def image_documents(parts: DataFrame) -> DataFrame:
    """One row for each image of parts (image, nth, kind, detail): image, document and fault.

    Parts come in the order of nth (equal ones by kind and detail): the image first, then its file system or its volume system; volumes follow their
    system, each with a file system right behind it or none. document nests the details:
    struct(detail, volume_system(detail, volumes[(detail, file_system(detail))]), file_system(detail)), with null where there is no such part.
    If a part comes where it may not, or its kind is unknown or null, document is null and fault tells the first such part. A null image is one of its own.
    """
    order = Window.partitionBy("image").orderBy("nth", "kind", "detail")
    kind, before = F.col("kind"), F.lag("kind").over(order)
    in_system = F.max(kind == SYSTEM).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fits = (
        F.when(kind == IMAGE, F.row_number().over(order) == 1)
        .when(kind == SYSTEM, before == IMAGE)
        .when(kind == VOLUME, before.isin(SYSTEM, VOLUME) | ((before == FILES) & in_system))
        .when(kind == FILES, before.isin(IMAGE, VOLUME))
    )
    told = F.concat(F.coalesce("kind", F.lit("null")), F.lit(" after "), F.coalesce(before, F.lit("nothing")))
    placed = parts.select(
        "image", "kind", "detail", F.row_number().over(order).alias("at"), before.alias("before"), F.coalesce(fits, F.lit(False)).alias("fits"), told.alias("told"),
        F.when(F.lead("kind").over(order) == FILES, F.struct(F.lead("detail").over(order).alias("detail"))).alias("within"),
    )

    def only(which: Column) -> Column:
        return F.min_by(F.when(which, F.struct("detail")), F.when(which, F.col("at")))

    volumes = F.array_sort(F.collect_list(F.when(F.col("kind") == VOLUME, F.struct("at", "detail", F.col("within").alias("file_system")))))
    whole = placed.groupBy("image").agg(
        F.min_by(F.when(~F.col("fits"), F.col("told")), F.when(~F.col("fits"), F.col("at"))).alias("fault"),
        only(F.col("kind") == IMAGE).alias("of_image"),
        only(F.col("kind") == SYSTEM).alias("of_system"),
        only((F.col("kind") == FILES) & (F.col("before") == IMAGE)).alias("of_files"),
        F.transform(volumes, lambda v: F.struct(v["detail"].alias("detail"), v["file_system"].alias("file_system"))).alias("volumes"),
    )
    system = F.when(F.col("of_system").isNotNull(), F.struct(F.col("of_system.detail").alias("detail"), "volumes"))
    document = F.struct(F.col("of_image.detail").alias("detail"), system.alias("volume_system"), F.col("of_files").alias("file_system"))
    return whole.select("image", F.when(F.col("fault").isNull(), document).alias("document"), "fault")
