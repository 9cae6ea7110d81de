"""Items and their companion images."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.functions import paths as P
from threadlake.functions import scalars as S

# Companion extensions in order of preference.
COMPANION_ORDER = (".jpg", ".JPG", ".jpeg", ".JPEG", ".png", ".PNG")


def ext_rank(path: str):
    """Position of the exact extension in COMPANION_ORDER, null if it is none of them."""
    found = F.array_position(F.array(*[F.lit(e) for e in COMPANION_ORDER]), P.raw_ext(path))
    return F.when(found > 0, found)


def _placed(df: DataFrame, path: str) -> DataFrame:
    return df.withColumn("_dir", P.dirname(path)).withColumn("_stem", P.stem(path))


def pair_companions(items: DataFrame, images: DataFrame, path: str = "file_path") -> DataFrame:
    """Each image with the item of the same directory and stem; '.emb' is preferred
    over other spellings. Columns image_path, item_path."""
    owners = (
        _placed(items.where(P.is_supported(path)), path)
        .groupBy("_dir", "_stem")
        .agg(F.min_by(path, F.struct(P.raw_ext(path) != ".emb", F.col(path))).alias("item_path"))
    )
    pics = _placed(images.where(P.ext(path).isin(*P.COMPANION_EXTS)), path)
    return pics.join(owners, ["_dir", "_stem"]).select(
        F.col(path).alias("image_path"), "item_path"
    )


def companions_of(items: DataFrame, images: DataFrame, path: str = "file_path") -> DataFrame:
    """Each item with each companion of the known spellings, and its rank (at most six)."""
    pics = _placed(images, path).select(
        "_dir", "_stem", F.col(path).alias("image_path"), ext_rank(path).alias("rank")
    ).where("rank is not null")
    owned = _placed(items.where(P.raw_ext(path).isin(".emb", ".EMB")), path)
    return owned.select("_dir", "_stem", F.col(path).alias("item_path")).join(
        pics, ["_dir", "_stem"]
    ).select("item_path", "image_path", "rank")


def first_companion(items: DataFrame, images: DataFrame, path: str = "file_path") -> DataFrame:
    """The companion that becomes an item's thumbnail."""
    return (
        companions_of(items, images, path)
        .groupBy("item_path")
        .agg(F.min_by("image_path", "rank").alias("image_path"))
    )


def inventory(items: DataFrame, images: DataFrame, path: str = "file_path") -> DataFrame:
    """One row per item with its companions in preference order and ``paired``."""
    owned = (
        companions_of(items, images, path)
        .groupBy("item_path")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "image_path"))).alias("_p"))
        .select("item_path", F.transform("_p", lambda p: p["image_path"]).alias("images"))
    )
    name = P.basename("item_path")
    base = items.where(P.raw_ext(path).isin(".emb", ".EMB")).select(F.col(path).alias("item_path"))
    return base.join(owned, "item_path", "left").select(
        "item_path",
        S.name_number(name).alias("num"),
        S.name_prefix(name).alias("prefix"),
        F.coalesce("images", F.array().cast("array<string>")).alias("images"),
        F.col("images").isNotNull().alias("paired"),
    )


def inventory_summary(inv: DataFrame) -> DataFrame:
    """A11."""
    return inv.agg(
        F.count(F.lit(1)).alias("items"),
        F.count_if("paired").alias("paired"),
        F.count_if(~F.col("paired")).alias("unpaired"),
        F.coalesce(F.sum(F.size("images")), F.lit(0)).cast("long").alias("images"),
    )


def unpaired(inv: DataFrame) -> DataFrame:
    """Items without a companion."""
    return inv.where(~F.col("paired"))


def build_pairs(items: DataFrame, images: DataFrame, path: str = "file_path") -> DataFrame:
    """(query image -> expected item) pairs; items without a number are left out."""
    name = P.basename("item_path")
    return (
        companions_of(items, images, path)
        .select(
            F.col("image_path").alias("query"),
            name.alias("expected"),
            "item_path",
            S.name_number(name).alias("num"),
            S.name_prefix(name).alias("prefix"),
            P.ext("image_path").alias("ext"),
        )
        .where("num is not null")
    )


def order_pairs(pairs: DataFrame) -> DataFrame:
    """By prefix (letter case ignored), number, extension."""
    return pairs.orderBy(
        F.lower("prefix"), F.col("num").cast("long"), "ext", "query"
    )
