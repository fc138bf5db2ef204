"""Photo-cache operators: which names still need a lookup, merging new
entries into the cache, slugs and photo columns.

The cache is a (name, url) table where url '' marks a known miss; overrides
are a (name, slug) table whose NULL slug means no override. The HTTP fetch of
the reference is not built (no network on executors); these are the data
parts around it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import upgrade_thumbnail, wiki_slug
from ..sources.versions import update_table


def names_to_fetch(names: DataFrame, cache: DataFrame, overrides: DataFrame,
                   name: str = "player_name") -> DataFrame:
    """Distinct names not in the cache, or cached as a miss ('') while an
    override slug exists for them."""
    n = names.select(F.col(name).alias("name")).where(F.col("name").isNotNull()).distinct()
    c = cache.select(F.col("name").alias("__cname"), F.col("url").alias("__curl"))
    o = overrides.where(F.col("slug").isNotNull()).select(F.col("name").alias("__oname"), "slug")
    j = (n.join(c, n.name == c.__cname, "left")
          .join(o, n.name == o.__oname, "left"))
    need = F.col("__cname").isNull() | ((F.col("__curl") == "") & F.col("__oname").isNotNull())
    return j.where(need).select("name", wiki_slug("name", "slug").alias("slug"))


def merge_cache(cache: DataFrame, updates: DataFrame) -> DataFrame:
    """New cache: entries of ``updates`` replace those with the same name;
    other cache entries stay (left anti join + union by name)."""
    u = updates.select("name", "url")
    kept = cache.select("name", "url").join(u.select("name"), "name", "left_anti")
    return kept.unionByName(u)


def write_back(updates: DataFrame, path: str) -> int:
    """Merge ``updates`` (one row a name) into the cache at ``path`` and write it back over
    itself; returns its version. A cache that was never written starts with ``updates``.
    The merge reads the current version while it writes the next one beside it, so a
    failure loses no entry, and a writer that was overtaken merges again, into what
    the other one wrote."""
    new = updates.select("name", "url")
    return update_table(updates.sparkSession, path, lambda cache: new if cache is None else merge_cache(cache, new), "json")


def with_photo(players: DataFrame, cache: DataFrame, name: str = "player_name") -> DataFrame:
    """Players with their cached photo URL upgraded to the large thumbnail;
    '' when there is none."""
    c = cache.select(F.col("name").alias("__pname"), F.col("url").alias("__purl"))
    j = players.join(c, F.col(name) == F.col("__pname"), "left")
    return j.withColumn("photo_url", F.coalesce(upgrade_thumbnail(F.col("__purl")), F.lit(""))) \
            .drop("__pname", "__purl")
