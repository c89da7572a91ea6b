"""Content-addressed blobs: intake, layout, use and sweep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Types that are stored, and the largest upload.
MEDIA_TYPES = ["application/pdf", "image/png", "image/jpeg", "image/webp"]
MOST_BYTES = 80 * 1024 * 1024


def accepted_pdfs(files: DataFrame) -> DataFrame:
    """Files (path, content) that are PDFs of a size that is taken, with their digest."""
    return files.where((F.octet_length("content") > 0) & (F.octet_length("content") <= MOST_BYTES) & (F.substring("content", 1, 4) == F.lit(b"%PDF"))).withColumn("file_hash", F.sha2("content", 256))


def is_digest(c: Column) -> Column:
    return F.coalesce(c.rlike("^[0-9a-f]{64}$"), F.lit(False))


def blob_path(digest: Column) -> Column:
    """Two levels of folders by the digest's first four digits."""
    return F.concat_ws("/", F.substring(digest, 1, 2), F.substring(digest, 3, 2), digest)


def new_blobs(contents: DataFrame, blobs: DataFrame) -> DataFrame:
    """Contents (content, media_type) of types that are stored and that aren't there yet, each once: digest, media_type, size, path, content."""
    rows = contents.where(F.col("media_type").isin(MEDIA_TYPES)).withColumn("digest", F.sha2("content", 256)).dropDuplicates(["digest"])
    return rows.join(blobs.select("digest"), "digest", "left_anti").select("digest", "media_type", F.octet_length("content").cast("long").alias("size"), blob_path(F.col("digest")).alias("path"), "content")


def write_blobs(rows: DataFrame, path: str) -> None:
    """Blobs as Parquet, laid out by the first two digits."""
    rows.withColumn("shard", F.substring("digest", 1, 2)).repartition("shard").write.mode("append").partitionBy("shard").parquet(path)


def referenced_digests(papers: DataFrame, elements: DataFrame) -> DataFrame:
    """All digests in use: papers' files, renders of their pages, images of elements; each once."""
    files = papers.select(F.col("blob_digest").alias("digest"))
    renders = papers.select(F.explode("pages").alias("p")).select(F.col("p.render_digest").alias("digest"))
    images = elements.select(F.col("image.digest").alias("digest"))
    return files.union(renders).union(images).where("digest is not null and digest != ''").distinct()


def orphans(blobs: DataFrame, referenced: DataFrame) -> DataFrame:
    """Blobs that nothing refers to."""
    return blobs.join(referenced.select("digest"), "digest", "left_anti")


def sweep_report(blobs: DataFrame, referenced: DataFrame) -> DataFrame:
    """One row: how many orphans there are and their bytes."""
    return orphans(blobs, referenced).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def bytes_used(blobs: DataFrame) -> DataFrame:
    return blobs.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
