"""Sample -> tissue -> cohort summaries and tracking levels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import attributes as A
from ..session import stored
from .lookup import resolve_roots
from .scans import running


def upper_median(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """(keys, out): element n/2 (from 0) of the sorted integer values, exactly.

    Values are counted per (key, value) on the map side; the position is a
    running sum, so no group is ever collected.
    """
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.groupBy(*keys).agg((F.expr("sum(_n) div 2") + 1).alias("_want"))
    cum = running(counts, keys, value, {"_cum": ("_n", "sum")}, inclusive=True)
    return cum.join(total, keys).where("_cum >= _want").groupBy(*keys).agg(F.min(value).alias(out))


def cohort_stats(samples: DataFrame) -> DataFrame:
    """Per transcript: tissues, samples, samples per tissue and expression statistics.

    ``samples`` has one row per sample: (id, tissue, value), value an integer.
    Medians: of samples per tissue the middle pair is averaged and truncated;
    of values the upper element counts.  Spreads are population deviations.
    ``samples`` is evaluated once.
    """
    samples = stored(samples.select("id", "tissue", "value"))
    per_tissue = samples.groupBy("id", "tissue").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("sum"),
    )
    base = per_tissue.groupBy("id").agg(
        F.count(F.lit(1)).alias("n_tissues"), F.sum("n").alias("n_samples"),
        F.avg("n").alias("mean_samples"), F.stddev_pop("n").alias("sd_samples"),
    )
    spread = samples.groupBy("id").agg(F.avg("value").alias("mean_value"), F.stddev_pop("value").alias("sd_value"))
    counts = per_tissue.select("id", "n")
    hi = upper_median(counts, ["id"], "n", "hi")
    lo = upper_median(counts.withColumn("n", -F.col("n")), ["id"], "n", "lo")
    med = hi.join(lo, "id").select("id", F.expr("(hi - lo) div 2").alias("median_samples"))
    val = upper_median(samples, ["id"], "value", "median_value")
    return base.join(spread, "id").join(med, "id").join(val, "id")


def threshold_counts(samples: DataFrame, threshold: float) -> DataFrame:
    """Per transcript: distinct tissues and samples with a value above the threshold, and the rest."""
    side = F.when(F.col("value") > threshold, "pass").otherwise("fail")
    # counting per (transcript, tissue) first keeps a crowded transcript out of one task
    per = samples.groupBy("id", "tissue", side.alias("side")).agg(F.count(F.lit(1)).alias("n"))
    pick = lambda s, c: F.sum(F.when(F.col("side") == s, c).otherwise(0))
    return per.groupBy("id").agg(
        pick("pass", F.lit(1)).alias("tissues_pass"), pick("pass", F.col("n")).alias("samples_pass"),
        pick("fail", F.lit(1)).alias("tissues_fail"), pick("fail", F.col("n")).alias("samples_fail"),
    )


def tracking_levels(rows: DataFrame, levels: list[str]) -> DataFrame:
    """Mean tpm, mean cov and number of samples at every level of a hierarchy.

    ``rows`` has tid, one column per level (top first), tpm and cov; the
    result has (tid, level, name, tpm_mean, cov_mean, num_samples).
    """
    steps = F.array(*[
        F.struct(F.lit(i).alias("level"), F.col(c).cast("string").alias("name"), F.concat_ws("/", *levels[: i + 1]).alias("path"))
        for i, c in enumerate(levels)
    ])
    long = rows.select("tid", "tpm", "cov", F.explode(steps).alias("x")).where("x.name IS NOT NULL")
    return long.groupBy("tid", F.col("x.level").alias("level"), F.col("x.name").alias("name"), F.col("x.path").alias("path")).agg(
        F.avg("tpm").alias("tpm_mean"), F.avg("cov").alias("cov_mean"), F.count(F.lit(1)).alias("num_samples")
    )


def combined_levels(trackings: DataFrame) -> DataFrame:
    """(tid, path, name, tpm_mean, cov_mean, num_samples): every merged transcript at every node of a hierarchy of merges.

    ``trackings`` holds the rows of all tracking files at once: path (array of names from the top of the hierarchy to the file's
    own), tid, q_tid, fpkm, tpm, cov.  A row without expression (fpkm, tpm or cov of 0) says that q_tid was merged into tid; the
    others are samples.  A sample counts for the transcript at the end of its tid's merges and for all nodes on its path.  A q_tid
    that was merged twice is an error.
    """
    final = (F.col("cov") > 0) & (F.col("fpkm") > 0) & (F.col("tpm") > 0)
    rows = stored(trackings.select("path", "tid", "q_tid", "tpm", "cov", F.coalesce(final, F.lit(False)).alias("final")))
    links = rows.where("NOT final AND q_tid IS NOT NULL").select("q_tid", "tid")
    twice = links.groupBy("q_tid").agg(F.count(F.lit(1)).alias("n")).where("n > 1").head(1)
    if twice:
        raise ValueError(f"merged twice: {twice[0].q_tid}")
    roots = resolve_roots(links, "q_tid", "tid")
    # samples of one merged transcript and file meet before the join, so a transcript with very many of them is one row
    part = rows.where("final").groupBy("path", "tid").agg(F.sum("tpm").alias("tpm"), F.sum("cov").alias("cov"), F.count(F.lit(1)).alias("n"))
    placed = part.join(roots.withColumnRenamed("node", "tid"), "tid", "left").withColumn("tid", F.coalesce("root", "tid"))
    above = F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda i: F.slice("path", F.lit(1), i)))
    nodes = placed.select("tid", "tpm", "cov", "n", above.alias("path")).groupBy("tid", "path").agg(F.sum("tpm").alias("tpm"), F.sum("cov").alias("cov"), F.sum("n").alias("n"))
    return nodes.select(
        "tid", "path", F.element_at("path", -1).alias("name"), (F.col("tpm") / F.col("n")).alias("tpm_mean"), (F.col("cov") / F.col("n")).alias("cov_mean"),
        F.col("n").alias("num_samples"),
    )


def with_tracking(feats: DataFrame, trackings: DataFrame) -> DataFrame:
    """Features whose transcript lines carry ``NAME_tpm_mean``, ``NAME_cov_mean`` and ``NAME_num_samples`` for every node NAME of the hierarchy.

    The nodes of a transcript are as many as the hierarchy has files, however many samples they hold.  Other lines, and
    transcripts without samples, stay as they are; a name that stands at several places of the hierarchy keeps the values of
    its first place in the order of paths.
    """
    levels = combined_levels(trackings)
    entries = F.array(*[F.struct(F.concat("name", F.lit(f"_{c}")).alias("key"), F.col(c).cast("string").alias("value")) for c in ("tpm_mean", "cov_mean", "num_samples")])
    first = levels.groupBy("tid", "name").agg(F.min_by(F.struct("tpm_mean", "cov_mean", "num_samples"), "path").alias("v")).select("tid", "name", "v.*")
    bags = first.groupBy("tid").agg(F.map_from_entries(F.flatten(F.collect_list(entries))).alias("_more"))
    rows = feats.withColumn("_attrs", A.parse_attributes(F.col("attributes")))
    own = F.when(F.col("type") == "transcript", F.try_element_at("_attrs", F.lit("transcript_id")))
    rows = rows.withColumn("_tid", own).join(bags.withColumnRenamed("tid", "_tid"), "_tid", "left")
    kept = F.map_filter("_attrs", lambda k, _: ~F.map_contains_key("_more", k))
    text = F.when(F.col("_more").isNull(), F.col("attributes")).otherwise(A.attribute_text(F.map_concat(kept, "_more")))
    return rows.withColumn("attributes", text).select(feats.columns)
