"""Annotation text (GTF / GFF3): lines -> features -> transcripts, and back to lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import attributes as A
from ..functions import chains as C
from ..session import pin_layout, stored

FEATURE_FIELDS = ("seqid", "source", "type", "start", "end", "score", "strand", "phase", "attributes")


#: Tables of file blocks up to so many rows (some MB) are sent to all tasks; larger ones are joined by a shuffle.
FEW_BLOCKS = 50_000


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Text lines: value, file and line_no, the place in the file from 0; gz is transparent."""
    return number_lines(spark.read.text(path))


def number_lines(rows: DataFrame) -> DataFrame:
    """Add ``file`` and ``line_no`` to the rows of a file source; rows are not moved unless there are very many blocks.

    A block of a file is read by one task from front to back, whatever else that task reads.  So a row's number is its place
    in its block plus the rows of the file's earlier blocks, and only one row for each block is counted and summed up.  The
    blocks are pinned; should a scan be cut in another way all the same, the query stops with an error.
    """
    spark = rows.sparkSession
    pin_layout(spark)
    here = rows.select(
        "*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id")
    )
    sizes = here.groupBy("file", "_block").agg(F.count(F.lit(1)).alias("n"), F.min("_id").alias("_first"))
    sizes = stored(sizes)
    before = F.sum("n").over(W.partitionBy("file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1))
    shifts = sizes.select("file", "_block", "_first", "n", F.coalesce(before, F.lit(0)).alias("_before"))
    if sizes.count() <= FEW_BLOCKS:
        shifts = F.broadcast(shifts)
    place = F.col("_id") - F.col("_first")
    number = F.when((place >= 0) & (place < F.col("n")), F.col("_before") + place).otherwise(F.raise_error(F.lit("the scan was cut in another way")).cast("bigint"))
    return here.join(shifts, ["file", "_block"], "left").select(*rows.columns, "file", number.alias("line_no"))


def line_order(df: DataFrame) -> Column:
    """What orders lines: their number, and before it the file where there is one."""
    return F.struct("file", "line_no") if "file" in df.columns else F.col("line_no")


def features(lines: DataFrame) -> DataFrame:
    """Feature rows of annotation lines; ``#`` starts a comment anywhere.

    Row-wise only, so it works on batch and on streaming text alike.
    Reversed coordinates are swapped.
    """
    bare = F.when(F.instr("value", "#") > 0, F.regexp_replace("value", "#.*$", "")).otherwise(F.col("value"))
    parts = F.split(bare, "\t")
    # a generator of one row keeps the filter from cutting the text a second time
    f = lines.select("*", F.explode(F.array(parts)).alias("_p")).where(F.size("_p") == 9)
    a, b = F.try_element_at("_p", F.lit(4)).try_cast("bigint"), F.try_element_at("_p", F.lit(5)).try_cast("bigint")
    # the filter on the number of fields may run after one on an id, so shorter lines must not fail here
    text = lambda i: F.trim(F.try_element_at("_p", F.lit(i)))
    kept = [c for c in lines.columns if c != "value"]
    return f.select(
        *kept, text(1).alias("seqid"), text(2).alias("source"), text(3).alias("type"),
        F.least(a, b).alias("start"), F.greatest(a, b).alias("end"),
        text(6).try_cast("double").alias("score"), text(7).alias("strand"), text(8).alias("phase"),
        F.rtrim(F.try_element_at("_p", F.lit(9))).alias("attributes"),
    )


def feature_class(kind: Column) -> Column:
    """What a feature type is, by its name in either case: exon (UTRs too), stop_codon, start_codon, CDS, intron, transcript, gene, or NULL."""
    t = F.lower(kind)
    codon = F.contains(t, F.lit("codon")) | F.contains(t, F.lit("cds"))
    return (
        F.when(F.contains(t, F.lit("utr")) | F.endswith(t, F.lit("exon")), "exon")
        .when(F.contains(t, F.lit("stop")) & codon, "stop_codon")
        .when(F.contains(t, F.lit("start")) & codon, "start_codon")
        .when(t == "cds", "CDS")
        .when(F.startswith(t, F.lit("intron")) | F.endswith(t, F.lit("intron")), "intron")
        .when(F.endswith(t, F.lit("rna")) | F.endswith(t, F.lit("transcript")), "transcript")
        .when(F.endswith(t, F.lit("gene")) | F.startswith(t, F.lit("gene")), "gene")
    )


def by_class(feats: DataFrame) -> DataFrame:
    """Features with their class as type, for files that name them otherwise; types without a class stay."""
    return feats.withColumn("type", F.coalesce(feature_class(F.col("type")), "type"))


def line_dialect(value: Column) -> Column:
    """gtf, gff or NULL for one line; the first decisive line decides a file."""
    blank = (F.trim(value) == "") | value.startswith("#")
    fields = F.split(value, "\t")
    attrs = F.try_element_at(fields, F.lit(9))
    return (
        F.when(blank, None)
        .when(F.size(fields) != 9, F.lit("none"))
        .when(attrs.contains('transcript_id "') & attrs.contains('gene_id "'), F.lit("gtf"))
        .when(attrs.rlike("(^|;)(ID|Parent)="), F.lit("gff"))
    )


def dialect(spark: SparkSession, path: str) -> str | None:
    first = spark.read.text(path).select(line_dialect(F.col("value")).alias("d")).where("d IS NOT NULL").head()
    return None if first is None or first["d"] == "none" else first["d"]


def with_ids(feats: DataFrame, gff: bool = False) -> DataFrame:
    """Add attrs (map), tid and gene.

    GFF3 exons may name several parents; each gets its own row.
    """
    rest = [c for c in feats.columns if c != "attrs"]
    if not gff:  # ids are found in the text; the map is made only where it is used
        own = [c for c in rest if c not in ("tid", "gene")]
        text = F.col("attributes")
        return feats.select(*own, A.parse_attributes(text).alias("attrs"), A.parsed_value(text, "transcript_id").alias("tid"), A.parsed_value(text, "gene_id").alias("gene"))
    bag = feats.select(*rest, F.explode(F.array(A.parse_attributes(F.col("attributes"), gff))).alias("attrs"))
    get = lambda k: F.try_element_at("attrs", F.lit(k))
    is_tx = F.col("type").isin("transcript", "mRNA")
    owners = F.when(is_tx, F.array(get("ID"))).otherwise(F.split(get("Parent"), ","))
    gene = F.when(is_tx, F.coalesce(get("gene_id"), get("Parent"))).otherwise(get("gene_id"))
    return bag.withColumn("tid", F.explode_outer(owners)).withColumn("gene", gene)


def assemble(feats: DataFrame, *, merge_gap: int | None = None) -> DataFrame:
    """One row per transcript: tid, gene, seqid, strand, source, attributes, chain, cds, phase, off_phase, start, end.

    ``feats`` comes from :func:`with_ids`.  The span is that of the exons;
    transcripts without exons keep an empty chain and their own span.
    ``merge_gap=5`` joins exons at most five bases apart.

    ``phase`` is what the first coding part, in transcription order, declares (0 if nothing).  The frame is walked from there;
    ``off_phase`` holds the coding parts that declare another phase than the walk gives them.
    """
    part = lambda t: F.array_sort(F.array_compact(F.collect_set(F.when(F.col("type") == t, C.interval(F.col("start"), F.col("end"))))))
    declared = F.struct(F.col("start").alias("s"), F.col("end").alias("e"), F.col("phase").try_cast("int").alias("phase"))
    is_tx = F.col("type").isin("transcript", "mRNA")
    one = lambda c: F.coalesce(F.max(F.when(is_tx, F.col(c))), F.max(c)).alias(c)
    tx = feats.where("tid IS NOT NULL").groupBy("tid").agg(
        one("gene"), one("seqid"), one("strand"), one("source"), one("attributes"),
        part("exon").alias("chain"), F.array_sort(F.array_compact(F.collect_set(F.when(F.col("type") == "CDS", declared)))).alias("_coded"),
        F.min("start").alias("_s"), F.max("end").alias("_e"),
    )
    tx = tx.withColumn("cds", F.array_distinct(F.transform("_coded", lambda x: C.interval(x["s"], x["e"]))))
    lead = F.when(F.col("strand") == "-", F.try_element_at("_coded", F.lit(-1))).otherwise(F.try_element_at("_coded", F.lit(1)))
    tx = tx.withColumn("phase", F.coalesce(lead["phase"], F.lit(0)))
    walked = C.let(C.phases_from(F.col("cds"), F.col("strand"), F.col("phase")), lambda w: F.filter("_coded", lambda x: x["phase"].isNotNull() & ~F.array_contains(w, x)))
    tx = tx.withColumn("off_phase", walked)
    if merge_gap is not None:
        tx = tx.withColumn("chain", C.merge(F.col("chain"), merge_gap))
    has = F.size("chain") > 0
    return tx.select(
        "tid", "gene", "seqid", "strand", "source", "attributes", "chain", "cds", "phase", "off_phase",
        F.when(has, C.chain_start(F.col("chain"))).otherwise(F.col("_s")).alias("start"),
        F.when(has, C.chain_end(F.col("chain"))).otherwise(F.col("_e")).alias("end"),
    )


def attribute_values(feats: DataFrame, key: str, feature: str = "transcript", gff: bool = False) -> DataFrame:
    """Distinct (key value, attribute, value) over all lines of one feature type.

    The long form of "a set of values per attribute": nothing is collected.
    """
    bag = feats.where(F.col("type") == feature).select(A.parse_attributes(F.col("attributes"), gff).alias("m"))
    return bag.select(F.try_element_at("m", F.lit(key)).alias("key"), F.explode("m").alias("attribute", "value")).where(
        "key IS NOT NULL"
    ).distinct()


def attribute_table(feats: DataFrame, names: list[str], cols: list[str] = (), feature: str = "transcript") -> DataFrame:
    """One row per transcript with the chosen attributes; the last line wins, missing ones are ``-``.

    ``feats`` needs line_no, see :func:`read_lines`; of several files the last in the order of paths wins.
    """
    rows = with_ids(feats.where(F.col("type") == feature))
    picked = F.struct(*[A.attribute_or_dash(F.col("attrs"), n).alias(n) for n in names], *[F.col(c) for c in cols])
    return rows.groupBy("tid").agg(F.max_by(picked, line_order(rows)).alias("p")).select("tid", "p.*")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df``, after making sure no key repeats."""
    bad = duplicates(df, keys).head(1)
    if bad:
        raise ValueError(f"repeated key: {bad[0].asDict()}")
    return df


def class_map(feats: DataFrame, query: str = "query", template: str = "template", codes: tuple[str, ...] = ("=",)) -> DataFrame:
    """(query, code, template, seqid, strand) of transcripts whose class code is in ``codes``."""
    tx = feats.where(F.col("type") == "transcript")
    a = lambda k: A.attribute(F.col("attributes"), k)
    rows = tx.select(
        a("transcript_id").alias(query), a("class_code").alias("code"), a("cmp_ref").alias(template), "seqid", "strand"
    ).where(F.col("code").isin(*codes))
    return require_unique(rows, [query])


def gene_descriptions(feats: DataFrame) -> DataFrame:
    """(name, description) of gene rows with a description; the last line wins."""
    bag = A.parse_attributes(F.col("attributes"), True)
    rows = feats.where(F.col("type") == "gene").select(
        F.try_element_at(bag, F.lit("Name")).alias("name"), F.try_element_at(bag, F.lit("description")).alias("description"), line_order(feats).alias("_at")
    ).where("description <> '-'")
    return rows.groupBy("name").agg(F.max_by("description", "_at").alias("description"))


def subset(feats: DataFrame, *, genes: DataFrame | None = None, tids: DataFrame | None = None) -> DataFrame:
    """Transcript, exon and CDS rows of the chosen genes or transcripts; children follow their transcript."""
    rows = with_ids(feats.where(F.col("type").isin("transcript", "exon", "CDS")))
    keep = rows.select("tid").where("false")
    if genes is not None:
        keep = keep.union(rows.where(F.col("type") == "transcript").join(genes.select("gene").distinct(), "gene", "left_semi").select("tid"))
    if tids is not None:
        keep = keep.union(tids.select("tid"))
    return rows.join(keep.distinct(), "tid", "left_semi").select(feats.columns)


def subset_by_region(feats: DataFrame, regions: DataFrame) -> DataFrame:
    """Features inside any region (seqid, lo, hi, strand or NULL for all); existence by running maxima, so no pairs."""
    from ..operators.ranges import containing

    every = F.array(*[F.lit(x) for x in "+-.?"])
    own = F.explode(F.when(F.col("strand").isNull(), every).otherwise(F.array("strand")))
    spans = regions.select("seqid", own.alias("_strand"), F.col("lo").alias("start"), F.col("hi").alias("end"))
    rows = feats.withColumn("_strand", F.coalesce("strand", F.lit(".")))
    return containing(rows, spans, ["seqid", "_strand"], "start", "end").where("is_contained").select(feats.columns)


def hierarchical_order(feats: DataFrame) -> DataFrame:
    """Transcript, exon and CDS rows in the order seqid, strand, transcript, type, start, end."""
    rank = F.when(F.col("type") == "transcript", 0).when(F.col("type") == "exon", 1).otherwise(2)
    rows = with_ids(feats.where(F.col("type").isin("transcript", "exon", "CDS"))).withColumn("_rank", rank)
    return rows.orderBy("seqid", "strand", "tid", "_rank", "start", "end").select(feats.columns)


def rename_sequences(feats: DataFrame, names: DataFrame, *, drop_unknown: bool = True) -> DataFrame:
    """Replace seqid by ``names`` (seqid, target); unknown ones are dropped or kept as they are."""
    out = feats.join(names, "seqid", "inner" if drop_unknown else "left")
    return out.withColumn("seqid", F.coalesce("target", "seqid")).select(feats.columns)


def to_lines(feats: DataFrame) -> DataFrame:
    """Feature rows to annotation lines (value)."""
    dash = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    return feats.select(F.concat_ws("\t", *[dash(c) for c in FEATURE_FIELDS]).alias("value"))


def coding_transcripts(tx: DataFrame) -> DataFrame:
    """Add ``coding``: the exons within the coding range, which begins with the first whole codon, with phases (NULL if nothing is coding).

    The range is that of ``cds``; its first part's declared ``phase`` is skipped.
    """
    c = F.col("cds")
    chain = C.coding_chain(F.col("chain"), F.col("strand"), C.chain_start(c), C.chain_end(c), F.col("phase"))
    return tx.withColumn("coding", F.when(F.size(c) > 0, F.filter(chain, lambda x: x["s"] <= x["e"])))


def transcript_lines(tx: DataFrame, source: str = "strandframe") -> DataFrame:
    """(seqid, start, tid, rank, value): transcript line, exon lines, CDS lines whose frame begins with ``phase`` (0 without that column).

    ``attrs`` is the attribute map; without it the text in ``attributes`` is parsed.
    """
    src = F.coalesce("source", F.lit(source)) if "source" in tx.columns else F.lit(source)
    attrs = F.col("attrs") if "attrs" in tx.columns else A.parse_attributes(F.col("attributes"))
    feature = "struct<type:string,s:bigint,e:bigint,phase:string>"
    row = lambda t, x, ph: F.struct(F.lit(t).alias("type"), x["s"].alias("s"), x["e"].alias("e"), ph.alias("phase")).cast(feature)
    whole = F.array(row("transcript", C.interval(F.col("start"), F.col("end")), F.lit(".")))
    exon = F.transform("chain", lambda x: row("exon", x, F.lit(".")))
    parts = [whole, exon]
    if "cds" in tx.columns:
        first = F.col("phase") if "phase" in tx.columns else F.lit(0)
        parts.append(F.transform(C.phases_from(F.col("cds"), F.col("strand"), first), lambda x: row("CDS", x, x["phase"].cast("string"))))
    # a transcript has two attribute texts, whatever the number of its lines
    own = lambda m: F.map_filter(m, lambda k, _: k.isin("transcript_id", "gene_id"))
    texts = C.let(attrs, lambda m: F.array(A.attribute_text(m), A.attribute_text(own(m))))
    each = tx.select("seqid", "strand", "start", "tid", src.alias("source"), texts.alias("texts"), F.concat(*parts).alias("fs"))
    out = each.select("seqid", "strand", "start", "tid", "source", "texts", F.posexplode("fs").alias("rank", "f"))
    text = F.get("texts", F.when(F.col("f.type") == "transcript", 0).otherwise(1))
    line = F.concat_ws(
        "\t", "seqid", "source", F.col("f.type"), F.col("f.s").cast("string"), F.col("f.e").cast("string"), F.lit("."), "strand", F.col("f.phase"), text
    )
    return out.select("seqid", "start", "tid", "rank", line.alias("value"))


def write_transcripts(tx: DataFrame, path: str, source: str = "strandframe") -> None:
    """Write annotation text in the order sequence, start, transcript, rank over the part files.

    Transcripts are dealt out by ranges and become lines in place, so all lines of one are in one file, one behind another,
    and only one row for each transcript is shuffled.
    """
    order = ["seqid", "start", "tid"]
    dealt = tx.repartitionByRange(*order).sortWithinPartitions(*order)
    transcript_lines(dealt, source).select("value").write.mode("overwrite").text(path)


def convert_attributes(feats: DataFrame) -> DataFrame:
    """GTF features with GFF3 attribute text."""
    bag = A.parse_attributes(F.col("attributes"))
    return feats.withColumn("attributes", A.attribute_text(bag, F.col("type"), gff=True))


def write_text(lines: DataFrame, path: str) -> None:
    lines.select("value").write.mode("overwrite").text(path)


def write_tsv(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=header, nullValue="-", quote="")
