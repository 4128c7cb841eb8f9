"""Sequences of chains from a tiled genome, and coding chains fitted to them.

A genome is a table of tiles (name, chunk_no, seq) of equal size, so no row, task or driver holds a whole sequence.  The
intervals of a chain are cut at tile borders, every piece finds its tile by equality, and the pieces are put together in
order.  Equal chains are looked up once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import chains as C
from ..functions import sequences as Q
from ..session import stored
from .pairs import AXIS, chain_classes, class_members
from .ranges import overlap_join
from .transfer import coding_templates, difference, once, refit_rna, trim_to_codons

#: Bases of a tile.
TILE = 65536


def tiles(seqs: DataFrame, size: int = TILE) -> DataFrame:
    """(name, chunk_no, seq): sequences (name, seq) in tiles, counted from 0."""
    n = F.greatest(F.ceil(F.length("seq") / size).cast("int"), F.lit(1))
    return seqs.select("name", "seq", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_no")).select(
        "name", "chunk_no", F.substring("seq", F.col("chunk_no") * size + 1, F.lit(size)).alias("seq")
    )


def tiles_of_lines(lines: DataFrame, size: int = TILE) -> DataFrame:
    """Tiles straight from numbered FASTA lines (value, line_no, and file where there are several), without a row that holds a sequence.

    A line's place in its sequence is a running sum of line lengths since the header, taken over blocks of lines; a line that
    crosses tile borders is cut there.
    """
    from .scans import running

    keys = ["file"] if "file" in lines.columns else []
    text = F.trim("value")
    head = text.startswith(">")
    rows = lines.select(*keys, "line_no", text.alias("text"), head.alias("head"), F.when(head, 0).otherwise(F.length(text)).cast("bigint").alias("n"))
    rows = rows.withColumn("at", F.when(F.col("head"), F.struct("line_no", F.regexp_extract("text", r"^>(\S*)", 1).alias("name"))))
    rows = stored(rows)
    sums = running(rows, keys, "line_no", {"end": ("n", "sum"), "record": ("at", "max")}, inclusive=True, bits=16)
    heads = sums.where("head").select(*keys, F.col("line_no").alias("first"), F.col("end").alias("before"))
    body = sums.where("NOT head AND n > 0 AND record IS NOT NULL").withColumn("first", F.col("record.line_no"))
    body = body.join(heads, [*keys, "first"]).withColumn("from", F.col("end") - F.col("n") - F.col("before"))
    cut = body.select(
        F.col("record.name").alias("name"), "text", "from", "n", F.explode(F.sequence(F.expr(f"`from` div {size}"), F.expr(f"(`from` + n - 1) div {size}"))).alias("chunk_no")
    )
    lo = F.greatest(F.col("from"), F.col("chunk_no") * size)
    hi = F.least(F.col("from") + F.col("n"), (F.col("chunk_no") + 1) * size)
    pieces = cut.select("name", F.col("chunk_no").cast("int").alias("chunk_no"), lo.alias("lo"), F.upper(F.substring("text", (lo - F.col("from") + 1).cast("int"), (hi - lo).cast("int"))).alias("piece"))
    ordered = F.array_sort(F.collect_list(F.struct("lo", "piece")))
    return pieces.groupBy("name", "chunk_no").agg(F.array_join(F.transform(ordered, lambda x: x["piece"]), "").alias("seq"))


def chain_sequences(chains: DataFrame, genome: DataFrame, size: int = TILE) -> DataFrame:
    """Add ``rna``: the sequence of each chain in transcription order.

    ``chains`` has seqid, strand and chain, ``genome`` the tiles of :func:`tiles` with that size.  Bases beyond the end of the
    sequence are missing; a chain without any base is an empty text.  Rows with an empty or NULL chain are kept.
    """
    keys = [*AXIS, "chain"]
    each = chains.where(F.size("chain") > 0).select(*keys).distinct()
    part = each.select(*keys, F.explode("chain").alias("x"))
    tile = F.explode(F.sequence(F.expr(f"(x.s - 1) div {size}"), F.expr(f"(x.e - 1) div {size}")))
    part = part.withColumn("chunk_no", tile)
    lo, hi = F.greatest(F.col("x.s"), F.col("chunk_no") * size + 1), F.least(F.col("x.e"), (F.col("chunk_no") + 1) * size)
    part = part.select(*keys, F.col("chunk_no").cast("int").alias("chunk_no"), lo.alias("lo"), hi.alias("hi"))
    found = part.join(genome.withColumnRenamed("name", "seqid"), ["seqid", "chunk_no"])
    offset = F.col("lo") - F.col("chunk_no") * F.lit(size).cast("bigint")
    found = found.select(*keys, "lo", F.substring("seq", offset.cast("int"), (F.col("hi") - F.col("lo") + 1).cast("int")).alias("piece"))
    ordered = F.array_sort(F.collect_list(F.struct("lo", "piece")))
    forward = found.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x["piece"]), "").alias("rna"))
    rna = forward.withColumn("rna", F.when(F.col("strand") == "-", Q.reverse_complement(F.col("rna"))).otherwise(F.col("rna")))
    return chains.join(rna, keys, "left").withColumn("rna", F.coalesce("rna", F.lit("")))


def fitted_to_sequence(tx: DataFrame, genome: DataFrame, size: int = TILE, check_length: bool = True) -> DataFrame:
    """Every query class with every template coding chain whose longest compatible stretch can be read in its sequence.

    The stretch (:func:`..functions.chains.longest_compatible`) is trimmed to whole codons of the template, then fitted to the
    sequence of the query's exons (:func:`.transfer.refit_rna`), and compared with the template.
    """
    q = chain_classes(tx.where(~F.col("is_template"))).select(*AXIS, "tid", "start", "end", "chain")
    q = chain_sequences(q, genome, size)
    p = overlap_join(q, coding_templates(tx, check_length), AXIS)
    own, cds = F.col("l_chain"), F.col("r_cds")
    cut = once(p, "cut", C.longest_compatible(own, cds)).where(C.chain_length(F.col("cut")) >= 3)
    if check_length:
        cut = once(cut, "cut", trim_to_codons(F.col("cut"), F.col("cut"), cds, F.col("strand"))).where(C.chain_length(F.col("cut")) >= 3)
    first = F.when(F.col("strand") == "-", C.chain_end(cds)).otherwise(C.chain_start(cds))
    fit = refit_rna(cut.withColumn("t0", first), "l_chain", "cut", "strand", "l_rna", "t0").where(C.chain_length(F.col("refit")) >= 3)
    return once(fit, "d", difference(cds, F.col("refit"), F.col("strand"))).select(
        F.col("l_tid").alias("class_tid"), F.col("r_first").alias("first"), F.col("refit").alias("fitted"), C.chain_length(F.col("refit")).alias("n"), "d.*"
    )


def transfer_with_sequence(tx: DataFrame, genome: DataFrame, size: int = TILE, check_length: bool = True) -> DataFrame:
    """(tid, kind, template, chain, bases, score) as :func:`.transfer.transfer_orfs`, with coding chains fitted to the sequence."""
    from .transfer import best_fits

    return best_fits(fitted_to_sequence(tx, genome, size, check_length), class_members(tx.where(~F.col("is_template"))))
