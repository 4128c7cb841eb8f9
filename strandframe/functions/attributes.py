"""Attribute bags of annotation lines: text <-> MAP<STRING, STRING>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .chains import let

# Keys written first, in this order, by attribute_text().
KEY_ORDER = (
    "ID", "Parent", "transcript_id", "gene_id", "gene_name", "gene_type", "db_xref",
    "description", "max_TPM", "sample_count", "assembly_id", "tag",
)


def parse_attributes(text: Column, gff: bool = False, keep: str = "first") -> Column:
    """Attribute text to a map; malformed pieces are skipped.

    ``keep`` decides which value of a repeated key stays, "first" or "last".  The two are the two text formats' rules: with
    "first" every semicolon ends a piece, with "last" one between quotes belongs to the value.
    """
    sep = "=" if gff else ' "'
    cut = F.split(text, ";") if keep == "first" else F.regexp_extract_all(text, F.lit(r'(?:[^";]|"[^"]*"|")+'), F.lit(0))
    bare = F.transform(cut, lambda p: F.btrim(F.trim(p), F.lit('"')))
    # exactly one separator, as in the text format
    pieces = F.filter(bare, lambda p: (F.instr(p, sep) > 1) & (F.instr(F.substring(p, F.instr(p, sep) + 1, F.length(p)), sep) == 0))

    def pair(p: Column) -> Column:
        at = F.instr(p, sep)
        value = F.substring(p, at + len(sep), F.length(p))
        return F.struct(F.trim(F.substring(p, F.lit(1), at - 1)).alias("key"), value.alias("value"))

    pairs = F.transform(pieces, pair)

    def kept(both: Column) -> Column:
        names = both["names"]
        if keep == "first":
            return F.filter(both["pairs"], lambda p, i: F.array_position(names, p["key"]) == i + 1)
        return F.filter(both["pairs"], lambda p, i: ~F.array_contains(F.slice(names, i + 2, F.size(names)), p["key"]))

    # let() keeps the split text from being taken apart again for every piece
    named = let(pairs, lambda ps: F.struct(ps.alias("pairs"), F.transform(ps, lambda p: p["key"]).alias("names")))
    return F.map_from_entries(let(named, kept))


def parsed_value(text: Column, key: str) -> Column:
    """The value of one key in ``parse_attributes(text)``.  ``key`` is a plain word.

    The first place of the key is looked at alone; the text is taken apart only if that is not a whole, plainly written piece.
    """
    at = F.instr(text, key)
    before = F.rtrim(F.substring(text, F.lit(1), at - 1))
    tail = F.substring(text, at + len(key), F.length(text))
    value = F.substring_index(F.substring(tail, 3, 1 << 30), '"', 1)
    after = F.substring(tail, F.length(value) + 3, F.length(tail))
    ended = F.startswith(after, F.lit('"')) & ((F.rtrim(after) == '"') | F.startswith(F.ltrim(F.substring(after, 2, 1 << 30)), F.lit(";")))
    plain = ((before == "") | F.endswith(before, F.lit(";"))) & F.startswith(tail, F.lit(' "')) & (value != "") & (F.instr(value, ";") == 0) & ended
    return F.when(at == 0, None).when(plain, value).otherwise(F.try_element_at(parse_attributes(text), F.lit(key)))


def attribute(text: Column, key: str) -> Column:
    """One value of GTF attribute text, NULL if the key is absent.  ``key`` must match whole."""
    return F.nullif(F.regexp_extract(text, rf'(?:^|;)\s*{key} "([^"]*)"', 1), F.lit(""))


def attribute_or_dash(attrs: Column, key: str) -> Column:
    return F.coalesce(F.try_element_at(attrs, F.lit(key)), F.lit("-"))


def rename_keys(attrs: Column, names: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.transform_keys(attrs, lambda k, _: F.coalesce(F.try_element_at(table, k), k))


def add_value(attrs: Column, key: str, value: Column, *, sep: str = ",", replace: bool = False) -> Column:
    """Set a key; an existing value is extended by ``sep`` + value unless ``replace``."""
    old = F.try_element_at(attrs, F.lit(key))
    new = value if replace else F.when(old.isNull(), value).otherwise(F.concat(old, F.lit(sep), value))
    rest = F.map_filter(attrs, lambda k, _: k != key)
    return F.map_concat(rest, F.create_map(F.lit(key), new))


def attribute_text(attrs: Column, feature: Column | None = None, gff: bool = False) -> Column:
    """Map to attribute text: :data:`KEY_ORDER` first, every other key in sorted order."""
    order = F.array(*[F.lit(k) for k in KEY_ORDER])
    lead = F.filter(order, lambda k: F.map_contains_key(attrs, k))
    rest = F.array_sort(F.array_except(F.map_keys(attrs), order))
    keys = F.concat(lead, rest)
    value = lambda k: F.element_at(attrs, k)
    if not gff:
        return F.array_join(F.transform(keys, lambda k: F.concat(k, F.lit(' "'), value(k), F.lit('";'))), " ")

    def piece(k: Column) -> Column:
        child = feature.isin("exon", "CDS")
        skip = ((feature == "gene") & (k == "transcript_id")) | (child & (k == "gene_id"))
        name = (
            F.when((feature == "gene") & (k == "gene_id"), "ID")
            .when((feature == "transcript") & (k == "transcript_id"), "ID")
            .when((feature == "transcript") & (k == "gene_id"), "Parent")
            .when(child & (k == "transcript_id"), "Parent")
            .otherwise(k)
        )
        return F.when(~skip, F.concat(name, F.lit("="), value(k)))

    return F.array_join(F.array_compact(F.transform(keys, piece)), ";")


def mentions(text: Column, word: str) -> Column:
    """Case-insensitive text search, as used for special-case genes."""
    return F.contains(F.lower(text), F.lit(word.lower()))


def percent_decode(text: Column) -> Column:
    """``%xx`` escapes to text; a plus sign stays a plus sign."""
    return F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def numeric_id(text: Column) -> Column:
    """``PREFIX.gene.transcript`` to STRUCT<gene, transcript>; NULL if malformed."""
    parts = F.split(text, "\\.")
    gene, tx = F.try_element_at(parts, F.lit(2)), F.try_element_at(parts, F.lit(3))
    ok = (F.size(parts) == 3) & gene.rlike("^[0-9]+$") & tx.rlike("^[0-9]+$")
    return F.when(ok, F.struct(gene.cast("bigint").alias("gene"), tx.cast("bigint").alias("transcript")))


def bump_suffix(text: Column, by: Column | int = 1) -> Column:
    """Raise the last dot-separated number by ``by``; ids without one start at ``.0``."""
    by = F.lit(by) if isinstance(by, int) else by
    base = F.regexp_extract(text, r"^(.*)\.([0-9]+)$", 1)
    num = F.regexp_extract(text, r"^(.*)\.([0-9]+)$", 2)
    has = F.length(num) > 0
    bumped = F.concat(base, F.lit("."), (num.try_cast("bigint") + by).cast("string"))
    fresh = F.concat(text, F.lit("."), (by - 1).cast("string"))
    return F.when(by <= 0, text).when(has, bumped).otherwise(fresh)


def float_list_sum(text: Column, sep: str = ",") -> Column:
    return F.aggregate(F.split(text, sep), F.lit(0.0), lambda a, x: a + F.coalesce(x.try_cast("double"), F.lit(0.0)))


def base_name(path: Column) -> Column:
    """File name without folder and extension."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def browser_range(seqid: Column, strand: Column, s: Column, e: Column) -> Column:
    return F.concat(seqid, strand, F.lit(":"), s.cast("string"), F.lit("-"), e.cast("string"))
