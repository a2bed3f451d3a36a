"""Mutation and pair identifiers, alleles and sequences as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of the two strands, lower case (fixed values).
REVERSE = ("-", "n", "negative", "neg", "reverse", "rev", "-1")
FORWARD = ("+", "p", "positive", "pos", "forward", "fwd", "1", "")


def strand_reverse(strand: Column) -> Column:
    """Whether the text of a strand names the reverse one; an absent strand is forward, an unknown spelling null."""
    s = F.lower(F.trim(strand))
    return F.when(strand.isNull() | s.isin(*FORWARD), False).when(s.isin(*REVERSE), True)


def strand_of(strand: Column, kind: str) -> Column:
    """The same for a column of Spark type ``kind``: flags say it themselves, numbers by being other than 0.

    An unknown spelling is an error.
    """
    if kind == "string":
        return F.when(strand_reverse(strand).isNull(), F.raise_error(F.concat(F.lit("unknown strand: "), strand))).otherwise(strand_reverse(strand))
    return F.coalesce(strand if kind == "boolean" else strand != 0, F.lit(False))


def parse_mutation(m: Column) -> Column:
    """``GENE:CHROM:POS:REF:ALT[:STRAND]`` as a struct; null where malformed."""
    p = F.split(m, ":")
    value = F.struct(F.get(p, 0).alias("gene"), F.get(p, 1).alias("chrom"))
    value = value.withField("pos", F.try_to_number(F.get(p, 2), F.lit("999999999999")).cast("long")).withField("ref", F.get(p, 3)).withField("alt", F.get(p, 4)).withField("rev", F.coalesce(strand_reverse(F.get(p, 5)), F.lit(False)))
    return F.when(F.size(p).isin(5, 6) & F.get(p, 2).rlike("^[0-9]+$"), value)


def parse_pair(key: Column) -> Column:
    """Both mutations of ``a|b``; null unless there are two, on one chromosome and one strand."""
    p = F.split(key, r"\|")
    a, b = parse_mutation(F.get(p, 0)), parse_mutation(F.get(p, 1))
    good = (F.size(p) == 2) & (a["chrom"] == b["chrom"]) & (a["rev"] == b["rev"])
    return F.when(good, F.struct(a.alias("a"), b.alias("b")))


def pair_key(gene: Column, chrom: Column, pos1: Column, ref1: Column, alt1: Column, pos2: Column, ref2: Column, alt2: Column, strand: Column) -> Column:
    """The pair identifier, lower position first; null if any part is missing."""
    s = F.coalesce(strand, F.lit("P"))
    one = F.concat(gene, F.lit(":"), chrom, F.lit(":"), pos1.cast("string"), F.lit(":"), ref1, F.lit(":"), alt1, F.lit(":"), s)
    two = F.concat(gene, F.lit(":"), chrom, F.lit(":"), pos2.cast("string"), F.lit(":"), ref2, F.lit(":"), alt2, F.lit(":"), s)
    return F.when(pos1 <= pos2, F.concat(one, F.lit("|"), two)).otherwise(F.concat(two, F.lit("|"), one))


def canonical_mutation(m: Column) -> Column:
    """Without ``chr`` and strand, alleles in upper case."""
    p = F.split(F.regexp_replace(m, r":[PN]$", ""), ":", 5)
    return F.concat_ws(":", F.get(p, 0), F.regexp_replace(F.get(p, 1), "^chr", ""), F.get(p, 2), F.upper(F.get(p, 3)), F.upper(F.get(p, 4)))


def gene_free(key: Column) -> Column:
    """A pair identifier with genes and strands left out."""
    def part(m: Column) -> Column:
        p = F.split(m, ":")
        return F.concat_ws(":", F.lit("_"), F.get(p, 1), F.get(p, 2), F.get(p, 3), F.get(p, 4))

    return F.array_join(F.transform(F.split(key, r"\|"), part), "|")


def complement(s: Column) -> Column:
    return F.translate(s, "ACGTacgt", "TGCAtgca")


def reverse_complement(s: Column) -> Column:
    return complement(F.reverse(s))


def is_snv(ref: Column, alt: Column) -> Column:
    return ref.rlike("^[ACGT]$") & alt.rlike("^[ACGT]$") & (ref != alt)


def fit_length(s: Column, n: int) -> Column:
    """Centre-padded with N, or centre-cropped, to ``n``."""
    left = F.floor((n - F.length(s)) / 2).cast("int")
    crop = F.floor((F.length(s) - n) / 2).cast("int") + 1
    padded = F.concat(F.repeat(F.lit("N"), left), s, F.repeat(F.lit("N"), n - F.length(s) - left))
    return F.when(F.length(s) >= n, F.substring(s, crop, F.lit(n))).otherwise(padded)


def parse_underscored(v: Column) -> Column:
    """``chr_pos_ref_alt_build`` as a struct; null where malformed."""
    p = F.split(v, "_")
    value = F.struct(F.regexp_replace(F.get(p, 0), "^chr", "").alias("chrom"), F.get(p, 1).cast("long").alias("pos"), F.get(p, 2).alias("ref"), F.get(p, 3).alias("alt"), F.get(p, 4).alias("build"))
    return F.when((F.size(p) == 5) & F.get(p, 1).rlike("^[0-9]+$"), value)


def parse_change(v: Column) -> Column:
    """``ref, pos, alt`` of ``A->B``, ``A/B``, ``T216A``, ``pos:ref:alt`` and ``pos-A``; what a notation lacks is null."""
    forms = (("^([ACGT]+)->([ACGT]+)$", 1, 0, 2), ("^([ACGT]+)/([ACGT]+)$", 1, 0, 2), ("^([ACGT])([0-9]+)([ACGT])$", 1, 2, 3), ("^([0-9]+):([ACGT]+):([ACGT]+)$", 2, 1, 3), ("^([0-9]+)-([ACGT])$", 0, 1, 2))
    out = F.lit(None).cast("struct<ref:string,pos:bigint,alt:string>")
    for form, ref, pos, alt in forms:
        part = lambda k, form=form: F.regexp_extract(v, form, k) if k else F.lit(None)
        out = F.when(v.rlike(form), F.struct(part(ref).cast("string").alias("ref"), part(pos).cast("long").alias("pos"), part(alt).cast("string").alias("alt"))).otherwise(out)
    return out


def to_dna(s: Column) -> Column:
    return F.translate(s, "Uu", "Tt")


def window_offsets(pos1: Column, pos2: Column, context: int, reverse: Column) -> Column:
    """``start, end, off1, off2``: the window ``context`` around two positions, and their places in its text."""
    start, end = F.least(pos1, pos2) - context, F.greatest(pos1, pos2) + context - 1
    at = lambda p: F.when(reverse, end - p).otherwise(p - start)
    return F.struct(start.alias("start"), end.alias("end"), at(pos1).alias("off1"), at(pos2).alias("off2"))


def excluded_gene(gene: Column, names: list[str], prefixes: list[str]) -> Column:
    out = gene.isin(*names)
    for p in prefixes:
        out = out | gene.startswith(p)
    return out
