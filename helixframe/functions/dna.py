"""Column functions on nucleotide strings.

A strand is a string over A, T, G and C; the order A, T, G, C gives the two-bit
codes 0 to 3.  All functions are built-in expressions, so they stay in the JVM,
and give null for null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ATGC"
#: Primers and their matching: length, tolerated edits and shift of an end, least distance between two primers.
PRIMER_LENGTH, PRIMER_EDITS, PRIMER_SHIFT, PRIMER_DISTANCE = 20, 4, 4, 6


def pack(payload: Column) -> Column:
    """Four bases for each byte of a binary column, high pair first."""
    out = F.lower(F.hex(payload))
    for n in range(16):
        out = F.replace(out, F.lit(f"{n:x}"), F.lit(BASES[n >> 2] + BASES[n & 3]))
    return out


def packed_gc(payload: Column) -> Column:
    """GC share of the packed bytes, without packing them: a base is G or C if the high bit of its pair is set; 0 for no bytes."""
    digits = F.hex(payload)
    high = F.length(F.translate(digits, "0145", "")) + F.length(F.translate(digits, "0123456789CD", ""))
    return F.when(F.length(digits) > 0, high / (2 * F.length(digits))).otherwise(0.0)


def unpack(strand: Column) -> Column:
    """The bytes of a packed strand; bases beyond the last full byte are ignored."""
    digits = F.translate(F.substring(strand, F.lit(1), (F.floor(F.length(strand) / 4) * 4).cast("int")), BASES, "0123")
    # 28 base-4 digits are 7 bytes, so a piece fits a long
    pieces = F.regexp_extract_all(digits, F.lit(".{1,28}"), 0)
    return F.unhex(F.array_join(F.transform(pieces, lambda p: F.lpad(F.conv(p, 4, 16), (F.length(p) / 2).cast("int"), F.lit("0"))), ""))


def complement(strand: Column) -> Column:
    return F.translate(strand, "ATGC", "TACG")


def reverse_complement(strand: Column) -> Column:
    return F.reverse(complement(strand))


def gc_count(strand: Column) -> Column:
    return F.length(F.translate(strand, "AT", ""))


def gc_content(strand: Column) -> Column:
    """Share of G and C; 0 for an empty strand."""
    return F.when(F.length(strand) > 0, gc_count(strand) / F.length(strand)).otherwise(0.0)


def runs(strand: Column) -> Column:
    """The homopolymer runs, in order."""
    return F.regexp_extract_all(strand, F.lit("A+|C+|G+|T+"), 0)


def max_run(strand: Column) -> Column:
    """Length of the longest homopolymer run; 0 for an empty strand."""
    return F.coalesce(F.array_max(F.transform(runs(strand), F.length)), F.lit(0))


def max_run_base(strand: Column) -> Column:
    """Base of the first run of the greatest length; null for an empty strand."""
    first = F.filter(runs(strand), lambda r: F.length(r) == max_run(strand))
    return F.substring(F.get(first, 0), 1, 1)


def valid_strand(text: Column) -> Column:
    """Bases only, in either case, and not empty."""
    return F.coalesce(text.rlike("^[ACGTacgt]+$"), F.lit(False))


def normalised_literal(text: Column) -> Column:
    """Upper case without dashes, underscores and white space; null if anything but bases is left."""
    plain = F.upper(F.regexp_replace(text, r"[-_\s]", ""))
    return F.when(valid_strand(plain), plain)


def palindrome(strand: Column) -> Column:
    """Equal to its own reverse complement."""
    return strand == reverse_complement(strand)


def melting_temperature(strand: Column) -> Column:
    """Wallace rule: two degrees for A and T, four for G and C."""
    return 2 * F.length(strand) + 2 * gc_count(strand)


def hamming(a: Column, b: Column) -> Column:
    """Differing positions within the shorter length."""
    n = F.least(F.length(a), F.length(b))
    differs = F.transform(F.sequence(F.lit(1), n), lambda i: (F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1))).cast("int"))
    return F.when(n > 0, F.aggregate(differs, F.lit(0), lambda s, x: s + x)).otherwise(0)


def similarity(a: Column, b: Column) -> Column:
    """Share of equal positions within the shorter length; 0 if that is 0."""
    n = F.least(F.length(a), F.length(b))
    return F.when(n > 0, (n - hamming(a, b)) / n).otherwise(0.0)


def tag(strand: Column, forward: Column, backward: Column) -> Column:
    """Strand between its forward primer and the reverse complement of its reverse primer."""
    return F.concat(forward, strand, reverse_complement(backward))


def primer_end(read: Column, primer: Column) -> Column:
    """Where the primer ends in the read: the earliest end of the least edit distance, if that is tolerable; else null."""
    low, high = F.length(primer) - PRIMER_SHIFT, F.least(F.length(primer) + PRIMER_SHIFT, F.length(read))
    ends = F.when(high >= low, F.sequence(low, high))
    best = F.array_min(F.transform(ends, lambda e: F.struct(F.levenshtein(primer, F.substring(read, F.lit(1), e)).alias("d"), e.alias("end"))))
    return F.when(best["d"] <= F.ceil(F.length(primer) * 0.2), best["end"])


def untag(read: Column, forward: Column, backward: Column) -> Column:
    """What lies between the two primers; null if one isn't found or nothing is between."""
    begin = primer_end(read, forward)
    tail = primer_end(F.reverse(read), F.reverse(reverse_complement(backward)))
    size = F.length(read) - tail - begin
    return F.when(size > 0, F.substring(read, begin + 1, size.cast("int")))


def local_gc(strand: Column, width: int) -> Column:
    """GC share of every window of ``width`` bases; an empty array for a shorter strand."""
    n = F.length(strand) - width + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: gc_count(F.substring(strand, i, F.lit(width))) / F.lit(width))).otherwise(F.array().cast("array<double>"))
