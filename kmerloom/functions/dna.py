"""Column functions over DNA strings, k-mers and edge masks.

An edge mask keeps eight flags: the high nibble the bases before a k-mer (a c g t from the top),
the low nibble the bases after it (T G C A). Seen from the other strand both nibbles swap.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Flags of the bases before and after a k-mer.
BEFORE = {"A": 0x80, "C": 0x40, "G": 0x20, "T": 0x10}
AFTER = {"A": 0x01, "C": 0x02, "G": 0x04, "T": 0x08}
BASES = "ACGT"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def revcomp(seq: Column | str) -> Column:
    """Reverse complement; case is kept and other characters stay."""
    return F.reverse(F.translate(_c(seq), "ACGTacgt", "TGCAtgca"))


def canonical(kmer: Column | str) -> Column:
    return F.least(_c(kmer), revcomp(kmer))


def is_canonical(kmer: Column | str) -> Column:
    return _c(kmer) <= revcomp(kmer)


def checked_k(k: int) -> int:
    if k < 3 or k % 2 == 0:
        raise ValueError(f"k must be odd and at least 3, not {k}")
    return k


def kmer_array(seq: Column | str, k: int) -> Column:
    """All k-mers of a sequence in order; none if it is shorter than k."""
    s = _c(seq)
    places = F.sequence(F.lit(1), F.length(s) - k + 1)
    return F.when(F.length(s) >= k, F.transform(places, lambda i: F.substring(s, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def occurrences(seq: Column | str, k: int) -> Column:
    """``pos, kmer, before, after`` of every k-mer; before and after are the neighbouring bases or ''."""
    s = _c(seq)
    one = lambda i: F.struct(i.alias("pos"), F.substring(s, i, F.lit(k)).alias("kmer"), F.when(i > 1, F.substring(s, i - 1, F.lit(1))).otherwise("").alias("before"), F.substring(s, i + k, F.lit(1)).alias("after"))
    return F.when(F.length(s) >= k, F.transform(F.sequence(F.lit(1), F.length(s) - k + 1), one))


def flag(base: Column | str, flags: dict[str, int]) -> Column:
    b = _c(base)
    out = F.lit(0)
    for letter, value in flags.items():
        out = F.when(b == letter, value).otherwise(out)
    return out


def swap(mask: Column | str) -> Column:
    """The mask as the other strand sees it."""
    m = _c(mask)
    return F.shiftleft(m, 4).bitwiseOR(F.shiftright(m, 4)).bitwiseAND(255)


def strand_mask(mask: Column | str, forward: Column) -> Column:
    return F.when(forward, _c(mask)).otherwise(swap(mask))


def edge_string(mask: Column | str) -> Column:
    """Eight characters, ``acgtACGT`` with dots for unset flags."""
    m = _c(mask)
    shown = [(BEFORE[b], b.lower()) for b in BASES] + [(AFTER[b], b) for b in BASES]
    return F.concat(*[F.when(m.bitwiseAND(bit) != 0, letter).otherwise(".") for bit, letter in shown])


def edge_string_revcomp(mask: Column | str) -> Column:
    """The display string reverse-complemented as text: letters keep their case."""
    return revcomp(edge_string(mask))


def mask_of_string(text: Column | str) -> Column:
    t = _c(text)
    bits = [BEFORE[b] for b in BASES] + [AFTER[b] for b in BASES]
    out = F.lit(0)
    for i, bit in enumerate(bits):
        out = out.bitwiseOR(F.when(F.substring(t, i + 1, 1) != ".", bit).otherwise(0))
    return out


def next_bases(mask: Column | str) -> Column:
    m = _c(mask)
    return F.filter(F.array(*[F.when(m.bitwiseAND(AFTER[b]) != 0, b) for b in BASES]), lambda x: x.isNotNull())


def previous_bases(mask: Column | str) -> Column:
    m = _c(mask)
    return F.filter(F.array(*[F.when(m.bitwiseAND(BEFORE[b]) != 0, b) for b in BASES]), lambda x: x.isNotNull())


def successors(node: Column | str, mask: Column | str, k: int) -> Column:
    """Strings that follow an oriented k-mer; the mask is in the strand of the string."""
    n = _c(node)
    return F.transform(next_bases(mask), lambda b: F.concat(F.substring(n, 2, k - 1), b))


def predecessors(node: Column | str, mask: Column | str, k: int) -> Column:
    n = _c(node)
    return F.transform(previous_bases(mask), lambda b: F.concat(b, F.substring(n, 1, k - 1)))


def pack(kmer: Column | str) -> Column:
    """Two bits a base as one positive BIGINT, for k up to 31; the order is that of the strings."""
    return F.conv(F.translate(_c(kmer), BASES, "0123"), 4, 10).cast("long")


def unpack(code: Column | str, k: int) -> Column:
    return F.translate(F.lpad(F.conv(_c(code).cast("string"), 10, 4), k, "0"), "0123", BASES)


def overlap_after(target: Column | str, ref: Column | str, k: int) -> Column:
    """The strand of ``target`` that follows ``ref`` with k - 1 shared bases, the string as given first; else null."""
    t, r = _c(target), _c(ref)
    tail = F.substring(r, 2, k - 1)
    return F.when(F.substring(t, 1, k - 1) == tail, t).when(F.substring(revcomp(t), 1, k - 1) == tail, revcomp(t))


def overlap_before(target: Column | str, ref: Column | str, k: int) -> Column:
    t, r = _c(target), _c(ref)
    head = F.substring(r, 1, k - 1)
    return F.when(F.substring(t, 2, k - 1) == head, t).when(F.substring(revcomp(t), 2, k - 1) == head, revcomp(t))


def repeated_to(text: Column | str, size: Column) -> Column:
    """The text repeated up to a length."""
    return F.rpad(F.lit(""), size, _c(text)) if isinstance(size, int) else F.substring(F.repeat(_c(text), F.ceil(size / F.length(_c(text))).cast("int")), F.lit(1), size)
