"""Run parameters and k-mer column functions.

Bases are coded A=0 C=1 T=2 G=3, so that a complement is XOR 2. A k-mer of the template strand holds its oldest base in
the lowest two bits, the reverse complement its newest. k is at most 16, so all values fit signed 64-bit columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACTG"  # fixed values: place = code


@dataclass(frozen=True)
class Params:
    """Parameters of an index: bit length from the genome size, k, window width, number of slots."""

    genome_size: int
    read_len: int
    seed: int = 40164
    rep_max_dist: int = 10_000

    def __post_init__(self):
        if self.k > 16:
            raise ValueError("k above 16 is not indexable")
        if self.window < 1:
            raise ValueError("read_len must be at least k")

    @property
    def bitlen(self) -> int:
        n = max(self.genome_size - 1, 1).bit_length()
        return n + n % 2

    @property
    def k(self) -> int:
        return self.bitlen // 2

    @property
    def window(self) -> int:
        return self.read_len + 1 - self.k

    @property
    def slots(self) -> int:
        return 1 << (2 * self.k - 1)


def strict(text: Column) -> Column:
    """Codes as a string of digits; N where a character is no base (case is ignored, U reads as T)."""
    return F.translate(F.regexp_replace(F.translate(text, "acgtuN", "ACGTU-"), "[^ACGTU]", "N"), "ACTUG", "01223")


def nibble(text: Column) -> Column:
    """Codes from bits 1 to 3 of ASCII characters, N from 4 on and for other characters."""
    code = lambda c: (c >> 1) & 7
    plain = F.translate(text, "".join(map(chr, range(128))), "".join(str(code(c)) if code(c) < 4 else "N" for c in range(128)))
    return F.regexp_replace(plain, "[^0-3N]", "N")


#: characters that ``synthetic`` reads from a table; texts with others are read character by character
TABLE = range(1, 0x250)


def synthetic(text: Column) -> Column:
    """Not a biological code: the code point's low two bits, N for '.' and newline; makes long runs of prose."""
    one = lambda c: "N" if chr(c) in ".\n" else str(c & 3)
    plain = F.translate(text, "".join(map(chr, TABLE)), "".join(map(one, TABLE)))
    slow = _each(text, lambda c: F.when(c.isin(".", "\n"), "N").otherwise(F.ascii(c).bitwiseAND(3).cast("string")))
    # a text of one byte a character needs no search but for the first character of all
    beyond = F.when(F.octet_length(text) == F.length(text), F.contains(text, F.lit("\0"))).otherwise(text.rlike("[^\\x{1}-\\x{24F}]"))
    return F.when(beyond, slow).otherwise(plain)


def _each(text: Column, code) -> Column:
    return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), code), "")


def complement(code: Column) -> Column:
    return code.bitwiseXOR(2)


def decode(code: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, BASES)), code + 1)


def template(digits: Column) -> Column:
    """k-mer of a string of k digits, oldest base lowest."""
    return F.conv(F.reverse(digits), 4, 10).cast("long")


def reverse(digits: Column) -> Column:
    """Reverse complement of a string of k digits, newest base lowest."""
    return F.conv(F.translate(digits, "0123", "2301"), 4, 10).cast("long")


def revcmp(v: Column, k: int) -> Column:
    """Reverse complement of a k-mer value."""
    out = F.lit(0).cast("long")
    for j in range(k):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(v, 2 * j).bitwiseAND(3).bitwiseXOR(2).cast("long"), 2 * (k - 1 - j)))
    return out


def is_template(dna: Column, rc: Column) -> Column:
    return (dna < rc) | ((dna == rc) & (dna.bitwiseAND(1) == 1))


def canonical(dna: Column, rc: Column) -> Column:
    return F.when(is_template(dna, rc), dna).otherwise(rc)


def xmer_hash(v: Column, s: Column | int, k: int) -> Column:
    """Seeded hash that is its own inverse: each half takes from the other the bits that the seed assigns to it."""
    mask = (1 << k) - 1
    s = F.lit(s) if isinstance(s, int) else s
    s = s.cast("long").bitwiseAND(mask)
    high, low = F.shiftright(v, k), v.bitwiseAND(F.lit(mask).cast("long"))
    new_high = high.bitwiseXOR(low.bitwiseAND(F.lit(mask).cast("long").bitwiseXOR(s)))
    return F.shiftleft(new_high, k).bitwiseOR(low.bitwiseXOR(high.bitwiseAND(s)))


def compress(v: Column, k: int) -> Column:
    """Fold a value and its complement onto one slot of half the range."""
    over = 1 << (2 * k - 1)
    return F.when(v.bitwiseAND(F.lit(over).cast("long")) == 0, v).otherwise(F.lit(over - 1).cast("long").bitwiseAND(F.bitwise_not(v)))


def slot(kmer: Column, ext: Column | int, k: int) -> Column:
    return compress(xmer_hash(kmer, ext, k), k)


def extensions(kmer: Column, k: int) -> Column:
    """Number of extensions that give a k-mer different slots.

    The hash reads an extension only where one of the k-mer's halves has a bit, so with b such places there are 2^b slots;
    of all ones, an extension and its complement share one.
    """
    ones = (1 << (2 * k)) - 1
    return F.when(kmer == ones, F.lit(1 << (k - 1))).otherwise(F.pow(F.lit(2.0), F.bit_count(_places(kmer, k)))).cast("long")


def _places(kmer: Column, k: int) -> Column:
    return F.shiftright(kmer, k).bitwiseOR(kmer).bitwiseAND(F.lit((1 << k) - 1).cast("long"))


def extension(kmer: Column, number: Column, k: int) -> Column:
    """The extension of that number (from 0) among those that give a k-mer different slots: its bits, dealt to the places that count."""
    places, out = _places(kmer, k), F.lit(0).cast("long")
    for i in range(k):
        rank = F.bit_count(places.bitwiseAND(F.lit((1 << i) - 1).cast("long")))
        bit = F.pmod(F.floor(number / F.pow(F.lit(2.0), rank)), F.lit(2)).cast("long")
        out = out + F.when(F.shiftright(places, i).bitwiseAND(F.lit(1).cast("long")) == 1, bit * (1 << i)).otherwise(F.lit(0).cast("long"))
    return out


def extension_number(v: int, number: int, k: int) -> int:
    """``extension`` of a number."""
    places, out = (v >> k | v) & ((1 << k) - 1), 0
    for i in range(k):
        if places >> i & 1:
            out |= (number & 1) << i
            number >>= 1
    return out


def slot_number(v: int, ext: int, k: int) -> int:
    """``slot`` of a number."""
    mask, over = (1 << k) - 1, 1 << (2 * k - 1)
    high, low, s = v >> k, v & mask, ext & mask
    v = (high ^ (low & (mask ^ s))) << k | (low ^ (high & s))
    return v if v < over else (over - 1) & ~v


def base_index(dna: Column, rc: Column, seed: int, k: int) -> Column:
    """The slot of a k-mer's canonical strand by the seed, which orders k-mers."""
    return slot(canonical(dna, rc), seed, k)


def located(dna: Column, rc: Column, pos: Column, x: Column | int, k: int) -> tuple[Column, Column]:
    """(slot, packed location) of a k-mer's canonical strand with extension x at pos; no flags and no strand are set."""
    none, x = F.lit(0), F.lit(x) if isinstance(x, int) else x
    return slot(canonical(dna, rc), x, k), pack(x, none, none, pos, none)


def unhash(value: Column, ext: Column | int, k: int) -> Column:
    """Heuristic inverse of ``slot``, for comparison only: it is right for one of the two folded values."""
    f = xmer_hash(value, ext, k)
    ones = F.lit((1 << (2 * k)) - 1).cast("long")
    return F.when(f < revcmp(f, k), xmer_hash(ones.bitwiseAND(F.bitwise_not(value)), ext, k)).otherwise(f)


def route(value: Column, k: int, bits: int) -> Column:
    """The top ``bits`` bits of a slot number."""
    return F.shiftright(value, 2 * k - 1 - bits)


# bit places of a packed location (fixed values): strand 0, position 1-44, annotation 45, dup 46, repetitive 47, extension 48-63
def pack(ext: Column, repetitive: Column, dup: Column, pos: Column, ori: Column) -> Column:
    bit = lambda c, n: F.shiftleft(c.cast("long"), n)
    return bit(ext, 48).bitwiseOR(bit(repetitive, 47)).bitwiseOR(bit(dup, 46)).bitwiseOR(bit(pos, 1)).bitwiseOR(ori.cast("long"))


def unpack(packed: Column) -> dict[str, Column]:
    bits = lambda at, n: F.shiftrightunsigned(packed, at).bitwiseAND(F.lit((1 << n) - 1).cast("long"))
    return {"ext": bits(48, 16).cast("int"), "repetitive": bits(47, 1) == 1, "dup": bits(46, 1) == 1, "pos": bits(1, 44), "ori": bits(0, 1).cast("int")}


def on_period(stored: Column, pos: Column, period: Column) -> Column:
    """Distance to a stored position if it is a multiple of the period, else null."""
    d = F.abs(pos - stored)
    return F.when(d % period == 0, d)


# what changes in a packed location
def _set(packed: Column, at: int, on: bool) -> Column:
    bit = F.lit(1 << at).cast("long")
    return packed.bitwiseOR(bit) if on else packed.bitwiseAND(F.bitwise_not(bit))


def with_dup(packed: Column, on: bool = True) -> Column:
    return _set(packed, 46, on)


def with_repetitive(packed: Column, on: bool = True) -> Column:
    return _set(packed, 47, on)


def with_strand(packed: Column, reverse: bool) -> Column:
    return _set(packed, 0, reverse)


def other_strand(packed: Column) -> Column:
    return packed.bitwiseXOR(F.lit(1).cast("long"))


def without_flags(packed: Column) -> Column:
    """Neither dup nor repetitive."""
    return with_dup(with_repetitive(packed, False), False)


def with_extension(packed: Column, ext: Column | int) -> Column:
    """Another extension (0 clears it), the rest as it is."""
    rest = packed.bitwiseAND(F.lit((1 << 48) - 1).cast("long"))
    return rest.bitwiseOR(F.shiftleft((F.lit(ext) if isinstance(ext, int) else ext).cast("long"), 48))


def extended(packed: Column) -> Column:
    """The next extension; null beyond the last of 65,536."""
    ext = unpack(packed)["ext"]
    return F.when(ext < 65_535, with_extension(packed, ext + 1))


def moved(packed: Column, by: int) -> Column:
    """A position ``by`` bases further."""
    return packed + F.lit(2 * by).cast("long")


def blacklisted(packed: Column) -> Column:
    """A location that bars its slot: no position, no flags, the next extension. One without a position, empty or barred already, stays as it is."""
    return F.when(unpack(packed)["pos"] == 0, packed).otherwise(extended(with_extension(F.lit(0).cast("long"), unpack(packed)["ext"])))


def same_pos_and_ext(a: Column, b: Column) -> Column:
    mask = F.lit(~((1 << 48) - 1) | (((1 << 44) - 1) << 1)).cast("long")
    return a.bitwiseXOR(b).bitwiseAND(mask) == 0


def scope_index(pos: Column, ori: Column, n: int) -> Column:
    """Place of a position and strand in a scope of n entries, n a power of two."""
    return F.shiftleft(pos, 1).bitwiseOR(ori.cast("long")).bitwiseAND(F.lit(n - 1).cast("long"))


def byte_shift(pos: Column) -> Column:
    """Bit place of a base in its byte of four."""
    return (pos.bitwiseAND(F.lit(3).cast("long")) * 2).cast("int")


def repeat_distance(stored: Column, pos: Column, last_contig: Column, max_dist: int) -> Column:
    """Distance from a stored position before, if that lies in the last contig (which begins at ``last_contig``) and is under max_dist; else null."""
    return F.when((stored > last_contig) & (pos - stored < max_dist), pos - stored)
