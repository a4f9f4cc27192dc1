"""Document fingerprints: a homomorphic hash of a document's multiset of paragraph pieces.

A text is cut into pieces: lines, cut again after sentence ends and every 96
characters. Each piece is hashed to a wide vector, and the vectors are summed:

* 8 wide lanes of 32 bits, modulo 2**32, tell whether two multisets are equal;
* 128 narrow lanes each count the pieces with one hash bit set, modulo 2**32, more than any text
  has pieces. The difference of two documents' lanes estimates by how many pieces they differ. As text they are written modulo 2**16.

Sums don't depend on the order of the pieces, and a piece is inserted or deleted by adding
or subtracting its own vector. Everything is a Spark expression on the row: no
shuffle, no Python.

Defined results: null and empty texts have no pieces and the zero fingerprint;
two zero fingerprints are alike (1). Repeated rows: see with_edited().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import durable, global_index

PIECE = r"[^.!?\n]{1,96}[.!?\n]*|[.!?\n]+"
WIDE_SEEDS, NARROW_SEEDS = (11, 12, 13, 14), (21, 22)
#: Two 32-bit counters in a 64-bit number. A text has fewer than 2**31 pieces, so that none carries and no sum overflows.
_FIELDS = 0x0000000100000001
_COUNTER = 0xFFFFFFFF
#: The part of each that is written.
_WRITTEN = 0x0000FFFF0000FFFF


def pieces(text: Column) -> Column:
    cut = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PIECE), F.lit(0))
    return F.filter(F.transform(cut, lambda p: F.btrim(p, F.lit(" \t\r\n"))), lambda p: p != "")


def _hash(piece: Column, seed: int) -> Column:
    return F.xxhash64(piece, F.lit(seed))


def fingerprint(text: Column) -> Column:
    """A struct: n (pieces), wide (array of 8 sums) and narrow (array of 64 numbers of two counters)."""

    def sums(found: Column) -> Column:
        def total(values: Column, part) -> Column:
            return F.aggregate(values, F.lit(0).cast("long"), lambda a, h: a + part(h))

        def of_seed(seed: int, parts: list) -> Column:
            hashed = F.transform(found, lambda p: _hash(p, seed))
            # A lambda's parameter holds the hashes, so that they are made once for all sums.
            return F.transform(F.array(hashed), lambda values: F.array(*[total(values, part) for part in parts]))[0]

        halves = [lambda h: h.bitwiseAND(F.lit(0xFFFFFFFF)), lambda h: F.shiftrightunsigned(h, 32)]
        bits = [(lambda h, k=k: F.shiftrightunsigned(h, k).bitwiseAND(F.lit(_FIELDS))) for k in range(32)]
        wide = F.flatten(F.array(*[of_seed(s, halves) for s in WIDE_SEEDS]))
        narrow = F.flatten(F.array(*[of_seed(s, bits) for s in NARROW_SEEDS]))
        return F.struct(F.size(found).cast("long").alias("n"), F.transform(wide, lambda v: v.bitwiseAND(F.lit(0xFFFFFFFF))).alias("wide"), narrow.alias("narrow"))

    return F.transform(F.array(pieces(text)), sums)[0]


def combined(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint of the union of two multisets; sign -1: of a without the pieces of b."""
    added = F.zip_with(a["wide"], b["wide"], lambda x, y: (x + sign * y).bitwiseAND(F.lit(0xFFFFFFFF)))
    lanes = F.zip_with(a["narrow"], b["narrow"], lambda x, y: _packed([p + sign * q for p, q in zip(_counters(x), _counters(y), strict=True)]))
    return F.struct((a["n"] + sign * b["n"]).alias("n"), added.alias("wide"), lanes.alias("narrow"))


def _counters(v: Column) -> list[Column]:
    return [v.bitwiseAND(F.lit(_COUNTER)), F.shiftrightunsigned(v, 32)]


def _packed(counts: list[Column]) -> Column:
    """The inverse of _counters, modulo 2**32."""
    return counts[0].bitwiseAND(F.lit(_COUNTER)).bitwiseOR(F.shiftleft(counts[1], 32))


def as_text(print_: Column) -> Column:
    """Hexadecimal: 8 wide lanes, then 128 narrow ones modulo 2**16, four to a number: of hash bits k, k + 16, k + 32 and k + 48, the last first."""
    wide = F.array_join(F.transform(print_["wide"], lambda v: F.lpad(F.lower(F.hex(v)), 8, "0")), "")
    of_seed = [[F.slice(print_["narrow"], at, 16) for at in (first, first + 16)] for first in range(1, 32 * len(NARROW_SEEDS), 32)]
    four = lambda low, high: low.bitwiseAND(F.lit(_WRITTEN)).bitwiseOR(F.shiftleft(high.bitwiseAND(F.lit(_WRITTEN)), 16))
    numbers = F.flatten(F.array(*[F.zip_with(low, high, four) for low, high in of_seed]))
    narrow = F.array_join(F.transform(numbers, lambda v: F.lpad(F.lower(F.hex(v)), 16, "0")), "")
    return F.concat(wide, narrow)


def likeness(a: Column, b: Column) -> Column:
    """1 for equal multisets, about 0 for disjoint ones; between, one minus the estimated squared distance over the squared sizes.

    With counters c of n pieces, 2 c - n is a sum of random signs, one for each piece; its mean
    square over the lanes estimates the squared size of the multiset, and that of a difference the squared distance.
    """

    def squares(differences: list[Column], n: Column) -> Column:
        # In doubles: exact to 2**53, and no overflow beyond.
        each = [(2 * d - n).cast("double") for d in differences]
        return sum((x * x for x in each), F.lit(0.0))

    def signs(x: Column, n: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + squares(_counters(v), n))

    def apart(x: Column, y: Column, n: Column) -> Column:
        each = F.zip_with(x, y, lambda u, v: squares([p - q for p, q in zip(_counters(u), _counters(v), strict=True)], n))
        return F.aggregate(each, F.lit(0.0), lambda acc, v: acc + v)

    whole = signs(a["narrow"], a["n"]) + signs(b["narrow"], b["n"])
    value = 1 - apart(a["narrow"], b["narrow"], a["n"] - b["n"]) / whole
    return F.when(a["wide"] == b["wide"], F.lit(1.0)).when(whole == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def with_edited(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, text, lent, print, next_print): each document beside what its edited text borrows.

    The last third of the characters gives way to the first as many of the next
    document in descending order of id, nulls last; the first follows the last. Equal ids are ordered by a hash of
    their texts, and of wholly equal rows each but the last is followed by its own copy.

    Only ids, lengths and hashes are ordered. The texts are shuffled once by their key, and each sends the
    characters that are asked of it to the document before it.
    """
    text, key = F.coalesce("text", F.lit("")), ["id0", "none", "h"]
    named = [F.coalesce("doc_id", F.lit(0)).alias("id0"), F.col("doc_id").isNull().alias("none"), F.xxhash64(text).alias("h")]
    thin = docs.select(*named, F.length(text).cast("long").alias("n_chars")).groupBy(*key, "n_chars").agg(F.count("*").alias("copies"))
    placed = durable(global_index(thin, [F.col("none"), F.col("id0").desc(), F.col("h"), F.col("n_chars")], "place"))
    n = max(1, placed.count())
    # The document before this one: its edited text asks for characters of this one.
    before = placed.select(((F.col("place") + 1) % n).alias("place"), *[F.col(c).alias(f"to_{c}") for c in (*key, "n_chars")])
    known = placed.join(before, "place").drop("place")
    held = docs.select(*named, text.alias("text")).dropDuplicates(key).join(known, key)
    own = held.select(*key, "text", "n_chars", "copies", fingerprint(F.col("text")).alias("print"))
    lent = held.select(*[F.col(f"to_{c}").alias(c) for c in key], F.substring("text", F.lit(1), F.floor(F.col("to_n_chars") / 3).cast("int")).alias("lent"), fingerprint(F.col("text")).alias("next_print"))
    both = own.join(lent, key).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    own_next = F.col("nth") < F.col("copies")
    lent = F.when(own_next, F.substring("text", F.lit(1), F.floor(F.col("n_chars") / 3).cast("int"))).otherwise(F.col("lent"))
    return both.select(F.when(~F.col("none"), F.col("id0")).alias("doc_id"), "n_chars", "text", lent.alias("lent"), "print", F.when(own_next, F.col("print")).otherwise(F.col("next_print")).alias("next_print"))


def edited_prints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited, print, edited_print, next_print) of every row."""
    both = with_edited(docs)
    kept = F.col("n_chars") - F.floor(F.col("n_chars") / 3)
    edited = F.concat(F.substring("text", F.lit(1), kept.cast("int")), "lent")
    return both.select("doc_id", "n_chars", edited.alias("edited"), "print", fingerprint(edited).alias("edited_print"), "next_print")
