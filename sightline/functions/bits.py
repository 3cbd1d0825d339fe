"""Bit signatures as Spark columns.

A signature of ``n_bits`` bits is stored as ``ARRAY<BIGINT>`` holding
``ceil(n_bits / 64)`` words.  The row-major bit string is left-padded with
zeros to a multiple of 64 and cut into words, most significant first, so the
first word carries the short remainder.  The hex text form is the bit string
as one number, lower-case, zero-padded to ``ceil(n_bits / 4)`` digits.

The number of bits is fixed by the algorithm and hash size, so every helper
takes it as a Python int and unrolls per-word work at plan-build time: the
resulting expressions are plain ``bit_count(a[i] ^ b[i])`` sums that stay in
whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def n_words(n_bits: int) -> int:
    if n_bits <= 0:
        raise ValueError(f"a signature needs at least one bit, got {n_bits}")
    return (n_bits + 63) // 64


def hex_digits(n_bits: int) -> int:
    return (n_bits + 3) // 4


def _word_slices(n_bits: int) -> list[tuple[int, int]]:
    """(1-based start, length) of each word's bits inside the bit string."""
    words = n_words(n_bits)
    first = n_bits - 64 * (words - 1)
    out = [(1, first)]
    for i in range(1, words):
        out.append((first + 64 * (i - 1) + 1, 64))
    return out


def double_array(values: list[float]) -> Column:
    """A literal ARRAY<DOUBLE> built in one call (shortest round-trip text of
    each double, so the values are exact)."""
    return F.expr("array(" + ", ".join(f"{float(v)!r}D".replace("e", "E") for v in values) + ")")


def int_array(values: list[int]) -> Column:
    """A literal ARRAY<INT> built in one call."""
    return F.expr("array(" + ", ".join(str(int(v)) for v in values) + ")")


def struct_array(rows: list[tuple[int, ...]], names: tuple[str, ...]) -> Column:
    """A literal ARRAY<STRUCT<names: INT>> built in one call."""
    items = ", ".join("named_struct(" + ", ".join(f"'{n}', {int(v)}" for n, v in zip(names, row)) + ")"
                      for row in rows)
    return F.expr(f"array({items})")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a lambda variable.

    A column used inside a higher-order function's lambda is evaluated for
    every element; binding it first keeps per-row work linear."""
    return F.transform(F.array(value), body).getItem(0)


def pack_bits(flags: Column, n_bits: int) -> Column:
    """ARRAY<BOOLEAN> of ``n_bits`` flags (row-major) -> ARRAY<BIGINT> words.

    ``shiftleft`` and ``|`` do not overflow-check, so the 64th bit lands in
    the sign bit under ANSI mode as well.
    """
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")

    def words(f: Column) -> Column:
        return F.array(*[
            F.aggregate(F.slice(f, start, length), zero,
                        lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(F.when(b, one).otherwise(zero)))
            for start, length in _word_slices(n_bits)])

    return words(flags) if n_words(n_bits) == 1 else let(flags, words)


def bits_to_hex(bits: Column, n_bits: int) -> Column:
    """Words -> hex text, ``ceil(n_bits/4)`` lower-case digits."""
    words = n_words(n_bits)
    parts = [F.lpad(F.lower(F.hex(bits.getItem(i))), 16, "0") for i in range(words)]
    full = F.concat(*parts) if len(parts) > 1 else parts[0]
    keep = hex_digits(n_bits)
    return F.substring(full, 16 * words - keep + 1, keep)


def hex_to_bits(hex_text: Column, n_bits: int) -> Column:
    """Hex text -> words.  ``n_bits`` is carried alongside, never guessed
    from the digit count."""
    words = n_words(n_bits)
    padded = F.lpad(F.lower(hex_text), 16 * words, "0")
    return F.array(*[
        F.conv(F.substring(padded, 16 * i + 1, 16), 16, -10).cast("bigint")
        for i in range(words)
    ])


def hamming(a: Column, b: Column, n_bits: int) -> Column:
    """Number of differing bits between two signatures of ``n_bits``."""
    terms = [F.bit_count(a.getItem(i).bitwiseXOR(b.getItem(i)))
             for i in range(n_words(n_bits))]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total.cast("int")


def hamming_to_literal(bits: Column, ref_words: list[int]) -> Column:
    """Distance of every row to one fixed signature, inlined as literals
    (constant-folded; no join)."""
    terms = [F.bit_count(bits.getItem(i).bitwiseXOR(F.lit(int(w)).cast("bigint")))
             for i, w in enumerate(ref_words)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total.cast("int")


def similarity_value(distance: int, n_bits: int) -> float:
    """Similarity in percent, same operation order as the column form."""
    return max(0.0, (1.0 - distance / n_bits) * 100.0)


def similarity_pct(distance: Column, n_bits: int | Column) -> Column:
    """``max(0, (1 - d / n) * 100)`` in doubles."""
    n = n_bits if isinstance(n_bits, Column) else F.lit(int(n_bits))
    ratio = distance.cast("double") / n.cast("double")
    return F.greatest(F.lit(0.0), (F.lit(1.0) - ratio) * F.lit(100.0))


def max_distance(threshold: float, n_bits: int) -> int:
    """Largest distance whose similarity still reaches ``threshold``.

    Similarity falls as the distance grows, so ``similarity >= t`` is the
    same row set as ``distance <= max_distance(t, n)``; -1 means no row can
    pass.  Found by evaluating the exact double formula for every distance.
    """
    best = -1
    for d in range(n_bits + 1):
        if similarity_value(d, n_bits) >= threshold:
            best = d
        else:
            break
    return best


def words_to_python_bits(words: list[int], n_bits: int) -> str:
    """Driver-side helper for tests: words -> '0101…' string of n_bits."""
    out = []
    for i, (_, length) in enumerate(_word_slices(n_bits)):
        w = int(words[i]) & ((1 << 64) - 1)
        out.append(format(w, "064b")[-length:])
    return "".join(out)
