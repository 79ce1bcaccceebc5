"""Sequence expressions: cleaning, validation, alphabets, k-mers, set overlap.

Every function takes and returns Columns; all but `kmer_overlap` stay inside the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from crossmer import constants as C
from crossmer.kernels.kmers import overlaps

NOT_AMINO = f"[^{C.AMINO_ACIDS}]"


def clean_sequence(raw: Column) -> Column:
    """Upper-case and delete everything that is not one of the 20 residues."""
    return F.regexp_replace(F.upper(F.trim(raw)), NOT_AMINO, "")


def is_valid_sequence(sequence: Column, min_len: int = C.MIN_SEQUENCE_LENGTH) -> Column:
    return (F.length(sequence) >= min_len) & ~sequence.rlike(NOT_AMINO)


def reduce_sequence(sequence: Column) -> Column:
    """Map residues to their 11 similarity groups, anything else to '?'."""
    source = "".join(C.REDUCED_GROUPS.values())
    target = "".join(group * len(members) for group, members in C.REDUCED_GROUPS.items())
    return F.translate(F.regexp_replace(F.upper(sequence), NOT_AMINO, "?"), source, target)


def encode_residues(sequence: Column) -> Column:
    """Array of matrix indexes, 20 for a non-standard residue."""
    def index(residue: Column) -> Column:
        position = F.call_function("instr", F.lit(C.MATRIX_ORDER), F.upper(residue))
        return F.when(position > 0, position - 1).otherwise(F.lit(len(C.MATRIX_ORDER)))

    return F.transform(residues(sequence), index)


def residues(sequence: Column) -> Column:
    """Array of single letters; empty array for an empty string."""
    return F.when(F.length(sequence) == 0, F.array().cast("array<string>")).otherwise(
        F.split(sequence, "")
    )


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once.

    An expression used inside a higher-order function is evaluated again for
    every element; a lambda variable is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def kmers(sequence: Column, k: int) -> Column:
    """All k-mers in order of position; empty array when the text is shorter than k."""
    def cut(text: Column) -> Column:
        count = F.length(text) - (k - 1)
        return F.when(count < 1, F.array().cast("array<string>")).otherwise(
            F.transform(
                F.sequence(F.lit(1), F.greatest(count, F.lit(1))),
                lambda i: F.substring(text, i, F.lit(k)),
            )
        )

    return bind(sequence, cut)


def kmer_set(sequence: Column, k: int = C.KMER_K) -> Column:
    return F.array_distinct(kmers(sequence, k))


def jaccard(left: Column, right: Column) -> Column:
    """Set overlap of two arrays, 0 when either is empty."""
    def overlap(a: Column, b: Column) -> Column:
        shared = F.size(F.array_intersect(a, b))
        return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
            shared / (F.size(a) + F.size(b) - shared))

    return bind(F.array_distinct(left), lambda a: bind(
        F.array_distinct(right), lambda b: overlap(a, b)))


@F.pandas_udf(T.DoubleType())
def kmer_overlap(left: pd.Series, right: pd.Series) -> pd.Series:
    """Set overlap of the k-mers (of length KMER_K) of two texts, 0 when either has none."""
    return pd.Series(overlaps(left.tolist(), right.tolist(), C.KMER_K))


def letter_lookup(values: dict[str, int], default: int = 0) -> Callable[[Column], Column]:
    """Letter -> integer through a literal array, without a map search per letter."""
    table = F.array(F.lit(default), *[F.lit(values.get(x, default)) for x in C.MATRIX_ORDER])
    return lambda letter: F.get(table, F.call_function("instr", F.lit(C.MATRIX_ORDER), letter))


def blosum_lookup(unknown: int = C.UNKNOWN_SCORE) -> Callable[[Column, Column], Column]:
    """Two letters -> substitution score, ``unknown`` for a non-standard residue."""
    scores = C.blosum62()
    letters = " " + C.MATRIX_ORDER
    table = F.array(*[F.lit(scores.get(x + y, unknown)) for x in letters for y in letters])
    position = lambda letter: F.call_function("instr", F.lit(C.MATRIX_ORDER), F.upper(letter))
    return lambda x, y: F.get(table, position(x) * len(letters) + position(y))


def ungapped_score(left: Column, right: Column) -> Column:
    """Sum of substitution scores over the common length of two strings."""
    score = blosum_lookup()
    size = F.least(F.length(left), F.length(right))
    return F.aggregate(
        F.zip_with(residues(F.substring(left, F.lit(1), size)),
                   residues(F.substring(right, F.lit(1), size)), score),
        F.lit(0), lambda total, value: total + value,
    )


def word_residues(text: Column) -> Column:
    """One residue per blank-separated word, so that copied passages become homologs."""
    words = F.filter(F.split(text, " "), lambda w: w != "")
    number = lambda w: F.conv(F.substring(F.md5(w), 1, 6), 16, 10).cast("int")
    letter = lambda w: F.substring(F.lit(C.AMINO_ACIDS), number(w) % 20 + 1, F.lit(1))
    return F.array_join(F.transform(words, letter), "")


def self_score(sequence: Column) -> Column:
    """Score of a sequence against itself: the most that any of its local alignments can reach."""
    total, diagonal = F.lit(0), C.blosum62()
    for letter in C.AMINO_ACIDS:
        count = F.length(sequence) - F.length(F.replace(sequence, F.lit(letter), F.lit("")))
        total = total + count * diagonal[letter + letter]
    return total
