"""sightline: visual-similarity search as Spark jobs.

Pictures become perceptual bit signatures inside Spark tasks; signatures are
kept in a partitioned Parquet table and searched with Hamming-distance
predicates that Catalyst plans as narrow filters, broadcast joins or exact
banded equi-joins.
"""

from sightline.functions.bits import (
    bits_to_hex,
    hamming,
    hamming_to_literal,
    hex_to_bits,
    max_distance,
    pack_bits,
    similarity_pct,
)
from sightline.operators.hashes import ALGORITHMS, signature_bits
from sightline.plans.search import SearchConfig, batch_search, picture_signatures, search

__all__ = [
    "ALGORITHMS",
    "SearchConfig",
    "batch_search",
    "bits_to_hex",
    "hamming",
    "hamming_to_literal",
    "hex_to_bits",
    "max_distance",
    "pack_bits",
    "picture_signatures",
    "search",
    "signature_bits",
    "similarity_pct",
]
