"""Imports every operator module, which fills the registry."""

from . import (centroids, compression_bands, decontaminate, lattice, licences, line_store, ngram_join, packing,  # noqa: F401
               paragraph_dedup, preference, prefix_trie, secret_scan, toxicity)
from .registry import ORACLES, QUERIES  # noqa: F401
