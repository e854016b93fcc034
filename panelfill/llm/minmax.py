"""Near copies by min-max hashing: both ends of each permutation make up the signature that is banded."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from panelfill.llm.jaccard import SHINGLE, Shingles, classes, joined, stay
from panelfill.llm.text import mix

PERCENT = 80
PERMUTATIONS = 64
BAND = 4


def multipliers(n: int) -> np.ndarray:
    """Odd numbers: multiplying by one modulo 2 ** 64 is a permutation of the hashes."""
    return mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)


def signatures(s: Shingles, texts: np.ndarray, permutations: int = PERMUTATIONS) -> np.ndarray:
    """Of each text (with at least one shingle) the smallest shingle under every permutation, then the largest under every one."""
    if not len(texts):
        return np.zeros((0, 2 * permutations), np.uint64)
    wanted = np.zeros(len(s.n), bool)
    wanted[texts] = True
    value, chosen = s.value[wanted[s.doc]], np.flatnonzero(wanted)
    first = np.concatenate([[0], np.cumsum(s.n[chosen])[:-1]])
    out = np.empty((2 * permutations, len(chosen)), np.uint64)
    for k, a in enumerate(multipliers(permutations)):
        h = value * a
        np.minimum.reduceat(h, first, out=out[k])
        np.maximum.reduceat(h, first, out=out[permutations + k])
    return out.T[np.searchsorted(chosen, texts)]


def band_keys(s: Shingles, texts: np.ndarray, permutations: int = PERMUTATIONS, band: int = BAND) -> tuple[np.ndarray, np.ndarray]:
    """A key for each band of ``band`` values of the signature, and its text; a band holds minima or maxima only."""
    values = signatures(s, texts, permutations)
    bands = values.shape[1] // band
    key = np.tile(mix(np.arange(1, bands + 1, dtype=np.uint64)), (len(texts), 1))
    for k in range(band):
        key = mix(key ^ values[:, k : bands * band : band])
    return key.reshape(-1), np.repeat(texts, bands)


def _met(docs: DataFrame, size: int, percent: int, permutations: int, band: int):
    return joined(docs, size, percent, lambda _: lambda s, texts: band_keys(s, texts, permutations, band))


def near_copies(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, permutations: int = PERMUTATIONS, band: int = BAND) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents link when their sets of ``size``-word shingles (A-Z lower-cased) have a likeness of at least ``percent`` /
    100, component_id is the smallest doc_id reachable, and kept says that the document is the one of its component
    that stays (doc_id = component_id).

    One multiplication a shingle and permutation gives two values of the signature, the least and the greatest hash. Two
    sets agree in either with the probability of their likeness J, so the share of equal values estimates J as twice as many
    permutations would, and with less variance, since both ends cannot be the same shingle. Documents that agree in a whole
    band meet: a pair of likeness J is missed with (1 - J ** band) ** (2 * permutations / band), which for J = 0.8 and
    the defaults is 5e-8. Equal sets are one before they are banded. Of a band key each document is paired with the smallest
    one only, first in its slice, then in its block of keys; every pair is verified on its full sets. Where documents
    that met stay in different components, those are searched as well (:func:`panelfill.llm.jaccard.joined`), so no
    link of documents that met is lost however many share a key.

    Null, empty and blank texts have no shingles and link with nothing. A null doc_id counts as larger than any
    other (ids must be below 2 ** 62), and its component_id is null unless linked to another; of linked null ids one is kept.
    Rows that repeat doc_id and text are one document and give a row each; rows that share an id, or a null one, with
    different texts are documents of their own. An empty table gives an empty table; further columns are ignored.
    """
    return classes(_met(docs, size, percent, permutations, band)[1])


def drop_near_copies(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, permutations: int = PERMUTATIONS, band: int = BAND) -> DataFrame:
    """The documents that :func:`near_copies` keeps, with the columns of ``docs``. Rows that repeat doc_id and text stay or go together."""
    return stay(*_met(docs, size, percent, permutations, band))
