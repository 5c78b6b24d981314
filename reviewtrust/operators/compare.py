"""All pairs of a product of few texts: one small numpy helper that Spark calls for each product."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# Executors need only Spark's own Python: the helper travels with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LINKS = "product_id bigint, left_id bigint, right_id bigint, similarity double"
_ARROW_LINKS = pa.schema([("product_id", pa.int64()), ("left_id", pa.int64()), ("right_id", pa.int64()), ("similarity", pa.float64())])
#: Elements whose holders are multiplied out at once.
_WIDTH = 1 << 13


def _runs(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, base: int, run: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner, element) of all runs of ``run`` words; a shorter text has no run and shares nothing with a different text."""
    counts = np.maximum(sizes - run + 1, 0)
    owners = np.repeat(np.arange(len(sizes)), counts)
    at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)
    element = codes[at]
    for k in range(1, run):
        element = element * base + codes[at + k]
    return owners, element


def _shared(owners: np.ndarray, elements: np.ndarray, texts: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct elements of each text, and how many each two texts share. Elements are below ``span``.

    An element and its owner are one number, so one sort of plain numbers finds both.
    """
    bits = (texts - 1).bit_length()
    if span > 1 << (63 - bits):
        elements = np.unique(elements, return_inverse=True)[1].astype(np.int64)
    held = np.sort(elements << bits | owners)
    if len(held):
        held = held[np.concatenate(([True], held[1:] != held[:-1]))]
    element, owner = held >> bits, held & ((1 << bits) - 1)
    sizes = np.bincount(owner, minlength=texts)
    same = element[1:] == element[:-1]
    none = np.zeros(min(len(held), 1), bool)
    common = np.concatenate((same, none)) | np.concatenate((none, same))
    element, owner = element[common], owner[common]
    column = np.cumsum(np.diff(element, prepend=element[:1]) > 0)
    columns = int(column[-1]) + 1 if len(column) else 0
    together = np.zeros((texts, texts))
    for first in range(0, columns, _WIDTH):
        lo, hi = np.searchsorted(column, [first, first + _WIDTH])
        holds = np.zeros((texts, min(_WIDTH, columns - first)), np.float32)
        holds[owner[lo:hi], column[lo:hi] - first] = 1
        together += holds @ holds.T
    return sizes, together


def links_in_product(threshold: float):
    """A function for ``applyInArrow``: (product_id, review_id, words) of one product to the links between its different texts.

    Word codes are below the product's number of words, so runs of three are exact numbers below 2^63 up to 2^21 words. The lowest bit
    of a word is 1 for stop words (``functions.text.hashed_words``).
    """

    def compare(table: pa.Table) -> pa.Table:
        ids, lists = table["review_id"].to_numpy(), table["words"].combine_chunks()
        if isinstance(lists, pa.ChunkedArray):
            lists = pa.concat_arrays(lists.chunks)
        offsets, words = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
        first: dict[bytes, int] = {}
        for i in np.argsort(ids, kind="stable"):
            if offsets[i + 1] > offsets[i]:
                first.setdefault(words[offsets[i] : offsets[i + 1]].tobytes(), i)
        kept = np.array(list(first.values()), dtype=np.int64)
        ids, starts, sizes = ids[kept], offsets[kept].astype(np.int64), np.diff(offsets)[kept].astype(np.int64)
        texts, none = len(kept), pa.Table.from_pydict({c: [] for c in _ARROW_LINKS.names}, schema=_ARROW_LINKS)
        if texts < 2:
            return none
        distinct, codes = np.unique(words, return_inverse=True)
        codes = codes.astype(np.int64)
        base = len(distinct)
        owners, each = _runs(codes, starts, sizes, base, 1)
        content = (distinct[each] & 1) == 0
        n2, s2 = _shared(*_runs(codes, starts, sizes, base, 2), texts, base**2)
        n3, s3 = _shared(*_runs(codes, starts, sizes, base, 3), texts, base**3)
        nc, sc = _shared(owners[content], each[content], texts, base)
        left, right = np.nonzero(np.triu(s2, 1))

        def ratio(shared: np.ndarray, total: np.ndarray) -> np.ndarray:
            return np.divide(shared, total, out=np.zeros(len(shared)), where=shared > 0)

        def jaccard(n: np.ndarray, s: np.ndarray) -> np.ndarray:
            return ratio(s[left, right], n[left] + n[right] - s[left, right])

        dice = ratio(sc[left, right] * 2, nc[left] + nc[right])
        score = np.maximum(np.maximum(jaccard(n3, s3), 0.85 * jaccard(n2, s2)), 0.75 * dice)
        near = score >= threshold
        product = np.full(int(near.sum()), table["product_id"][0].as_py(), dtype=np.int64)
        return pa.table([product, ids[left[near]], ids[right[near]], score[near]], schema=_ARROW_LINKS)

    return compare
