"""Evaluation texts inside a corpus: SimHash of item-sized windows, found by Hamming blocks.

An item is cut into windows of two kinds, and so is every document:

* passages of ``window`` words (the least that counts as a leak) at every word, with
  shingles of five words as features;
* windows of the item's own size: of the sizes ``ITEM_SIZES`` the largest that the item
  has, with words as features, weighted by their rarity, so that edited copies stay near.
  Item windows begin at every fifth word (every 13th, if long) and document windows at
  every fourth: of four successive item windows one lies exactly as in the document.

A window's fingerprint is the 64-bit SimHash of its features.  Item fingerprints are
indexed by four blocks of 16 bits, each under every value that differs in at most
``errors`` bits: two fingerprints within ``4 (errors + 1) - 1`` bits are that near in a
block at least, so the look-up finds all of them (3 bits for passages, 15 for item-sized
windows, 11 for those of 260 words).  Candidates are verified by the exact
weighted-shingle similarity (``similarity``).

Documents are only scanned: the item index travels to the tasks (in blocks of at most
``index_windows`` passages, so its size is bounded whatever the number of items; more
items mean more passes) and the result has a row per document and item.  Nothing of the
corpus is shuffled or collected, and no bucket is capped.

Defined results: null and empty texts, and texts or items shorter than a passage, match
nothing; rows repeated under one id give one row, with the best of them; columns besides
id and text are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.mime import readable_text

SHINGLE = 5
BITS = 64
BLOCKS, BLOCK_BITS = 4, 16
#: Sizes of item-sized windows in words (shingles: 16, 64, 256), and how many bits of a
#: block may differ: short windows have coarser fingerprints.
ITEM_SIZES = (20, 68, 260)
ITEM_ERRORS = (3, 3, 2)
#: Words between item windows of each size, and between document windows; no common divisor.
ITEM_STRIDES, DOC_STRIDE = (5, 5, 13), 4
#: Words that a shingle may be off its place, from words put in or left out.
SLACK = 8
#: Words of no weight behind every document: its last windows may reach beyond its end.
TAIL = 3 * SLACK
#: Rarity is counted in so many buckets of word hashes, whatever the number of items.
RARITY_BUCKETS = 1 << 16
_WORD = re.compile(r"[^\W_]+")
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def words(text: str) -> list[str]:
    """Runs of letters and digits after NFKC, without letter case."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return _WORD.findall(text.casefold())


class Hashes(dict):
    """Hashes of words, remembered; hash 0 is that of no word."""

    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) if word else 0
        return h


def word_hashes(tokens: list[str], known: Hashes) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))


def shingle_hashes(h: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hash of each run of ``size`` words; order matters."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = h[:n].copy()
        for k in range(1, size):
            out = out * _ODD + h[k : k + n]
        out ^= out >> np.uint64(31)
        out *= _MIX
        out ^= out >> np.uint64(29)
    return out


def fingerprints(shingles: np.ndarray, per_window: int) -> np.ndarray:
    """SimHash of every run of ``per_window`` shingles; a bit is set if more than half of them have it."""
    n = len(shingles) - per_window + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    bits = np.unpackbits(shingles.view(np.uint8)).reshape(-1, BITS)
    if per_window > 255:
        bits = bits.astype(np.uint32)
    # sums over runs of 1, 2, 4, ... shingles, put together to runs of per_window
    total, done, run, size = None, 0, bits, 1
    rest = per_window
    while True:
        if rest & 1:
            total = run[done : done + n].copy() if total is None else total + run[done : done + n]
            done += size
        rest >>= 1
        if not rest:
            break
        run = run[:-size] + run[size:]
        size *= 2
    return np.packbits(total > per_window // 2, axis=1).view(np.uint64).ravel()


def weighted_fingerprints(h: np.ndarray, weight: np.ndarray, sizes: list[int], stride: int) -> dict[int, np.ndarray]:
    """SimHash of windows of words at every ``stride``-th word, for each of ``sizes``
    (multiples of ``stride``): a bit is set if more than half of the weight has it."""
    n = len(h) // stride * stride
    bits = np.unpackbits(h[:n].view(np.uint8)).reshape(-1, BITS)
    bits *= weight[:n, None]
    groups, heavy = bits[0::stride], weight[:n:stride].astype(np.uint16)
    for k in range(1, stride):
        groups = groups + bits[k::stride]
        heavy += weight[k:n:stride]
    # sums may run over: differences of windows, at most 3 a word, do not
    run = np.zeros((len(groups) + 1, BITS), np.uint16)
    groups.cumsum(0, dtype=np.uint16, out=run[1:])
    whole = np.r_[np.uint16(0), heavy.cumsum(dtype=np.uint16)]
    out = {}
    for size in sizes:
        k = size // stride
        if len(groups) < k:
            out[size] = np.zeros(0, np.uint64)
        else:
            set_ = (run[k:] - run[:-k]) > ((whole[k:] - whole[:-k]) >> 1)[:, None]
            out[size] = np.packbits(set_, axis=1).view(np.uint64).ravel()
    return out


class HammingIndex:
    """All pairs of fingerprints within ``radius`` bits."""

    def __init__(self, prints: np.ndarray, errors: int):
        self.prints, self.errors, self.radius = prints, errors, BLOCKS * (errors + 1) - 1
        flips = [0]
        for _ in range(errors):
            flips = sorted({f ^ bit for f in flips for bit in [0, *(1 << k for k in range(BLOCK_BITS))]})
        flips = np.array(flips, np.uint64)
        self.blocks = []
        for b in range(BLOCKS):
            own = (prints >> np.uint64(b * BLOCK_BITS)) & np.uint64(0xFFFF)
            value = (own[:, None] ^ flips[None, :]).ravel()
            order = np.argsort(value, kind="stable")
            starts = np.searchsorted(value[order], np.arange((1 << BLOCK_BITS) + 1, dtype=np.uint64)).astype(np.int64)
            self.blocks.append((np.uint64(b * BLOCK_BITS), starts, (order // len(flips)).astype(np.int32), starts[1:] > starts[:-1]))

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number in ``prints``, number in the index) of each pair, once."""
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        parts = prints.view(np.uint16).reshape(-1, BLOCKS)  # lowest bits first
        for b, (shift, starts, order, there) in enumerate(self.blocks):
            hit = np.flatnonzero(there[parts[:, b]])
            if not len(hit):
                continue
            value = parts[hit, b].astype(np.int64)
            first = starts[value]
            c = starts[value + 1] - first
            i = np.repeat(hit, c)
            j = order[np.arange(len(i)) - np.repeat(np.cumsum(c) - c - first, c)]
            far = prints[i] ^ self.prints[j]
            near = np.bitwise_count(far) <= self.radius
            i, j, far = i[near], j[near], far[near]
            # a pair that an earlier block has found is left out here
            for shift0, *_ in self.blocks[:b]:
                new = np.bitwise_count((far >> shift0) & np.uint64(0xFFFF)) > self.errors
                i, j, far = i[new], j[new], far[new]
            left.append(i)
            right.append(j)
        return np.concatenate(left), np.concatenate(right).astype(np.int64)


class Rarity:
    """Weights of words, 3 (rare) to 1 (in more than a tenth of the items)."""

    def __init__(self, counts: dict[int, int], n_items: int):
        share = np.zeros(RARITY_BUCKETS)
        share[list(counts)] = np.array(list(counts.values()), float) / max(1, n_items)
        self.weights = np.where(share > 0.1, 1, np.where(share > 0.02, 2, 3)).astype(np.uint8)
        if n_items < 20:
            self.weights[:] = 1  # too few items to tell what is rare

    @staticmethod
    def bucket(h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(40)).astype(np.int64) % RARITY_BUCKETS

    def of(self, h: np.ndarray) -> np.ndarray:
        return self.weights[self.bucket(h)]


def similarity(doc: np.ndarray, starts: np.ndarray, item: np.ndarray, weight: np.ndarray, slack: int = SLACK, chunk: int = 1000) -> np.ndarray:
    """Weighted-shingle similarity of document windows (``doc`` words from ``starts``) and
    item windows (rows of word hashes ``item`` and weights).

    A shingle of five words of the item agrees as far as the weight of its words goes
    that the document has in the same order, at the shingle's place or at most ``slack``
    words off, whichever is best; between two of its words one word may be put in or left
    out.  The similarity is the mean agreement, shingles weighing as much as their words."""
    out = np.ones(len(starts))
    size = item.shape[1]
    n = size - SHINGLE + 1
    padded = np.concatenate([np.zeros(slack, np.uint64), doc, np.zeros(slack + size, np.uint64)])
    other = np.flatnonzero((padded[starts[:, None] + slack + np.arange(size)] != item).any(1))
    for a in range(0, len(other), chunk):
        pick = other[a : a + chunk]
        own, w = item[pick], weight[pick]
        near = padded[starts[pick, None] + np.arange(size + 2 * slack)]
        # same[d]: weights of the words that are there, by how far off they are
        same = np.stack([(near[:, d : d + size] == own) * w for d in range(2 * slack + 1)])
        head, tail = np.zeros((2 * slack + 1, len(pick), n), np.uint8), sum(same[:, :, k : k + n] for k in range(SHINGLE))
        best = tail.max(0)
        for k in range(SHINGLE - 1):
            head = head + same[:, :, k : k + n]
            tail = tail - same[:, :, k : k + n]
            for x, y in ((head[1:], tail[:-1]), (head[:-1], tail[1:])):
                np.maximum(best, (x + y).max(0), out=best)
        out[pick] = best.sum(1) / sum(w[:, k : k + n] for k in range(SHINGLE)).sum(1)
    return out


@dataclass
class Windows:
    """Windows of one size: item number, first word in the item, words, index."""

    size: int
    item: np.ndarray
    place: np.ndarray
    words: np.ndarray  # windows x size
    index: HammingIndex


class ItemIndex:
    """The passages and the item-sized windows of a block of items."""

    def __init__(self, texts: list[str | None], window: int, rarity: Rarity, errors: tuple[int, ...] = ITEM_ERRORS):
        self.window, self.rarity = window, rarity
        known = Hashes()
        tokens = [words(t or "") for t in texts]
        hashes = [word_hashes(t, known) for t in tokens]
        self.n_words = np.array([len(t) for t in tokens], np.int64)
        per = window - SHINGLE + 1
        prints, places, self.texts = [], [], []
        for t, h in zip(tokens, hashes):
            prints.append(fingerprints(shingle_hashes(h), per))
            places.append(np.arange(len(prints[-1])))
            self.texts += [" ".join(t[k : k + window]) for k in range(len(t) - window + 1)]
        self.passages = self._windows(window, hashes, prints, places, 0)
        self.whole: list[Windows] = []
        for size, above, stride, wrong in zip(ITEM_SIZES, [*ITEM_SIZES[1:], np.inf], ITEM_STRIDES, errors):
            prints, places = [], []
            for h in hashes:
                at = np.arange(0, len(h) - size + 1, stride) if size <= len(h) < above else np.zeros(0, np.int64)
                own = weighted_fingerprints(h, rarity.of(h), [size], 1)[size][at] if len(at) else np.zeros(0, np.uint64)
                prints.append(own)
                places.append(at)
            if sum(map(len, prints)):
                self.whole.append(self._windows(size, hashes, prints, places, wrong))

    @staticmethod
    def _windows(size: int, hashes: list[np.ndarray], prints: list[np.ndarray], places: list[np.ndarray], errors: int) -> Windows:
        cat = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
        own = [h[p[:, None] + np.arange(size)] for h, p in zip(hashes, places) if len(p)]
        item = cat([np.full(len(p), i) for i, p in enumerate(places)], np.int64)
        return Windows(size, item, cat(places, np.int64), np.concatenate(own) if own else np.zeros((0, size), np.uint64), HammingIndex(cat(prints, np.uint64), errors))


def _lay_out(lists: list[list[str]], known: Hashes) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Words of the documents in a row, their hashes, the first word of each document and
    its end; each begins at a multiple of ``DOC_STRIDE`` and is followed by ``TAIL`` places
    without a word at least."""
    tokens: list[str] = []
    first, end = np.empty(len(lists), np.int64), np.empty(len(lists), np.int64)
    for k, t in enumerate(lists):
        first[k] = len(tokens)
        tokens += t
        end[k] = len(tokens)
        tokens += [""] * (TAIL + -len(tokens) % DOC_STRIDE)
    return tokens, word_hashes(tokens, known), first, end


def scan_batch(ids: list, texts: list[str | None], index: ItemIndex, known: Hashes, least: float):
    """Rows (id, item, words of the longest common run, passages matched, their best
    similarity, best similarity of an item-sized window); 0 where there is none."""
    if len(known) > 1_000_000:
        known.clear()  # only a memo; hashes do not depend on it
    tokens, h, first, end = _lay_out([words(t) if t else [] for t in texts], known)
    if not len(h):
        return []
    window, p = index.window, index.passages
    pairs: dict[tuple[int, int], list] = {}
    # passages
    i, j = p.index.candidates(fingerprints(shingle_hashes(h), window - SHINGLE + 1))
    doc = np.searchsorted(first, i, side="right") - 1
    inside = i + window <= end[doc]
    i, j, doc = i[inside], j[inside], doc[inside]
    sim = similarity(h, i, p.words[j], index.rarity.of(p.words[j]))
    keep = sim >= least
    i, j, doc, sim = i[keep], j[keep], doc[keep], sim[keep]
    if len(i):
        item, shift = p.item[j], i - p.place[j]
        by = np.lexsort((i, shift, item, doc))
        i, j, doc, sim, item, shift = i[by], j[by], doc[by], sim[by], item[by], shift[by]
        last, run = None, 0
        for a, b, d, it, s, at in zip(i.tolist(), j.tolist(), doc.tolist(), item.tolist(), sim.tolist(), shift.tolist()):
            own = pairs.setdefault((d, it), [0, set(), 0.0, 0.0])
            own[1].add(b)
            own[2] = max(own[2], s)
            if " ".join(tokens[a : a + window]) == index.texts[b]:
                run = run + 1 if last == (d, it, at, a - 1) else 1
                last = (d, it, at, a)
                own[0] = max(own[0], run + window - 1)
    # item-sized windows
    if index.whole:
        weight = index.rarity.of(h)
        weight[h == 0] = 0
        prints = weighted_fingerprints(h, weight, [w.size for w in index.whole], DOC_STRIDE)
        for w in index.whole:
            i, j = w.index.candidates(prints[w.size])
            i = i * DOC_STRIDE
            doc = np.searchsorted(first, i, side="right") - 1
            inside = i + w.size <= end[doc] + TAIL
            i, j, doc = i[inside], j[inside], doc[inside]
            sim = similarity(h, i, w.words[j], index.rarity.of(w.words[j]))
            for k in np.flatnonzero(sim >= least):
                own = pairs.setdefault((int(doc[k]), int(w.item[j[k]])), [0, set(), 0.0, 0.0])
                own[3] = max(own[3], float(sim[k]))
    return [(ids[d], it, n, len(met), q, s) for (d, it), (n, met, q, s) in sorted(pairs.items())]


def rarity_of(items: DataFrame) -> Rarity:
    """Items in which each bucket of words occurs: a bounded number of sums."""

    def apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            own = [np.unique(Rarity.bucket(word_hashes(words(t), Hashes()))) for t in f["t"]]
            yield pd.DataFrame({"b": np.concatenate([*own, np.full(len(own), -1)]).astype(np.int64)})

    counts = {r["b"]: r["count"] for r in items.select("t").mapInPandas(apply, "b long").groupBy("b").count().collect()}
    n = counts.pop(-1, 0)
    return Rarity(counts, n)


def leaks(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 12,
    least_similarity: float = 0.8,
    index_windows: int = 50_000,
    batch: int = 100,
) -> DataFrame:
    """Document, item, ``common_words`` (longest run of words that both have, 0 if none
    reaches a passage), ``windows`` (item passages met), ``coverage`` (their share of the
    item), ``passage_similarity`` (best passage) and ``similarity`` (best item-sized
    window); 0 where there is none of at least ``least_similarity``."""
    if window < SHINGLE:
        raise ValueError(f"a window has at least {SHINGLE} words")
    rows = items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null").dropDuplicates().orderBy("i", "t")
    id_type = docs.schema[doc_id].dataType.simpleString()
    item_type = items.schema[item_id].dataType.simpleString()
    names = ["doc_id", "item_id", "common_words", "windows", "coverage", "passage_similarity", "similarity"]
    schema = f"doc_id {id_type}, item_id {item_type}, common_words int, windows int, coverage double, passage_similarity double, similarity double"
    rarity = rarity_of(rows)
    source = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t")).where("i is not null and t is not null")

    def scan(block: list) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast((ItemIndex([t for _, t in block], window, rarity), [i for i, _ in block]))

        def apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            index, own_ids = shared.value
            total = np.maximum(index.n_words - window + 1, 1)
            known = Hashes()
            for frame in frames:
                ids, texts = frame["i"].tolist(), frame["t"].tolist()
                for a in range(0, len(ids), batch):
                    found = scan_batch(ids[a : a + batch], [readable_text(t) for t in texts[a : a + batch]], index, known, least_similarity)
                    yield pd.DataFrame([(d, own_ids[it], n, w, w / total[it], p, s) for d, it, n, w, p, s in found], columns=names)

        return source.mapInPandas(apply, schema)

    out, block, size = None, [], 0
    for r in rows.toLocalIterator():
        n = max(0, len(words(r["t"])) - window + 1)
        if block and size + n > index_windows:
            part = scan(block)
            out, block, size = part if out is None else out.unionByName(part), [], 0
        block.append((r["i"], r["t"]))
        size += n
    part = scan(block)
    out = part if out is None else out.unionByName(part)
    # a handful of rows: documents that hold an item more than once, or are repeated
    return out.groupBy("doc_id", "item_id").agg(*[F.max(c).alias(c) for c in names[2:]])


def found(pairs: DataFrame, min_words: int = 12) -> DataFrame:
    """Pairs whose texts have at least ``min_words`` consecutive words in common."""
    return pairs.where(F.col("common_words") >= min_words).select("doc_id", "item_id")
