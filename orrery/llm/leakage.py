"""Evaluation texts leaking into training text."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.text import word_hashes, words

#: Words searched at once: some 200 bytes each are held.
_CHUNK = 60_000
#: Words of evaluation items in one block, i.e. in one pass over the corpus.
BLOCK_WORDS = 500_000
#: Words in a shingle.
SHINGLE = 5


def bit_sums(hashes: np.ndarray, size: int = 255) -> np.ndarray:
    """Row i has, for each of the 64 bits, how many of the first i hashes have it, in numbers that differences over ``size`` words fit in: one pass serves windows of every size up to it."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
    kind = np.uint8 if size < 1 << 8 else np.uint16 if size < 1 << 16 else np.uint32
    sums = np.zeros((len(hashes) + 1, 64), kind)
    np.cumsum(bits, axis=0, dtype=kind, out=sums[1:])
    return sums


def simhashes(sums: np.ndarray, size: int) -> np.ndarray:
    """SimHash of every window of ``size`` words from ``bit_sums``: bit b is set where most of the words' hashes have it."""
    n = len(sums) - size
    if n <= 0:
        return np.empty(0, np.uint64)
    return np.packbits(sums[size:] - sums[:n] > size // 2, axis=1).view(np.uint64).ravel()


class HammingIndex:
    """Fingerprints found by all queries within ``radius`` bits, by radius + 1 blocks of bits.

    Two fingerprints that differ in at most ``radius`` bits agree in at least one block, so looking up every block misses none.
    """

    def __init__(self, fingerprints: np.ndarray, radius: int):
        self.fingerprints, self.radius = fingerprints, radius
        edges = [64 * i // (radius + 1) for i in range(radius + 2)]
        self.blocks = [(np.uint64(a), np.uint64((1 << (b - a)) - 1)) for a, b in zip(edges, edges[1:], strict=False)]
        self.sorted = []
        for shift, mask in self.blocks:
            keys = (fingerprints >> shift) & mask
            order = np.argsort(keys, kind="stable")
            unique, first = np.unique(keys[order], return_index=True)
            table = None
            if int(mask) < 1 << 16:
                table = np.zeros(int(mask) + 1, bool)
                table[unique] = True
            self.sorted.append((order, unique, np.append(first, len(keys)), table))

    def search(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query index, fingerprint index) within the radius, each once."""
        found = [np.empty((0, 2), np.int64)]
        for (shift, mask), (order, unique, first, table) in zip(self.blocks, self.sorted, strict=True):
            keys = (queries >> shift) & mask
            hit = np.flatnonzero(table[keys] if table is not None else np.isin(keys, unique))
            if not len(hit):
                continue
            slot = np.searchsorted(unique, keys[hit])
            n = first[slot + 1] - first[slot]
            q = np.repeat(hit, n)
            step = np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n)
            f = order[np.repeat(first[slot], n) + step]
            near = np.bitwise_count(queries[q] ^ self.fingerprints[f]) <= self.radius
            found.append(np.stack([q[near], f[near]], axis=1))
        pairs = np.unique(np.concatenate(found), axis=0)
        return pairs[:, 0], pairs[:, 1]


def shingles(found: list[str]) -> Counter:
    return Counter(tuple(found[i : i + SHINGLE]) for i in range(max(1, len(found) - SHINGLE + 1)))


def similarity(a: Counter, b: Counter, weight) -> float:
    """Weighted Jaccard similarity of two bags of shingles; 1 for two empty ones."""
    least = sum(weight(s) * min(n, b[s]) for s, n in a.items() if s in b)
    most = sum(weight(s) * n for s, n in a.items()) + sum(weight(s) * n for s, n in b.items()) - least
    return least / most if most else 1.0


def shingle_codes(hashes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """A hash of every run of ``size`` words."""
    n = max(0, len(hashes) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
    return out


class ItemIndex:
    """The windows of ``window`` words of a block of evaluation items: where each begins, and an index of their fingerprints for each size.

    With ``short`` items of fewer words are one window of their own size; without they leak nowhere.
    """

    def __init__(self, items: list[tuple[int, str]], window: int, radius: int, least: float, short: bool = False):
        if window < 1 or least <= 0:
            raise ValueError("a window needs a word, and the least similarity must be above 0")
        self.least, self.largest, self.overlap = least, window, window - 1
        self.keys, self.words = [], []
        starts: dict[int, list] = {}
        prints: dict[int, list] = {}
        seen: Counter = Counter()
        for key, text in items:
            w = words(text)
            size = min(len(w), window)
            if not w or (size < window and not short):
                continue
            starts.setdefault(size, []).extend((len(self.keys), i) for i in range(len(w) - size + 1))
            prints.setdefault(size, []).append(simhashes(bit_sums(word_hashes(w), size), size))
            seen.update(set(shingles(w)))
            self.keys.append(key)
            self.words.append(w)
        #: shingles that several items share weigh less
        self.shared = {x: n for x, n in seen.items() if n > 1}
        self.sizes = {n: (np.array(starts[n], np.int32).reshape(-1, 2), HammingIndex(np.concatenate(prints[n]), radius)) for n in starts}

    def weight(self, shingle: tuple) -> float:
        return 1 / self.shared.get(shingle, 1)

    def leaks(self, docs: list[tuple[int, list[str]]]) -> Iterator[tuple[int, int, float]]:
        """(document, item, similarity) of whatever the documents hold, the most similar window of each; the words of all documents are searched at once.

        Candidates are windows whose fingerprints are near; the weighted similarity of their shingles admits them; asked for equality (1), so does that of their words.
        """
        if not self.keys or self.least > 1.0:
            return
        text = [w for _, found in docs for w in found]
        ends = np.cumsum(np.array([len(found) for _, found in docs], np.int64))
        sums = bit_sums(word_hashes(text), self.largest)
        best: dict[tuple[int, int], float] = {}
        for size, (starts, index) in self.sizes.items():
            q, f = index.search(simhashes(sums, size))
            inside = np.searchsorted(ends, q, side="right") == np.searchsorted(ends, q + size - 1, side="right")
            for at, (i, offset) in zip(q[inside].tolist(), starts[f[inside]].tolist(), strict=True):
                pair = docs[int(np.searchsorted(ends, at, side="right"))][0], self.keys[i]
                if best.get(pair, 0.0) >= 1.0:
                    continue
                found, item = text[at : at + size], self.words[i][offset : offset + size]
                like = min(1.0, similarity(shingles(found), shingles(item), self.weight))
                if like >= self.least - 1e-12 and like > best.get(pair, 0.0) and (self.least < 1.0 or found == item):
                    best[pair] = like
        for (doc, key), like in best.items():
            yield doc, key, like


class PassageIndex:
    """The shingles of a block of evaluation items' whole passages, and the items that have each.

    A window as similar as ``least`` shares shingles of ``least`` times the item's weight, so looking up every shingle of a
    text misses none, whatever the window's length. Dropping a shingle the item lacks from an end of a window never makes it less
    similar, and a window heavier than the item's weight / ``least`` is not similar enough, so only windows between shared shingles and up to that weight are tried.
    A passage of fewer words than a shingle has is one itself: it leaks where its words stand, with similarity 1.
    """

    #: texts are searched whole, for a window has no fixed length
    overlap = None

    def __init__(self, items: list[tuple[int, str]], least: float):
        if least <= 0:
            raise ValueError("the least similarity must be above 0")
        self.least = least
        self.keys, self.words = [], []
        self.short: dict[int, dict[int, list[tuple[int, list[str]]]]] = {}
        seen: Counter = Counter()
        codes, owners = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for key, text in items:
            w = words(text)
            if len(w) < SHINGLE:
                if w:
                    self.short.setdefault(len(w), {}).setdefault(int(shingle_codes(word_hashes(w), len(w))[0]), []).append((key, w))
                continue
            seen.update(set(shingles(w)))
            codes.append(np.unique(shingle_codes(word_hashes(w))))
            owners.append(np.full(len(codes[-1]), len(self.keys)))
            self.keys.append(key)
            self.words.append(w)
        #: shingles that several items share; all others weigh 1
        self.shared = {s: n for s, n in seen.items() if n > 1}
        every = np.concatenate(codes)
        order = np.argsort(every, kind="stable")
        self.codes, first = np.unique(every[order], return_index=True)
        self.owners, self.first = np.concatenate(owners)[order], np.append(first, len(every))
        self.weights = 1.0 / np.diff(self.first)
        self.bags: dict[int, tuple[Counter, Counter, float]] = {}

    def weight(self, shingle: tuple) -> float:
        """A shingle counts less the more items share it."""
        return 1 / self.shared.get(shingle, 1)

    def bag(self, i: int) -> tuple[Counter, Counter, float]:
        """An item's shingles, the same by their places in ``codes``, and their weight."""
        if i not in self.bags:
            slots = np.searchsorted(self.codes, shingle_codes(word_hashes(self.words[i])))
            self.bags[i] = shingles(self.words[i]), Counter(slots.tolist()), float(self.weights[slots].sum())
        return self.bags[i]

    def leaks(self, docs: list[tuple[int, list[str]]]) -> Iterator[tuple[int, int, float]]:
        """(document, item, similarity) of whatever the documents hold; the words of all documents are searched at once."""
        text = [w for _, found in docs for w in found]
        ends = np.cumsum(np.array([len(found) for _, found in docs], np.int64))
        hashes = word_hashes(text)
        yield from self._verbatim(docs, text, ends, hashes)
        if not self.keys:
            return
        codes = shingle_codes(hashes)
        slot = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        hit = np.flatnonzero(self.codes[slot] == codes)
        weight = np.ones(len(codes))
        weight[hit] = self.weights[slot[hit]]
        upto = np.concatenate([[0.0], np.cumsum(weight)])
        doc = np.searchsorted(ends, hit, side="right")
        inside = doc == np.searchsorted(ends, hit + SHINGLE - 1, side="right")
        hit, doc = hit[inside], doc[inside]
        if not len(hit):
            return
        # a row per shared shingle and item that has it, those of one document and item together and in the text's order
        n = self.first[slot[hit] + 1] - self.first[slot[hit]]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        item, at, doc = self.owners[np.repeat(self.first[slot[hit]], n) + step], np.repeat(hit, n), np.repeat(doc, n)
        order = np.lexsort((at, item, doc))
        item, at, doc = item[order], at[order], doc[order]
        edges = np.append(np.flatnonzero(np.append(True, (item[1:] != item[:-1]) | (doc[1:] != doc[:-1]))), len(at))
        shared = np.add.reduceat(weight[at], edges[:-1])
        for g in range(len(shared)):
            i = int(item[edges[g]])
            bag, places, whole = self.bag(i)
            if shared[g] < self.least * whole - 1e-9:
                continue
            span = at[edges[g] : edges[g + 1]]
            window = self._best(span.tolist(), slot[span].tolist(), weight[span], upto, places, whole)
            if window is None:
                continue
            found = text[window[0] : window[1]]
            like = 1.0 if found == self.words[i] else min(1.0, similarity(shingles(found), bag, self.weight))
            if like >= self.least - 1e-12:
                yield docs[int(doc[edges[g]])][0], self.keys[i], like

    def _verbatim(self, docs: list, text: list[str], ends: np.ndarray, hashes: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """Where the words of passages shorter than a shingle stand."""
        same = set()
        for size, known in self.short.items():
            codes = shingle_codes(hashes, size)
            for at in np.flatnonzero(np.isin(codes, np.fromiter(known, np.uint64, len(known)))).tolist():
                doc = int(np.searchsorted(ends, at, side="right"))
                if at + size <= ends[doc]:
                    same.update((docs[doc][0], key) for key, w in known[int(codes[at])] if text[at : at + size] == w)
        for doc, key in same:
            yield doc, key, 1.0

    def _best(self, at: list[int], slots: list[int], weight: np.ndarray, upto: np.ndarray, places: Counter, whole: float) -> tuple[int, int] | None:
        """The words from and to of the most similar window, None if no window is near ``least``; ``at`` are the shared shingles in order."""
        best, window, most = self.least - 1e-9, None, whole / self.least + 1e-9
        rest, weight = np.cumsum(weight[::-1])[::-1].tolist(), weight.tolist()
        for a, start in enumerate(at):
            if rest[a] < self.least * whole - 1e-9 or best > 1 - 1e-9:
                break
            had: dict[int, int] = {}
            common, before = 0.0, upto[start]
            for b in range(a, len(at)):
                size = upto[at[b] + 1] - before
                if size > most:
                    break
                s = slots[b]
                had[s] = had.get(s, 0) + 1
                if had[s] <= places[s]:
                    common += weight[b]
                    if (like := common / (whole + size - common)) > best:
                        best, window = like, (start, at[b] + SHINGLE)
        return window


def _finder(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = index.value

        def out(docs):
            rows = list(find.leaks(docs))
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.float64())],
                names=["doc_id", "eval_id", "similarity"],
            )

        docs, n = [], 0
        for batch in batches:
            for key, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key is None or not (found := words(t)):
                    continue
                # a very long text is searched in pieces that share what a window may span, if that is limited
                step, overlap = (len(found), 0) if find.overlap is None else (_CHUNK, find.overlap)
                for at in range(0, max(1, len(found) - overlap), step):
                    piece = found[at : at + step + overlap]
                    docs.append((key, piece))
                    n += len(piece)
                    if n >= _CHUNK:
                        yield out(docs)
                        docs, n = [], 0
        if docs:
            yield out(docs)

    return run


def leaked_items(documents: DataFrame, items: DataFrame, *, doc: str = "doc_id", text: str = "text", item: str = "eval_id", passage: str = "passage", window: int | None = 8, radius: int = 3, least: float = 1.0, short: bool = False, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, eval_id, similarity): which documents contain passages of which evaluation items.

    With ``window`` an item leaks if one of its runs of that many consecutive words stands in a document, or one as similar as ``least``; items of fewer words have no such run, with ``short`` they
    count whole. With ``window=None`` the item's whole passage is compared with the document's windows of every length, and leaks if the most similar one
    reaches ``least`` (above 0). Items may have any number of words from one on.

    With ``window`` every window of items and documents has a SimHash; a multi-index over radius + 1 blocks of bits finds all item windows within
    ``radius`` bits of a document's window, and the exact weighted similarity of their shingles admits those of ``least`` or more (of equal windows, which have equal fingerprints, none is missed; asked for 1 the words
    are compared as well). Without, fingerprints and ``radius`` play no part: every five-word shingle of the documents is looked up among the items', and the exact weighted
    similarity of the windows between shared shingles decides, so none is missed. Whole texts are searched; NULL and empty texts and NULL ids have no rows.

    The items are the stated query set: they are dealt by hash into blocks of about ``block_words`` words, each held by the executors for one pass
    over the documents, which are never shuffled.
    """
    spark = documents.sparkSession
    asked = items.filter(F.col(item).isNotNull() & F.col(passage).isNotNull()).select(F.col(item).cast("bigint").alias("i"), F.col(passage).alias("p"))
    total = asked.agg(F.sum(F.length("p") / 5)).first()[0] or 0
    blocks = max(1, int(-(-total // block_words)))
    corpus = documents.select(F.col(doc).cast("bigint").alias("d"), F.col(text).alias("t")).filter("t IS NOT NULL")
    found = None
    for b in range(blocks):
        rows = [(r[0], r[1]) for r in asked.filter(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b).collect()]  # about block_words words
        index = spark.sparkContext.broadcast(PassageIndex(rows, least) if window is None else ItemIndex(rows, window, radius, least, short))
        part = corpus.mapInArrow(_finder(index), "doc_id bigint, eval_id bigint, similarity double")
        found = part if found is None else found.unionByName(part)
    return found.groupBy("doc_id", "eval_id").agg(F.max("similarity").alias("similarity"))
