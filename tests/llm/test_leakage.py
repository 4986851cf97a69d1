import random

import numpy as np

from orrery.llm.leakage import HammingIndex, bit_sums, leaked_items, shingles, similarity, simhashes
from orrery.llm.text import word_hashes, words


def test_words():
    assert words("Straße, GROẞE ﬁx x­yz é _a_b 3½ A​B") == ["strasse", "grosse", "fix", "xyz", "e", "a", "b", "31", "2", "ab"]
    assert words(None) == words("") == words(" .,! ") == []


def test_simhash_is_the_majority_of_bits():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**64, 300, dtype=np.uint64)
    for size in (1, 8, 33):
        got = simhashes(bit_sums(h), size)
        assert len(got) == 300 - size + 1
        for at in (0, 7, len(got) - 1):
            want = 0
            for b in range(64):
                if sum(int(x) >> b & 1 for x in h[at : at + size]) > size // 2:
                    want |= 1 << b
            raw = np.unpackbits(h[at : at + size].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0) > size // 2
            assert got[at] == np.packbits(raw).view(np.uint64)[0]
            assert bin(int(got[at])).count("1") == bin(want).count("1")
    assert len(simhashes(bit_sums(h[:3]), 4)) == len(simhashes(bit_sums(h[:0]), 4)) == 0


def test_multi_index_finds_all_within_the_radius():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**64, 50, dtype=np.uint64)
    queries = np.concatenate([base ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, k, replace=False))) for k in range(6)])
    for radius in (0, 1, 3, 7):
        q, f = HammingIndex(base, radius).search(queries)
        want = {(i, j) for i, x in enumerate(queries) for j, y in enumerate(base) if bin(int(x) ^ int(y)).count("1") <= radius}
        assert set(zip(q.tolist(), f.tolist(), strict=True)) == want


def test_weighted_similarity():
    a, b = shingles(list("abcdefg")), shingles(list("abcdefx"))
    assert similarity(a, a, lambda s: 1.0) == 1.0
    assert abs(similarity(a, b, lambda s: 1.0) - 2 / 4) < 1e-12
    assert abs(similarity(a, b, lambda s: 3.0 if s == tuple("abcde") else 1.0) - 4 / 6) < 1e-12


def tables(spark, n=300, seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)]
    say = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    items = [(i, " ".join(say(rng.choice([5, 7, 8, 30, 30])))) for i in range(30)] + [(100, None), (101, "")]
    docs = []
    for d in range(n):
        text = say(rng.choice([0, 3, 8, 40]))
        if rng.random() < 0.5:
            w = items[rng.randrange(30)][1].split()
            at = rng.randrange(max(1, len(w) - 6))
            text[rng.randrange(len(text) + 1) : 0] = w[at : at + rng.choice([7, 8, 9, 30])]
        docs.append((d, " ".join(w.upper() if rng.random() < 0.3 else w for w in text)))
    docs += [(n, None), (n + 1, ""), (None, items[4][1]), (n + 2, "x " * 30_000 + items[9][1]), (n + 3, "a b a b a b a b a b")]
    return spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "'c' AS similarity", "1 AS eval_id"), spark.createDataFrame(items, "eval_id bigint, passage string"), docs, items


def brute(docs, items, k=8):
    grams = {}
    for i, p in items:
        w = words(p)
        for at in range(len(w) - k + 1):
            grams.setdefault(tuple(w[at : at + k]), set()).add(i)
    return {(d, i) for d, t in docs if d is not None for w in [words(t)] for at in range(len(w) - k + 1) for i in grams.get(tuple(w[at : at + k]), ())}


def test_runs_of_eight_words(spark):
    documents, items, docs, rows = tables(spark)
    want = brute(docs, rows)
    assert len(want) > 20
    for more in ({}, {"block_words": 40}, {"radius": 0}):
        got = [tuple(r)[:2] for r in leaked_items(documents, items, **more).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_periodic_windows_need_equal_words(spark):
    docs = spark.createDataFrame([(1, "b a b a b a b a"), (2, "a b a b a b a b")], "doc_id bigint, text string")
    items = spark.createDataFrame([(5, "a b a b a b a b")], "eval_id bigint, passage string")
    assert [tuple(r)[:2] for r in leaked_items(docs, items).collect()] == [(2, 5)]


def test_whole_items(spark):
    rng = random.Random(8)
    item = [f"v{rng.randrange(10**6)}" for _ in range(60)]
    edited = [*item[:30], "changed", *item[31:]]
    broken = [w if i % 4 else "gap" for i, w in enumerate(item)]
    docs = spark.createDataFrame([(1, "start " + " ".join(item) + " end"), (2, "so " + " ".join(edited)), (3, " ".join(broken)), (4, "other")], "doc_id bigint, text string")
    items = spark.createDataFrame([(9, " ".join(item))], "eval_id bigint, passage string")
    got = {r["doc_id"]: r["similarity"] for r in leaked_items(docs, items, window=None, radius=7, least=0.8).collect()}
    assert set(got) == {1, 2} and got[1] == 1.0 and abs(got[2] - 51 / 61) < 1e-9


def test_empty(spark):
    documents, items, _, _ = tables(spark, 5)
    assert leaked_items(documents.limit(0), items).count() == 0
    assert leaked_items(documents, items.limit(0)).count() == 0
    assert word_hashes([]).shape == (0,)


def test_pieces_of_long_texts_miss_nothing(spark, monkeypatch):
    from orrery.llm import leakage

    rng = random.Random(11)
    items = [(i, " ".join(f"u{rng.randrange(10**6)}" for _ in range(12))) for i in range(60)]
    text = []
    for _, p in items:
        text += [f"f{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 40))] + p.split()
    index = leakage.ItemIndex(items, 8, 3, 1.0)
    for chunk in (9, 50, 60_000):
        monkeypatch.setattr(leakage, "_CHUNK", chunk)
        import pyarrow as pa

        class Held:
            value = index

        batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([" ".join(text)])], names=["d", "t"])
        found = {(d, i) for b in leakage._finder(Held)(iter([batch])) for d, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}
        assert found == {(1, i) for i, _ in items}


def nearest(doc, item, weight):
    """The largest similarity of any run of the document's words, by trying all; without a common shingle it is 0."""
    bag = shingles(item)
    if not bag.keys() & shingles(doc).keys():
        return 0.0
    return max((similarity(shingles(doc[a:b]), bag, weight) for a in range(len(doc)) for b in range(a + 5, len(doc) + 1)), default=0.0)


def test_whole_items_in_windows_of_any_length_miss_nothing(spark):
    rng = random.Random(21)
    say = lambda k, v: [f"{v}{rng.randrange(10**6)}" for _ in range(k)]
    common = say(9, "c")
    passages = [say(rng.randrange(21, 40), "p") for _ in range(8)] + [common + say(20, "p"), common + say(22, "p"), [*"ab" * 13], say(5, "p")]
    texts = []
    for p in passages:
        gone = lambda w, at: [*w[:at], *w[at + 1 :]]
        for t in (p, p[:-1], p[1:], p[1:-1], ["x", *p[1:-1], "y"], gone(p, len(p) // 2), [*p[:9], *say(2, "i"), *p[9:]], [*p[:9], *p[20:]], p + p, [*p[: len(p) // 2], *say(3, "i"), *p[len(p) // 2 :]]):
            texts += [t, [*say(3, "f"), *t, *say(4, "f")]]
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(texts)], "doc_id bigint, text string")
    items = spark.createDataFrame([(i, " ".join(p)) for i, p in enumerate(passages)], "eval_id bigint, passage string")
    seen = {}
    for p in passages:
        for s in set(shingles(p)):
            seen[s] = seen.get(s, 0) + 1
    like = {(d, i): nearest(t, p, lambda s: 1 / seen.get(s, 1)) for d, t in enumerate(texts) for i, p in enumerate(passages)}
    want = {k: v for k, v in like.items() if v >= 0.8 - 1e-12}
    got = {(r["doc_id"], r["eval_id"]): r["similarity"] for r in leaked_items(docs, items, window=None, least=0.8).collect()}
    assert len(want) > 120 and got.keys() == want.keys()
    assert all(abs(v - want[k]) < 1e-9 for k, v in got.items())


def test_long_whole_items(spark):
    rng = random.Random(31)
    items = {n: [f"l{rng.randrange(10**6)}" for _ in range(n)] for n in (255, 256, 300, 1000)}
    docs = [(n, " ".join(["so", *w, "on"])) for n, w in items.items()] + [(-n, " ".join(w[: n // 2] + ["in"] + w[n // 2 :])) for n, w in items.items()]
    rows = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "eval_id bigint, passage string")
    got = {(r["doc_id"], r["eval_id"]): r["similarity"] for r in leaked_items(spark.createDataFrame(docs, "doc_id bigint, text string"), rows, window=None, least=0.8).collect()}
    assert got.keys() == {(d, abs(d)) for d, _ in docs} and all(got[n, n] == 1.0 for n in items)


def test_short_and_long_items_and_windows(spark):
    rng = random.Random(41)
    items = {n: [f"s{rng.randrange(10**6)}" for _ in range(n)] for n in (1, 3, 4, 7, 8, 300)}
    docs = [(n, " ".join(["so", *w, "on"])) for n, w in items.items()] + [(100 + n, " ".join([*w[:-1], "other"])) for n, w in items.items()] + [(999, "")]
    rows = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()] + [(0, ""), (-1, None)], "eval_id bigint, passage string")
    texts = spark.createDataFrame(docs, "doc_id bigint, text string")
    whole = {(r["doc_id"], r["eval_id"]) for r in leaked_items(texts, rows, window=None, least=0.8).collect()}
    assert whole == {(n, n) for n in items} | {(400, 300)}  # of eight words seven are 3 of 5 shingles
    runs = {(r["doc_id"], r["eval_id"]) for r in leaked_items(texts, rows, window=8, short=True).collect()}
    assert runs == {(n, n) for n in items} | {(400, 300)}
    assert {(r["doc_id"], r["eval_id"]) for r in leaked_items(texts, rows, window=8).collect()} == {(8, 8), (300, 300), (400, 300)}
    assert {(r["doc_id"], r["eval_id"]) for r in leaked_items(texts, rows, window=300).collect()} == {(300, 300)}


def test_similarity_admits_candidates(spark):
    """Below 1 near windows come out with their similarity, and recall against all windows whose fingerprints are near is whole."""
    rng = random.Random(43)
    item = [f"q{rng.randrange(10**6)}" for _ in range(40)]
    near = [*item[:39], "z"]
    docs = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(near)), (3, " ".join(reversed(item)))], "doc_id bigint, text string")
    items = spark.createDataFrame([(5, " ".join(item))], "eval_id bigint, passage string")
    got = {r["doc_id"]: r["similarity"] for r in leaked_items(docs, items, window=40, radius=12, least=0.8).collect()}
    assert got[1] == 1.0 and abs(got[2] - 35 / 37) < 1e-9 and 3 not in got


def recall(sizes, edits, seed=47):
    """Share of the (document, item) pairs of similarity 0.8 or more, told by trying every window, that whole-item search finds."""
    from orrery.llm import leakage

    rng = random.Random(seed)
    say = lambda n: [f"r{rng.randrange(10**6)}" for _ in range(n)]
    items = [(i, say(n)) for i, n in enumerate(sizes)]
    docs = []
    for i, w in items:
        for _ in range(2):
            t = list(w)
            for _ in range(rng.randrange(0, edits + 1)):
                at = rng.randrange(len(t))
                t[at : at + 1] = rng.choice([[], ["e1"], [t[at], "e2"]])
            docs.append((len(docs), i, [*say(2), *t, *say(2)]))
    index = leakage.PassageIndex([(i, " ".join(w)) for i, w in items], 0.8)
    found = {(d, i) for d, i, _ in index.leaks([(d, t) for d, _, t in docs])}
    want = {(d, i) for d, i, t in docs if nearest(t, dict(items)[i], lambda s: 1) >= 0.8}
    return len(want), len(want & found) / max(1, len(want)), len(found - want)


def test_recall_at_ten_to_four_hundred_words():
    for sizes, edits in (([10, 12, 15, 20, 30], 1), ([40, 60], 2), ([100], 4)):
        n, share, wrong = recall(sizes * (6 if sizes[0] < 40 else 2 if sizes[0] < 100 else 1), edits)
        assert n >= 1 and share == 1.0 and wrong == 0
    # trying all windows of 400 words takes too long: verbatim and once edited passages must be found
    from orrery.llm import leakage

    w = [f"h{i}" for i in range(400)]
    index = leakage.PassageIndex([(1, " ".join(w))], 0.8)
    assert len(list(index.leaks([(1, w), (2, [*w[:200], "e", *w[201:]]), (3, ["x", *w[30:]])]))) == 3
