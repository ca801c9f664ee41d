"""Operators that compare documents or vectors, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from eventledger.llm import decontaminate, hilbert_ann, line_dedup, near_dedup, suffix_tree
from eventledger.llm.components import components

CLASHING = ("size", "score", "words", "key", "kept", "tid", "text_hash", "crc", "n_tokens", "window", "n_lines")


def docs_of(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for name in CLASHING:
        df = df.withColumn(name, F.lit(name))
    return df


EDGES = [(None, None), (-3, ""), (-2, " \n\n"), (None, "one two"), (-4, "a b c"), (-4, "a b c"), (-4, "d e f")]


# ---- decontamination


def plain_words(text):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(fold))


def plain_contamination(rows, items, width=10):
    windows = defaultdict(set)
    for item, text in items:
        w = plain_words(text)
        for s in range(max(1, len(w) - width + 1)) if w else ():
            windows[tuple(w[s : s + width])].add(item)
    out = []
    for doc, text in rows:
        w, hit, found = plain_words(text), set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit.update(range(s, s + n))
                    found.update(str(i) for i in windows[tuple(w[s : s + n])] if i is not None)
        out.append((str(doc), len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def contaminated(spark, rows, items):
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("words", F.lit(1))
    got = decontaminate.contamination(docs_of(spark, rows), bench).collect()
    return sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got)


@pytest.fixture(scope="module")
def leaks():
    draw = random.Random(1)
    vocabulary = ["the", "of", "Été", "x1", "ß", "and", "b", "É"]
    line = lambda n: [draw.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(line(draw.choice([0, 1, 4, 10, 14, 25])))) for i in range(25)]
    items += [(100, items[3][1]), (None, " ".join(line(12))), (101, None)]
    rows = []
    for i in range(80):
        words = line(draw.randint(0, 60))
        if i % 3 == 0:
            words[5:5] = (draw.choice(items)[1] or "").upper().split()
        rows.append((i, ", ".join(words)))
    return rows + EDGES, [x for x in items if x[1] is None or len(x[1].split()) != 1]


def test_contamination_equals_brute_force(spark, leaks, monkeypatch):
    rows, items = leaks
    expected = plain_contamination(rows, items)
    assert contaminated(spark, rows, items) == expected
    # many passes and a shuffle join give the same
    monkeypatch.setattr(decontaminate, "PAIRS_PER_PASS", 60)
    monkeypatch.setattr(decontaminate, "WORDS_BROADCAST", 2)
    assert contaminated(spark, rows, items) == expected


def test_contamination_of_empty_tables(spark, leaks):
    rows, items = leaks
    assert contaminated(spark, [], items) == []
    assert contaminated(spark, rows, []) == plain_contamination(rows, [])


def test_proximity_matches(spark):
    words = [f"w{i}" for i in range(12)]
    bench = spark.createDataFrame([(1, " ".join(words[:10]))], "item_id bigint, text string")
    near = words[:4] + ["new"] + words[4:8] + ["other", "words", "w9"]
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, "w0 and nothing else"), (4, "w8 w8 w8")]
    got = decontaminate.matches(docs_of(spark, rows), bench, near=0.8, slack=3).where("window is not null")
    assert {(r.doc_id, r.exact) for r in got.collect()} == {(1, True), (2, False)}


# ---- lines


def plain_dedup(rows, least):
    order = sorted(set(rows), key=lambda r: ((r[0] is not None, r[0] or 0), zlib.crc32((r[1] or "").encode())))
    seen, keys, out = set(), set(), {}
    for doc, text in order:
        kept = []
        for i, line in enumerate(text.split("\n") if text is not None else ()):
            if not line.strip(" "):
                kept.append(i)
                continue
            if line in seen:
                continue
            seen.add(line)
            w = tuple(line.split(" "))
            near = False
            if len(w) >= least:
                own = {(len(w), j, w[:j], w[j + 1 :]) for j in range(len(w))}
                less = {w[:j] + w[j + 1 :] for j in range(len(w))} if len(w) > least else set()
                near = bool(own & keys) or any(("whole", x) in keys for x in less) or ("less", w) in keys
                keys |= own | {("less", x) for x in less} | {("whole", w)}
            if not near:
                kept.append(i)
        out[doc, text] = kept
    return out


@pytest.fixture(scope="module")
def lined():
    draw = random.Random(3)
    vocabulary = ["aa", "bb", "cc", "dd", "ee"]
    base = [[draw.choice(vocabulary) for _ in range(draw.randint(8, 17))] for _ in range(10)]
    rows = [(None, "x\n\nx\n y"), (1, "q\nq"), (1, "q\nq"), (1, "q\nz"), (7, "only\n\n"), *EDGES]
    for _ in range(150):
        lines = []
        for _ in range(draw.randint(1, 5)):
            w = list(draw.choice(base))
            for _ in range(draw.randint(0, 2)):
                j, kind = draw.randrange(len(w)), draw.random()
                if kind < 0.5:
                    w[j] = draw.choice([*vocabulary, f"z{draw.randint(0, 50)}", ""])
                elif kind < 0.75:
                    w.insert(j, draw.choice(vocabulary))
                else:
                    del w[j]
            lines.append(" ".join(w))
        rows.append((draw.randint(-50, 400), "\n".join(lines)))
    return rows


def test_line_verdicts_equal_brute_force(spark, lined):
    expected = plain_dedup(lined, 10)
    got = line_dedup.line_verdicts(docs_of(spark, lined)).collect()
    crc = lambda t: None if t is None else zlib.crc32(t.encode())
    assert sorted((str(r.doc_id), str(r.crc), r.n_lines, r.kept) for r in got) == sorted(
        (str(d), str(crc(t)), len(t.split("\n")) if t is not None else 0, expected[d, t]) for d, t in lined
    )
    assert line_dedup.line_verdicts(docs_of(spark, [])).count() == 0


def test_dedup_lines_keeps_columns_and_drops_what_is_left_empty(spark, lined):
    expected = plain_dedup(lined, 10)
    out = line_dedup.dedup_lines(docs_of(spark, lined))
    assert out.columns == docs_of(spark, lined).columns
    want = []
    for d, t in lined:
        lines = (t or "").split("\n")
        kept = [lines[i] for i in expected[d, t]]
        if t is None or any(x.strip(" ") for x in kept) or len(kept) == len(lines):
            want.append((str(d), None if t is None else "\n".join(kept)))
    assert sorted(map(str, want)) == sorted(str((str(r.doc_id), r.text)) for r in out.collect())


def test_a_hot_line_and_a_very_long_one(spark):
    hot = "a line that is found in very many of the documents of this table"
    long = " ".join(f"w{i}" for i in range(4000))
    rows = [(i, f"{hot}\nown line {i}") for i in range(300)]
    rows += [(900, long), (901, long.replace("w77 ", "w-77 ")), (902, long.replace("w78 ", "").replace("w79 ", ""))]
    kept = {r.doc_id: r.kept for r in line_dedup.line_verdicts(docs_of(spark, rows)).collect()}
    assert kept[0] == [0, 1] and all(kept[i] == [1] for i in range(1, 300))
    assert (kept[900], kept[901], kept[902]) == ([0], [], [0])


# ---- near copies


def plain_classes(rows, similarity=0.8):
    bags = []
    for _, text in rows:
        w = plain_words(text)
        bags.append(Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            same = rows[i] == rows[j] and not bags[i]
            shared = (bags[i] & bags[j]).total()
            if same or shared and shared >= similarity * (bags[i].total() + bags[j].total() - shared):
                root[find(i)] = find(j)
    classes = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        classes[find(i)].append(str(doc))
    return sorted(sorted(c) for c in classes.values())


@pytest.fixture(scope="module")
def copied():
    draw = random.Random(4)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(5))
    rows = []
    for g in range(12):
        base = [word() for _ in range(draw.choice([3, 30, 200]))]
        for _ in range(draw.choice([1, 2, 8, 25])):
            w = list(base)
            for _ in range(draw.choice([0, 0, 1, 2, 4, 9])):
                w[draw.randrange(len(w))] = word()
            rows.append((len(rows), " ".join(w)))
    return rows + [(1000, "same " * 40), (1001, "Same, " * 41), (1002, "same " * 80)] + EDGES


def test_near_classes_equal_brute_force(spark, copied, monkeypatch):
    expected = plain_classes(copied)

    def classes():
        found = defaultdict(list)
        for r in near_dedup.near_classes(docs_of(spark, copied)).collect():
            found[r.class_key].append(str(r.doc_id))
        return sorted(sorted(c) for c in found.values())

    assert classes() == expected
    monkeypatch.setattr(near_dedup, "PIECE", 4)  # buckets compared in many pieces
    assert classes() == expected


def test_tiles_of_an_open_bucket_are_bounded_and_hold_each_pair_once(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "PIECE", 16)
    bucket = [(1, f"{i:04}".encode(), f"c{i}" if i >= 60 else "main", i < 60, 300, 60) for i in range(300)]
    bucket += [(2, f"{i:04}".encode(), f"c{i}" if i else "main", i < 1, 5, 1) for i in range(5)]
    df = spark.createDataFrame(bucket, "key bigint, tid binary, component string, inside boolean, n_all bigint, n_main bigint")
    tiles = defaultdict(list)
    for r in near_dedup._tiles(df).collect():
        tiles[r.key, r.piece].append((bytes(r.tid), r.side))
    assert max(map(len, tiles.values())) < 80  # two pieces as a hash deals them, not all that is outside
    assert len([t for t in tiles if t[0] == 2]) == 1
    seen = Counter()
    for (key, _), rows in tiles.items():
        side = np.array([s for _, s in rows])
        alike = np.zeros((len(rows), near_dedup.PLACES // 2), np.uint8)
        for i, j in near_dedup._likely_in_tile(alike, side):
            seen[key, *sorted((rows[i][0], rows[j][0]))] += 1
    inside = {(key, tid) for key, tid, _, main, *_ in bucket if main}
    names = {key: sorted(r[1] for r in bucket if r[0] == key) for key in (1, 2)}
    want = {(k, a, b) for k, n in names.items() for x, a in enumerate(n) for b in n[x + 1 :] if not {(k, a), (k, b)} <= inside}
    assert set(seen) == want and set(seen.values()) == {1}


def test_the_screen_leaves_pairs_at_the_limit_to_the_overlap():
    # places agree in a pair at 0.8 with 0.8 + 0.2 / 16; all but few such pairs must reach the exact overlap
    agree = np.random.default_rng(1).random((20_000, near_dedup.PLACES)) < 0.8 + 0.2 / 16
    halves = np.where(agree, 0, 1).astype(np.uint8)
    others = halves[:, ::2] << 4 | halves[:, 1::2]
    small = np.concatenate([np.zeros((1, near_dedup.PLACES // 2), np.uint8), others])
    side = np.array([near_dedup.OUTER] + [near_dedup.OTHER] * len(others))
    assert len(list(near_dedup._likely_in_tile(small, side))) > 0.9995 * len(others)


def test_one_of_each(spark, copied):
    df = docs_of(spark, copied)
    left = near_dedup.one_of_each(df)
    assert left.columns == df.columns
    assert left.count() == len(plain_classes(copied))
    assert near_dedup.one_of_each(docs_of(spark, [])).count() == 0


def test_signatures_are_unbiased():
    draw = np.random.default_rng(1)
    a = Counter({i: int(draw.integers(1, 6)) for i in range(300)})
    b = +Counter({i: max(0, c + int(draw.integers(-1, 2))) for i, c in a.items() if i < 270})
    b.update({1000 + i: 2 for i in range(20)})
    true = (a & b).total() / (a | b).total()
    agree = []
    for seed in range(20):
        hashes = np.array([i * 7919 + seed * 1000003 + 1 for bag in (a, b) for i in bag], np.uint64)
        owner = np.repeat([0, 1], [len(a), len(b)])
        counts = np.array([c for bag in (a, b) for c in bag.values()])
        one, two = near_dedup.signatures(near_dedup.mixed(hashes), owner, counts, 2)
        agree.append((one == two).mean())
    assert abs(np.mean(agree) - true) < 4 * math.sqrt(true * (1 - true) / (20 * near_dedup.PLACES))


def test_components(spark):
    edges = [(f"{i:03}", f"{i + 1:03}") for i in range(60)] + [("a", "b"), ("b", "a"), ("c", "a"), ("z", "z")]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u string, v string")).collect()}
    assert got == {f"{i:03}": "000" for i in range(61)} | {"a": "a", "b": "a", "c": "a"}


# ---- language model


def test_base_scores_and_order_of_the_tree(spark):
    draw = random.Random(5)
    rows = [(i, " ".join(draw.choice(["The", "cat", "sat", "on", "a", "mat"]) for _ in range(draw.randint(0, 40)))) for i in range(120)]
    rows += EDGES + [(500, "zebra\x0bcat x \x00 cat"), (501, "tac eht tas taM")]
    train = docs_of(spark, [r for r in rows if r[0] is not None and 0 <= r[0] < 100])
    counts = suffix_tree.gather(train).checkpoint()
    tree = suffix_tree.fit(counts)
    out = suffix_tree.score(docs_of(spark, rows), counts, tree, frequent=3).collect()
    assert len(out) == len(rows)
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = lambda t: re.findall("[^\x20\x09-\x0d]+", (t or "").translate(fold))
    known = Counter(w for i, t in rows if i is not None and 0 <= i < 100 for w in tokens(t))
    n, v = known.total() + 100, len(known) + 1
    log = lambda c: math.log10((c + 0.5) / (n + 0.5 * (v + 1)))
    want = sorted(
        (str(i), len(tokens(t)) + 1, sum(known[w] > 0 for w in tokens(t)) + 1, n, round(sum(log(known[w]) for w in tokens(t)) + log(100), 6))
        for i, t in rows
    )
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == want
    by_id = {r.doc_id: r for r in out}
    assert all(r.score < 0 for r in out)
    ordinary = next(r for r in out if r.doc_id is not None and 100 <= r.doc_id < 120 and r.n_tokens > 4)
    assert ordinary.score / ordinary.n_tokens > by_id[501].score / by_id[501].n_tokens
    none = suffix_tree.gather(docs_of(spark, [])).checkpoint()
    empty = suffix_tree.score(docs_of(spark, rows), none, suffix_tree.fit(none)).collect()
    assert len(empty) == len(rows) and all(r.train_tokens == 0 and r.n_known == 0 for r in empty)


def test_distributions_sum_to_one_and_stretches_agree():
    texts = ["the cat sat on the mat " * 30, "a dog", "", "été"]
    stream, begins, _, _ = suffix_tree.symbols(texts)
    runs, n = suffix_tree.run_counts(stream, begins)
    rows = Counter()
    for run, count in zip(runs.tolist(), n.tolist()):
        for d in range(suffix_tree.DEPTH + 1):
            rows[d, run >> 8 & ((1 << 8 * d) - 1), run & 255] += count
    tree = suffix_tree.SuffixTree(*np.array([(*k, c) for k, c in rows.items()]).T)
    chance = 10.0 ** tree.logs.reshape(-1, tree.width).astype(float)
    unseen = int((tree.column == tree.width - 1).sum())
    sums = chance[:, :-1].sum(axis=1) + unseen * chance[:, -1]
    assert np.allclose(sums, 1, atol=1e-5)
    # one stretch of all, or one text at a time, gives the same scores
    together = tree.scores(stream, begins)
    alone = [tree.scores(*suffix_tree.symbols([t])[:2])[0] for t in texts]
    assert np.allclose(together, alone, atol=1e-3)


# ---- neighbours


def test_the_tree_keeps_every_context_that_passes(spark):
    # more contexts differ from their suffixes than a model of 40,000 states can hold
    draw = np.random.default_rng(3)
    contexts = np.unique(draw.integers(1 << 39, 1 << 40, 45_000))
    usual = contexts.astype(np.int64) << 8 | draw.integers(97, 123, len(contexts))
    runs = spark.createDataFrame(pa.table({"key": usual, "n": np.full(len(usual), 5_000)}))
    counts = runs.withColumn("kind", F.lit(0)).select("kind", "key", "n")
    found = suffix_tree.retained(counts)
    kept = found.select("depth", "context").distinct().count()
    assert kept > 40_000
    tree = suffix_tree.fit(counts)
    assert tree.retained == kept
    assert tree.chances(usual, suffix_tree.DEPTH).min() > 0.9


def test_curve_is_a_walk():
    for dims, bits in ((2, 4), (3, 3)):
        cells = np.array(np.meshgrid(*[range(1 << bits)] * dims)).reshape(dims, -1).T
        keys = hilbert_ann.hilbert_keys(cells, bits)
        assert sorted(keys) == list(range(len(cells)))
        walk = cells[np.argsort(keys)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def plain_nearest(rows, k=10):
    good = sorted({(i, tuple(map(float, v))) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)})
    out = []
    for i, v in good:
        if i % 100 == 0:
            alike = [g for g in good if len(g[1]) == len(v)]
            ids, vectors = np.array([j for j, _ in alike]), np.array([w for _, w in alike])
            away = np.sqrt(((vectors - np.array(v)) ** 2).sum(axis=1))
            order = [j for j in np.lexsort((ids, away)) if ids[j] != i][:k]
            out += [(i, r + 1, int(ids[j]), float(away[j])) for r, j in enumerate(order)]
    return sorted(out)


def test_nearest_equals_brute_force_where_windows_cover_all(spark):
    draw = np.random.default_rng(6)
    rows = [(i, draw.normal(size=4).astype(np.float32).tolist()) for i in range(350)]
    rows += [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(600, 700)]  # ties
    rows += [(700, None), (800, [0.0] * 4), (900, [1.0, None, 2.0, 3.0]), (1000, [float("nan"), 1.0, 2.0, 3.0]), (1100, [1.0, 2.0]), (1200, [1.5, 2.5]), (1201, [0.5, 2.0]), (None, [1.0, 1.0, 1.0, 1.0]), rows[100]]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("place", F.lit(1)).withColumn("rank", F.lit(2))
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in hilbert_ann.nearest(df, F.col("vec_id") % 100 == 0).collect())
    want = plain_nearest(rows)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-12)
    assert hilbert_ann.nearest(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_recall_with_narrow_windows(spark, monkeypatch):
    monkeypatch.setattr(hilbert_ann, "BLOCK", 64)
    monkeypatch.setattr(hilbert_ann, "QUERIES", 2)
    draw = np.random.default_rng(7)
    centers = draw.normal(size=(40, 4)) * 5
    rows = [(i, (centers[i % 40] + draw.normal(size=4) * 0.2).tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = hilbert_ann.nearest(df, F.col("vec_id") % 100 == 0).collect()
    found = {(r.query_id, r.vec_id) for r in got}
    want = {(q, v) for q, _, v, _ in plain_nearest(rows)}
    assert len(found & want) >= 0.9 * len(want)
