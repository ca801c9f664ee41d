"""Phrase mining, licence templates and token overlaps against plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from eventledger.llm import license_templates, phrases, token_overlaps

EDGES = [(1, None), (2, ""), (3, " \n "), (None, "one two"), (4, "same text"), (4, "same text"), (5, "same text")]


def docs_of(spark, rows, columns="doc_id bigint, text string"):
    df = spark.createDataFrame(rows, columns)
    for name in ("n", "words", "phrase", "hash", "score", "labels", "pairs", "row", "times", "rank"):
        df = df.withColumn(name, F.lit(name))
    return df


# --- phrases


def plain_phrases(rows, support, most):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", text):
            words = [w for w in re.split("[ \t]+", piece) if w]
            totals[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    candidates = {p: n for p, n in counts.items() if len(p[1]) > 1 and n >= support}
    found = defaultdict(list)
    for (lang, p), a in candidates.items():
        cuts = []
        for k in range(1, len(p)):
            l, r = counts[lang, p[:k]], counts[lang, p[k:]]
            cuts.append((2_000_000 * a // (l + r), k, l, r))
        score, _, l, r = min(cuts)
        longer = [
            n for (lang2, q), n in candidates.items()
            if lang2 == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))
        ]
        if not any(100 * n >= 80 * a for n in longer):
            found[lang].append((-score, -a, " ".join(p).encode(), l, r))
    return sorted(
        (lang, i + 1, p.decode(), -a, l, r, totals[lang], -score)
        for lang, ps in found.items()
        for i, (score, a, p, l, r) in enumerate(sorted(ps)[:most])
    )


def chatter(n, seed):
    draw = random.Random(seed)
    words = ["a", "b", "C", "dé", "x-y", "日本", "é", "in", "the"]
    marks = [" ", " ", " ", "\t ", ". ", "\n", ", ", "!"]
    rows = []
    for i in range(n):
        text = "".join(draw.choice(words) + draw.choice(marks) for _ in range(draw.randint(0, 40)))
        rows.append((draw.choice(["en", "de", None, "und"]), text))
    return rows + [(None, None), ("en", ""), ("fr", "..."), ("es", "z" * 40_000), ("en", "Twice a b"), ("en", "Twice a b")]


@pytest.mark.parametrize("one_in", [1, 4, 1_000_000])
def test_phrases_equal_plain_counts_whatever_the_sample(spark, one_in):
    rows = chatter(150, one_in)
    docs = docs_of(spark, [(i, lang, text) for i, (lang, text) in enumerate(rows)], "doc_id bigint, lang string, text string")
    got = phrases.collocations(docs, support=5, most=20, one_in=one_in).collect()
    assert sorted(tuple(r) for r in got) == plain_phrases(rows, 5, 20)


def test_a_failed_border_starts_further_passes(spark, monkeypatch):
    passes = []
    real = phrases._count_pass
    monkeypatch.setattr(phrases, "_count_pass", lambda *a: passes.append(a) or real(*a))
    rows = [(i, "en", "one two three four five") for i in range(6)]
    docs = docs_of(spark, rows, "doc_id bigint, lang string, text string")
    # nobody proposes: words in the first pass, then a length each
    found = phrases.frequent_phrases(docs, 5, 10**9).where("words = 4").collect()
    assert sorted(r["phrase"] for r in found) == ["one two three four", "two three four five"]
    assert len(passes) == 4
    passes.clear()
    assert phrases.frequent_phrases(docs, 5, 1).where("words = 4").count() == 2 and len(passes) == 1


def test_a_full_bitmap_changes_nothing(spark, monkeypatch):
    rows = chatter(60, 9)
    docs = docs_of(spark, [(i, lang, text) for i, (lang, text) in enumerate(rows)], "doc_id bigint, lang string, text string")
    monkeypatch.setattr(phrases, "LEAST_BITS", 6)
    monkeypatch.setattr(phrases, "MOST_BITS", 6)
    # and hands over what it has added up again and again
    monkeypatch.setattr(phrases, "TALLIED", 50)
    monkeypatch.setattr(phrases, "NAMED", 3)
    got = phrases.collocations(docs, support=5, most=20).collect()
    assert sorted(tuple(r) for r in got) == plain_phrases(rows, 5, 20)


def test_knock_out_ranks_like_one_sort(spark, monkeypatch):
    monkeypatch.setattr(phrases, "RANKED_TOGETHER", 40)
    rows = [("x" if i % 3 else "y", str(i), i % 7) for i in range(1000)]
    df = spark.createDataFrame(rows, "lang string, phrase string, score bigint")
    got = phrases.top_of_each(df, "lang", "phrase", [F.desc("score"), F.asc("phrase")], 10)
    want = []
    for lang in "xy":
        best = sorted((-s, p) for name, p, s in rows if name == lang)[:10]
        want += [(lang, p, -s, i + 1) for i, (s, p) in enumerate(best)]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_no_documents_have_no_phrases(spark):
    docs = docs_of(spark, [], "doc_id bigint, lang string, text string")
    assert phrases.collocations(docs).count() == 0


# --- licences

MARKUP = [
    ("one", 'licensed <<beginOptional>>as <<var;match="free|open source">><<endOptional>> under it'),
    ("two", 'by <<var;words="1-3">> and <<var;words="0-2">> friends'),
    ("three", "<<beginOptional>>very <<beginOptional>>very<<endOptional>><<endOptional>> free"),
]


def test_templates_accept_what_the_markup_says():
    scanner = license_templates.Scanner(MARKUP, {})
    texts = {
        "Licensed under it": ["one"],
        "licensed as OPEN-source under it!": ["one"],
        "licensed as free under it": ["one", "three"],
        "licensed as under it": [],
        "licensed quite under it": [],
        "by a and friends": ["two"],
        "by a b c and d e friends": ["two"],
        "by and friends": [],
        "by a b c d and friends": [],
        "by a and b c d friends": [],
        "very very free": ["three"],
        "licensed under\nit by by by and and friends": ["one", "two"],
    }
    found = scanner.scan(list(texts))
    assert [sorted({label for _, _, label in spans}) for _, _, spans in found] == list(texts.values())


def test_templates_agree_with_regular_expressions():
    draw = random.Random(3)
    words = "licensed as free open source under it by and friends very x".split()
    texts = [" ".join(draw.choice(words) for _ in range(draw.randint(0, 30))) for _ in range(2000)]
    scanner = license_templates.Scanner(MARKUP, {"by and": "b", "free": "f"})
    for text, (n, places, spans) in zip(texts, scanner.scan(texts)):
        assert n == len(text.split())
        for label, markup in MARKUP:
            wanted = re.search(f"(?:^| ){license_templates.as_regex(markup)}", text + " ") is not None
            assert wanted == (label in {x for _, _, x in spans})
        w = text.split()
        assert sorted(places) == sorted(
            [(i, "b") for i in range(n - 1) if w[i : i + 2] == ["by", "and"]] + [(i, "f") for i in range(n) if w[i] == "free"]
        )
        for label, group in (("one", None), ("two", None)):
            own = sorted((s, e) for s, e, x in spans if x == label)
            assert all(a[1] <= b[0] for a, b in zip(own, own[1:]))


def test_long_templates_and_a_changed_word():
    scanner = license_templates.Scanner(license_templates.TEMPLATES, license_templates.PHRASES)
    whole = next(m for label, m in license_templates.TEMPLATES if label == "bsd-2-clause")
    text = re.sub("<<beginOptional>>.<<endOptional>> ", "", whole)
    changed = text.replace("reproduce the above", "reproduce any above")
    long = "word " * 30_000 + text.upper()
    labels = [{x for _, _, x in spans} for _, _, spans in scanner.scan([text, changed, long, None])]
    assert labels == [{"bsd-2-clause"}, set(), {"bsd-2-clause"}, set()]


@pytest.mark.parametrize("markup", ["a <<endOptional>>", "<<beginOptional>> a", '<<var;words="3-1">> a', "<<else>> a", "<<beginOptional>>a<<endOptional>>"])
def test_bad_markup_is_refused(markup):
    with pytest.raises(ValueError):
        license_templates.Automaton([("x", markup)])


def test_licence_scan_of_edge_cases(spark):
    rows = [*EDGES, (6, "See the Apache License, then the apache license."), (7, "Licensed under CC BY-NC 4.0."), (8, "mit\nLICENSE")]
    got = {tuple(r) for r in license_templates.scan(docs_of(spark, rows)).collect()}
    empty = lambda i, n: (i, n, 0, None, None, "", "", 0.0, "")
    assert got == {
        empty(1, 0), empty(2, 0), empty(3, 0), empty(None, 2), empty(4, 2), empty(5, 2),
        (6, 8, 2, 2, 6, "apache", "apache", 0.5, ""),
        (7, 7, 1, 2, 2, "cc-by", "cc-by,cc-by-nc-4.0", 1.0, "cc-by-nc-4.0:0:7"),
        (8, 2, 1, 0, 0, "mit", "mit", 0.5, ""),
    }
    assert license_templates.scan(docs_of(spark, rows)).count() == len(rows)
    assert license_templates.scan(docs_of(spark, [])).count() == 0


# --- token overlaps

FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def sides():
    with open(FILES[0], encoding="utf-8") as a, open(FILES[1], "rb") as b:
        return token_overlaps.byte_level(a.read()), token_overlaps.pieces_with_bytes(b.read())


def plain_overlaps(sides, rows):
    per_row = []
    for _, text in rows:
        ids = [side.encode([text])[0] for side in sides] if text else [[], []]
        raw = (" " + (text or "")).encode()
        if not text or any(b"".join(s.spelling[i] for i in x) != raw for s, x in zip(sides, ids)):
            per_row.append(([], [], [], ""))
            continue
        owners = [[k for k, i in enumerate(x) for _ in s.spelling[i]] for s, x in zip(sides, ids)]
        links = [(ids[0][i], ids[1][j]) for i, j in sorted(set(zip(*owners)))]
        ends = [set(np.cumsum([len(s.spelling[i]) for i in x]).tolist()) for s, x in zip(sides, ids)]
        written, start = [], 0
        for end in sorted(ends[0] & ends[1]):
            inside = [",".join(str(x[k]) for k in sorted(set(o[start:end]))) for x, o in zip(ids, owners)]
            written.append("|".join(inside))
            start = end
        per_row.append((*ids, links, ";".join(written)))
    counts = Counter(pair for row in per_row for pair in set(row[2]))
    best = defaultdict(int)
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    return sorted(
        (
            (
                doc_id, len(a), len(b), written.count(";") + 1 if written else 0, len(links),
                sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links),
                hashlib.sha256(written.encode()).hexdigest() if written else "",
            )
            for (doc_id, _), (a, b, links, written) in zip(rows, per_row)
        ),
        key=repr,
    )


def test_texts_are_encoded_in_parts(sides):
    draw = random.Random(31)
    bits = ["a", "the", " ", "  ", "\n", "\t ", "'s", "é", "日", "1", "<|endoftext|>", "\x1c", "\x85", "!", "🙂", "▁", "\u3000", "\u0301", " word next "]
    texts = ["".join(draw.choice(bits) * draw.randint(1, 3) for _ in range(draw.randint(0, 25))) for _ in range(3000)] + [None]
    given = []

    def counting(side):
        return side._replace(encode=lambda some: given.extend(some) or side.encode(some))

    parted, whole = token_overlaps.Aligner(*sides), token_overlaps.Aligner(*(s._replace(in_parts=False) for s in sides))
    for some in (texts, texts[::2]):
        for one, other in zip(parted.align(some), whole.align(some)):
            assert np.array_equal(one, other)
    repeats = [" ".join(draw.choice(["some", "words,", "that", "repeat"]) for _ in range(500)) for _ in range(20)]
    token_overlaps.Aligner(*map(counting, sides)).align(repeats)
    assert sum(map(len, given)) < 200


def test_merge_path_cuts_anywhere():
    draw = random.Random(5)
    for size in (1, 2, 3, 7, 1000):
        for _ in range(40):
            a, b = (np.unique([draw.randint(1, 60) for _ in range(draw.randint(0, 30))] + [60]) for _ in range(2))
            i, j = token_overlaps.split_diagonals(a, b, size)
            pieces = np.diff(i + j)
            assert i[-1] == len(a) and j[-1] == len(b) and (pieces[:-1] == size).all()
            merged = token_overlaps.merge_ends(a, b, size)
            cover = lambda ends: [int(np.searchsorted(ends, byte, side="left")) for byte in range(1, 61)]
            assert sorted(zip(merged.link_a.tolist(), merged.link_b.tolist())) == sorted(set(zip(cover(a), cover(b))))
            assert a[merged.closes_a].tolist() == b[merged.closes_b].tolist() == sorted(set(a) & set(b))


@pytest.mark.parametrize("sent", [1 << 20, 40, 0])
def test_overlaps_equal_plain_ones(spark, sides, sent, monkeypatch):
    draw = random.Random(7)
    bits = ["the ", "anti", "dis", "é", "日本", " ", "\n\n", "🙂", "<s>", "<|endoftext|>", "1999", "x" * 50, "\t", "'s"]
    texts = ["".join(draw.choice(bits) for _ in range(draw.randint(1, 40))) for _ in range(60)]
    rows = [*EDGES, (90, "▁ is a space"), (91, "nul \0 here"), (92, "the " * 3000), *enumerate(texts, 10)]
    docs = docs_of(spark, rows).repartition(3)
    got = token_overlaps.align(docs, *FILES, sent_pairs=sent)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_overlaps(sides, rows)


def test_no_documents_have_no_overlaps(spark):
    assert token_overlaps.align(docs_of(spark, []), *FILES).count() == 0
