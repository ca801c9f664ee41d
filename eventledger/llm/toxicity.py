"""Toxicity from a weighted lexicon matched by Aho-Corasick.

Texts are folded first: lower case, accents and look-alike letters mapped to
plain ones, digits between letters read as the letters they imitate. Entries are
whole words and beginnings of words, each with a weight learned from labelled
documents; an entry may have exception phrases (the entry with the word before
or after it) in which it does not count. The sum over a text is normalised by
its length and turned into a probability.
"""

import math
import re
import unicodedata
from collections import Counter

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from eventledger.llm.common import arrow_map, share, text_or_empty

# Bound of the labelled documents that the lexicon is fitted on.
SAMPLE_DOCUMENTS = 20_000

# An entry is seen in this many toxic documents at least, and this many times likelier there.
LEAST_DOCUMENTS, LEAST_RATIO = 3, 8.0
# Lengths of the beginnings of words that may become entries.
BEGINNINGS = range(4, 9)
# Words of a text beyond which one hit counts for less.
USUAL_WORDS = 400

# Letters of other scripts that look like Latin ones.
LOOKALIKES = str.maketrans(
    "аеорсухіјѕԁһӏкмтвнοαερτυνικϲ",
    "aeopcyxijsdhlkmtbhoaeptuvikc",
)
# Digits and signs that stand for letters inside a word.
DIGITS = str.maketrans("013457@$", "oieastas")
_DISGUISED = re.compile(r"(?=[^\W\d_]*[0-9@$])(?=[0-9@$]*[^\W\d_])[\w@$]+")
_WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """Lower case, without accents, with look-alikes and digits read as letters."""
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text.translate(LOOKALIKES))
        text = "".join(c for c in text if not unicodedata.combining(c))
    if _SUSPECT.search(text):
        text = _DISGUISED.sub(lambda m: m.group().translate(DIGITS), text)
    return text


_SUSPECT = re.compile(r"[^\W\d_][0-9@$]|[0-9@$][^\W\d_]")


def words_of(text: str) -> list[str]:
    return _WORD.findall(fold(text))


class Lexicon:
    """Entries with weights, exception phrases, and the line from evidence to probability."""

    def __init__(self, entries: dict[str, float], exceptions: set[str], slope: float = 1.0, offset: float = -2.0):
        self.entries, self.exceptions, self.slope, self.offset = entries, exceptions, slope, offset

    def automaton(self):
        """Entries begin at a word's start (marked by a space); a final space marks whole words."""
        found = ahocorasick.Automaton()
        for entry, weight in self.entries.items():
            found.add_word(" " + entry, (" " + entry, weight))
        for phrase in self.exceptions:
            found.add_word(" " + phrase + " ", (" " + phrase + " ", None))
        if len(found):
            found.make_automaton()
        return found

    def matcher(self):
        """A function text -> (weights of the entries found, hits, words).

        An entry that is found again and again counts by the logarithm.
        """
        found = self.automaton()

        def match(text: str) -> tuple[list[float], int, int]:
            words = words_of(text)
            line = " " + " ".join(words) + " "
            hits: dict[int, tuple[float, str]] = {}  # by the word's start: its heaviest entry
            excused: list[tuple[int, int]] = []
            if len(found):
                for end, (entry, weight) in found.iter(line):
                    start = end - len(entry) + 1
                    if weight is None:
                        excused.append((start, end))
                    else:
                        hits[start] = max((weight, entry), hits.get(start, (weight, entry)))
            kept = Counter(hit for s, hit in hits.items() if not any(a <= s < b for a, b in excused))
            weights = [weight * (1 + math.log(n)) for (weight, _), n in kept.items()]
            return weights, kept.total(), len(words)

        return match

    def evidence(self, weights: list[float], hits: int, words: int) -> float:
        """Sum of the weights per text of usual length; short texts are not scaled up."""
        return sum(weights) / max(1.0, math.sqrt(words / USUAL_WORDS))

    def probability(self, evidence: float) -> float:
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, self.offset + self.slope * evidence))))


def _features(word: str):
    yield word + " "
    for n in BEGINNINGS:
        if len(word) >= n:
            yield word[:n]


def _texts(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(text, toxic) of at most ``sample`` labelled documents, those of smallest hash.

    Texts are not shuffled; rows that share an id all count.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .groupBy(F.col("doc_id").cast("bigint").alias("_id"))
        .agg(F.max("toxic").cast("int").alias("_toxic"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(sample)
    )
    return docs.join(F.broadcast(chosen), docs["doc_id"] == chosen["_id"]).select(
        text_or_empty(), F.col("_toxic").alias("toxic")
    )


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCUMENTS) -> Lexicon:
    """Fit a lexicon on labelled documents (``labels``: doc_id, toxic).

    Document frequencies of words and beginnings of words are counted in Spark
    over the sample of at most ``sample`` documents; the driver gets those features
    that are toxic by the test, and the different (evidence, label) pairs, counted.
    The sample bounds both, however often its rows repeat; no entry or exception
    phrase is left out. Rows without
    a label, and labels without a row, are not used; without labels of both kinds
    the lexicon is empty.
    """
    texts = _texts(docs, labels, sample).checkpoint()
    totals = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:
        return Lexicon({}, set(), offset=-2.0)

    def features():
        def handle(texts, labels):
            for text, label in zip(texts, labels):
                for feature in {f for w in set(words_of(text)) for f in _features(w)}:
                    yield feature, label

        return handle

    seen = (
        arrow_map(texts, "feature string, toxic int", features)
        .groupBy("feature")
        .agg(F.sum("toxic").cast("bigint").alias("t"), F.count("*").alias("n"))
        .where((F.col("t") >= LEAST_DOCUMENTS) & (F.col("t") * clean >= LEAST_RATIO * toxic * (F.col("n") - F.col("t") + 0.5)))
    )
    rows = seen.collect()
    entries = _chosen([(r["feature"], r["t"], r["n"] - r["t"]) for r in rows], toxic, clean)
    plain = Lexicon(entries, set())
    exceptions = _exceptions(texts, plain)
    lexicon = Lexicon(entries, exceptions)

    def evidences():
        match = lexicon.matcher()

        def handle(texts, labels):
            for text, label in zip(texts, labels):
                yield lexicon.evidence(*match(text)), label

        return handle

    points = arrow_map(texts, "evidence double, toxic int", evidences).groupBy("evidence", "toxic").agg(F.count("*").alias("n"))
    lexicon.slope, lexicon.offset = _line(sorted(map(tuple, points.collect())))
    return lexicon


def _chosen(rows: list[tuple[str, int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Entries by weight; a beginning replaces the longer entries that it explains."""
    weight = {
        f: math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1)) for f, t, c in rows
    }
    spread = {f: t for f, t, _ in rows}
    chosen: dict[str, float] = {}
    for feature in sorted(weight, key=lambda f: (-spread[f] * weight[f], len(f), f)):
        stem = feature.rstrip(" ")
        shorter = (stem[:n] for n in range(min(BEGINNINGS), len(stem) + 1))
        if any(s in chosen for s in shorter):
            continue  # the shorter beginning already counts these words
        chosen[feature] = weight[feature]
    return chosen


def _exceptions(texts: DataFrame, lexicon: Lexicon) -> set[str]:
    """Two-word phrases around an entry that are found in clean documents rather than toxic ones."""
    found = lexicon.automaton()
    if not len(found):
        return set()

    def phrases():
        automaton = lexicon.automaton()

        def handle(texts, labels):
            for text, label in zip(texts, labels):
                words = words_of(text)
                hit = [any(True for _ in automaton.iter(f" {w} ")) for w in words]
                around = set()
                for i, is_hit in enumerate(hit):
                    if is_hit:
                        around.update(" ".join(words[j : j + 2]) for j in (i - 1, i) if 0 <= j <= len(words) - 2)
                for phrase in around:
                    yield phrase, label

        return handle

    rows = (
        arrow_map(texts, "phrase string, toxic int", phrases)
        .groupBy("phrase")
        .agg(F.sum("toxic").cast("bigint").alias("t"), F.count("*").alias("n"))
        .where((F.col("n") - F.col("t") >= LEAST_DOCUMENTS) & (F.col("t") * 4 <= F.col("n")))
        .collect()
    )
    return {r["phrase"] for r in rows}


def _line(points: list[tuple[float, int, int]], rounds: int = 60) -> tuple[float, float]:
    """Slope and offset of the logistic line through (evidence, label, times), by Newton's method."""
    slope, offset = 0.5, -2.0
    for _ in range(rounds):
        g0 = g1 = h00 = h01 = h11 = 0.0
        for x, y, n in points:
            p = 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, offset + slope * x))))
            w = n * p * (1 - p)
            g0 += n * (y - p)
            g1 += n * (y - p) * x
            h00 += w
            h01 += w * x
            h11 += w * x * x
        g1 -= 0.05 * slope  # keeps the slope finite when the classes part cleanly
        h11 += 0.05
        h00 += 1e-6
        det = h00 * h11 - h01 * h01
        if det < 1e-12:
            break
        step0, step1 = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        offset, slope = offset + max(-1, min(1, step0)), max(0.0, slope + max(-1, min(1, step1)))
        if abs(step0) + abs(step1) < 1e-9:
            break
    return slope, offset


def score(docs: DataFrame, lexicon: Lexicon, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds score, predicted, hits to ``columns`` of every row of ``docs``.

    A null text counts as empty; a text without hits has the score of the offset.
    Repeated rows are scored each, texts of any length whole; an empty table gives
    no rows. Columns of ``docs`` may not be called like the three added ones.
    """
    shared = share(docs.sparkSession, lexicon)
    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def rows():
        lexicon = shared()
        match = lexicon.matcher()

        def handle(texts, *others):
            for text, *kept in zip(texts, *others):
                weights, hits, words = match(text or "")
                p = lexicon.probability(lexicon.evidence(weights, hits, words))
                yield (*kept, p, int(p >= 0.5), hits)

        return handle

    schema = ", ".join(f"`{c}` {fields[c]}" for c in columns)
    return arrow_map(
        docs.select("text", *[F.col(f"`{c}`") for c in columns]),
        schema + ", score double, predicted int, hits int",
        rows,
    )


def without_toxic(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The rows of ``docs`` that are not predicted to be toxic, with all their columns.

    Texts are judged as by ``score``: whole, a null one as empty, repeated rows
    each. No column is added, so columns of any name may stand beside the text.
    """
    shared = share(docs.sparkSession, lexicon)

    def keep(batches):
        lexicon = shared()
        match = lexicon.matcher()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            clean = [lexicon.probability(lexicon.evidence(*match(t or ""))) < 0.5 for t in texts]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
