"""The pipeline stage by stage, each against a plain version on its own input."""

import hashlib
import math
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from eventledger.llm import toxicity
from eventledger.llm.catalog import remainder
from test_corpus_operators import plain_classes, plain_contamination, plain_dedup

SF_DIR = "/root/testdata/sf0.001"


def plain_probability(lexicon, text):
    """Every entry tried at every word, without an automaton."""
    words = toxicity.words_of(text)
    line = " " + " ".join(words) + " "
    found = Counter()
    at = 0
    for i, word in enumerate(words):
        rest = line[at + 1 :]
        best = max(((w, " " + e) for e, w in lexicon.entries.items() if rest.startswith(e)), default=None)
        excused = any(
            line.startswith(" " + p + " ", max(at - back, 0)) and at < at - back + len(p) + 2
            for p in lexicon.exceptions
            for back in ({0, at - line.rfind(" ", 0, at)} if at else {0})
            if at - back >= 0
        )
        if best and not excused:
            found[best] += 1
        at += len(word) + 1
    total = sum(w * (1 + math.log(n)) for (w, _), n in found.items())
    return lexicon.probability(total / max(1.0, math.sqrt(len(words) / toxicity.USUAL_WORDS)))


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and result of each stage, over the smallest tables and rows with the odd cases."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").withColumn("score", F.lit("extra"))
    odd = spark.createDataFrame(
        [(9001, None), (9002, ""), (9003, " \n"), (None, "a text without an id that has a few words"), (9004, "x"), (9004, "x"),
         (9005, "\n".join(f"own line number {i} of the longest text of all, with words w{i}" for i in range(2000)))],
        "doc_id bigint, text string",
    )
    docs = docs.unionByName(odd, allowMissingColumns=True)
    found, folder = {}, tmp_path_factory.mktemp("stages")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF_DIR)
        out.write.parquet(f"{folder}/{name}")
        found[name] = docs, spark.read.parquet(f"{folder}/{name}")
        docs = found[name][1]
    return found


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def same(a, b):
    return sorted(map(repr, a)) == sorted(map(repr, b))


def test_columns_stay(stages):
    for name, (docs, out) in stages.items():
        if name != "bpe_encode":
            assert out.columns == docs.columns, name


def test_toxic_documents_go(spark, stages):
    docs, out = stages["toxicity"]
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").where(remainder() != 0)
    lexicon = toxicity.learn(docs, labels)
    kept = [(i, t) for i, t in pairs(docs) if plain_probability(lexicon, t or "") < 0.5]
    assert same(pairs(out), kept) and len(kept) < docs.count()


def test_repeated_lines_go(stages):
    docs, out = stages["line_dedup"]
    rows = pairs(docs)
    kept = plain_dedup(rows, 10)
    want = []
    for i, t in rows:
        lines = (t or "").split("\n")
        left = [lines[n] for n in kept[i, t]]
        if t is None or len(left) == len(lines) or any(x.strip(" ") for x in left):
            want.append((i, None if t is None else "\n".join(left)))
    assert same(pairs(out), want)
    wrong = out.where("text is not null and n_chars is not null and n_chars <> length(text)")
    assert wrong.isEmpty()


def test_one_of_each_class_stays(stages):
    docs, out = stages["near_dedup"]
    classes = plain_classes(pairs(docs))
    assert out.count() == len(classes)
    left = Counter(str(i) for i, _ in pairs(out))
    first = lambda c: "None" if "None" in c else min(c, key=int)
    assert left == Counter(first(c) for c in classes)


def test_contaminated_documents_go(spark, stages):
    docs, out = stages["decontaminate"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    verdict = {row[0]: row[-1] for row in plain_contamination(pairs(docs), items)}
    assert same(pairs(out), [(i, t) for i, t in pairs(docs) if not verdict[str(i)]])


def test_what_is_left_is_encoded(stages):
    docs, out = stages["bpe_encode"]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, t in pairs(docs):
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        joined = " ".join(map(str, ids))
        want.append((i, len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), joined))
    assert same(out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids").rdd.map(tuple).collect(), want)


def test_run_applies_all_stages(spark):
    out = corpus_pipeline.run(spark, SF_DIR)
    assert 0 < out.count() < 200 and "ids" in out.columns


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF_DIR).count() == 0
