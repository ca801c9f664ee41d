"""Queries over the test tables, one per operator, and their SQL twins."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from eventledger.llm import (
    bpe_stream,
    decontaminate,
    hilbert_ann,
    license_templates,
    line_dedup,
    near_dedup,
    phrases,
    secret_scan,
    shards,
    suffix_tree,
    token_counts,
    token_overlaps,
    toxicity,
)
from eventledger.llm.common import read

HELD_OUT_OF = 5


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def remainder(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 5; null where the id is null."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % HELD_OUT_OF


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = near_dedup.near_classes(read(spark, sf_dir, "documents"))
    return classes.select("doc_id", "class_id", "class_size", "text_id")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(read(spark, sf_dir, "documents"))


def op3_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.assign_shards(read(spark, sf_dir, "documents"), 16)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    labels = read(spark, sf_dir, "labels").where(remainder() != 0)
    scored = toxicity.score(docs, toxicity.learn(docs, labels))
    return scored.select(
        "doc_id",
        F.coalesce(remainder() == 0, F.lit(False)).alias("held_out"),
        "score",
        "predicted",
        "hits",
    )


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(
        read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), 1024
    )


def op6_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = F.coalesce(remainder() == 1, F.lit(False))
    counts = suffix_tree.gather(docs.where(~held_out)).checkpoint()
    scored = suffix_tree.score(docs, counts, suffix_tree.fit(counts))
    return scored.select(
        "doc_id",
        held_out.alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        "base_score",
        "score",
    )


def op7_hilbert_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_ann.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


def op8_bpe_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_stream.encode_documents(
        read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json")
    )


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.drop("text_hash")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = line_dedup.line_verdicts(read(spark, sf_dir, "documents"))
    every = F.when(F.col("n_lines") > 0, F.sequence(F.lit(0), F.col("n_lines") - 1)).otherwise(
        F.array().cast("array<int>")
    )
    return verdicts.select(
        "doc_id",
        F.col("n_lines").cast("bigint").alias("n_lines"),
        F.size("kept").cast("bigint").alias("n_kept"),
        F.concat_ws(",", F.array_except(every, "kept").cast("array<string>")).alias("dropped_lines"),
    )


def op11_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_templates.scan(read(spark, sf_dir, "documents")).drop("spans")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read(spark, sf_dir, "documents"), support=30, most=2000)


def op13_token_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_overlaps.align(
        read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
    )


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_near_dedup,
            op2_secret_scan,
            op3_byte_shards,
            op4_toxicity,
            op5_token_counts,
            op6_suffix_tree,
            op7_hilbert_ann,
            op8_bpe_stream,
            op9_decontaminate,
            op10_line_dedup,
            op11_license_templates,
            op12_phrases,
            op13_token_overlaps,
        )
    }


def all_sql() -> dict[str, str]:
    return {
        "op9_decontaminate": OP9_SQL,
        "op10_line_dedup": OP10_SQL,
        "op11_license_templates": op11_sql(),
        "op12_phrases": OP12_SQL,
    }


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x : x <> '') AS w
  FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x : x <> '') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + 9], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
widths AS (SELECT DISTINCT n FROM win),
places AS (
  SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, widths)),
hits AS (SELECT p.doc_id, p.s, p.n, win.item_id FROM places p JOIN win USING (n, phrase)),
words AS (SELECT doc_id, count(DISTINCT pos) AS n_hit
  FROM (SELECT doc_id, unnest(range(s, s + n)) AS pos FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(i, ',' ORDER BY i)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP10_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no
  FROM documents),
full_lines AS (SELECT doc_id, no, line FROM l WHERE trim(line) <> ''),
firsts AS (
  SELECT line, min(doc_id::HUGEINT * 1000000000 + no) AS place, string_split(line, ' ') AS w
  FROM full_lines GROUP BY line),
long AS (SELECT place, w, len(w) AS n FROM firsts WHERE len(w) >= 10),
cut AS (SELECT place, n, i, md5(array_to_string(list_concat(w[:i - 1], w[i + 1:]), ' ')) AS rest
  FROM (SELECT place, w, n, unnest(range(1, n + 1)) AS i FROM long)),
changed AS (
  SELECT place FROM (SELECT place, min(place) OVER (PARTITION BY n, i, rest) AS low FROM cut) WHERE low < place),
whole AS (SELECT place, n, md5(array_to_string(w, ' ')) AS rest FROM long),
pairs AS (SELECT w.place AS a, c.place AS b FROM whole w JOIN cut c ON w.n = c.n - 1 AND w.rest = c.rest),
near AS (SELECT place FROM changed UNION SELECT greatest(a, b) FROM pairs),
kept AS (SELECT place FROM firsts WHERE place NOT IN (SELECT place FROM near)),
judged AS (
  SELECT l.doc_id, l.no, trim(l.line) = '' OR k.place IS NOT NULL AS stays
  FROM l LEFT JOIN kept k ON k.place = l.doc_id::HUGEINT * 1000000000 + l.no)
SELECT d.doc_id, count(j.no)::BIGINT AS n_lines, count(j.no) FILTER (WHERE j.stays)::BIGINT AS n_kept,
  coalesce(string_agg(j.no::VARCHAR, ',' ORDER BY j.no) FILTER (WHERE NOT j.stays), '') AS dropped_lines
FROM documents d LEFT JOIN judged j ON j.doc_id = d.doc_id
GROUP BY d.doc_id
"""


def op11_sql() -> str:
    """Templates as regular expressions over the words, phrases by comparing words."""
    def places(phrase: str) -> str:
        same = " AND ".join(f"w[i + {k}] = '{word}'" for k, word in enumerate(phrase.split()))
        return f"list_filter(range(1, len(w) + 1), lambda i : coalesce({same}, false))"

    patterns: dict[str, list[str]] = {}
    for label, markup in license_templates.TEMPLATES:
        patterns.setdefault(label, []).append(license_templates.as_regex(markup))
    base = ",\n  ".join(f"{places(p)} AS p{k}" for k, p in enumerate(license_templates.PHRASES))
    named = ", ".join(
        f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, label in enumerate(license_templates.PHRASES.values())
    )
    stated = ",\n    ".join(
        f"CASE WHEN regexp_matches(line, ' (?:{'|'.join(found)})') THEN '{label}' END" for label, found in patterns.items()
    )
    every = ", ".join(f"p{k}" for k in range(len(license_templates.PHRASES)))
    joined = lambda found: f"array_to_string(list_sort(list_distinct(list_filter({found}, lambda x : x IS NOT NULL))), ',')"
    return rf"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x : x <> '') AS w
  FROM documents),
p AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS line,
  {base}
  FROM d),
f AS (SELECT doc_id, len(w)::BIGINT AS n_words, flatten([{every}]) AS found, [{named}] AS named, [
    {stated}] AS stated
  FROM p)
SELECT doc_id, n_words, len(found)::BIGINT AS n_base, (list_min(found) - 1)::BIGINT AS first_word,
  (list_max(found) - 1)::BIGINT AS last_word, {joined("named")} AS base_labels,
  {joined("list_concat(named, stated)")} AS labels,
  CASE WHEN len(list_filter(stated, lambda x : x IS NOT NULL)) > 0 THEN 1.0::DOUBLE
    WHEN len(found) > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS score
FROM f
"""


OP12_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x : x <> '') AS w FROM p),
f AS (
  SELECT lang, k, array_to_string(w[s:s + k - 1], ' ') AS phrase, count(*) AS n
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM w, (VALUES (1), (2), (3), (4)) AS sizes(k))
  GROUP BY ALL),
totals AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND n >= 30),
cuts AS (
  SELECT lang, phrase, a, cut, array_to_string(w[:cut], ' ') AS head, array_to_string(w[cut + 1:], ' ') AS rest
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM c)),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.cut, l.n AS l, r.n AS r,
    ((2000000::HUGEINT * c.a) // (l.n::HUGEINT + r.n))::BIGINT AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = c.head JOIN f r ON r.lang = c.lang AND r.phrase = c.rest),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (
  SELECT DISTINCT lang, array_to_string(w[s:s + m - 1], ' ') AS phrase, a AS longer
  FROM (SELECT lang, w, m, a, unnest(range(1, k - m + 2)) AS s FROM c, (VALUES (2), (3)) AS sizes(m) WHERE m < k)),
kept AS (
  SELECT * FROM weakest v
  WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = v.lang AND i.phrase = v.phrase
    AND 100::HUGEINT * i.longer >= 80::HUGEINT * v.a)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase) ASC) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
