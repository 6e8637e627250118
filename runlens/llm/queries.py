"""Registered queries: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm import (
    collocations, fingerprints, language, leaks, lines, ngram_join, personal, pieces, quality, ranked, substrings, toxicity, vectors,
)
from runlens.llm.tables import join_checked, stored, table


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal.find_personal(table(spark, sf_dir, "documents"))
    joined = "array_join(transform({}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')"
    base = ", ".join(f"'{k}'" for k in personal.BASE)
    return found.select(
        "doc_id",
        *[F.expr(f"cast(size(filter(spans, x -> x.kind = '{k}')) as bigint) as n_{k}") for k in personal.BASE],
        F.expr(f"sha2({joined.format(f'filter(spans, x -> x.kind in ({base}))')}, 256) as base_sha256"),
        F.expr(f"{joined.format('spans')} as spans"),
    )


def _remainder(n: int) -> str:
    return f"crc32(cast(doc_id as string)) % {n}"


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = f"{_remainder(3)} = 1"
    return language.identify(docs, docs.where(f"not ({held_out})")).selectExpr(
        "doc_id", f"coalesce({held_out}, false) as held_out", "lang_pred", "score"
    )


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = f"{_remainder(4)} = 2"
    scored = quality.classify(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), f"not ({held_out})"
    )
    return scored.selectExpr(
        "doc_id", f"coalesce({held_out}, false) as held_out", "score", "cast(score >= 0.7 as int) as predicted"
    )


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeated(table(spark, sf_dir, "documents")).selectExpr(
        "doc_id", "n_words", "n_removed", "sha2(kept, 256) as kept_sha256"
    )


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), f"{_remainder(5)} = 0"
    known = table(spark, sf_dir, "labels").where(f"toxic is not null and not ({held_out})").selectExpr("doc_id", "toxic as y")
    # the labelled texts are picked once and read in several passes
    rows = join_checked(docs, stored(known, "toxicity-labels"), "doc_id").where("text is not null").select("text", "y")
    rows = stored(rows, "toxicity-rows", wide=True)
    return toxicity.detect(docs, toxicity.train(rows)).selectExpr(
        "doc_id", f"coalesce({held_out}, false) as held_out", "score", "cast(score >= 0.5 as int) as predicted", "spans"
    )


def op1_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.links(table(spark, sf_dir, "embeddings"))


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents"), every=True).selectExpr(
        "doc_id",
        "cast(size(split(text, '\n')) + coalesce(size(removed_lines), 0) as bigint) as n_lines",
        "cast(coalesce(size(removed_lines), 0) as bigint) as n_removed",
        "sha2(text, 256) as text_sha256",
    )


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    done = pieces.encode_texts(docs, pieces.load())
    return done.selectExpr(
        "doc_id", "cast(size(ids) as bigint) as n_pieces", "ids", "sha2(decoded, 256) as decoded_sha256"
    )


def op10_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.compare_with_edited(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_chars",
        "edited_sha256",
        fingerprints.fingerprint("own_signature").alias("fingerprint"),
        fingerprints.fingerprint("edited_signature").alias("edited_fingerprint"),
        fingerprints.likeness("own_signature", "edited_signature").alias("near_edited"),
        fingerprints.likeness("own_signature", "next_signature").alias("near_next"),
    )


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collocations.collocations(table(spark, sf_dir, "documents"))
    return found.selectExpr("lang", *[c if c == "phrase" else f"cast({c} as bigint) as {c}" for c in ("rank", "phrase", "a", "l", "r", "n", "score")])


def op13_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranked.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.selectExpr("item as item_id", "cast(rank as int) as rank", "id as doc_id", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_vectors": op1_vectors,
    "op2_ngram_join": op2_ngram_join,
    "op3_toxicity": op3_toxicity,
    "op4_lines": op4_lines,
    "op5_quality": op5_quality,
    "op6_personal_data": op6_personal_data,
    "op7_pieces": op7_pieces,
    "op8_language": op8_language,
    "op9_substrings": op9_substrings,
    "op10_leaks": op10_leaks,
    "op11_fingerprints": op11_fingerprints,
    "op12_collocations": op12_collocations,
    "op13_ranked": op13_ranked,
}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = f"unnest(regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'))"

ORACLE: dict[str, str] = {
    "op12_collocations": f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS part FROM documents),
lists AS (SELECT row_number() OVER () AS piece, lang, regexp_extract_all(part, '[^\\x20\\x09]+') AS w FROM pieces),
places AS (SELECT lang, piece, unnest(w) AS w1, generate_subscripts(w, 1) AS i FROM lists),
runs AS (
  SELECT lang, w1, lead(w1, 1) OVER s AS w2, lead(w1, 2) OVER s AS w3 FROM places WINDOW s AS (PARTITION BY piece ORDER BY i)),
totals AS (SELECT lang, count(*)::BIGINT AS n FROM runs GROUP BY lang),
f AS MATERIALIZED (
  SELECT lang, w1, '' AS w2, '' AS w3, w1 AS p, count(*)::BIGINT AS f FROM runs GROUP BY ALL
  UNION ALL SELECT lang, w1, w2, '', w1 || ' ' || w2, count(*) FROM runs WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10
  UNION ALL SELECT lang, w1, w2, w3, w1 || ' ' || w2 || ' ' || w3, count(*) FROM runs WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
cuts AS (
  SELECT lang, p, f AS a, 1 AS k, w1 AS lp, trim(w2 || ' ' || w3, ' ') AS rp FROM f WHERE w2 <> ''
  UNION ALL SELECT lang, p, f, 2, w1 || ' ' || w2, w3 FROM f WHERE w3 <> ''),
parts AS MATERIALIZED (SELECT lang || chr(0) || p AS id, f FROM f),
lefts AS MATERIALIZED (SELECT c.*, x.f AS l FROM cuts c JOIN parts x ON x.id = c.lang || chr(0) || c.lp),
scores AS MATERIALIZED (
  SELECT c.*, y.f AS r, ((1000000::HUGEINT * c.a * c.a) // (c.l::HUGEINT * y.f)) AS score
  FROM lefts c JOIN parts y ON y.id = c.lang || chr(0) || c.rp),
lowest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
longer AS (
  SELECT id, max(f) AS longer FROM (
    SELECT lang || chr(0) || w1 || ' ' || w2 AS id, f FROM f WHERE w3 <> ''
    UNION ALL SELECT lang || chr(0) || w2 || ' ' || w3, f FROM f WHERE w3 <> '') GROUP BY id),
kept AS (
  SELECT s.lang, s.p AS phrase, s.a, s.l, s.r, s.score
  FROM lowest s LEFT JOIN longer g ON g.id = s.lang || chr(0) || s.p WHERE g.longer IS NULL OR 100 * g.longer < 50 * s.a),
best AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM best JOIN totals USING (lang) WHERE rank <= 2000""",
    "op13_ranked": f"""
WITH tf AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, {_TERMS} AS term FROM documents) GROUP BY ALL),
lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
c AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS l FROM lengths),
w AS (
  SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, c GROUP BY term),
items AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, {_TERMS} AS term FROM benchmark)),
scores AS (
  SELECT i.item_id, t.doc_id,
    sum(w.w * ((1000000000 * t.tf) // (1000 * t.tf + 20 * (100 - 50 + ((50 * e.n * c.n_docs) // c.l)))))::BIGINT AS score
  FROM items i JOIN tf t USING (term) JOIN w USING (term) JOIN lengths e ON e.doc_id = t.doc_id, c GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM best WHERE rank <= 50""",
}
