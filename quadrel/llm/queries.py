"""Queries of the training-data problems (1, 5, 8, 9, 10) and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrel.llm.copies import canonical_lang, canonical_text, copies, copy_counts
from quadrel.llm.mixing import mix, shares
from quadrel.llm.spans import shared_share, shared_spans
from quadrel.llm.terms import gram_counts, marked
from quadrel.llm.tokens import decode, encode
from quadrel.storage import materialize, scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    term = F.lower(F.regexp_replace("token", r"^[ \t\r\n ]+|[ \t\r\n ]+$", ""))
    return table(spark, sf_dir, "rdf_litindex").select("lit_id", "pos", "posting_id", "literal", F.when(term != "", term).alias("term"))


def _n_literals(postings: DataFrame) -> int:
    return postings.select("lit_id").where("lit_id is not null").distinct().count()


def _terms(spark: SparkSession, sf_dir: str, max_n: int) -> DataFrame:
    rows = _postings(spark, sf_dir)
    return marked(gram_counts(rows, "lit_id", "pos", "term", max_n, "posting_id"), _n_literals(rows))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms that are too rare or too common to search by."""
    return _terms(spark, sf_dir, 1).where("mark is not null").select(F.element_at("gram", 1).alias("token"), "mark")


def p1_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences and literals of every term, and its mark."""
    return _terms(spark, sf_dir, 1).select(F.element_at("gram", 1).alias("token"), "n", "records", "mark")


def p1_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences and literals of every term and every pair of neighbouring terms."""
    return _terms(spark, sf_dir, 2).select(F.array_join("gram", " ").alias("gram"), F.size("gram").alias("length"), "n", "records")


def p1_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every distinct literal text the places indexed and the literals that have it."""
    rows = _postings(spark, sf_dir)
    return marked(gram_counts(rows, "lit_id", "pos", "literal"), _n_literals(rows)).select(F.element_at("gram", 1).alias("literal"), "n", "records", "mark")


def _literal_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = table(spark, sf_dir, "rdf").where("lit_id is not null and object is not null").groupBy("lit_id").agg(F.max("object").alias("text"))
    rows = table(spark, sf_dir, "rdf11").select("lit_id", "lang").join(text, "lit_id")
    return copies(rows.select("lit_id", F.concat(canonical_lang(F.col("lang")), F.lit("\u0002"), canonical_text(F.col("text"))).alias("key")), "key", "lit_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every literal that is a copy of another with a smaller id."""
    return _literal_copies(spark, sf_dir).where("id <> keep_id").select("keep_id", F.col("id").alias("copy_id"))


def p5_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One literal of each sort and the number of its copies."""
    return copy_counts(_literal_copies(spark, sf_dir))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document by byte_bpe_50k."""
    return encode(table(spark, sf_dir, "documents"))


def p8_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text as decoded from its ids."""
    return encode(table(spark, sf_dir, "documents")).select("doc_id", decode(F.col("ids")).alias("text"))


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's source and number of tokens; a document is a row, whatever its id."""
    with scratch() as keep:
        return keep(materialize(encode(table(spark, sf_dir, "documents"), keep=("source",)).select("doc_id", "source", F.size("ids").alias("n_tokens"))))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mixture and how often each is used."""
    return mix(_sized(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p9_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture at the size of the corpus: sources that can't give their share are clamped at their cap, the others give more."""
    sized, targets = _sized(spark, sf_dir), table(spark, sf_dir, "mix_targets")
    total = sized.join(targets.select("source").distinct(), "source", "left_semi").agg(F.sum("n_tokens")).collect()[0][0] or 0
    return mix(sized, targets, total)


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares of tokens that the mixture reaches."""
    targets = table(spark, sf_dir, "mix_targets")
    return shares(materialize(mix(_sized(spark, sf_dir), targets)), targets)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The maximal runs of characters that stand in another document too, in passages of 150 characters or more."""
    return shared_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))


def p10_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document how many of its characters are shared."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return shared_share(docs, shared_spans(docs))


QUERIES = {f.__name__: f for f in (p1_found, p1_terms, p1_pairs, p1_literals, p5_found, p5_kept, p8_ids, p8_decoded, p9_mix, p9_corpus, p9_shares, p10_found, p10_shared)}

_TERM = "lower(trim(token, ' ' || chr(9) || chr(10) || chr(13) || chr(160)))"
_SLOT = f"t AS (SELECT DISTINCT lit_id, pos, {_TERM} AS token FROM rdf_litindex WHERE token IS NOT NULL AND lit_id IS NOT NULL AND {_TERM} <> '')"
_MARK = "CASE WHEN count(DISTINCT lit_id) < 3 THEN 'rare' WHEN count(DISTINCT lit_id) > 0.08 * (SELECT count(DISTINCT lit_id) FROM rdf_litindex) THEN 'common' END AS mark"
_RUN = "trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+', ' ', 'g'))"
_KEYS = f"""x AS (SELECT lit_id, any_value(object) AS text FROM rdf WHERE lit_id IS NOT NULL AND object IS NOT NULL GROUP BY lit_id),
k AS (SELECT r.lit_id, replace(lower(coalesce(r.lang, '')), '_', '-') AS lang, CASE WHEN regexp_matches(text, '[;|]')
  THEN list_sort(list_filter(list_transform(regexp_split_to_array(text, '[;|]'), lambda f: {_RUN.format('f')}), lambda f: f <> '')) ELSE ['=', {_RUN.format('text')}] END AS form,
  regexp_matches(text, '[;|]') AS fields FROM rdf11 r JOIN x USING (lit_id)),
g AS (SELECT lit_id, min(lit_id) OVER (PARTITION BY lang, fields, form) AS keep_id FROM k)"""

# All windows of 150 characters, grouped by their text.
_SPANS = """d AS (SELECT doc_id, text FROM documents WHERE length(text) >= 150 AND doc_id IS NOT NULL), w AS (SELECT doc_id, i, substr(text, i + 1, 150) AS t FROM (SELECT doc_id, text, unnest(range(0, length(text) - 149)) AS i FROM d)),
c AS (SELECT t FROM w GROUP BY t HAVING min(doc_id) <> max(doc_id)), h AS (SELECT doc_id, i FROM w SEMI JOIN c USING (t)),
n AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 150, true) AS new FROM h),
g AS (SELECT doc_id, i, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM n),
sp AS (SELECT doc_id, min(i) AS span_start, max(i) + 150 AS span_end FROM g GROUP BY doc_id, run)"""

ORACLES = {
    "p10_found": f"WITH {_SPANS} SELECT doc_id, span_start, span_end FROM sp",
    "p10_shared": f"WITH {_SPANS} SELECT doc_id, coalesce(length(text), 0) AS n_chars, coalesce((SELECT sum(span_end - span_start) FROM sp WHERE sp.doc_id = documents.doc_id), 0)::BIGINT AS n_shared FROM documents",
    "p1_found": f"WITH {_SLOT} SELECT token, mark FROM (SELECT token, {_MARK} FROM t GROUP BY token) WHERE mark IS NOT NULL",
    "p1_terms": f"WITH {_SLOT} SELECT token, count(*) AS n, count(DISTINCT lit_id) AS records, {_MARK} FROM t GROUP BY token",
    "p1_literals": f"WITH t AS (SELECT DISTINCT lit_id, pos, literal FROM rdf_litindex WHERE literal IS NOT NULL AND lit_id IS NOT NULL) SELECT literal, count(*) AS n, count(DISTINCT lit_id) AS records, {_MARK} FROM t GROUP BY literal",
    "p1_pairs": f"""WITH {_SLOT}, f AS (SELECT lit_id, pos, arg_max(token, (posting_id, token)) AS nxt FROM (SELECT lit_id, pos, posting_id, {_TERM} AS token FROM rdf_litindex WHERE token IS NOT NULL AND {_TERM} <> '') GROUP BY lit_id, pos)
SELECT token AS gram, 1 AS length, count(*) AS n, count(DISTINCT lit_id) AS records FROM t GROUP BY token
UNION ALL SELECT t.token || ' ' || f.nxt, 2, count(*), count(DISTINCT t.lit_id) FROM t JOIN f ON f.lit_id = t.lit_id AND f.pos = t.pos + 1 GROUP BY t.token, f.nxt""",
    "p5_found": f"WITH {_KEYS} SELECT keep_id, lit_id AS copy_id FROM g WHERE keep_id <> lit_id",
    "p5_kept": f"WITH {_KEYS} SELECT keep_id, count(*) AS n_copies FROM g GROUP BY keep_id",
    "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
