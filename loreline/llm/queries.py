"""The thin ``opN_<name>`` queries over whole tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreline.llm.decontam import find_contamination
from loreline.llm.divergence import source_divergence
from loreline.llm.fill_middle import fill_in_middle, restored
from loreline.llm.html_extract import extract_html
from loreline.llm.jaccard_join import near_duplicates
from loreline.llm.license_scan import scan_licenses
from loreline.llm.lsh_forest import forest_duplicates
from loreline.llm.mixing import LANG_TARGETS, lang_labels, mix_sources
from loreline.llm.quality import score_quality
from loreline.llm.substring_dedup import substring_dedup
from loreline.llm.suffix_dedup import suffix_dedup
from loreline.llm.topk import top_k
from loreline.llm.toxicity import score_toxicity



def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and a benchmark item that it holds."""
    return find_contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses that documents name: doc_id, license, containment, start_word, n_words."""
    return scan_licenses(_read(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity of every document: doc_id, severity, grade, toxic."""
    return score_toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    labels = _read(spark, sf_dir, "labels").filter(~held_out)
    scored = score_quality(_read(spark, sf_dir, "documents"), labels)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_html(_read(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate of every document in a mixture by language: doc_id, n_words, domain, posterior, rate, copies."""
    docs = _read(spark, sf_dir, "documents")
    return mix_sources(docs, lang_labels(docs, _read(spark, sf_dir, "labels")), LANG_TARGETS)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup(_read(spark, sf_dir, "documents"), window=13)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


_OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, list_aggregate(w[i:i + 12], 'string_agg', ' ') AS s FROM d, LATERAL (SELECT unnest(range(1, len(w) - 11)) AS i) t),
first_of AS (SELECT s, min(doc_id) AS least FROM win GROUP BY s),
hit AS (SELECT win.doc_id, win.i FROM win JOIN first_of USING (s) WHERE first_of.least < win.doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM hit),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS k FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY k) AS t FROM word ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id),
cnt AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(cnt.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN cnt USING (doc_id)
"""


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup(_read(spark, sf_dir, "documents"), length=50)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document: doc_id, n_shingles, component_id."""
    return near_duplicates(_read(spark, sf_dir, "documents"), width=5, percent=80)


_OP9_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM d, LATERAL (SELECT unnest(range(1, greatest(len(w) - 3, 2))) AS i) t WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
rare AS (SELECT s FROM sh GROUP BY s HAVING count(*) > 1),
sh2 AS (SELECT sh.* FROM sh SEMI JOIN rare USING (s)),
inter AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh2 x JOIN sh2 y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
link AS (SELECT a, b FROM inter JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, comp.component_id FROM d LEFT JOIN n USING (doc_id) JOIN comp USING (doc_id)
"""


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 highest integer inner products of every 50th vector: query_id, rank, vec_id, score."""
    return top_k(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


_OP10_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 5
"""


def op11_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document by 2-word shingles: doc_id, n_shingles, component_id, kept."""
    return forest_duplicates(_read(spark, sf_dir, "documents"), width=2, percent=80)


_OP11_SQL = (_OP9_SQL.replace("array_to_string(w[i:i + 4], ' ')", "array_to_string(w[i:i + 1], ' ')").replace("greatest(len(w) - 3, 2)", "greatest(len(w), 2)")
             .replace("comp.component_id FROM", "comp.component_id, d.doc_id = comp.component_id AS kept FROM"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text cut at its own two places: doc_id, n, form, prefix_chars, middle_chars, and digests of the output and of the text rebuilt from it."""
    made = fill_in_middle(_read(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))


_OP12_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
      CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
x AS (SELECT *, substring(t, 1, a) AS pre, substring(t, a + 1, b - a) AS mid, substring(t, b + 1) AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM x
"""


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of every source from the others of its language, and its own terms: lang, source, part, item, value, rank."""
    return source_divergence(_read(spark, sf_dir, "documents"), min_docs=3, top=200)


_OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, translate(unnest(w), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
tot AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY g.lang, g.source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 1)) // (tot.total + v.v) AS p
      FROM g JOIN k USING (lang) JOIN tot USING (lang, source) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
lp AS (SELECT lang, term, 1 + (CAST(1000000000 AS HUGEINT) * (sum(n) + 1)) // (any_value(l.total) + any_value(v.v)) AS q
       FROM c JOIN (SELECT lang, sum(total) AS total FROM tot GROUP BY lang) l USING (lang) JOIN v USING (lang) GROUP BY lang, term),
pr AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pall AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pr.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pr ON pr.lang = a.lang AND pr.source = a.source AND pr.item = b.source),
tm AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, (p.p - lp.q) * (p.p - lp.q) // lp.q AS value FROM p JOIN lp USING (lang, term) WHERE p.n > 0 AND p.p > lp.q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS k FROM (FROM pall UNION ALL FROM tm))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(k AS INTEGER) AS rank FROM r WHERE part = 'pair' OR k <= 200
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from corpus_pipeline import run

    return {"pipeline": run} | {f.__name__: f for f in (op1_decontamination, op2_license_scan, op3_toxicity, op4_quality, op5_html_extraction, op6_substring_dedup, op7_suffix_dedup, op8_mixing, op9_jaccard_join, op10_topk, op11_lsh_forest, op12_fill_in_middle, op13_source_divergence)}


def oracle_sql() -> dict[str, str]:
    from corpus_pipeline import ORACLE_SQL

    return ({"pipeline": ORACLE_SQL} if ORACLE_SQL else {}) | {"op6_substring_dedup": _OP6_SQL, "op9_jaccard_join": _OP9_SQL, "op10_topk": _OP10_SQL, "op11_lsh_forest": _OP11_SQL, "op12_fill_in_middle": _OP12_SQL, "op13_source_divergence": _OP13_SQL}
