"""The numbered queries over the text tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .collocations import collocations
from .decontaminate import contaminated
from .exact_dedup import grace_dedup
from .jaccard_join import jaccard_components
from .language_id import language_id
from .licenses import BETWEEN, MENTION, TELLING, TEMPLATES, WORD, licence_scan
from .line_dedup import dedup_lines
from .lm_scoring import lm_scores
from .packing import best_fit_packing
from .pii import digest, personal_data
from .secrets import labelled_findings, secret_scan
from .simhash import simhash_components
from .whitening import whitened


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(_documents(spark, sf_dir)).select("doc_id", "n_lines", "n_dropped", "text")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(_documents(spark, sf_dir))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(personal_data(_documents(spark, sf_dir)))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(_documents(spark, sf_dir))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(_documents(spark, sf_dir), added=True).drop("ids")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no paths: a document's source and language stand for its folder."""
    docs = _documents(spark, sf_dir).withColumn("path", F.concat_ws("/", "source", "lang"))
    return secret_scan(docs, labelled_findings(spark), path_col="path")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(_documents(spark, sf_dir))


def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no paths: each lies in a folder by source and language, and every twentieth is
    taken for the folder's licence file, so that what those say is inherited."""
    docs = _documents(spark, sf_dir)
    name = F.when(F.col("doc_id") % 20 == 0, F.concat(F.lit("LICENSE."), F.col("doc_id").cast("string"))).otherwise(F.col("doc_id").cast("string"))
    return licence_scan(docs.withColumn("path", F.concat_ws("/", "source", "lang", name)))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grace_dedup(_documents(spark, sf_dir))


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_documents(spark, sf_dir))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_documents(spark, sf_dir))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: All pairs of distinct lines of 16 characters or more and like length; a third of one without an edit lies in the other. DuckDB counts edits in bytes,
#: so each accented letter of the tables is first made one control character.
OP1_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
f AS (SELECT line, min((doc_id, pos)) AS first, length(line) AS n, translate(line, 'ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü', PLAIN) AS bytes FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY line),
near AS (SELECT DISTINCT x.line FROM f x JOIN f y ON x.n - y.n BETWEEN -2 AND 2 AND y.first < x.first AND x.n >= 16 AND y.n >= 16
         WHERE CASE WHEN contains(y.line, x.line[1:x.n // 3]) OR contains(y.line, x.line[x.n // 3 + 1:x.n // 3 * 2]) OR contains(y.line, x.line[x.n // 3 * 2 + 1:])
                    THEN levenshtein(x.bytes, y.bytes) <= 2 ELSE false END),
j AS (SELECT l.doc_id, l.pos, l.line, f.line IS NOT NULL AND ((l.doc_id, l.pos) <> f.first OR near.line IS NOT NULL) AS gone
      FROM l LEFT JOIN f ON l.line = f.line LEFT JOIN near ON l.line = near.line),
d AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text FROM j GROUP BY doc_id)
SELECT o.doc_id, coalesce(d.n_lines, 0) AS n_lines, coalesce(d.n_dropped, 0) AS n_dropped, CASE WHEN o.text IS NULL THEN NULL ELSE d.text END AS text
FROM documents o LEFT JOIN d USING (doc_id)
""".replace("PLAIN", " || ".join(f"chr({k})" for k in [*range(1, 9), *range(14, 27)]))

#: Exact containment of five-word shingles, without any sketch.
OP7_SQL = r"""
WITH b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
bs AS (SELECT DISTINCT item_id, k, s FROM (SELECT item_id, least(5, len(w)) AS k, unnest(list_transform(range(1, greatest(2, len(w) - 3)), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM b WHERE len(w) > 0)),
ds AS (SELECT DISTINCT doc_id, k, s FROM (SELECT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s FROM d JOIN (SELECT DISTINCT k FROM bs) ON len(w) >= k)),
n AS (SELECT item_id, count(*) AS item_shingles FROM bs GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS shared, any_value(item_shingles) AS item_shingles, count(*) / any_value(item_shingles) AS containment
FROM ds JOIN bs USING (k, s) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING count(*) >= 0.8 * any_value(item_shingles)
"""

def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _op9_sql() -> str:
    """Term weights from the templates' texts; sentences that mention a licence, their parts, and whole
    licence files against them; then the best of the folder, or of the one above."""
    given = ", ".join(f"({k}, {_quoted(n)}, {_quoted(t)})" for k, (n, t) in enumerate(TEMPLATES))
    parts = r"list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), chr(10)), lambda s: regexp_matches(s, 'MENTION'))".replace("MENTION", MENTION)
    cut = f"unnest(list_distinct(list_concat([s], string_split_regex(s, '{BETWEEN}'))))"
    tells = ", ".join(f"'{w}'" for w in TELLING)
    told = f"list_distinct(list_filter(bag, lambda x: x IN ({tells})))"
    return f"""
WITH tt AS (SELECT * FROM (VALUES {given}) AS t(template, licence, text)), tb AS (SELECT template, licence, regexp_extract_all(lower(text), '{WORD}') AS bag FROM tt), tk AS (SELECT template, licence, {told} AS tells FROM tb),
tw AS (SELECT template, word, count(*) AS c FROM (SELECT template, unnest(bag) AS word FROM tb) GROUP BY ALL), df AS (SELECT word, ln((1 + (SELECT count(*) FROM tt)) / (1 + count(*))) + 1 AS idf FROM tw GROUP BY word),
tn AS (SELECT template, sqrt(sum((c * idf) ^ 2)) AS norm FROM tw JOIN df USING (word) GROUP BY template), t AS (SELECT template, word, c * idf / norm AS weight, idf FROM tw JOIN df USING (word) JOIN tn USING (template)),
d AS (SELECT doc_id, text, concat_ws('/', source, lang) AS folder, doc_id % 20 = 0 AS file FROM documents),
s AS (SELECT doc_id, {cut} AS s, false AS whole FROM (SELECT doc_id, unnest({parts}) AS s FROM d) UNION ALL SELECT doc_id, text, true FROM d WHERE file),
bags AS (SELECT doc_id, row_number() OVER () AS k, whole, regexp_extract_all(lower(s), '{WORD}') AS bag FROM s),
w AS (SELECT doc_id, k, whole, telling, word, count(*) AS n FROM (SELECT doc_id, k, whole, {told} AS telling, unnest(bag) AS word FROM bags) GROUP BY ALL),
norms AS (SELECT k, sqrt(sum((n * coalesce(idf, ln(1 + (SELECT count(*) FROM tt)) + 1)) ^ 2)) AS norm FROM w LEFT JOIN df USING (word) GROUP BY ALL),
dots AS (SELECT doc_id, k, whole, template, licence, tells, sum(n * idf * weight) AS dot FROM w JOIN t USING (word) JOIN tk USING (template) WHERE list_has_all(telling, tells) GROUP BY ALL),
cand AS (SELECT doc_id, k, whole, licence, tells, dot / norm AS score FROM dots JOIN norms USING (k) WHERE dot / norm >= 0.6),
best AS (SELECT doc_id, whole, licence, round(max(score), 6) AS score FROM cand c WHERE NOT EXISTS (SELECT 1 FROM cand o WHERE o.k = c.k AND o.licence <> c.licence AND list_has_all(o.tells, c.tells) AND len(o.tells) > len(c.tells)) GROUP BY ALL),
own AS (SELECT doc_id, min((NOT whole, -score, licence)) AS m, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences FROM best GROUP BY doc_id),
given AS (SELECT folder, min((m[2], m[3])) AS g FROM own JOIN d USING (doc_id) WHERE file GROUP BY folder),
up AS (SELECT d.doc_id, coalesce(a.g, b.g, c.g) AS g FROM d LEFT JOIN given a ON a.folder = d.folder LEFT JOIN given b ON contains(d.folder, '/') AND b.folder = string_split(d.folder, '/')[1] LEFT JOIN given c ON c.folder = '')
SELECT doc_id, coalesce(m[3], g[2]) AS licence, coalesce(licences, g[2]) AS licences, coalesce(-m[2], -g[1]) AS score,
       CASE WHEN m IS NOT NULL THEN CASE WHEN m[1] THEN 'header' ELSE 'file' END WHEN g IS NOT NULL THEN 'directory' END AS origin
FROM d LEFT JOIN own USING (doc_id) LEFT JOIN up USING (doc_id)
"""


#: Shared shingles of all pairs, then what links reach.
OP11_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(2, len(w) - 3)), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM d WHERE len(w) > 0), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)
"""

OP12_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
j AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: {'g': array_to_string(w[i:i + k - 1], ' '), 'h1': w[i], 't1': array_to_string(w[i + 1:i + k - 1], ' '), 'h2': array_to_string(w[i:i + 1], ' '), 't2': w[i + k - 1]})) AS j FROM w, (VALUES (1), (2), (3)) AS t(k) WHERE len(w) >= k),
g AS (SELECT lang, k, j.g AS g, j.h1 AS h1, j.t1 AS t1, j.h2 AS h2, j.t2 AS t2 FROM j),
f AS (SELECT lang, g, lang || chr(10) || g AS key, any_value(k) AS k, count(*) AS f, any_value(h1) AS h1, any_value(t1) AS t1, any_value(h2) AS h2, any_value(t2) AS t2 FROM g GROUP BY lang, g), n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE k > 1 AND f >= 10),
parts AS (SELECT lang, g, key, f AS a, 1 AS cut, lang || chr(10) || h1 AS h, lang || chr(10) || t1 AS t FROM c UNION ALL SELECT lang, g, key, f, 2, lang || chr(10) || h2, lang || chr(10) || t2 FROM c WHERE k = 3),
cuts AS (SELECT p.lang, p.g, p.key, a, cut, x.f AS l, y.f AS r, ((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f))::BIGINT AS score FROM parts p JOIN f x ON x.key = p.h JOIN f y ON y.key = p.t),
best AS (SELECT lang, g, key, min((score, cut, a, l, r)) AS m FROM cuts GROUP BY ALL),
longer AS (SELECT lang || chr(10) || h2 AS key, max(f) AS a FROM c WHERE k = 3 GROUP BY 1 UNION ALL SELECT lang || chr(10) || t1, max(f) FROM c WHERE k = 3 GROUP BY 1),
inside AS (SELECT DISTINCT c.key FROM c JOIN longer o ON o.key = c.key WHERE c.k = 2 AND 100 * o.a >= 50 * c.f),
kept AS (SELECT lang, g AS phrase, m[3] AS a, m[4] AS l, m[5] AS r, m[1] AS score FROM best LEFT JOIN inside i ON i.key = best.key WHERE i.key IS NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""

OP10_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, coalesce(text, '') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256 FROM d JOIN g ON d.text = g.text
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_personal_data": op3_personal_data,
    "op4_simhash": op4_simhash,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_secret_scan": op6_secret_scan,
    "op7_decontamination": op7_decontamination,
    "op8_language_id": op8_language_id,
    "op9_licence_scan": op9_licence_scan,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_jaccard_join": op11_jaccard_join,
    "op12_collocations": op12_collocations,
    "op13_whitening": op13_whitening,
}
ORACLE_SQL: dict[str, str] = {"op1_line_dedup": OP1_SQL, "op7_decontamination": OP7_SQL, "op9_licence_scan": _op9_sql(), "op10_exact_dedup": OP10_SQL, "op11_jaccard_join": OP11_SQL, "op12_collocations": OP12_SQL}
