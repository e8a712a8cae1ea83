"""The registered queries of this subpackage and their SQL where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import ann, bpe, centroids, decontaminate, html, minhash, ngram_join, phrases, quality, secrets, substring, tokenfiles, warc
from cohortlens.storage import new_path, ship


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file: under $TOKENIZER_DIR, else where the installed package has it."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), decode=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids_le", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fitted(docs, table(spark, sf_dir, "labels"))
    out = quality.scored(docs, model)
    return out.select("doc_id", quality.in_fold("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("coverage", 9).alias("coverage"), "n_tiles")


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked(table(spark, sf_dir, "documents"), words=4, percent=85)


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extracted(table(spark, sf_dir, "pages"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), folder, every=True)
    return warc.read(spark, folder).select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "token-files")
    tokenfiles.write(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), folder)
    return tokenfiles.read(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids_le").alias("ids_crc32"))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "utf-8"), 256).alias("kept_sha256"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.findings(table(spark, sf_dir, "documents"), secrets.trained())
    return found.select("doc_id", "kind", "start", "end", F.sha2("secret", 256).alias("secret_sha256"), F.round("score", 9).alias("score"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.with_inertia(*centroids.clustered(table(spark, sf_dir, "embeddings"), k=40, rounds=5, dims=64, scale=256))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.linked(table(spark, sf_dir, "documents"), words=4, percent=80)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), least=30, most=2000)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_quality": op2_quality,
    "op3_decontamination": op3_decontamination,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_html_text": op5_html_text,
    "op6_warc": op6_warc,
    "op7_token_files": op7_token_files,
    "op8_nearest": op8_nearest,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_secret_scan": op10_secret_scan,
    "op11_centroids": op11_centroids,
    "op12_minhash": op12_minhash,
    "op13_collocations": op13_collocations,
}

#: Words without upper-case A-Z, as SQL.
LOWER_WORDS = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"""

OP4_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {LOWER_WORDS} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 4 THEN array_to_string(ws, chr(31)) ELSE array_to_string(ws[i:i + 3], chr(31)) END AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT a AS node, b AS to_node FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.to_node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m.least_id, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT node AS doc_id, min(to_node) AS least_id FROM r GROUP BY node) m USING (doc_id)
"""

OP12_SQL = f"SELECT *, doc_id = component_id AS kept FROM ({OP4_SQL.replace('100 * c >= 85 *', '100 * c >= 80 *')}) q"

OP9_SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
k AS (SELECT doc_id, i, ws[i] AS word, CASE WHEN i + 34 <= len(ws) THEN md5(array_to_string(ws[i:i + 34], ' ')) END AS win FROM p),
c AS (SELECT doc_id, i, word, CASE WHEN win IS NOT NULL AND count(*) OVER (PARTITION BY win) > 1 THEN 1 ELSE 0 END AS dup FROM k),
g AS (SELECT doc_id, i, word, max(dup) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM c),
a AS (SELECT doc_id, count(*) AS n_words, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM g GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN a USING (doc_id)
"""

OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
s AS (SELECT page_id, html, strlen(html) AS payload_bytes FROM p),
m AS (SELECT page_id, html, payload_bytes, max(page_id) OVER (PARTITION BY html) AS last_id FROM s)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN payload_bytes >= 1000 AND last_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND last_id <> page_id THEN last_id END AS refers_to
FROM m
"""



def _lloyd_sql(k: int, rounds: int, dims: int, scale: int) -> str:
    """All rounds one after the other; centroids are lists, and a mean is rounded down exactly."""
    gap = "list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    near = lambda c: f"SELECT v.row, v.vec_id, v.x, arg_min({{'c': c.c, 'd': {gap}}}, {{'d': {gap}, 'c': c.c}}) AS b FROM v CROSS JOIN {c} c GROUP BY v.row, v.vec_id, v.x"
    steps = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda e: floor(e::DOUBLE * {scale})::BIGINT) AS x FROM embeddings
WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x FROM (SELECT sha256('2:' || vec_id) AS h, x FROM v WHERE vec_id IS NOT NULL ORDER BY h, x LIMIT {k}))",
    ]
    for r in range(rounds):
        steps += [
            f"a{r} AS MATERIALIZED ({near(f'c{r}')})",
            f"s{r} AS (SELECT b.c AS c, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM a{r}, (SELECT unnest(range(1, {dims + 1})) AS i) GROUP BY b.c, i)",
            f"m{r} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM s{r} GROUP BY c)",
            f"c{r + 1} AS MATERIALIZED (SELECT c, coalesce(m.x, o.x) AS x FROM c{r} o LEFT JOIN m{r} m USING (c))",
        ]
    last = f"f AS MATERIALIZED ({near(f'c{rounds}')})"
    return f"""WITH {', '.join([*steps, last])} SELECT vec_id, b.c::INT AS cluster, b.d AS distance, (sum(b.d) OVER (PARTITION BY b.c))::BIGINT AS cluster_inertia, (sum(b.d) OVER ())::BIGINT AS inertia,
sha256(array_to_string(o.x, ',')) AS centroid_sha256 FROM f JOIN c{rounds} o ON o.c = f.b.c"""


OP11_SQL = _lloyd_sql(40, 5, 64, 256)

OP13_SQL = """
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k))),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
x AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws, unnest(range(1, k)) AS cut FROM f WHERE k >= 2),
s AS (SELECT x.*, h.f AS l, t.f AS r, ((2000000::HUGEINT * a) // (h.f + t.f))::BIGINT AS score FROM x JOIN f h ON h.lang = x.lang AND h.phrase = array_to_string(ws[1:cut], ' ') JOIN f t ON t.lang = x.lang AND t.phrase = array_to_string(ws[cut + 1:], ' ')),
b AS (SELECT lang, phrase, k, a, arg_min({'l': l, 'r': r, 'score': score}, {'score': score, 'cut': cut}) AS c FROM s GROUP BY ALL),
i AS (SELECT lang, f, phrase AS longer, string_split(phrase, ' ') AS ws, k, unnest(range(2, k)) AS m FROM f WHERE k >= 3),
j AS (SELECT lang, f, array_to_string(ws[q:q + m - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, k - m + 2)) AS q FROM i)),
d AS (SELECT DISTINCT b.lang, b.phrase FROM b JOIN j USING (lang, phrase) WHERE 100::HUGEINT * j.f >= 80::HUGEINT * b.a),
o AS (SELECT lang, phrase, a, c.l AS l, c.r AS r, c.score AS score, row_number() OVER (PARTITION BY lang ORDER BY c.score DESC, a DESC, phrase) AS rank FROM b ANTI JOIN d USING (lang, phrase))
SELECT lang, rank, phrase, a, l, r, n, score FROM o JOIN n USING (lang) WHERE rank <= 2000
"""

SQL: dict[str, str] = {"op11_centroids": OP11_SQL, "op12_minhash": OP12_SQL, "op13_collocations": OP13_SQL, "op6_warc": OP6_SQL, "op4_ngram_jaccard": OP4_SQL, "op9_substring_dedup": OP9_SQL}
