"""Registered queries of the subpackage and the SQL that states their result, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import conversation_trie as ct
from veilframe.llm import dartminhash as dm
from veilframe.llm import decontaminate as dc
from veilframe.llm import hnsw, jaccard_join
from veilframe.llm import licenses
from veilframe.llm import line_dedup as ld
from veilframe.llm import packing, quality, secrets, source_audit
from veilframe.llm import token_shards as ts
from veilframe.llm import warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    manifest = ts.write_token_shards(table(spark, sf_dir, "documents"), path, end_id=1)
    return ts.read_token_shards(manifest)


@query()
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_warc(warc.write_warc(table(spark, sf_dir, "pages"))).drop("url", "archive")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query(
    f"""
    WITH d AS (SELECT row_number() OVER () AS u, doc_id, {_WORDS} AS w FROM documents),
    b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
    starts AS (SELECT item_id, w, least(10, len(w)) AS l, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM b WHERE len(w) > 0),
    bw AS (SELECT DISTINCT item_id, l, list_slice(w, s, s + l - 1) AS win FROM starts),
    lens AS (SELECT DISTINCT l FROM bw),
    places AS (SELECT u, w, l, unnest(range(1, len(w) - l + 2)) AS s FROM d, lens WHERE len(w) >= l),
    dw AS (SELECT u, l, s, list_slice(w, s, s + l - 1) AS win FROM places),
    hits AS (SELECT u, s, dw.l, item_id FROM dw JOIN bw ON dw.l = bw.l AND dw.win = bw.win),
    covered AS (SELECT u, unnest(range(s, s + l)) AS p FROM hits),
    n AS (SELECT u, count(DISTINCT p) AS n_hit FROM covered GROUP BY u),
    ids AS (SELECT DISTINCT u, CAST(item_id AS VARCHAR) AS id FROM hits),
    i AS (SELECT u, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM ids GROUP BY u)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN n USING (u) LEFT JOIN i USING (u)
    """
)
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dc.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("items_sha256", F.sha2(F.concat_ws(",", "items"), 256)).drop("items")


@query()
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query()
def op6_dartminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dm.near_duplicates(table(spark, sf_dir, "documents"))


@query(
    """
    WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS u, doc_id, text FROM documents),
    e AS (SELECT u, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS nr FROM d),
    f AS (SELECT u, line, nr, row_number() OVER (PARTITION BY u ORDER BY nr) AS j, row_number() OVER (ORDER BY u, nr) AS p
          FROM e WHERE trim(line, ' ') <> ''),
    w AS (SELECT a.u, a.j, a.p, a.line AS x, b.line AS y FROM f a JOIN f b ON a.u = b.u AND b.j = a.j + 1),
    later2 AS (SELECT u, j FROM (SELECT u, j, p, min(p) OVER (PARTITION BY x, y) AS o FROM w) WHERE p > o),
    later1 AS (SELECT u, j FROM (SELECT u, j, p, line, min(p) OVER (PARTITION BY line) AS o FROM f) WHERE p > o AND length(line) >= 20),
    gone AS (SELECT u, j FROM later2 UNION SELECT u, j + 1 FROM later2 UNION SELECT u, j FROM later1),
    marked AS (SELECT e.u, e.nr, e.line, f.j, g.u IS NOT NULL AS gone FROM e LEFT JOIN f ON e.u = f.u AND e.nr = f.nr LEFT JOIN gone g ON f.u = g.u AND f.j = g.j),
    texts AS (SELECT u, count(j) AS n_lines, count(*) FILTER (gone) AS n_deleted, string_agg(line, chr(10) ORDER BY nr) FILTER (NOT gone) AS text FROM marked GROUP BY u)
    SELECT doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(t.text, '') END AS text, CAST(coalesce(n_lines, 0) AS INTEGER) AS n_lines,
           CAST(coalesce(n_deleted, 0) AS INTEGER) AS n_deleted
    FROM d LEFT JOIN texts t USING (u)
    """
)
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ld.dedup_lines(docs, report=True).drop("longest_repeat")


@query()
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = ts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(counted, length=F.col("n_tokens"))


@query()
def op2_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    index = hnsw.build_index(vectors, k=5)
    return hnsw.search(index, vectors.where("vec_id % 50 = 0"), k=5)


@query()
def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    classifier = licenses.train(licenses.training_rows(spark, docs))
    return licenses.scan(docs, classifier).withColumn("families", F.concat_ws(",", "families"))


@query()
def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    letters = secrets.learn_letters(docs)
    model = secrets.train(secrets.labelled_findings(spark), letters)
    judged = secrets.judge(secrets.candidates(docs), letters, model)
    return judged.select("doc_id", "nr", F.length("value").alias("length"), F.sha2("value", 256).alias("value_sha256"), "probability", (F.col("probability") >= 0.5).alias("secret"))


# crc-32 of a decimal number, bit by bit
_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(8 * length(id)), lambda i: ((ascii(substr(id, i // 8 + 1, 1)) >> (i % 8)::INTEGER) & 1)::BIGINT)),
                lambda crc, b: xor(crc >> 1, (xor(crc, b) & 1) * 3988292384)), 4294967295::BIGINT)"""


@query(
    f"""
    WITH t AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS p,
                      strlen(coalesce(text, '')) AS s FROM conversations WHERE conv_id IS NOT NULL),
    own AS (SELECT c, c::VARCHAR AS id, list({{'p': p, 's': s}} ORDER BY turn IS NOT NULL, turn, role, p) AS x FROM t GROUP BY c),
    hs AS (SELECT c, x, {_CRC32} % 9 AS h FROM own),
    r AS (SELECT a.c, list_concat(CASE WHEN b.c IS NULL THEN [] ELSE b.x[1:a.h] END, a.x[a.h + 1:]) AS x FROM hs a LEFT JOIN hs b ON b.c = a.c - a.c % 5),
    m AS (SELECT c, len(x) AS n, d, list_transform(x[1:d], lambda e: e.p) AS path, CASE WHEN d > 0 THEN x[d].s ELSE 0 END AS s
          FROM (SELECT c, x, unnest(range(0, len(x) + 1)) AS d FROM r)),
    g AS (SELECT *, min(c) OVER (PARTITION BY d, path) AS node FROM m),
    nodes AS (SELECT node, d, count(*) AS n_convs, any_value(s) AS s, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '')) AS ends
              FROM g GROUP BY node, d),
    up AS (SELECT a.node, a.d, b.node AS parent FROM nodes a JOIN g b ON b.c = a.node AND b.d = a.d - 1),
    kids AS (SELECT parent, d - 1 AS d, count(*) AS n FROM up GROUP BY ALL),
    own_sums AS (SELECT x.node, x.d, (k.n IS NULL)::BIGINT AS leaf, (n_convs - 1) * s AS saved FROM nodes x LEFT JOIN kids k ON k.parent = x.node AND k.d = x.d),
    sums AS (SELECT a.node, a.d, sum(o.leaf)::BIGINT AS n_leaves, sum(o.saved)::BIGINT AS saved FROM own_sums o JOIN g a ON a.c = o.node AND a.d <= o.d GROUP BY a.node, a.d)
    SELECT x.node AS conv_id, x.d AS depth, u.parent AS parent_conv_id, x.n_convs, coalesce(k.n, 0) AS n_children, y.n_leaves, y.saved AS saved_tokens, x.ends AS ends_sha256
    FROM nodes x JOIN sums y USING (node, d) LEFT JOIN up u USING (node, d) LEFT JOIN kids k ON k.parent = x.node AND k.d = x.d
    """
)
def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ct.branched_trie(table(spark, sf_dir, "conversations"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')"


@query(
    f"""
    WITH d AS (SELECT row_number() OVER () AS u, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_TERMS} AS w FROM documents),
    e AS (SELECT u, lang, source, unnest(w) AS term FROM d),
    kept AS (SELECT lang, term FROM e GROUP BY lang, term HAVING count(DISTINCT u) >= 3),
    size AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
    c AS (SELECT lang, source, term, count(*) AS n FROM e JOIN kept USING (lang, term) GROUP BY lang, source, term),
    g AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY lang, source),
    p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 1)) // (total + v)::HUGEINT AS p
          FROM g JOIN size USING (lang) JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
    l AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term),
    q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang) + v)::HUGEINT AS q FROM l JOIN size USING (lang)),
    sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
             FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
              FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
    found AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM pairs UNION ALL FROM found))
    SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
    """
)
def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(table(spark, sf_dir, "documents"))


@query(
    r"""
    WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS u, doc_id,
                      regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT DISTINCT u, array_to_string(w[i:i + 2], ' ') AS x FROM (SELECT u, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
    n AS (SELECT u, count(*) AS n FROM s GROUP BY u),
    c AS (SELECT a.u AS a, b.u AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.u <> b.u GROUP BY a.u, b.u),
    l AS (SELECT a, b FROM c JOIN n x ON x.u = a JOIN n y ON y.u = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
    r AS (WITH RECURSIVE t(a, b) AS (SELECT a, b FROM l UNION SELECT t.a, l.b FROM t JOIN l ON l.a = t.b) SELECT a, min(b) AS b FROM t GROUP BY a)
    SELECT d.doc_id, coalesce(n, 0) AS n_shingles, (SELECT doc_id FROM d e WHERE e.u = least(d.u, coalesce(r.b, d.u))) AS component_id
    FROM d LEFT JOIN n USING (u) LEFT JOIN r ON r.a = d.u
    """
)
def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.linked(table(spark, sf_dir, "documents"))
