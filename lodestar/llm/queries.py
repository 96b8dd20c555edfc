"""The registered queries of this package and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Rows in an Arrow batch: texts may be long, so batches stay small.
ARROW_ROWS = 512


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@_query(
    "op8_warc",
    """
    WITH base AS (
      SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
    kept AS (SELECT payload_digest, max(page_id) AS keeper FROM base WHERE payload_bytes >= 1000 GROUP BY 1)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN keeper IS NULL OR keeper = page_id THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN keeper <> page_id THEN keeper END AS refers_to
    FROM base LEFT JOIN kept USING (payload_digest)
    """,
)
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.llm import warc

    return warc.round_trip(spark, _table(spark, sf_dir, "pages"))


@_query("op3_sentencepiece")
def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lodestar.llm import pieces

    return pieces.encode_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@_query("op4_packing")
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lodestar.llm import packing

    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@_query("op7_quality")
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.llm import lm_quality

    return lm_quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query("op10_fingerprints")
def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.llm import fingerprints

    return fingerprints.with_neighbours(_table(spark, sf_dir, "documents"))


@_query("op2_pii")
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.llm import pii

    return pii.digests(pii.find(_table(spark, sf_dir, "documents")))


@_query("op5_licenses")
def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.llm import licenses

    return licenses.find(_table(spark, sf_dir, "documents"))


@_query("op9_lines")
def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.llm import lines

    return lines.dedup(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_kept", "text")


@_query("op1_ngram_join")
def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.llm import ngram_join

    return ngram_join.join(_table(spark, sf_dir, "documents"))


@_query(
    "op6_topk",
    """
    WITH words AS (
      SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+')) AS term FROM documents),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
    len AS (SELECT d.doc_id, coalesce(sum(tf), 0) AS len FROM documents d LEFT JOIN tf USING (doc_id) GROUP BY 1),
    stat AS (SELECT count(*) AS n, avg(len) AS mean FROM len),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
    gain AS (
      SELECT q.doc_id AS query_id, t.doc_id,
             round(sum(q.tf * ln(1 + (n - df + 0.5) / (df + 0.5)) * t.tf * 2.2 / (t.tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score
      FROM tf q JOIN tf t USING (term) JOIN df USING (term) JOIN len ON len.doc_id = t.doc_id, stat
      WHERE q.doc_id % 100 = 0 GROUP BY ALL)
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
    FROM gain QUALIFY rank <= 10
    """,
)
def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from lodestar.llm import topk

    docs = _table(spark, sf_dir, "documents")
    return topk.search(docs, docs.where(F.col("doc_id") % 100 == 0), order="lang")


@_query(
    "op13_spelling",
    r"""
    WITH runs AS (
      SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
    counted AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY ALL),
    hashed AS (
      SELECT run, n, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(octet_length(bytes)::BIGINT), lambda i: ('0x' || substr(hex(bytes), 2 * i + 1, 2))::BIGINT)),
        lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, i: xor(r >> 1, 3988292384 * (r & 1))))) AS h
      FROM (SELECT *, encode(coalesce(doc_id::VARCHAR, '') || ':' || run) AS bytes FROM counted)),
    words AS (
      SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(n)::BIGINT AS n
      FROM hashed GROUP BY 1 HAVING sum(n) >= 5 AND length(word) >= 6),
    cut AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
    pairs AS (
      SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
      UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
      UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
    best AS (SELECT word, count(*) AS n_near, max(near_n) AS near_n, arg_min(near, (-near_n, near)) AS near FROM pairs GROUP BY 1),
    forms AS (
      SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * n THEN near END AS form, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n
      FROM words w LEFT JOIN best USING (word)),
    chain AS (
      WITH RECURSIVE step(word, root) AS (SELECT word, word FROM forms UNION ALL SELECT s.word, f.form FROM step s JOIN forms f ON f.word = s.root WHERE f.form IS NOT NULL)
      SELECT s.word, s.root FROM step s JOIN forms f ON f.word = s.root WHERE f.form IS NULL)
    SELECT word, form, root, n, n_near, form_n FROM forms JOIN chain USING (word)
    """,
)
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.llm import spelling

    return spelling.group(_table(spark, sf_dir, "documents"))


@_query(
    "op12_trie",
    r"""
    WITH coded AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
    own AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(octet_length(encode(role)) || ':' || role || text)) AS i FROM coded),
    convs AS (
      SELECT c AS conv_id, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
        lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, k: xor(r >> 1, 3988292384 * (r & 1))))) % 6 AS h
      FROM (SELECT DISTINCT conv_id AS c FROM own)),
    built AS (
      SELECT c.conv_id, o.i, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.conv_id - c.conv_id % 100 AND o.i <= h
      UNION ALL SELECT c.conv_id, o.i, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.i > h),
    steps AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS depth, md5(octet_length(encode(role)) || ':' || role || text) AS code, length(text) AS chars FROM built),
    paths AS (
      SELECT conv_id, depth, chars, md5(string_agg(code, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS path FROM steps
      UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
    linked AS (SELECT *, lag(path) OVER (PARTITION BY conv_id ORDER BY depth) AS above, lead(path) OVER (PARTITION BY conv_id ORDER BY depth) IS NULL AS last FROM paths),
    nodes AS (
      SELECT path, any_value(above) AS above, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
             sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256, bool_and(last) AS leaf
      FROM linked GROUP BY path),
    sums AS (
      SELECT p.path, count(*) FILTER (n.leaf) AS n_leaves, sum((n.n_convs - 1) * n.chars) AS saved
      FROM nodes n JOIN paths p ON p.conv_id = n.conv_id AND p.depth <= n.depth GROUP BY 1),
    children AS (SELECT above AS path, count(*) AS n FROM nodes GROUP BY 1)
    SELECT n.conv_id, n.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, s.n_leaves, s.saved::BIGINT AS saved_tokens, n.ends_sha256
    FROM nodes n JOIN sums s USING (path) LEFT JOIN children c USING (path) LEFT JOIN nodes up ON up.path = n.above
    """,
)
def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.llm import trie

    return trie.prefix_trie(_table(spark, sf_dir, "conversations"))


@_query(
    "op11_minhash",
    r"""
    WITH split AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    sets AS (
      SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1:i + 5], ' ')) END) AS s FROM split),
    posted AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
    links AS (
      SELECT a.doc_id AS a, b.doc_id AS b FROM posted a JOIN posted b USING (shingle)
      WHERE a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
    reached AS (
      WITH RECURSIVE reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
      SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
    SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN reached USING (doc_id)
    """,
)
def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.llm import minhash_join

    return minhash_join.near_groups(_table(spark, sf_dir, "documents"))
