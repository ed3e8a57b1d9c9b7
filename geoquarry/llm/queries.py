"""The registered queries of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoquarry.llm.common import table
from geoquarry.llm.labelled import remainder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a query under a name, with the SQL that gives the same rows."""

    def register(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


URL_SQL = """
WITH rest AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
parsed AS (
  SELECT page_id, path,
         translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host
  FROM (SELECT page_id, regexp_extract(r, '^[^/?#]*', 0) AS h, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest)),
marks AS (SELECT doc_id, max(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels WHERE quality IS NOT NULL GROUP BY 1),
hosts AS (
  SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad,
         array_to_string(list_slice(string_split(host, '.'), greatest(len(string_split(host, '.')) - 1, 1), len(string_split(host, '.'))), '.') AS domain,
         string_split(host, '.')[len(string_split(host, '.'))] AS suffix
  FROM parsed LEFT JOIN marks ON page_id = doc_id GROUP BY host),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY 1, 2),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY 1),
whole AS (SELECT sum(n) AS n, sum(bad) AS bad FROM suffixes),
spreads AS (
  SELECT level, CASE WHEN b > 0 THEN least(greatest((s - a) / b, 1e-4), 0.99) ELSE 1e-4 END AS rho
  FROM (
    SELECT level, sum(n * pow(bad / n - m, 2.0)) AS s, sum(m * (1 - m) * (1 - n / pn)) AS a,
           sum(m * (1 - m) * (1 - n / pn) * (n - 1)) AS b
    FROM (
      SELECT 1 AS level, c.n::DOUBLE AS n, c.bad::DOUBLE AS bad, p.n::DOUBLE AS pn, p.bad::DOUBLE / p.n AS m FROM suffixes c, whole p WHERE c.n > 0
      UNION ALL
      SELECT 2, c.n, c.bad, p.n, p.bad::DOUBLE / p.n FROM domains c JOIN suffixes p USING (suffix) WHERE c.n > 0
      UNION ALL
      SELECT 3, c.n, c.bad, p.n, p.bad::DOUBLE / p.n FROM hosts c JOIN domains p ON c.domain = p.domain WHERE c.n > 0)
    GROUP BY level)),
weights AS (SELECT coalesce(max(CASE WHEN level = 1 THEN (1 - rho) / rho END), 9999.0) AS w1,
                   coalesce(max(CASE WHEN level = 2 THEN (1 - rho) / rho END), 9999.0) AS w2,
                   coalesce(max(CASE WHEN level = 3 THEN (1 - rho) / rho END), 9999.0) AS w3 FROM spreads),
m1 AS (SELECT s.suffix, (s.bad + w1 * ((whole.bad + 0.5) / (whole.n + 1.0))) / (s.n + w1) AS m FROM suffixes s, whole, weights),
m2 AS (SELECT d.domain, (d.bad + w2 * m1.m) / (d.n + w2) AS m FROM domains d JOIN m1 USING (suffix), weights),
m3 AS (SELECT h.host, h.n + w3 AS t, (h.bad + w3 * m2.m) / (h.n + w3) AS m FROM hosts h JOIN m2 USING (domain), weights),
known AS (SELECT host, m - 1.64 * sqrt(m * t * (t - m * t) / (t * t * (t + 1))) AS bound FROM m3),
rules(rule, above, start, verdict) AS (VALUES ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
  ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')),
fits AS (
  SELECT host, path, max(struct_pack(l := length(rule), rule := rule, verdict := verdict)) AS f
  FROM (SELECT DISTINCT host, path FROM parsed) p JOIN rules ON (host = above OR ends_with(host, '.' || above)) AND starts_with(path, start)
  GROUP BY host, path)
SELECT page_id, p.host, p.path, f.rule AS rule,
       coalesce(f.verdict, CASE WHEN bound > 0.25 THEN 'block' ELSE 'allow' END) AS verdict
FROM parsed p LEFT JOIN known USING (host) LEFT JOIN fits ON fits.host = p.host AND fits.path = p.path"""


@query("op4_url_filter", URL_SQL)
def op4_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Judge every page's URL by rules, then by its host's shrunk share of low-quality labels."""
    from geoquarry.llm.url_filter import judge

    labels = table(spark, folder, "labels")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), (F.col("quality") == 0).alias("bad"))
    return judge(table(spark, folder, "pages"), outcomes).select("page_id", "host", "path", "rule", "verdict")


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 12))::BIGINT AS place
  FROM documents),
s AS (
  SELECT source, source_size, [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)]::DOUBLE AS weight
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source)),
r AS (
  SELECT *, 2.0 * source_size AS cap, 1.5 * sum(source_size) OVER ()::DOUBLE AS whole,
         coalesce(sum(2.0 * source_size) OVER (ORDER BY 2.0 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS given,
         sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY 2.0 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weights
  FROM s),
f AS (SELECT *, cap * weights <= (whole - given) * weight AS is_full FROM r),
t AS (
  SELECT source, source_size,
         CASE WHEN is_full THEN cap ELSE (whole - coalesce(sum(CASE WHEN is_full THEN cap END) OVER (), 0)) * weight
              / (sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ()) END::DOUBLE AS target
  FROM f),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies FROM t),
c AS (
  SELECT d.doc_id, d.size, b.source_size, b.target, b.copies, b.target - b.copies * b.source_size AS budget,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY place) AS upto,
         sum(d.size) OVER (PARTITION BY d.source, place) AS inside
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * (copies + CASE WHEN budget > 0 AND (upto < budget OR (upto - inside < budget AND upto - budget <= budget - (upto - inside)))
                             THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c"""


@query("op8_mixing", MIX_SQL)
def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Mix all documents to the weights 5, 2, 1 of their sources."""
    from geoquarry.llm.mixing import mix

    return mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Score every document for toxicity; labels of one fifth of the ids are held out."""
    from geoquarry.llm.toxicity import fit_toxicity, toxicity

    docs = table(spark, folder, "documents")
    model = fit_toxicity(docs, table(spark, folder, "labels").filter(remainder(5) != 0))
    return toxicity(docs, model).select(
        "doc_id",
        F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
    )


@query("op3_byte_bpe")
def op3_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Encode every document by the public ranks and decode the ids again, as digests."""
    from geoquarry.llm.byte_bpe import bpe_digests

    return bpe_digests(table(spark, folder, "documents"))


@query("op5_quality")
def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Score every document for quality; labels of one quarter of the ids are held out."""
    from geoquarry.llm.quality import fit_quality, quality

    docs = table(spark, folder, "documents")
    model = fit_quality(docs, table(spark, folder, "labels").filter(remainder(4) != 2))
    return quality(docs, model).select(
        "doc_id",
        F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= 0.7).cast("int").alias("predicted"),
    )


@query("op7_fingerprints")
def op7_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint every document and an edited copy, compare it with its neighbour, and find its near copies."""
    from geoquarry.llm.fingerprints import with_next

    return with_next(table(spark, folder, "documents"))


JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS h FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS d, doc_id AS c FROM documents UNION SELECT reach.d, edges.b FROM reach JOIN edges ON edges.a = reach.c)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least_id AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT d, min(c) AS least_id FROM reach GROUP BY 1) ON d = w.doc_id"""


@query("op1_ngram_jaccard", JACCARD_SQL)
def op1_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """Find the near-duplicate component of every document by sets of four words."""
    from geoquarry.llm.ngram_join import Likeness, jaccard_components

    return jaccard_components(table(spark, folder, "documents"), Likeness(4, 85))


@query("op9_substring_dedup")
def op9_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Cut out every window of 50 words that an earlier document has, as digests."""
    from geoquarry.llm.substring_dedup import kept_digests

    return kept_digests(table(spark, folder, "documents"))


@query("op6_embedding_dedup")
def op6_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Link all vectors of cosine 0.95 or more."""
    from geoquarry.llm.embedding_dedup import near_vectors

    return near_vectors(table(spark, folder, "embeddings"))


@query("op2_html_extraction")
def op2_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """Extract the main text of every page."""
    from geoquarry.llm.html_extraction import extracted

    return extracted(table(spark, folder, "pages"))


@query("op11_secret_scan")
def op11_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Find secrets in every document, by patterns and by formats learned from what the patterns find."""
    from geoquarry.llm.secret_scan import KINDS, learn_formats, secret_spans

    docs = table(spark, folder, "documents")
    base = F.filter("secrets", lambda span: span["kind"].isin(KINDS))

    def of(kind: str) -> F.Column:
        return F.size(F.filter("secrets", lambda span: span["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    def joined(spans: F.Column) -> F.Column:
        return F.array_join(F.transform(spans, lambda span: F.concat_ws(":", span["kind"], span["start"], span["end"])), ",")

    return secret_spans(docs, learn_formats(docs)).select(
        "doc_id",
        *(of(kind) for kind in KINDS),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
    )


@query("op12_whitening")
def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Whiten all vectors and return their first four components."""
    from geoquarry.llm.whitening import whitened

    return whitened(table(spark, folder, "embeddings"))


TRIE_SQL = r"""
WITH c AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
n AS (
  SELECT c, max(pos) AS turns, c - c % 5 AS head,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
             lambda crc, b: list_reduce([xor(crc, b), 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT],
               lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)), 4294967295::BIGINT) % 9 AS h
  FROM c GROUP BY c),
built AS (
  SELECT n.c, 1 AS part, c.pos, c.role, c.text FROM n JOIN c ON c.c = n.head WHERE c.pos <= n.h
  UNION ALL SELECT n.c, 2, c.pos, c.role, c.text FROM n JOIN c ON c.c = n.c WHERE c.pos > n.h),
deep AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, pos) AS d, role, text FROM built),
lists AS (SELECT n.c, coalesce(list({'r': role, 't': text} ORDER BY d) FILTER (WHERE d IS NOT NULL), []) AS turns FROM n LEFT JOIN deep USING (c) GROUP BY n.c),
paths AS (SELECT c, len(turns) AS whole, d, md5(d || ':' || list_slice(turns, 1, d)::VARCHAR) AS k, md5((d - 1) || ':' || list_slice(turns, 1, d - 1)::VARCHAR) AS up,
                 CASE WHEN d > 0 THEN strlen(turns[d].t) ELSE 0 END AS size
          FROM (SELECT c, turns, unnest(range(0, len(turns) + 1)) AS d FROM lists)),
nodes AS (SELECT k, d, min(c) AS conv_id, max(up) AS up, count(*) AS n_convs, max(size) AS size,
                 sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE whole = d), '')) AS ends_sha256 FROM paths GROUP BY k, d),
kids AS (SELECT up AS k, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
facts AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids USING (k)),
below AS (SELECT a.k, sum((f.n_convs - 1) * f.size) AS saved, count(*) FILTER (WHERE f.n_children = 0) AS leaves
          FROM facts f JOIN paths p ON p.k = f.k AND p.c = f.conv_id JOIN paths a ON a.c = p.c AND a.d <= p.d GROUP BY a.k)
SELECT f.conv_id, f.d::BIGINT AS depth, CASE WHEN f.d > 0 THEN o.conv_id END AS parent_conv_id, f.n_convs::BIGINT AS n_convs,
       f.n_children::BIGINT AS n_children, below.leaves::BIGINT AS n_leaves, below.saved::BIGINT AS saved_tokens, f.ends_sha256
FROM facts f JOIN below USING (k) LEFT JOIN nodes o ON o.k = f.up"""


@query("op13_prefix_trie", TRIE_SQL)
def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Rebuild all conversations and describe every distinct prefix of them."""
    from geoquarry.llm.prefix_trie import prefix_trie

    return prefix_trie(table(spark, folder, "conversations"))
