"""The ``opN_*`` queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.llm.url_filter import judge

    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    return judge(table(spark, sf_dir, "pages"), labels, URL_RULES).drop("mean")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.llm.exact_dedup import exact_groups

    groups = exact_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.llm.sharding import shard

    return shard(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidewell.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidewell.llm.bpe import encode

    coded = encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, decoded=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.llm.substring_dedup import remove_repeats

    kept = remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.llm.simhash import near_groups

    groups = near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.llm.pii import KINDS, find, shown

    found = find(table(spark, sf_dir, "documents"))

    def count(kind: int):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    sizes = [F.size("spans").cast("long").alias("n_spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_added")]
    return found.select("doc_id", *counts, F.sha2(shown(F.col("base")), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"), *sizes)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.llm.language_id import fit_sample, held_out, identify

    docs = table(spark, sf_dir, "documents")
    model = fit_sample(docs)
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(found).alias("held_out"), "lang_pred", "score")


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.llm.ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


QUERIES = (op1_packing, op2_pii, op3_url_filter, op4_prefix_bpe, op5_substring_dedup, op6_simhash, op7_exact_dedup, op8_language_id, op9_nearest, op10_sharding)


def queries():
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op10_sharding": _shard_sql(), "op3_url_filter": _url_sql(), "op5_substring_dedup": REPEATS_SQL, "op7_exact_dedup": EXACT_SQL, "op9_nearest": NEAREST_SQL}


EXACT_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id)
"""

NEAREST_SQL = """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
             AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
p AS (SELECT a.vec_id AS query_id, b.vec_id,
             sqrt(list_reduce(list_transform(range(1, len(a.v) + 1), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i])), lambda x, y: x + y)) AS score
      FROM e a JOIN e b ON a.vec_id <> b.vec_id AND a.vec_id % 100 = 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
WHERE rank <= 10
"""

REPEATS_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM w, unnest(range(1, len(ws) - 11)) AS t(i)),
low AS (SELECT k, min(doc_id) AS lo FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN low USING (k) WHERE lo < doc_id),
words AS (SELECT doc_id, p, ws[p] AS word FROM w, unnest(range(1, len(ws) + 1)) AS t(p)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""


def _url_sql() -> str:
    from tidewell.llm.url_filter import ADDRESS, GENERIC

    cases = sorted(URL_RULES, key=lambda r: (-len(r[0] + r[1]), -len(r[0])))
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h + p}'" for h, p, _ in cases) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for h, p, v in cases) + " END"

    def strength(children: str, parent: str) -> str:
        return f"""(SELECT (1 - rho) / rho AS m FROM (SELECT least(greatest(coalesce(CASE WHEN sum(den) > 0 THEN sum(num) / sum(den) END, 0), 0.0001), 0.99) AS rho FROM (
          SELECT pq - ps * p - p * (1 - p) * (k - 1) AS num, p * (1 - p) * (pn - pn2 / pn - (k - 1)) AS den FROM (
            SELECT sum(n) AS pn, sum(s) AS ps, sum(n * n) AS pn2, sum(s * s / n) AS pq, count(*) AS k, sum(s) / sum(n) AS p FROM {children} WHERE n > 0 GROUP BY {parent}))))"""

    return rf"""
WITH urls AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                      regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
parts AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*\z', '') AS site FROM urls),
good AS (SELECT doc_id AS page_id, max(quality) AS good FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
sites AS (SELECT *, regexp_matches(site, '{ADDRESS}') AS address, regexp_extract(site, '^.*\.((?:{GENERIC})\.[a-z]{{2}})\z', 1) AS two, string_split(site, '.') AS ls FROM (
  SELECT site, CAST(count(good) AS DOUBLE) AS n, CAST(coalesce(sum(good), 0) AS DOUBLE) AS s FROM parts LEFT JOIN good USING (page_id) GROUP BY site)),
hosts AS (SELECT site, n, s, 0 AS whole, CASE WHEN address THEN site WHEN two <> '' THEN two ELSE ls[-1] END AS suffix,
    CASE WHEN address THEN site ELSE array_to_string(ls[greatest(len(ls) - CASE WHEN two <> '' THEN 2 ELSE 1 END, 1):], '.') END AS domain FROM sites),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(s) AS s FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, 0 AS whole, sum(n) AS n, sum(s) AS s FROM domains GROUP BY ALL),
mu0 AS (SELECT (sum(s) + 1) / (sum(n) + 2) AS mu0 FROM suffixes),
mu1 AS (SELECT suffix, (s + m * mu0) / (n + m) AS mu1 FROM suffixes, mu0, {strength("suffixes", "whole")}),
mu2 AS (SELECT domain, (s + m * mu1) / (n + m) AS mu2 FROM domains JOIN mu1 USING (suffix), {strength("domains", "suffix")}),
beta AS (SELECT site, s + m * mu2 AS a, n - s + m * (1 - mu2) AS b FROM hosts JOIN mu2 USING (domain), {strength("hosts", "domain")}),
bound AS (SELECT site, a / (a + b) + 1.645 * sqrt(a / (a + b) * (b / (a + b)) / (a + b + 1)) AS upper FROM beta)
SELECT page_id, host, path, {rule} AS rule, coalesce({verdict}, CASE WHEN upper < 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM parts JOIN bound USING (site)
"""


def _shard_sql() -> str:
    from tidewell.llm.sharding import KEYS, PRIME

    def network(rows: str, x: str) -> str:
        """A pass of the network over column x of rows, as column y."""
        sql = f"(SELECT *, {x} // a AS l, {x} % a AS r FROM {rows})"
        for k in KEYS:
            p = f"((r + {k}) % {PRIME})"
            sql = f"(SELECT * EXCLUDE (l, r), r AS l, (l + {p} * {p} % {PRIME} * {p} % {PRIME}) % a AS r FROM {sql})"
        return f"(SELECT * EXCLUDE (l, r), l * a + r AS y FROM {sql})"

    # CRC-32 by half bytes, the low one of each byte first.
    table = []
    for c in range(16):
        for _ in range(4):
            c = c >> 1 ^ (3988292384 if c & 1 else 0)
        table.append(c)
    return f"""
WITH RECURSIVE digits AS (SELECT doc_id, string_split(hex(encode(coalesce(text, ''))), '') AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS bytes FROM documents),
halves AS (SELECT doc_id, bytes + 1 AS size, list_transform(range(2 * bytes), lambda k: CAST(instr('0123456789ABCDEF', h[k + 2 - 2 * (k % 2)]) - 1 AS BIGINT)) AS halves FROM digits),
sums AS (SELECT doc_id, size, xor(4294967295, list_reduce(halves, lambda c, x: xor(c >> 4, [{", ".join(f"{c}::BIGINT" for c in table)}][(xor(c, x) & 15) + 1]), 4294967295::BIGINT)) AS text_crc32 FROM halves),
numbered AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS x, count(*) OVER () AS n FROM sums),
sized AS (SELECT *, CAST(floor(sqrt(n - 1)) AS BIGINT) + 1 AS a FROM numbered),
walk AS (SELECT * FROM {network("sized", "x")} UNION ALL SELECT * EXCLUDE (z) FROM {network("(SELECT * EXCLUDE (y), y AS z FROM walk WHERE y >= n)", "z")})
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(y % 8 AS INTEGER) AS shard, y // 8 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM walk WHERE y < n
"""
