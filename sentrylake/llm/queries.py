"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, htmltext, langid, lm, merkle, packing, pii, secrets, sharding, simhash, urlfilter, whiten
from .util import crc_mod, table, work_dir

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents appended in sixteen arrivals, compacted, and read back from the committed manifest."""
    docs = table(spark, sf_dir, "documents")
    store = sharding.ShardStore(spark, work_dir(spark, "sharding"))
    store.append(docs, number=sharding.by_range(docs, "doc_id", 16))
    version = store.compact()["version"]
    return store.read(version).select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("text_sha256"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    words = secrets.dictionary(docs)
    model = secrets.train(secrets.labelled_findings(spark), words)
    found = secrets.scan(docs, model, path=F.col("source"), dictionary=words)
    return found.select(
        "doc_id", "ordinal", "start", F.length("candidate").cast("long").alias("length"),
        F.sha2("candidate", 256).alias("candidate_sha256"), "probability", "secret",
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, out = lm.fit(table(spark, sf_dir, "documents"), training=crc_mod(F.col("doc_id"), 7) != 2)
    return out.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), with_ids=False))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, training=crc_mod(F.col("doc_id"), 4) != 2)
    out = langid.identify(docs, model)
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


#: Host and path of each rule, joined, with its verdict.
URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.filter_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = decontaminate.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return judged.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.documents(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whiten(table(spark, sf_dir, "embeddings"))


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_secret_scan": op2_secret_scan,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_simhash": op4_simhash,
    "op5_pii": op5_pii,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_packing": op7_packing,
    "op8_language_id": op8_language_id,
    "op9_url_filter": op9_url_filter,
    "op10_decontaminate": op10_decontaminate,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_whitening": op12_whitening,
    "op13_html_extraction": op13_html_extraction,
    "pipeline": pipeline,
}



def _merkle_sql() -> str:
    """Trees, and folds of the received leaves, level by level by recursion: first in each source, then over the subroots."""
    part = lambda c: f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda t: "sha256(" + " || ".join(map(part, ["doc_id", "source", "lang", "n_chars", t])) + ")"
    # a bit a step; the first of each byte's takes the byte in. The last complement changes what is even
    x = "CASE WHEN j % 8 = 0 THEN xor(c, CAST(ascii(s[j // 8 + 1]) AS BIGINT)) ELSE c END"
    crc = f"xor(4294967295, list_reduce(list_concat([4294967295], range(8 * length(s))), lambda c, j: xor(({x}) >> 1, 3988292384 * (({x}) & 1))))"
    tree = """
SELECT k, 0 AS lvl, i, n, d FROM {leaves}
UNION ALL SELECT k, lvl + 1, i // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY i)) FROM {name} WHERE n > 1 GROUP BY k, lvl, i // 3, n"""
    beside = """
SELECT k, lvl, i, coalesce(string_agg(d, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
  coalesce(string_agg(d, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {tree} WINDOW w AS (PARTITION BY k, lvl, i // 3 ORDER BY i)"""
    fold = """
SELECT x, k, i, 0 AS lvl, n, d, proof FROM {start}
UNION ALL SELECT f.x, f.k, f.i // 3, f.lvl + 1, (f.n + 2) // 3, sha256(l || d || r), proof || l || r
FROM {name} f JOIN {beside} s ON f.k = s.k AND f.lvl = s.lvl AND f.i = s.i WHERE f.n > 1"""
    return f"""
WITH RECURSIVE given AS (SELECT doc_id, coalesce('=' || source, '') AS k, {leaf("text")} AS leaf,
  CASE WHEN {crc} % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf("text")} END AS received FROM (SELECT *, CAST(doc_id AS VARCHAR) AS s FROM documents)),
leaves AS (SELECT doc_id AS x, k, row_number() OVER (PARTITION BY k ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY k) AS n, leaf AS d, received FROM given),
tree AS ({tree.format(leaves="leaves", name="tree")}),
subroots AS (SELECT k, d AS subroot FROM tree WHERE n = 1),
tops AS (SELECT '' AS k, k AS source, row_number() OVER (ORDER BY k) - 1 AS i, count(*) OVER () AS n, subroot AS d FROM subroots),
top AS ({tree.format(leaves="tops", name="top")}),
beside AS ({beside.format(tree="tree")}),
over AS ({beside.format(tree="top")}),
up AS ({fold.format(start="(SELECT x, k, i, n, received AS d, '' AS proof FROM leaves)", name="up", beside="beside")}),
uptop AS ({fold.format(start="(SELECT x, '' AS k, t.i, t.n, up.d, proof FROM up JOIN tops t ON up.k = t.source WHERE up.n = 1)", name="uptop", beside="over")}),
root AS (SELECT d AS root FROM top WHERE n = 1)
SELECT x AS doc_id, leaves.d AS leaf, subroot, root, sha256(proof) AS proof_sha256, uptop.d AS folded_root, uptop.d = root AS verified
FROM uptop JOIN leaves USING (x) JOIN subroots ON leaves.k = subroots.k CROSS JOIN root WHERE uptop.n = 1"""


ORACLE_SQL = {
    "op1_sharding": "SELECT doc_id, lang, source, n_chars, sha256(text) AS text_sha256 FROM documents",
    "op3_exact_dedup": f"""
WITH d AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)""",
    "op9_url_filter": """
WITH p AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN regexp_extract(url, '^(?s:.*?)://([^?#]*)', 1) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/]*(/(?s:.*))?$', 1) AS path FROM p),
r(rhost, rpath, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (SELECT page_id, rhost || rpath AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC) AS k
  FROM h JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT h.page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM h LEFT JOIN m ON h.page_id = m.page_id AND k = 1""",
    "op10_decontaminate": f"""
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
bw AS (SELECT item_id, list_filter(regexp_split_to_array({_LOWER}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bm AS (SELECT item_id, w, least(len(w), 13) AS m FROM bw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS t FROM (SELECT item_id, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM bm)),
ms AS (SELECT DISTINCT m FROM win),
dp AS (SELECT doc_id, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM dw, ms),
hit AS (SELECT d.doc_id, d.i, d.m, win.item_id FROM (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS t FROM dp) d JOIN win ON d.m = win.m AND d.t = win.t),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY 1),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s FROM hit GROUP BY 1)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN pos ON dw.doc_id = pos.doc_id LEFT JOIN it ON dw.doc_id = it.doc_id""",
    "op11_merkle_manifest": _merkle_sql(),
}
