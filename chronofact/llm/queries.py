"""The operators of this subpackage applied to the driver's tables.

Each query reads its whole table and derives the contract's columns from its
operator's own output.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .url_filter import DEFAULT_RULES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The vocabulary file of op1, among the public tokenizers of this machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_best_fit_packing(spark, sf_dir):
    from .packing import pack, pieces

    return pack(pieces(table(spark, sf_dir, "documents"), tokenizer_path()))


def op2_substring_dedup(spark, sf_dir):
    from .substring import remove_repeats

    out = remove_repeats(table(spark, sf_dir, "documents"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_words", gone.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_quality(spark, sf_dir):
    from .quality import score

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_license_scan(spark, sf_dir):
    from .licenses import DEFAULT_TEMPLATES, scan_licenses

    found = scan_licenses(table(spark, sf_dir, "documents"))
    labels = F.array(*[F.lit(t.label) for t in DEFAULT_TEMPLATES])
    phrase = F.array(*[F.lit(t.phrase) for t in DEFAULT_TEMPLATES])
    base = F.filter("spans", lambda s: F.get(phrase, s["template"]))
    names = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: F.get(labels, s["template"])))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda s: s["start"])).alias("first_word"),
        F.array_max(F.transform(base, lambda s: s["start"])).alias("last_word"),
        names(base).alias("base_labels"),
        names(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["cover"])), F.lit(0.0)).alias("score"),
    )


def op5_near_duplicates(spark, sf_dir):
    from .near_dup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_toxicity(spark, sf_dir):
    from .toxicity import fit, held_out, score

    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels"))).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op7_top_k(spark, sf_dir):
    from .topk import integers, top_k

    vectors = integers(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op8_secret_scan(spark, sf_dir):
    from .secrets import KINDS, scan_secrets

    found = scan_secrets(table(spark, sf_dir, "documents"))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS[:3]))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS[:3]), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


def op9_decontamination(spark, sf_dir):
    from .decontam import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_url_filter(spark, sf_dir):
    from .url_filter import match_rules

    return match_rules(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "matched_by")


QUERIES = {q.__name__: q for q in (op1_best_fit_packing, op2_substring_dedup, op3_quality, op4_license_scan, op5_near_duplicates, op6_toxicity, op7_top_k, op8_secret_scan, op9_decontamination, op10_url_filter)}
OTHER_RULES = ", ".join(f"({i}, '{r.name}', '{r.action}', '{r.pattern}')" for i, r in enumerate(DEFAULT_RULES) if not r.site)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Queries that SQL can express, as DuckDB runs them.  The others train a model
#: (3, 6), run a tokenizer (1), a checksum of the method's own (8), or tolerate
#: changes within a span (4, 9); tests hold those against brute force.
ORACLE_SQL: dict[str, str] = {
    "op2_substring_dedup": r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
 win AS (SELECT doc_id, s, array_to_string(list_slice(w, s, s + 12), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM d WHERE len(w) >= 13)),
 first AS (SELECT g, min(doc_id) AS least FROM win GROUP BY g HAVING min(doc_id) < max(doc_id)),
 gone AS (SELECT DISTINCT doc_id, s + k AS pos FROM win JOIN first USING (g), range(13) r(k) WHERE doc_id > least),
 words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
 kept AS (SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.pos) AS t FROM words w ANTI JOIN gone g ON w.doc_id = g.doc_id AND w.pos = g.pos GROUP BY w.doc_id),
 n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
 SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op5_near_duplicates": rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
 sh AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, s, s + 4), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS s FROM d WHERE len(w) > 0)),
 size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
 pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
 link AS (SELECT a, b FROM pair JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE c / (x.n + y.n - c) >= 0.8),
 edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
 reach(id, other) AS (SELECT a, a FROM edge UNION SELECT r.id, e.b FROM reach r JOIN edge e ON e.a = r.other)
 SELECT doc_id, coalesce(c.class_id, doc_id) AS class_id FROM documents LEFT JOIN (SELECT id, min(other) AS class_id FROM reach GROUP BY id) c ON c.id = doc_id""",
    "op7_top_k": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
 s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda x: x[1] * x[2]))::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0)
 SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s QUALIFY rank <= 10""",
    "op10_url_filter": f"""WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://(.*)$', 1) END AS rest FROM pages),
 p AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
 r(action, h, q) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
 m AS (SELECT page_id, arg_max(h || q, len(h || q)) AS rule, arg_max(action, len(h || q)) AS action FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY page_id),
 o(nth, name, action, pattern) AS (VALUES {OTHER_RULES}),
 w AS (SELECT page_id, arg_max(name, len(name) * 1000 - nth) AS word, arg_max(o.action, len(name) * 1000 - nth) AS action FROM p JOIN o ON regexp_matches(host || path, pattern) GROUP BY page_id)
 SELECT p.page_id, host, path, m.rule, coalesce(m.action, w.action, 'allow') AS verdict, coalesce(m.rule, word) AS matched_by FROM p LEFT JOIN w USING (page_id) LEFT JOIN m USING (page_id)""",
}
