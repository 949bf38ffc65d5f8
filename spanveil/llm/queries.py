"""The pN_ queries and their SQL."""

from __future__ import annotations

from spanveil.llm import chunking, crosssplit, leakage, neardup, packing, pii, sampling, truncation
from spanveil.plans.session import table


def _limits(spark, d, target):
    return table(spark, d, "size_limits").filter(f"target_table = '{target}'")


def p1_found(spark, d):
    return chunking.oversized(table(spark, d, "labelled_docs"), _limits(spark, d, "labelled_docs"))


def p1_pieces(spark, d):
    return chunking.split_records(table(spark, d, "labelled_docs"), _limits(spark, d, "labelled_docs"))


def p1_summary(spark, d):
    return chunking.split_summary(table(spark, d, "labelled_docs"), _limits(spark, d, "labelled_docs"))


def p2_found(spark, d):
    return crosssplit.cross_split_pairs(table(spark, d, "labelled_docs")).select("document_a", "document_b").distinct()


def p2_report(spark, d):
    return crosssplit.cross_split_report(table(spark, d, "labelled_docs"))


def p5_found(spark, d):
    return neardup.near_duplicate_pairs(table(spark, d, "labelled_docs"))


def p5_groups(spark, d):
    return neardup.near_duplicate_groups(table(spark, d, "labelled_docs"))


def p6_bins(spark, d):
    return packing.fill(table(spark, d, "documents"), _limits(spark, d, "documents"))


def p6_found(spark, d):
    return packing.oversized(p6_bins(spark, d))


def p6_report(spark, d):
    return packing.fill_report(p6_bins(spark, d), _limits(spark, d, "documents"))


#: A public rank file; another one is used by setting spanveil.vocabulary on the session.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def p6_bins_bpe(spark, d):
    size = packing.bpe_token_count("text", spark.conf.get("spanveil.vocabulary", VOCABULARY))
    return packing.fill(table(spark, d, "documents"), _limits(spark, d, "documents"), size)


def p7_found(spark, d):
    return leakage.leaked_documents(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_items(spark, d):
    return leakage.exposed_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark, d):
    return truncation.truncated(table(spark, d, "documents"))


def p8_report(spark, d):
    return truncation.truncation_report(table(spark, d, "documents"))


def p3_found(spark, d):
    return sampling.unreachable(table(spark, d, "labelled_docs"), table(spark, d, "sample_targets"))


def p3_report(spark, d):
    return sampling.target_report(table(spark, d, "labelled_docs"), table(spark, d, "sample_targets"))


def p3_sample(spark, d):
    return sampling.draw_sample(table(spark, d, "labelled_docs"), table(spark, d, "sample_targets"))


PSEUDONYM_KEY = "spanveil-demo-key"


def p4_found(spark, d):
    found = pii.values(table(spark, d, "labelled_docs"), table(spark, d, "deid_results"), PSEUDONYM_KEY)
    return found.select("src", "rec_id", "label", "span_start", "span_end")


def p4_linked(spark, d):
    return pii.linked(table(spark, d, "labelled_docs"), table(spark, d, "deid_results"), PSEUDONYM_KEY)


def p4_redacted(spark, d):
    return pii.redacted(table(spark, d, "labelled_docs"), table(spark, d, "deid_results"))


def p4_pseudonyms(spark, d):
    return pii.redacted(table(spark, d, "labelled_docs"), table(spark, d, "deid_results"), PSEUDONYM_KEY)


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_pieces, p1_summary, p2_found, p2_report, p3_found, p3_report, p3_sample, p4_found, p4_linked, p4_redacted, p4_pseudonyms, p5_found, p5_groups, p6_found, p6_bins, p6_bins_bpe, p6_report, p7_found, p7_items, p8_found, p8_report)
}

RECORD_TEXT = """coalesce(full_text, array_to_string([t || CASE WHEN trailing_whitespace[i] THEN ' ' ELSE '' END FOR t, i IN tokens], ''))"""

CATEGORY = r"""
    WITH named AS (
        SELECT document, i, upper(trim(coalesce(labels[i], 'O'))) AS x
        FROM (SELECT document, labels, unnest(range(1, len(labels) + 1)) AS i
              FROM (SELECT document, any_value(labels) AS labels FROM labelled_docs WHERE split = 'train' AND labels IS NOT NULL GROUP BY document))),
    cut AS (SELECT document, i, x[1] AS t, CASE WHEN x[1] IN ('B', 'I') AND length(x) > 2 THEN trim(x[3:]) ELSE '' END AS l FROM named),
    spans AS (
        SELECT document, l FROM (SELECT *, lag(l, 1, '') OVER (PARTITION BY document ORDER BY i) AS before FROM cut)
        WHERE l <> '' AND (t = 'B' OR l <> before)),
    best AS (
        SELECT document, l FROM (
            SELECT document, l, row_number() OVER (PARTITION BY document ORDER BY count(*) DESC, l) AS k FROM spans GROUP BY document, l) WHERE k = 1),
    pool AS (
        SELECT d.document, coalesce(l, 'NO_PII') AS category
        FROM (SELECT DISTINCT document FROM labelled_docs WHERE split = 'train' AND labels IS NOT NULL) d LEFT JOIN best USING (document)),
    stock AS (SELECT category, count(*) AS n FROM pool GROUP BY category)"""
WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
PAIRS = f"""
    WITH texts AS (SELECT document, any_value({RECORD_TEXT}) AS t, any_value(split) AS split FROM labelled_docs WHERE document IS NOT NULL GROUP BY document),
    words AS (SELECT document, {WORDS.format("t")} AS w FROM texts),
    shingles AS (SELECT DISTINCT document, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT *, unnest(range(1, len(w) - 1)) AS i FROM words)),
    sizes AS (SELECT document, count(*) AS n FROM shingles GROUP BY document),
    shared AS (SELECT a.document AS document_a, b.document AS document_b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.document < b.document GROUP BY ALL),
    pairs AS (SELECT document_a, document_b FROM shared JOIN sizes x ON x.document = document_a JOIN sizes y ON y.document = document_b WHERE 2 * c >= x.n + y.n - c)"""
CROSS = f"""{PAIRS},
    cross_pairs AS (SELECT p.*, coalesce(x.split = 'train', false) AS ta FROM pairs p JOIN texts x ON x.document = document_a JOIN texts y ON y.document = document_b
                    WHERE coalesce(x.split = 'train', false) <> coalesce(y.split = 'train', false))"""
NEEDED = "greatest(min_count, CAST(round(target_share * sample_size) AS BIGINT))"

SQL = {
    "p2_found": f"{CROSS} SELECT document_a, document_b FROM cross_pairs",
    "p2_report": f"""{CROSS}, e AS (SELECT CASE WHEN ta THEN document_b ELSE document_a END AS ev, CASE WHEN ta THEN document_a ELSE document_b END AS tr FROM cross_pairs),
        meta AS (SELECT document, any_value(split) AS eval_split, any_value(source) AS eval_source FROM labelled_docs GROUP BY document)
        SELECT eval_split, eval_source, count(*) AS pairs, count(DISTINCT ev) AS eval_documents, count(DISTINCT tr) AS train_documents FROM e JOIN meta ON document = ev GROUP BY ALL""",
    "p5_found": f"{PAIRS} SELECT document_a, document_b FROM pairs",
    "p7_found": f"""
        WITH d AS (SELECT doc_id, {WORDS.format("text")} AS w FROM documents), e AS (SELECT item_id, {WORDS.format("text")} AS w FROM eval_items),
        runs AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS r FROM (SELECT *, unnest(range(1, len(w) - 8)) AS i FROM e)),
        seen AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 9], ' ') AS r FROM (SELECT *, unnest(range(1, len(w) - 8)) AS i FROM d))
        SELECT DISTINCT doc_id, item_id FROM seen JOIN runs USING (r)""",
    "p3_found": f"""{CATEGORY}
        SELECT plan_id, category FROM sample_targets LEFT JOIN stock USING (category) WHERE coalesce(n, 0) < {NEEDED}""",
    "p3_report": f"""{CATEGORY}
        SELECT plan_id, category, {NEEDED} AS needed, coalesce(n, 0) AS available,
               least(coalesce(n, 0), {NEEDED}) AS drawn, {NEEDED} - least(coalesce(n, 0), {NEEDED}) AS shortfall
        FROM sample_targets LEFT JOIN stock USING (category)""",
    "p1_found": f"""
        SELECT DISTINCT limit_id, document FROM labelled_docs, size_limits
        WHERE target_table = 'labelled_docs'
          AND ((unit = 'chars' AND length({RECORD_TEXT}) > max_size) OR (unit = 'tokens' AND len(tokens) > max_size))""",
    "p6_found": r"""
        SELECT limit_id, doc_id FROM size_limits, (
            SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]')) AS n FROM documents)
        WHERE target_table = 'documents' AND n > max_size""",
}


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
