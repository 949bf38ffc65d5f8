"""All queries over the core operators, with their SQL.

Detectors are checked by construction: one list of parts makes the text in Spark, and the same list makes the expected spans
in SQL by adding up lengths, without any pattern.  The parts are expressions both engines read the same way.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import functions as F

from spanveil.functions import lexicon as X
from spanveil.functions.spans import resolve
from spanveil.operators import corpus, detectors, generators, metrics, policy, redact, scorer
from spanveil.plans.analyze import analyze, by_label, deidentify, exploded
from spanveil.plans.session import busy, shared_dir, stage, table
from spanveil.schema import CLASS_IDS, CORPUS_LABELS
from spanveil.sources import readers, writers
from spanveil.streaming import stream

# A capitalised made-up name per nation: its key as letters.
NAME = "'N' || chr(CAST(97 + n_nationkey % 5 AS INT)) || 'or' || chr(CAST(97 + n_nationkey AS INT)) || 'el'"


def num(key: str, width: int, of: int = 10**9, low: int = 0) -> str:
    return f"lpad(CAST({low} + {key} % {of} AS STRING), {width}, '0')"


def text_of(key: str) -> str:
    return f"CAST({key} AS STRING)"


@dataclass(frozen=True)
class Built:
    """A text per row of a table: parts are literals, or (expression, label or None)."""

    table: str
    key: str
    parts: tuple
    detector: str | None = None
    labels: tuple[str, ...] = ()

    def pieces(self) -> list[tuple[str, str | None]]:
        return [(p if isinstance(p, tuple) else (f"'{p}'", None)) for p in self.parts]

    def text(self) -> str:
        return " || ".join(f"({e})" for e, _ in self.pieces())

    def frame(self, spark, d):
        return busy(table(spark, d, self.table)).selectExpr(f"CAST({self.key} AS BIGINT) AS key", f"{self.text()} AS text")

    def spans(self, spark, d):
        df = self.frame(spark, d)
        if self.detector:
            df = df.withColumn("spans", detectors.detector(F.col("text"), self.detector))
        else:
            df = df.withColumn("spans", detectors.detect(F.col("text"), self.labels or None))
        return flat(df)

    def sql(self, wanted=lambda label: True, extra: str = "") -> str:
        out, before = [], []
        for e, label in self.pieces():
            if label and wanted(label):
                start = " + ".join(f"length({b})" for b in before) or "0"
                out.append(
                    f"SELECT CAST({self.key} AS BIGINT) AS key, '{label}' AS label, {e} AS value, CAST({start} AS BIGINT) AS span_start, "
                    f"CAST({start} + length({e}) AS BIGINT) AS span_end{extra} FROM {self.table}"
                )
            before.append(f"({e})")
        return " UNION ALL ".join(out)


def flat(df):
    rows = exploded(df, ["key"])
    return rows.select("key", "label", F.col("span_text").alias("value"), F.col("span_start").cast("bigint").alias("span_start"), F.col("span_end").cast("bigint").alias("span_end"))


def md5_part(key: str, first: int, size: int) -> str:
    return f"substr(md5({text_of(key)}), {first}, {size})"


MAC_VALUE = " || ':' || ".join(md5_part("o_orderkey", 1 + 2 * k, 2) for k in range(6))
UUID_VALUE = " || '-' || ".join(md5_part("o_orderkey", a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))

BUILT = {
    "det_email": Built("supplier", "s_suppkey", ("Write to ", (f"'s' || {text_of('s_suppkey')} || '@mail.example.com'", "EMAIL"), " today"), "email"),
    "det_ssn": Built("customer", "c_custkey", ("SSN ", (f"{num('c_custkey', 3, 500, 100)} || '-' || {num('c_custkey', 2, 98, 1)} || '-' || {num('c_custkey', 4, 9998, 1)}", "SSN"), " on file"), "ssn"),
    "det_phone": Built("customer", "c_custkey", ("Call ", (f"'703-555-' || {num('c_custkey', 4, 10000)}", "PHONE_NUM"), " now or ", (f"'(415) 555-' || {num('c_custkey', 4, 10000)} || ' ext. ' || {num('c_custkey', 2, 90, 10)}", "PHONE_NUM"), "."), "phone"),
    "det_url": Built("orders", "o_orderkey", ("see ", (f"'https://github.com/u' || {text_of('o_orderkey')}", "URL_PERSONAL"), ", not https://www.wikipedia.org/wiki/Lake ok"), "url"),
    "det_domain": Built("orders", "o_orderkey", ("my store is ", (f"'shop' || {text_of('o_orderkey')} || '.com'", "URL_PERSONAL"), " now"), "domain"),
    "det_user": Built("customer", "c_custkey", ("add @", (f"'user_' || {text_of('c_custkey')}", "USERNAME"), " soon"), "user"),
    "det_id_cue": Built("customer", "c_custkey", ("My student ID is ", (num("c_custkey", 7), "ID_NUM"), "."), "id_cue"),
    "det_id_bare": Built("orders", "o_orderkey", ("Code ", (f"'AB' || {num('o_orderkey', 8, 90000000, 10000001)}", "ID_NUM"), " stays"), "id_bare"),
    "det_street": Built("customer", "c_custkey", ("We live at ", (f"CAST(1 + c_custkey % 999 AS STRING) || ' Old Mill Lane, Apt ' || CAST(1 + c_custkey % 9 AS STRING)", "STREET_ADDRESS"), "."), "street"),
    "det_date": Built("orders", "o_orderkey", ("Due ", ("substr(CAST(o_orderdate AS STRING), 1, 10)", "DATE"), " sharp"), "date"),
    "det_name": Built("nation", "n_nationkey", ("My name is ", (f"'Ona ' || {NAME}", "NAME_STUDENT"), "."), "name"),
    "det_related": Built("nation", "n_nationkey", ("My brother ", (NAME, "NAME_RELATED"), " laughed"), "related"),
    "det_title": Built("nation", "n_nationkey", ("ask Mrs. ", (NAME, "NAME_RELATED"), " about it"), "title"),
    "det_school": Built("nation", "n_nationkey", ("The pupils of ", (f"{NAME} || ' Middle School'", "SCHOOL"), " won"), "school"),
    "det_loc": Built("nation", "n_nationkey", ("We moved to ", (NAME, "LOCATION"), " last year, near ", (f"{NAME} || ', VT'", "LOCATION"), " in spring"), "loc"),
    "det_age": Built("customer", "c_custkey", ("im ", ("CAST(7 + c_custkey % 11 AS STRING)", "AGE"), " and she is ", ("CAST(8 + c_custkey % 11 AS STRING)", "AGE"), " years old"), "age"),
    "det_bday": Built("customer", "c_custkey", ("my birthday is ", ("'June ' || CAST(1 + c_custkey % 28 AS STRING)", "DATE"), " ok"), "bday"),
    "det_ipv4": Built("orders", "o_orderkey", ("Seen at ", ("'10.' || CAST(o_orderkey % 256 AS STRING) || '.' || CAST(o_orderkey % 199 AS STRING) || '.7'", "IP_ADDRESS"), " ok"), "ipv4"),
    "det_ipv6": Built("orders", "o_orderkey", ("addr ", (f"'2001:0db8:' || {md5_part('o_orderkey', 1, 4)} || ':' || {md5_part('o_orderkey', 5, 4)}", "IP_ADDRESS"), " up"), "ipv6"),
    "det_mac": Built("orders", "o_orderkey", ("mac ", (MAC_VALUE, "DEVICE_ID"), " up"), "mac"),
    "det_uuid": Built("orders", "o_orderkey", ("ad id ", (UUID_VALUE, "DEVICE_ID"), " set"), "uuid"),
    "det_geo": Built("orders", "o_orderkey", ("at ", (f"'40.' || {num('o_orderkey', 4, 10000)} || ', -74.' || {num('o_orderkey', 4, 10000)}", "GEO"), " now"), "geo"),
}
# A made-up name per customer: its key as letters.
CNAME = "'Q' || translate(lpad(CAST(c_custkey AS STRING), 6, '0'), '0123456789', 'abcdefghij')"
DAY = "CAST(1 + c_custkey % 28 AS STRING)"
#: The other forms of the detectors, one each.
BUILT |= {
    "det_phone_intl": Built("customer", "c_custkey", ("Ring ", (f"'+44 7700 ' || {num('c_custkey', 3, 900, 100)} || ' ' || {num('c_custkey', 3, 900, 100)}", "PHONE_NUM"), " please"), "phone"),
    "det_date_long": Built("customer", "c_custkey", ("On ", (f"'March ' || {DAY} || ', 2012'", "DATE"), " we left, back ", (f"'Sept. ' || {DAY} || 'th 2013'", "DATE"), " or so"), "date"),
    "det_date_us": Built("customer", "c_custkey", ("due ", (f"'03/' || {DAY} || '/2012'", "DATE"), ", never 13/40/2012 or 3/4/12"), "date"),
    "det_user_cue": Built("customer", "c_custkey", ("username: ", (f"'kit' || {text_of('c_custkey')} || 'x'", "USERNAME"), " ok, login = ", (f"'pat' || {text_of('c_custkey')}", "USERNAME"), " too"), "user"),
    "det_user_is": Built("customer", "c_custkey", ("my username on it is ", (f"'kit' || {text_of('c_custkey')}", "USERNAME"), " and not taken"), "user"),
    "det_user_platform": Built("customer", "c_custkey", ("discord ", (f"'kit_' || {text_of('c_custkey')}", "USERNAME"), " works"), "user"),
    "det_user_platform_is": Built("customer", "c_custkey", ("my snap for class is ", (f"'kit_' || {text_of('c_custkey')}", "USERNAME"), " today"), "user"),
    "det_name_signoff": Built("customer", "c_custkey", ("See you.", ("chr(10) || 'Sincerely,' || chr(10)", None), (f"'Ona ' || {CNAME}", "NAME_STUDENT"), ("chr(10) || 'Room 4'", None)), "name"),
    "det_name_by": Built("customer", "c_custkey", ("Written by ", (f"'Ona ' || {CNAME}", "NAME_STUDENT"), ", made by hand"), "name"),
    "det_related_called": Built("customer", "c_custkey", ("Their little cousin called ", (CNAME, "NAME_RELATED"), " laughed"), "related"),
    "det_school_of": Built("customer", "c_custkey", ("She went to the ", (f"'University of ' || {CNAME}", "SCHOOL"), " in May"), "school"),
    "det_age_forms": Built("customer", "c_custkey", ("he is ", ("CAST(7 + c_custkey % 11 AS STRING)", "AGE"), " yo and turning ", ("CAST(8 + c_custkey % 11 AS STRING)", "AGE"), " soon"), "age"),
    "det_id_cue_forms": Built("customer", "c_custkey", ("badge: ", (f"'K-' || {num('c_custkey', 6)}", "ID_NUM"), ", lunch number ", (num("c_custkey", 6), "ID_NUM"), " and roll no. ", (f"'R' || {num('c_custkey', 5)}", "ID_NUM"), "."), "id_cue"),
}
#: Sentences in which nothing is to be found.
HARMLESS = (
    "'We live near 12 Oak Tracks and mile ' || CAST(c_custkey AS STRING)", "'Pages 1200-1350 and version 10.1.2.3.' || CAST(c_custkey % 9 AS STRING)", "'I handle issue ' || CAST(c_custkey % 90 AS STRING) || ' and twitter is great'",
    "'In High School we get ' || CAST(c_custkey % 90 AS STRING) || ' more pages'", "'It was 3/4/12 or ' || CAST(c_custkey % 90 AS STRING) || ' days later'", "'see www.wikipedia.org for ' || CAST(c_custkey % 90 AS STRING) || ' more'",
)
MIXED = Built(
    "customer", "c_custkey",
    ("Write to ", (f"'c' || {text_of('c_custkey')} || '@mail.example.com'", "EMAIL"), " or call ", (f"'703-555-' || {num('c_custkey', 4, 10000)}", "PHONE_NUM"),
     ". My student ID is ", (num("c_custkey", 7), "ID_NUM"), ", from ", (f"'10.0.' || CAST(c_custkey % 256 AS STRING) || '.9'", "IP_ADDRESS"), " ok. I was ill on ", ("'2012-03-' || " + num("c_custkey", 2, 28, 1), "DATE"), "."),
)
NAMED = Built("nation", "n_nationkey", ("My name is ", (f"'Ona ' || {NAME}", "NAME_STUDENT"), ". We like ", (NAME, "NAME_STUDENT"), ("chr(39) || 's ideas and '", None), ("'Ona'", "NAME_STUDENT"), "."))

CALLED = Built("customer", "c_custkey", ("My name is ", (f"'Ona ' || {CNAME}", "NAME_STUDENT"), ". We like ", (CNAME, "NAME_STUDENT"), ("chr(39) || 's ideas and '", None), ("'Ona'", "NAME_STUDENT"), ", not Onaq."))

GOLD = """
    WITH docs AS (SELECT document, any_value(tokens) AS t, any_value(trailing_whitespace) AS w, any_value(labels) AS l FROM labelled_docs WHERE labels IS NOT NULL GROUP BY document),
    tok AS (SELECT document, i, length(t[i]) AS n, CASE WHEN w[i] THEN 1 ELSE 0 END AS w, upper(trim(coalesce(l[i], 'O'))) AS x FROM (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM docs)),
    bio AS (SELECT *, CASE WHEN x[1] IN ('B', 'I') AND length(x) > 2 THEN x[1] ELSE 'O' END AS p, CASE WHEN x[1] IN ('B', 'I') AND length(x) > 2 THEN trim(x[3:]) ELSE '' END AS label,
            coalesce(sum(n + w) OVER (PARTITION BY document ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM tok),
    opened AS (SELECT *, CASE WHEN p = 'B' OR (p = 'I' AND label <> lag(label, 1, '') OVER (PARTITION BY document ORDER BY i)) THEN 1 ELSE 0 END AS o FROM bio),
    num AS (SELECT *, sum(o) OVER (PARTITION BY document ORDER BY i) AS k FROM opened),
    gold AS (SELECT document, any_value(label) AS label, CAST(min(pos) AS BIGINT) AS "start", CAST(max(pos + n) AS BIGINT) AS "end" FROM num WHERE p <> 'O' GROUP BY document, k)"""
PRED = """,
    pred AS (SELECT DISTINCT document, label, CAST(span_start AS BIGINT) AS "start", CAST(span_end AS BIGINT) AS "end" FROM spans WHERE document IS NOT NULL)"""
CORPUS_IN = "(" + ", ".join(f"'{l}'" for l in CORPUS_LABELS) + ")"
JUDGED = f"""{GOLD}{PRED},
    g AS (SELECT * FROM gold WHERE label IN {CORPUS_IN}), q AS (SELECT * FROM pred WHERE label IN {CORPUS_IN}),
    kinds AS (
        SELECT document, label, "start", "end",
               CASE WHEN EXISTS (SELECT 1 FROM pred p WHERE p.document = g.document AND p.label = g.label AND p."start" < g."end" AND g."start" < p."end") THEN 'tp' ELSE 'fn' END AS kind,
               NOT EXISTS (SELECT 1 FROM pred p WHERE p.document = g.document AND p."start" < g."end" AND g."start" < p."end") AS exposed FROM g
        UNION ALL
        SELECT document, label, "start", "end", 'fp', false FROM q
        WHERE NOT EXISTS (SELECT 1 FROM gold g WHERE g.document = q.document AND g.label = q.label AND q."start" < g."end" AND g."start" < q."end"))"""
PRF = """
    counts AS (SELECT label, count(*) FILTER (kind = 'tp') AS tp, count(*) FILTER (kind = 'fp') AS fp, count(*) FILTER (kind = 'fn') AS fn, count(*) FILTER (exposed) AS exposed FROM kinds GROUP BY ROLLUP (label)),
    pr AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS r FROM counts)"""


def _unique_docs(spark, d):
    return table(spark, d, "labelled_docs").filter("labels is not null").dropDuplicates(["document"])


def _labelled_texts(spark, d):
    """``document, text`` of labelled_docs, rows as they are: ``full_text``, where null the joined tokens; null without either."""
    text = F.coalesce("full_text", corpus.rebuilt_text(F.col("tokens"), F.coalesce("trailing_whitespace", F.array().cast("array<boolean>"))))
    return table(spark, d, "labelled_docs").select("document", text.alias("text"))


def gold_rows(spark, d):
    g = corpus.rebuild(_unique_docs(spark, d)).select("document", F.explode_outer("gold").alias("g")).filter("g is not null")
    return g.select("document", F.col("g.label").alias("label"), F.col("g.start").cast("bigint").alias("start"), F.col("g.end").cast("bigint").alias("end"))


def pred_rows(spark, d):
    s = table(spark, d, "spans").filter("document is not null")
    return s.select("document", "label", F.col("span_start").cast("bigint").alias("start"), F.col("span_end").cast("bigint").alias("end")).distinct()


def span_arrays(spark, d, exact: bool = True):
    """The reported spans of each document as an array; null confidence counts as 0, repeated rows once."""
    s = table(spark, d, "spans").filter("document is not null and span_start is not null and span_end is not null")
    one = F.struct(
        "label", "text", F.col("span_start").cast("int").alias("start"), F.col("span_end").cast("int").alias("end"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "source",
        F.col("span_id").cast("int").alias("seq"),
    )
    return s.groupBy("document").agg(F.collect_set(one).alias("spans"))


RANKED = """
    WITH RECURSIVE s AS (
        SELECT DISTINCT document, label, CAST(span_start AS BIGINT) AS a, CAST(span_end AS BIGINT) AS b, coalesce(confidence, 0) AS c, source, span_id, text
        FROM spans WHERE document IS NOT NULL AND span_start IS NOT NULL AND span_end IS NOT NULL),
    r AS (SELECT *, row_number() OVER (PARTITION BY document ORDER BY c DESC, b - a DESC, CASE WHEN source = 'model' THEN 0 ELSE 1 END, a, span_id) AS k FROM s),
    walk AS (
        SELECT document, 1::BIGINT AS k, [struct_pack(id := span_id, a := a, b := b)] AS kept FROM r WHERE k = 1
        UNION ALL
        SELECT w.document, r.k, CASE WHEN len(list_filter(w.kept, lambda x: x.a < r.b AND r.a < x.b)) > 0 THEN w.kept ELSE list_append(w.kept, struct_pack(id := r.span_id, a := r.a, b := r.b)) END
        FROM walk w JOIN r ON r.document = w.document AND r.k = w.k + 1),
    last AS (SELECT document, kept FROM walk QUALIFY row_number() OVER (PARTITION BY document ORDER BY k DESC) = 1)"""


# ---- queries -------------------------------------------------------------------------------------------------------


def masked_by_lang(spark, d):
    """Detect, mask under a policy, check, and count per language and label what was removed and what leaked."""
    docs = busy(table(spark, d, "documents")).select("doc_id", F.lower(F.trim("lang")).alias("lang"), "text")
    out = deidentify(docs, "ferpa", verify=False, document="doc_id")
    rows = out.select("lang", F.explode_outer("acted").alias("s"), F.size("leaks").alias("leaks")).filter("s is not null")
    return rows.groupBy("lang", F.col("s.label").alias("label")).agg(F.count("*").alias("removed"), F.sum((F.col("leaks") > 0).cast("bigint")).alias("in_leaking_texts"))


def det_all(spark, d):
    return MIXED.spans(spark, d)


def det_nothing(spark, d):
    """Spans in sentences without any identifier."""
    texts = busy(table(spark, d, "customer")).selectExpr("CAST(c_custkey AS BIGINT) AS key", f"explode(array({', '.join(HARMLESS)})) AS text")
    return texts.select("key", F.size(detectors.detect(F.col("text"))).cast("bigint").alias("spans")).groupBy("key").agg(F.sum("spans").alias("spans"), F.count("*").alias("texts"))


def propagate_customers(spark, d):
    """Names introduced once and mentioned again, a text per customer."""
    return flat(analyze(CALLED.frame(spark, d)))


def det_labels(spark, d):
    return Built(MIXED.table, MIXED.key, MIXED.parts, labels=("EMAIL", "IP_ADDRESS")).spans(spark, d)


def propagate(spark, d):
    df = analyze(NAMED.frame(spark, d))
    rows = exploded(df, ["key"])
    return rows.select("key", "label", F.col("span_text").alias("value"), F.col("span_start").cast("bigint").alias("span_start"), F.col("span_end").cast("bigint").alias("span_end"))


def analyze_query(spark, d):
    return flat(analyze(MIXED.frame(spark, d)))


def extract(spark, d):
    """All labels over the whole corpus of documents: spans per label and source."""
    found = analyze(busy(table(spark, d, "documents")).select("doc_id", "text"))
    return exploded(found, ["doc_id"]).groupBy("label", "source").agg(F.count("*").alias("spans"), F.countDistinct("doc_id").alias("documents"))


NAME_TYPES = ("NAME_STUDENT", "NAME_RELATED", "SCHOOL", "LOCATION")


def names_corpus(spark, d):
    """The detectors of names, titles, schools and places over all documents, without propagation: spans per label."""
    docs = busy(table(spark, d, "documents")).select("doc_id", detectors.detect(F.col("text"), NAME_TYPES).alias("spans"))
    return exploded(docs, ["doc_id"]).groupBy("label").agg(F.count("*").alias("spans"), F.countDistinct("doc_id").alias("documents"))


def propagate_corpus(spark, d):
    """Name propagation over the texts of all labelled documents: propagated spans per document and label."""
    docs = _labelled_texts(spark, d).filter("text is not null").dropDuplicates(["document"])
    rows = exploded(analyze(docs), ["document"]).filter("source = 'propagated'")
    return rows.groupBy("document", "label").agg(F.count("*").alias("spans"))


def coppa_corpus(spark, d):
    """All documents masked under coppa: what was removed per label, and how much of it in texts with leaks."""
    out = deidentify(busy(table(spark, d, "documents")).select("doc_id", "text"), "coppa", verify=False, document="doc_id")
    rows = out.select(F.explode_outer("acted").alias("s"), F.size("leaks").alias("leaks")).filter("s is not null")
    return rows.groupBy(F.col("s.label").alias("label")).agg(F.count("*").alias("removed"), F.sum((F.col("leaks") > 0).cast("bigint")).alias("in_leaking_texts"))


def by_label_query(spark, d):
    df = analyze(MIXED.frame(spark, d))
    return by_label(df, "key").select("key", "label", F.size("values").cast("bigint").alias("n"), F.col("values")[0].alias("first_value"))


def doc_email(spark, d):
    df = table(spark, d, "documents").select("doc_id", detectors.detector(F.col("text"), "email").alias("s"))
    return df.select("doc_id", F.explode_outer("s.text").alias("value")).filter("value is not null")


def overlaps_query(spark, d):
    from spanveil.functions.spans import overlaps

    p = pred_rows(spark, d).select("document", "label", F.struct("start", "end").alias("x"))
    a, b = p.alias("a"), p.alias("b")
    both = a.join(b, (F.col("a.document") == F.col("b.document")) & (F.col("a.label") < F.col("b.label")) & overlaps(F.col("a.x"), F.col("b.x")))
    return both.select("a.document", F.col("a.label").alias("label_a"), F.col("b.label").alias("label_b"), F.col("a.x.start").alias("start_a"), F.col("b.x.start").alias("start_b"))


def span_trim(spark, d):
    from spanveil.functions.spans import trimmed

    return table(spark, d, "orders").select(F.col("o_orderkey").cast("bigint").alias("key"), trimmed(F.concat(F.col("o_orderkey").cast("string"), F.lit(".).\"']"))).alias("value"))


def resolve_query(spark, d):
    kept = span_arrays(spark, d).select("document", F.explode(resolve(F.col("spans"))).alias("s"))
    return kept.select("document", F.col("s.seq").cast("bigint").alias("span_id"))


def stopword(spark, d):
    df = table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("key"), F.expr("CASE WHEN n_nationkey % 2 = 0 THEN 'The ' ELSE 'Ona ' END || n_name").alias("v"))
    return df.select("key", detectors.is_stopword(F.col("v")).alias("stop"))


def digits_only(spark, d):
    day = F.col("o_orderdate").cast("string").substr(1, 10)
    return table(spark, d, "orders").select(F.col("o_orderkey").cast("bigint").alias("key"), detectors.digits_only(day).alias("digits"))


def luhn(spark, d):
    v = F.lpad((F.col("o_orderkey") * 7919).cast("string"), 13, "4")
    return table(spark, d, "orders").select(F.col("o_orderkey").cast("bigint").alias("key"), detectors.is_luhn(v).alias("ok"))


def url_is_personal(spark, d):
    v = F.expr("element_at(array('https://github.com/a', 'https://sub.school.edu/a', 'www.draw.io', 'https://unknown.example.com/p'), CAST(n_nationkey % 4 AS INT) + 1)")
    before = F.expr("CASE WHEN n_nationkey % 8 >= 4 THEN 'look at my store: ' ELSE 'we used ' END")
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("key"), detectors.url_is_personal(v, before).alias("personal"))


def hash_value(spark, d):
    return table(spark, d, "spans").select("span_id", redact.hash_value(F.col("text")).alias("hashed"))


def shift_date(spark, d):
    v = F.col("o_orderdate").cast("date")
    return table(spark, d, "orders").select(
        F.col("o_orderkey").cast("bigint").alias("key"), redact.shift_date(F.date_format(v, "MM/dd/yyyy"), 30).alias("us"), redact.shift_date(F.date_format(v, "yyyy-MM-dd"), -45).alias("iso"),
        redact.shift_date(F.date_format(v, "MMMM d, yyyy"), 400).alias("long"),
    )


def surrogate(spark, d):
    s = table(spark, d, "spans").filter("text is not null")
    return s.select("span_id", "label", redact.surrogate(F.col("label"), F.col("text"), 7).alias("made"))


def tokenise(spark, d):
    docs = busy(table(spark, d, "documents")).filter("text is not null")
    return docs.select("doc_id", F.size(corpus.tokenise(F.col("text"))).cast("bigint").alias("tokens"))


def policy_rows(spark, d):
    return table(spark, d, "policies")


def pol_filter(spark, d):
    """For every policy, how many reported spans of each label it acts on."""
    rules = policy.checked(policy_rows(spark, d)).select(F.struct("*").alias("p"), F.explode(F.map_keys("labels")).alias("_l"))
    spans = span_arrays(spark, d).select(F.explode("spans").alias("s"))
    both = spans.join(F.broadcast(rules), F.col("s.label") == F.col("_l"))
    acted = both.filter(F.size(redact.acted_on(F.array("s"), F.col("p"))) > 0)
    return acted.groupBy(F.col("p.name").alias("policy"), F.col("s.label").alias("label")).agg(F.count("*").alias("n"))


def method(spark, d):
    """The method each request ran under."""
    pol = policy.checked(policy_rows(spark, d)).select(F.col("name").alias("_n"), F.struct("*").alias("p"))
    req = table(spark, d, "deid_results").select("request_id", "policy", "method").distinct()
    return req.join(F.broadcast(pol), F.col("policy") == F.col("_n"), "left").select("request_id", redact.method_of(F.col("p"), F.col("method")).alias("used"))


def method_label(spark, d):
    """The method of every policy for every label it names."""
    p = policy_rows(spark, d).select("name", "default_method", F.explode("labels").alias("label", "rule")).filter("rule is not null")
    return p.select(F.col("name").alias("policy"), "label", F.coalesce("rule.method", "default_method").alias("method"), F.coalesce("rule.mask", F.concat(F.lit("["), F.col("label"), F.lit("]"))).alias("mask"))


def _deid(spark, d, built, pol, **kw):
    return deidentify(built.frame(spark, d), pol, document="key", verify=False, **kw)


def deid_mask(spark, d):
    return _deid(spark, d, MIXED, "ferpa", date_shift_days=30).select("key", "deidentified_text")


def deid_coppa(spark, d):
    return _deid(spark, d, NAMED, "coppa").select("key", "deidentified_text")


def deid_hash(spark, d):
    return _deid(spark, d, MIXED, "ferpa", method="hash", date_shift_days=30).select("key", "deidentified_text")


def deid_replace(spark, d):
    return _deid(spark, d, MIXED, "research").select("key", "deidentified_text")


def deid_keep(spark, d):
    return _deid(spark, d, MIXED, "ferpa", method="keep", date_shift_days=30).select("key", F.size("leaks").cast("bigint").alias("leaks"))


def deid_requests(spark, d):
    """The requests run again under the policy table: leaks, spans acted on and spans left, per policy and method."""
    req = table(spark, d, "deid_results").filter("original_text is not null").dropDuplicates(["request_id"])
    req = req.select("request_id", F.col("policy").alias("wanted"), "method", F.col("original_text").alias("text"))
    out = deidentify(req, policy_rows(spark, d), policy_name="wanted", method=F.col("method"), document="request_id", verify=False)
    good = F.sum((F.size("leaks") == 0).cast("bigint"))
    return out.groupBy(F.col("wanted").alias("policy"), F.col("method_used").alias("method")).agg(F.count("*").alias("requests"), good.alias("clean"), F.sum("audit.entities_acted_on").alias("acted"), F.sum("audit.entities_below_policy_threshold").alias("left_alone"))


def replacements(spark, d):
    return _deid(spark, d, NAMED, "ferpa").select("key", F.explode("replacements").alias("original", "replaced"))


def leak_check(spark, d):
    """Original values that still stand in the text a request returned."""
    r = table(spark, d, "deid_results").filter("deidentified_text is not null and replacements is not null").dropDuplicates(["request_id"])
    return r.select("request_id", F.explode(redact.leaks_in(F.col("deidentified_text"), F.map_keys("replacements"))).alias("leak"))


def quarantine(spark, d):
    good, bad = redact.quarantined(_deid(spark, d, MIXED, "ferpa", method=None))
    return good.agg(F.count("*").alias("n")).withColumn("kind", F.lit("clean")).unionByName(bad.agg(F.count("*").alias("n")).withColumn("kind", F.lit("leaking")))


def audit(spark, d):
    out = _deid(spark, d, MIXED, "ferpa", date_shift_days=30)
    a = F.col("audit")
    return out.select("key", a["policy"].alias("policy"), a["method"].alias("method"), a["entities_acted_on"].alias("acted"), a["entities_below_policy_threshold"].alias("below"), a["input_chars"].alias("input_chars"), a["output_sha256"].alias("sha"), a["leaks_found"].alias("leaks"), a["by_label"]["EMAIL"].alias("emails"))


def audit_summary(spark, d):
    """Audit records of past requests: per policy and label, spans acted on."""
    r = table(spark, d, "deid_results").filter("audit is not null").dropDuplicates(["request_id"])
    x = r.select("audit.policy", F.explode("audit.by_label").alias("label", "n"))
    return x.groupBy("policy", "label").agg(F.sum("n").alias("acted"), F.count("*").alias("requests"))


def rebuild(spark, d):
    return gold_rows(spark, d)


def rebuilt_text(spark, d):
    docs = table(spark, d, "labelled_docs").filter("tokens is not null").dropDuplicates(["document"])
    return docs.select("document", F.sha2(corpus.rebuilt_text(F.col("tokens"), F.col("trailing_whitespace")), 256).alias("sha"))


def score(spark, d):
    k = metrics.judged(gold_rows(spark, d), pred_rows(spark, d))
    return k.groupBy("label", "kind").agg(F.count("*").alias("n"))


def exposed(spark, d):
    k = metrics.judged(gold_rows(spark, d), pred_rows(spark, d)).filter("exposed")
    return k.select("document", "label", "start", "end")


def prf(spark, d):
    return metrics.prf(metrics.judged(gold_rows(spark, d), pred_rows(spark, d)))


def label_scope(spark, d):
    k = metrics.judged(gold_rows(spark, d), pred_rows(spark, d), labels=metrics.scope("all"))
    return k.filter("kind = 'fp'").groupBy("label").agg(F.count("*").alias("n"))


def report(spark, d):
    k = metrics.judged(gold_rows(spark, d), pred_rows(spark, d))
    r = metrics.report(k, _unique_docs(spark, d).count(), "spans")
    return r.select("model", "docs", F.col("overall.tp").alias("tp"), F.col("overall.fn").alias("fn"), F.col("overall.f5").alias("f5"), "identifiers", "exposed", "removed_under_any_label")


def leak_report(spark, d):
    texts = corpus.rebuild(_unique_docs(spark, d)).select("document", "text")
    return metrics.leaks(metrics.judged(gold_rows(spark, d), pred_rows(spark, d)), texts)


def rules_quality(spark, d):
    """The rules scored on the labelled documents: reported is what they find against the corpus labels."""
    docs = corpus.rebuild(_unique_docs(spark, d)).select("document", "text")
    p = exploded(analyze(docs), ["document"]).select("document", "label", F.col("span_start").alias("start"), F.col("span_end").alias("end"))
    return metrics.prf(metrics.judged(gold_rows(spark, d), p))


def is_positive(spark, d):
    return _unique_docs(spark, d).select("document", corpus.is_positive(F.col("labels")).alias("positive"))


def encode(spark, d):
    x = _unique_docs(spark, d).select("document", F.explode(corpus.encode(F.col("labels"))).alias("cls"))
    return x.groupBy("document", F.col("cls").cast("bigint").alias("cls")).agg(F.count("*").alias("n"))


def char_project(spark, d):
    x = _unique_docs(spark, d).select("document", F.explode(corpus.char_labels(F.col("tokens"), F.col("trailing_whitespace"), F.col("labels"))).alias("label"))
    return x.groupBy("document", "label").agg(F.count("*").alias("chars"))


def renumber(spark, d):
    docs = _unique_docs(spark, d).select("document", "source")
    return corpus.renumber(docs.filter("source = 'synthetic'").select("document", F.col("document").alias("was")), docs.filter("source = 'real'"))


def split(spark, d):
    parts = corpus.split(_unique_docs(spark, d).select("document", "labels"))
    return parts.select("document", "part")


def marks(spark, d):
    marked = F.expr("'By ⟦NAME_STUDENT|' || c_name || '⟧ aged ⟦AGE|' || CAST(c_custkey % 90 AS STRING) || '⟧⟦SSN|x⟧.'")
    df = table(spark, d, "customer").select(F.col("c_custkey").cast("bigint").alias("key"), corpus.unmark(marked).alias("u"))
    return df.select("key", F.explode("u.gold").alias("g"), F.col("u.text").alias("plain")).select("key", "plain", F.col("g.label").alias("label"), F.col("g.start").cast("bigint").alias("span_start"), F.col("g.end").cast("bigint").alias("span_end"))


def essay_bio(spark, d):
    df = table(spark, d, "customer").selectExpr("CAST(c_custkey AS BIGINT) AS key", "array('One more line.', 'I am ' || c_name || ' today.') AS sentences")
    value = F.array(F.struct(F.lit("NAME_STUDENT").alias("label"), F.expr("substr(sentences[1], 6, length(sentences[1]) - 12)").alias("value")))
    df = df.withColumn("values", F.array(F.slice(value, 1, 0), value))
    out = corpus.to_bio(corpus.locate_spans(df, "sentences", "values"))
    return out.select("key", F.size("tokens").cast("bigint").alias("tokens"), F.size(F.filter("labels", lambda l: l != "O")).cast("bigint").alias("inside"), F.element_at("labels", 7).alias("seventh"))


def token_metrics(spark, d):
    df = table(spark, d, "orders").selectExpr("CAST(o_orderkey % 5 AS INT) AS gold", "CAST((o_orderkey * 7 + o_orderkey % 3) % 5 AS INT) AS pred")
    m = metrics.token_metrics(df, "gold", "pred")
    return m.select("tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f5")])


def f_beta(spark, d):
    p, r = F.expr("(c_custkey % 101) / 100D"), F.expr("(c_custkey % 97) / 96D")
    return table(spark, d, "customer").select(F.col("c_custkey").cast("bigint").alias("key"), F.round(metrics.f_beta(p, r), 6).alias("f5"))


def _slice(column: str, start: int, size: int):
    return F.transform(F.slice(column, start, size), lambda v: v.cast("double"))


def softmax(spark, d):
    s = scorer.softmax(_slice("embedding", 1, 8))
    return table(spark, d, "embeddings").select("vec_id", F.round(s[0], 6).alias("p0"), F.round(F.aggregate(s, F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


def argmax(spark, d):
    return table(spark, d, "embeddings").select("vec_id", scorer.argmax(_slice("embedding", 1, 15)).cast("bigint").alias("cls"))


def quant_agree(spark, d):
    df = table(spark, d, "embeddings").select(_slice("embedding", 1, 6).alias("a"), _slice("embedding", 2, 6).alias("b"))
    return metrics.agreement(df, "a", "b").select(F.round("same_argmax", 6).alias("same_argmax"), F.round("max_difference", 6).alias("max_difference"))


def win(spark, d):
    """Windows of every document, and whether the kept ranges tile it."""
    w = busy(table(spark, d, "documents")).filter("text is not null").select("doc_id", "text", scorer.windows(F.col("text")).alias("w"))
    covered = F.aggregate("w", F.lit(0), lambda a, x: a + x["keep_to"] - x["keep_from"])
    return w.select("doc_id", F.size("w").cast("bigint").alias("windows"), (covered == F.length("text")).alias("tiles"))


def win_words(spark, d):
    """Windows of texts of equal words: how many, and where the first one's kept range ends."""
    t = table(spark, d, "customer").selectExpr("CAST(c_custkey AS BIGINT) AS key", "repeat('abcd ', CAST(100 + c_custkey % 2000 AS INT)) AS text")
    w = t.select("key", scorer.windows(F.col("text")).alias("w"))
    return w.select("key", F.size("w").cast("bigint").alias("windows"), F.col("w")[0]["keep_to"].cast("bigint").alias("first_kept"), F.element_at("w", -1)["start"].cast("bigint").alias("last_start"))


PIECES = ("O", "B-NAME_STUDENT", "I-NAME_STUDENT", "I-ID_NUM")


def decode_pieces(spark, d):
    """Spans from word pieces with given probabilities: pieces of one value join, a piece of a word stands for all of it."""
    odds = lambda k, p: "array(" + ", ".join(str(p if i == k else round((1 - p) / 3, 6)) + "D" for i in range(4)) + ")"
    parts = ((0, 2, 0, 0.9), (3, 6, 3, 0.9), (6, 10, 3, 0.7), (11, 13, 0, 0.8), (14, 17, 1, 0.8), (18, 21, 2, 0.6), (0, 0, 1, 0.9))
    tokens = ", ".join(f"named_struct('s', {a}, 'e', {b}, 'p', {odds(k, p)})" for a, b, k, p in parts)
    df = table(spark, d, "customer").selectExpr("CAST(c_custkey AS BIGINT) AS key", f"'ID ' || {num('c_custkey', 7)} || ' by Ona ' || {CNAME} || '.' AS text", f"array({tokens}) AS tokens")
    found = df.select("key", F.explode(scorer.decode(F.col("text"), scorer.chosen(F.col("tokens")), PIECES)).alias("s"))
    at = lambda c: F.col(f"s.{c}").cast("bigint").alias(f"span_{c}")
    return found.select("key", "s.label", F.col("s.text").alias("value"), at("start"), at("end"), F.round("s.confidence", 4).alias("confidence"))


STUB_CLASSES = ["O", *[c for c in CLASS_IDS if c != "O"]]


def _stub():
    """A deterministic predictor: numbers of seven digits or more are ID_NUM, words after "My name is " names."""
    import re

    import numpy as np

    word, name, number = re.compile(r"\w+"), STUB_CLASSES.index("B-NAME_STUDENT"), STUB_CLASSES.index("B-ID_NUM")

    def one(chunk):
        found = list(word.finditer(chunk))
        scores = np.full((len(found), len(STUB_CLASSES)), 0.1 / (len(STUB_CLASSES) - 1))
        for i, m in enumerate(found):
            scores[i, number if m.group().isdigit() and len(m.group()) >= 7 else name if chunk.endswith("My name is ", 0, m.start()) else 0] = 0.9
        return np.array([m.span() for m in found]).reshape(-1, 2), scores

    return lambda chunks: [one(c) for c in chunks]


def model_authority(spark, d):
    """Labels per source when a scorer has run: it alone decides the labels it is the authority for."""
    docs = _labelled_texts(spark, d).dropDuplicates(["document"]).na.fill({"text": ""})
    df = scorer.detect_model(docs, _stub, STUB_CLASSES, name="stub")
    return exploded(analyze(df, model_spans="model_spans"), ["document"]).groupBy("label", "source").agg(F.count("*").alias("n"))


def gen_k12(spark, d):
    return generators.documents(spark, 2000, "hard")


def gen_essay(spark, d):
    return generators.essays(spark, 2000, seed=3)


def cued_quality(spark, d):
    docs = stage(corpus.rebuild(generators.documents(spark, 1000, "cued")), "cued")
    gold = docs.select("document", F.explode("gold").alias("g")).select("document", "g.label", "g.start", "g.end")
    pred = exploded(analyze(docs.select("document", "text")), ["document"]).select("document", "label", F.col("span_start").alias("start"), F.col("span_end").alias("end"))
    return metrics.prf(metrics.judged(gold, pred, labels=metrics.scope("all")))


def src_manifest(spark, d):
    return table(spark, d, "model_manifest").select("name", F.explode_outer("labels").alias("label"), F.coalesce("local_path", "hf_id").alias("place"))


def src_policies(spark, d):
    return policy_rows(spark, d).select("name", F.size("labels").cast("bigint").alias("labels")).orderBy("name")


def fp_policy(spark, d):
    text = F.concat_ws("\r\n", "name", "description")
    return policy_rows(spark, d).select("name", F.sha2(F.regexp_replace(text, "\r\n", "\n"), 256).alias("sha"))


def src_limit(spark, d):
    """The first hundred labelled documents of a file: the limit is the feature."""
    path = f"{shared_dir(spark)}/spanveil/limit-{uuid.uuid4().hex}"
    writers.corpus(_unique_docs(spark, d).select("document", "tokens", "labels"), path)
    return readers.corpus(spark, path, limit=100, lines=True).select("document")


def src_rest(spark, d):
    req = table(spark, d, "deid_results").select("request_id", F.col("original_text").alias("text"), F.lit("rules").alias("model_name"), F.lit(None).cast("array<string>").alias("labels"), "policy").distinct()
    checked = readers.check_requests(req, table(spark, d, "model_manifest"), policy_rows(spark, d))
    return checked.groupBy(F.col("status").cast("bigint").alias("status"), "problem").agg(F.count("*").alias("n"))


def snk_corpus(spark, d):
    path = f"{shared_dir(spark)}/spanveil/snk-corpus-{uuid.uuid4().hex}"
    writers.corpus(_unique_docs(spark, d).select("document", "tokens", "trailing_whitespace", "labels"), path)
    return readers.corpus(spark, path, lines=True).select("document", F.size("tokens").cast("bigint").alias("tokens"), F.size("labels").cast("bigint").alias("labels"))


def snk_json(spark, d):
    path = f"{shared_dir(spark)}/spanveil/snk-json-{uuid.uuid4().hex}"
    writers.results_json(_deid(spark, d, MIXED, "ferpa", date_shift_days=30), path)
    out = spark.read.text(path).select(F.from_json("value", "deidentified_text string, n_entities bigint, entities array<struct<label string, text string>>").alias("r"))
    return out.select(F.col("r.deidentified_text").alias("deidentified_text"), F.col("r.n_entities").alias("n"), F.exists("r.entities", lambda e: e["text"].isNotNull()).alias("has_values"))


def stream_masked(spark, d):
    """The labelled documents as a stream of files, masked: texts, spans acted on and leaks."""
    path = f"{shared_dir(spark)}/spanveil/stream-{uuid.uuid4().hex}"
    _labelled_texts(spark, d).filter("text is not null").write.parquet(f"{path}/in")
    live = spark.readStream.schema("document bigint, text string").parquet(f"{path}/in")
    out = stream.deidentify_stream(live).select("document", F.size("acted").alias("acted"), F.size("leaks").alias("leaks"))
    return stream.run_to_table(out, f"{path}/out").agg(F.count("*").alias("texts"), F.sum("acted").alias("acted"), F.sum("leaks").alias("leaks"))


def src_text(spark, d):
    """Masked texts written as plain text and read as whole files again."""
    path = f"{shared_dir(spark)}/spanveil/snk-text-{uuid.uuid4().hex}"
    writers.redacted_text(_deid(spark, d, NAMED, "ferpa").coalesce(1), path)
    whole = readers.texts(spark, path).select(F.explode(F.split("text", "\n")).alias("line")).filter("line <> ''")
    return whole.groupBy("line").agg(F.count("*").alias("n"))


def src_dataset(spark, d):
    """Prepared train and validation parts, written by part and read again."""
    path = f"{shared_dir(spark)}/spanveil/prepared-{uuid.uuid4().hex}"
    docs = _unique_docs(spark, d).select("document", "tokens", "trailing_whitespace", "labels")
    writers.prepared(corpus.split(docs), path)
    return readers.prepared(spark, f"{path}/documents").groupBy("part").agg(F.count("*").alias("n"))


def snk_report(spark, d):
    path = f"{shared_dir(spark)}/spanveil/report-{uuid.uuid4().hex}"
    writers.report(metrics.prf(metrics.judged(gold_rows(spark, d), pred_rows(spark, d))).na.fill({"label": "overall"}), path)
    return spark.read.schema("label string, tp bigint, fp bigint, fn bigint").json(path)


def resolve_model(spark, d):
    """Where each listed model is taken from when no local copy exists; a name that isn't listed stands for itself."""
    m = table(spark, d, "model_manifest").select("name", "local_path", "hf_id")
    asked = m.select("name").distinct().unionAll(spark.createDataFrame([("other/model",)], "name string"))
    return readers.resolve_models(asked, m)


def _rendered(spark, d, method):
    pol = policy.checked(policy_rows(spark, d)).select(F.col("name").alias("_n"), F.struct("*").alias("p"))
    s = table(spark, d, "spans").distinct().withColumn("_w", F.lit("district_default")).join(F.broadcast(pol), F.col("_n") == F.col("_w"))
    one = F.struct("label", "text")
    return s.select("span_id", redact.rendered(one, F.col("p").withField("labels", F.map_filter("p.labels", lambda k, v: F.lit(False))), F.lit(method), F.lit(30), redact.SALT, 0).alias("out"))


def r_mask(spark, d):
    return _rendered(spark, d, "mask")


def r_hash(spark, d):
    return _rendered(spark, d, "hash")


def r_keep(spark, d):
    return _rendered(spark, d, "keep")


def r_shift(spark, d):
    return _rendered(spark, d, "shift_dates")


def shift_days(spark, d):
    n = table(spark, d, "documents").select("doc_id", redact.shift_days(F.col("doc_id"), 42).alias("days"))
    return n.select("doc_id", ((F.abs("days") >= 1) & (F.abs("days") <= 365)).alias("within"))


def leak_gaps(spark, d):
    """A value that stands twice, acted on once: the second mention is a leak, though the output may hold it as a surrogate too."""
    df = table(spark, d, "nation").selectExpr("CAST(n_nationkey AS BIGINT) AS key", f"'Ask ' || {NAME} || ' or ' || {NAME} || '.' AS text", f"{NAME} AS v")
    span = F.array(F.struct(F.lit("NAME_STUDENT").alias("label"), F.col("v").alias("text"), F.lit(4).alias("start"), (F.length("v") + 4).alias("end"), F.lit("[X]").alias("out")))
    return df.select("key", redact.leaks_in(F.array_join(redact.splice(F.col("text"), span)["gaps"], "\n"), F.array("v")).alias("l")).select("key", F.explode("l").alias("leak"))


def spoken_email(spark, d):
    """Addresses spelled out in words are gold only: the rules find none of them."""
    docs = table(spark, d, "orders").select(F.col("o_orderkey").cast("bigint").alias("key"), F.concat(F.lit("its u"), F.col("o_orderkey").cast("string"), F.lit(" at mail dot example dot com")).alias("text"))
    return docs.select(F.size(detectors.detect(F.col("text"), ["EMAIL"])).alias("n")).agg(F.sum("n").cast("bigint").alias("found"))


def decode(spark, d):
    """Decoded spans of a deterministic scorer over all labelled documents."""
    docs = _labelled_texts(spark, d).filter("text is not null").dropDuplicates(["document"])
    out = scorer.detect_model(docs, _stub, STUB_CLASSES, name="stub").select("document", F.explode_outer("model_spans").alias("s")).filter("s is not null")
    return out.select("document", "s.label", "s.start", "s.end", "s.text", F.round("s.confidence", 4).alias("confidence"))


def subtoken_align(spark, d):
    docs = corpus.rebuild(_unique_docs(spark, d)).withColumn("chars", corpus.char_labels(F.col("tokens"), F.col("trailing_whitespace"), F.col("labels")))
    offsets = F.transform(corpus.tokenise(F.col("text")), lambda t: F.struct(t["start"].alias("s"), t["end"].alias("e")))
    docs = docs.select("document", "text", "chars", offsets.alias("o")).withColumn("cls", corpus.align(F.col("chars"), F.col("text"), F.col("o")))
    return docs.select("document", F.explode("cls").alias("cls")).groupBy("document", F.col("cls").cast("bigint").alias("cls")).agg(F.count("*").alias("n"))


def explode_windows(spark, d):
    docs = _unique_docs(spark, d).select("document", "tokens", "labels")
    return corpus.token_windows(docs, ["tokens", "labels"], 128, 32).select("document", F.col("window").cast("bigint").alias("window"), F.size("tokens").cast("bigint").alias("tokens"))


REGULATION = (
    ("records", "student's name", "NAME_STUDENT", "needs a model"), ("records", "family members' names", "NAME_RELATED", "partly"), ("records", "address", "STREET_ADDRESS", "partly"),
    ("records", "address", "LOCATION", "partly"), ("records", "personal identifier", "SSN", "found"), ("records", "personal identifier", "ID_NUM", "found"), ("records", "date of birth", "DATE", "partly"),
    ("records", "other information", "SCHOOL", "partly"), ("records", "other information", "AGE", "partly"), ("children", "online contact", "EMAIL", "found"), ("children", "online contact", "URL_PERSONAL", "found"),
    ("children", "screen name", "USERNAME", "found"), ("children", "telephone", "PHONE_NUM", "found"), ("children", "persistent identifier", "IP_ADDRESS", "found"), ("children", "persistent identifier", "DEVICE_ID", "found"),
    ("children", "geolocation", "GEO", "found"),
)


def regulation_map(spark, d):
    """What each kind of rule names, and how many reported spans of its labels there are."""
    dim = spark.createDataFrame(REGULATION, "rule string, item string, label string, status string")
    n = table(spark, d, "spans").groupBy("label").agg(F.count("*").alias("n"))
    return dim.join(n, "label", "left").select("rule", "item", "label", "status", F.coalesce("n", F.lit(0)).alias("n"))


def snk_synth(spark, d):
    """Generated documents written and read again: labels per style."""
    path = f"{shared_dir(spark)}/spanveil/snk-synth-{uuid.uuid4().hex}"
    docs = generators.documents(spark, 500, "cued").unionByName(generators.documents(spark, 500, "hard"))
    writers.corpus(docs, path)
    return readers.corpus(spark, path, lines=True).select(F.explode("labels").alias("label")).groupBy("label").agg(F.count("*").alias("n"))


def label_counts_by_day(spark, d):
    s = table(spark, d, "spans").distinct()
    return s.groupBy(F.window("detected_at", "1 day").start.cast("date").alias("day"), "label").agg(F.count("*").alias("n"))


OTHERS = {
    "masked_by_lang": masked_by_lang, "det_all": det_all, "det_labels": det_labels, "det_nothing": det_nothing, "propagate_customers": propagate_customers, "propagate": propagate, "analyze": analyze_query, "extract": extract, "by_label": by_label_query, "doc_email": doc_email,
    "overlaps": overlaps_query, "span_trim": span_trim, "resolve": resolve_query, "stopword": stopword, "digits_only": digits_only, "luhn": luhn, "url_is_personal": url_is_personal, "hash_value": hash_value,
    "shift_date": shift_date, "surrogate": surrogate, "tokenise": tokenise, "pol_filter": pol_filter, "method": method, "method_label": method_label, "deid_mask": deid_mask, "deid_coppa": deid_coppa,
    "deid_hash": deid_hash, "deid_replace": deid_replace, "deid_keep": deid_keep, "deid_requests": deid_requests, "replacements": replacements, "leak_check": leak_check, "quarantine": quarantine, "audit": audit,
    "audit_summary": audit_summary, "rebuild": rebuild, "rebuilt_text": rebuilt_text, "score": score, "exposed": exposed, "prf": prf, "label_scope": label_scope, "report": report, "leak_report": leak_report,
    "rules_quality": rules_quality, "is_positive": is_positive, "encode": encode, "char_project": char_project, "renumber": renumber, "split": split, "marks": marks, "essay_bio": essay_bio, "token_metrics": token_metrics,
    "f_beta": f_beta, "softmax": softmax, "argmax": argmax, "quant_agree": quant_agree, "win": win, "win_words": win_words, "decode_pieces": decode_pieces, "model_authority": model_authority, "gen_k12": gen_k12, "gen_essay": gen_essay, "cued_quality": cued_quality,
    "src_manifest": src_manifest, "src_policies": src_policies, "fp_policy": fp_policy, "src_limit": src_limit, "src_rest": src_rest, "snk_corpus": snk_corpus, "snk_json": snk_json, "snk_synth": snk_synth, "regulation_map": regulation_map,
    "label_counts_by_day": label_counts_by_day, "src_text": src_text, "stream_masked": stream_masked, "src_dataset": src_dataset, "snk_report": snk_report, "resolve_model": resolve_model, "r_mask": r_mask, "r_hash": r_hash, "r_keep": r_keep,
    "r_shift": r_shift, "shift_days": shift_days, "leak_gaps": leak_gaps, "spoken_email": spoken_email, "decode": decode, "subtoken_align": subtoken_align, "explode_windows": explode_windows,
    "names_corpus": names_corpus, "propagate_corpus": propagate_corpus, "coppa_corpus": coppa_corpus,
}


def _joined(built: Built, replace) -> str:
    """The text of a built row with its labelled parts replaced."""
    return " || ".join(f"({replace(e, l) if l else e})" for e, l in built.pieces())


def _masked(e: str, label: str) -> str:
    if label == "DATE":
        return f"strftime(CAST({e} AS DATE) + INTERVAL 30 DAY, '%Y-%m-%d')"
    return f"'[{label}]'"


def _hashed(e: str, label: str) -> str:
    return _masked(e, label) if label in ("DATE", "IP_ADDRESS") else f"substr(sha256('{redact.SALT}' || {e}), 1, 10)"


SHIFTED = "coalesce(" + ", ".join(f"strftime(try_strptime(v, '{f}') + INTERVAL 30 DAY, '{f}')" for f in ("%m/%d/%Y", "%m-%d-%Y", "%Y-%m-%d", "%B %d, %Y", "%b %d, %Y", "%B %d %Y")) + ")"
NONWORD = r"[^\p{L}\p{M}\p{Nd}\p{Pc}]"
MASKED = _joined(MIXED, _masked)

SQL = {
    "det_all": MIXED.sql(),
    "win_words": """SELECT key, windows, CASE WHEN windows > 1 THEN 1900 ELSE 5 * n END AS first_kept, 1800 * (windows - 1) AS last_start FROM (
        SELECT key, n, 1 + CAST(ceil(greatest(0, 5 * n - 2000) / 1800.0) AS BIGINT) AS windows FROM (SELECT CAST(c_custkey AS BIGINT) AS key, CAST(100 + c_custkey % 2000 AS BIGINT) AS n FROM customer))""",
    "decode_pieces": f"""SELECT CAST(c_custkey AS BIGINT) AS key, 'ID_NUM' AS label, {num('c_custkey', 7)} AS value, CAST(3 AS BIGINT) AS span_start, CAST(10 AS BIGINT) AS span_end, CAST(0.8 AS DOUBLE) AS confidence FROM customer
        UNION ALL SELECT CAST(c_custkey AS BIGINT), 'NAME_STUDENT', 'Ona ' || {CNAME}, 14, 18 + length({CNAME}), CAST(0.7 AS DOUBLE) FROM customer""",
    "det_nothing": f"SELECT CAST(c_custkey AS BIGINT) AS key, CAST(0 AS BIGINT) AS spans, CAST({len(HARMLESS)} AS BIGINT) AS texts FROM customer",
    "propagate_customers": CALLED.sql(),
    "essay_bio": r"""SELECT key, 8 + n AS tokens, n AS inside, 'B-NAME_STUDENT' AS seventh FROM (SELECT CAST(c_custkey AS BIGINT) AS key, CAST(len(regexp_extract_all(c_name, '\w+|[^\w\s]')) AS BIGINT) AS n FROM customer)""",
    "det_labels": MIXED.sql(lambda l: l in ("EMAIL", "IP_ADDRESS")),
    "propagate": NAMED.sql(),
    "analyze": MIXED.sql(),
    "by_label": f"SELECT key, label, CAST(1 AS BIGINT) AS n, value AS first_value FROM ({MIXED.sql()})",
    "doc_email": r"SELECT doc_id, unnest(regexp_extract_all(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b')) AS value FROM documents",
    "overlaps": """SELECT a.document, a.label AS label_a, b.label AS label_b, a.span_start::BIGINT AS start_a, b.span_start::BIGINT AS start_b
        FROM (SELECT DISTINCT document, label, span_start, span_end FROM spans) a JOIN (SELECT DISTINCT document, label, span_start, span_end FROM spans) b
        ON a.document = b.document AND a.label < b.label AND a.span_start < b.span_end AND b.span_start < a.span_end""",
    "span_trim": "SELECT o_orderkey::BIGINT AS key, o_orderkey::VARCHAR AS value FROM orders",
    "resolve": f"{RANKED} SELECT document, x.id AS span_id FROM (SELECT document, unnest(kept) AS x FROM last)",
    "stopword": "SELECT n_nationkey::BIGINT AS key, n_nationkey % 2 = 0 AS stop FROM nation",
    "digits_only": "SELECT o_orderkey::BIGINT AS key, strftime(o_orderdate, '%Y%m%d') AS digits FROM orders",
    "luhn": """SELECT key, list_sum([CASE WHEN i % 2 = 0 THEN CASE WHEN 2 * c > 9 THEN 2 * c - 9 ELSE 2 * c END ELSE c END FOR c, i IN digits]) % 10 = 0 AS ok
        FROM (SELECT o_orderkey::BIGINT AS key, [CAST(x AS INT) FOR x IN string_split(reverse(lpad((o_orderkey * 7919)::VARCHAR, 13, '4')), '')] AS digits FROM orders)""",
    "url_is_personal": "SELECT n_nationkey::BIGINT AS key, n_nationkey % 4 IN (0, 3) OR (n_nationkey % 4 = 2 AND n_nationkey % 8 >= 4) AS personal FROM nation",
    "hash_value": f"SELECT span_id, substr(sha256('{redact.SALT}' || text), 1, 10) AS hashed FROM spans",
    "shift_date": """SELECT o_orderkey::BIGINT AS key, strftime(o_orderdate::DATE + INTERVAL 30 DAY, '%m/%d/%Y') AS us, strftime(o_orderdate::DATE - INTERVAL 45 DAY, '%Y-%m-%d') AS iso,
        CASE WHEN month(o_orderdate::DATE) = 9 THEN '[DATE]' ELSE strftime(o_orderdate::DATE + INTERVAL 400 DAY, '%B %d, %Y') END AS long FROM orders""",
    "tokenise": r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[\p{L}\p{M}\p{Nd}\p{Pc}\p{Nl}\x{200C}\x{200D}]+|[^\p{L}\p{M}\p{Nd}\p{Pc}\p{Nl}\x{200C}\x{200D}\s\x{0B}\x{85}\p{Z}]')) AS BIGINT) AS tokens FROM documents WHERE text IS NOT NULL",
    "pol_filter": """SELECT p.name AS policy, s.label, count(*) AS n
        FROM (SELECT DISTINCT document, label, text, span_start, span_end, coalesce(confidence, 0) AS c, source, span_id FROM spans WHERE document IS NOT NULL AND span_start IS NOT NULL AND span_end IS NOT NULL) s, policies p
        WHERE p.labels[s.label] IS NOT NULL AND coalesce(p.labels[s.label].enabled, true) AND s.c >= coalesce(p.labels[s.label].min_confidence, p.min_confidence, 0) GROUP BY ALL""",
    "method": """SELECT request_id, CASE WHEN r.method IS NOT NULL AND coalesce(p.allow_method_override, true) THEN r.method ELSE coalesce(p.default_method, 'mask') END AS used
        FROM (SELECT DISTINCT request_id, policy, method FROM deid_results) r LEFT JOIN policies p ON r.policy = p.name""",
    "method_label": """SELECT name AS policy, e.key AS label, coalesce(e.value.method, default_method) AS method, coalesce(e.value.mask, '[' || e.key || ']') AS mask
        FROM (SELECT name, default_method, unnest(map_entries(labels)) AS e FROM policies) WHERE e.value IS NOT NULL""",
    "deid_mask": f"SELECT c_custkey::BIGINT AS key, {MASKED} AS deidentified_text FROM customer",
    "deid_coppa": f"SELECT n_nationkey::BIGINT AS key, {_joined(NAMED, lambda e, l: chr(39) + '[CHILD]' + chr(39))} AS deidentified_text FROM nation",
    "deid_hash": f"SELECT c_custkey::BIGINT AS key, {_joined(MIXED, _hashed)} AS deidentified_text FROM customer",
    "deid_keep": "SELECT c_custkey::BIGINT AS key, CAST(3 AS BIGINT) AS leaks FROM customer",
    "replacements": f"""SELECT n_nationkey::BIGINT AS key, original, '[STUDENT]' AS replaced FROM (
        SELECT n_nationkey, unnest(['Ona ' || {NAME}, {NAME}, 'Ona']) AS original FROM nation)""",
    "leak_check": rf"""SELECT DISTINCT request_id, v AS leak FROM (
            SELECT request_id, deidentified_text AS t, trim(unnest(map_keys(replacements))) AS v FROM (
                SELECT request_id, any_value(deidentified_text) AS deidentified_text, any_value(replacements) AS replacements FROM deid_results
                WHERE deidentified_text IS NOT NULL AND replacements IS NOT NULL GROUP BY request_id))
        WHERE length(v) >= 3 AND regexp_matches(t, '(?:^|{NONWORD})' || regexp_escape(v) || '(?:$|{NONWORD})')""",
    "quarantine": "SELECT count(*) AS n, 'clean' AS kind FROM customer UNION ALL SELECT 0, 'leaking'",
    "audit": f"""SELECT c_custkey::BIGINT AS key, 'ferpa' AS policy, 'mask' AS method, 5::BIGINT AS acted, 0::BIGINT AS below, length({MIXED.text()})::BIGINT AS input_chars, sha256({MASKED}) AS sha, 0::BIGINT AS leaks, 1::BIGINT AS emails FROM customer""",
    "audit_summary": """SELECT policy, e.key AS label, CAST(sum(e.value) AS BIGINT) AS acted, count(*) AS requests FROM (
        SELECT a.policy AS policy, unnest(map_entries(a.by_label)) AS e FROM (SELECT request_id, any_value(audit) AS a FROM deid_results WHERE audit IS NOT NULL GROUP BY request_id)) GROUP BY ALL""",
    "rebuild": f"""{GOLD} SELECT document, label, "start", "end" FROM gold""",
    "rebuilt_text": "SELECT document, sha256(array_to_string([t || CASE WHEN w[i] THEN ' ' ELSE '' END FOR t, i IN tokens], '')) AS sha FROM (SELECT document, any_value(tokens) AS tokens, any_value(trailing_whitespace) AS w FROM labelled_docs WHERE tokens IS NOT NULL GROUP BY document)",
    "score": f"{JUDGED} SELECT label, kind, count(*) AS n FROM kinds GROUP BY ALL",
    "exposed": f"""{JUDGED} SELECT document, label, "start", "end" FROM kinds WHERE exposed""",
    "prf": f"{JUDGED},{PRF} SELECT label, tp, fp, fn, round(p, 4) AS precision, round(r, 4) AS recall, CASE WHEN p + r > 0 THEN round(26 * p * r / (25 * p + r), 4) ELSE 0 END AS f5, exposed FROM pr",
    "label_scope": f"""{GOLD}{PRED} SELECT label, count(*) AS n FROM pred q WHERE label IN ({", ".join(repr(l) for l in metrics.scope("all"))})
        AND NOT EXISTS (SELECT 1 FROM gold g WHERE g.document = q.document AND g.label = q.label AND q."start" < g."end" AND g."start" < q."end") GROUP BY label""",
    "report": f"""{JUDGED},{PRF} SELECT 'spans' AS model, (SELECT count(*) FROM docs) AS docs, tp, fn, round(26 * p * r / (25 * p + r), 4) AS f5, tp + fn AS identifiers, exposed,
        round(1 - exposed / (tp + fn)::DOUBLE, 4) AS removed_under_any_label FROM pr WHERE label IS NULL""",
    "is_positive": "SELECT document, len(list_filter(any_value(labels), lambda x: upper(trim(coalesce(x, 'O'))) <> 'O')) > 0 AS positive FROM labelled_docs WHERE labels IS NOT NULL GROUP BY document",
    "encode": f"""{GOLD} SELECT document, CAST(CASE WHEN p = 'O' THEN 0 ELSE 2 * list_position([{", ".join(repr(l) for l in CORPUS_LABELS)}], label) - CASE WHEN p = 'B' THEN 1 ELSE 0 END END AS BIGINT) AS cls, count(*) AS n FROM opened GROUP BY ALL""",
    "char_project": f"""{GOLD}, c AS (SELECT document, CASE WHEN p = 'O' THEN 'O' ELSE p || '-' || label END AS label, n AS m FROM opened UNION ALL SELECT document, 'O', w FROM opened)
        SELECT document, label, CAST(sum(m) AS BIGINT) AS chars FROM c GROUP BY ALL HAVING sum(m) > 0""",
    "renumber": """WITH d AS (SELECT DISTINCT document, source FROM labelled_docs WHERE labels IS NOT NULL)
        SELECT CAST((SELECT max(document) FROM d WHERE source = 'real') + row_number() OVER (ORDER BY document) AS BIGINT) AS document, document AS was FROM d WHERE source = 'synthetic'""",
    "split": """WITH d AS (SELECT document, len(list_filter(any_value(labels), lambda x: upper(trim(coalesce(x, 'O'))) <> 'O')) > 0 AS pos, md5('42|' || document::VARCHAR) AS turn FROM labelled_docs WHERE labels IS NOT NULL GROUP BY document),
        n AS (SELECT *, row_number() OVER (ORDER BY turn, document) - 1 AS k, count(*) OVER () AS size FROM d),
        rest AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY turn, document) - 1 AS j, count(*) OVER (PARTITION BY pos) AS m FROM n WHERE k >= floor(size * 0.1))
        SELECT document, 'validation' AS part FROM n WHERE k < floor(size * 0.1) UNION ALL SELECT document, 'train' FROM rest WHERE pos OR j < floor(m * 0.3)""",
    "marks": """SELECT key, plain, label, s::BIGINT AS span_start, (s + n)::BIGINT AS span_end FROM (
        SELECT c_custkey::BIGINT AS key, 'By ' || c_name || ' aged ' || (c_custkey % 90)::VARCHAR || 'x.' AS plain, unnest([
            struct_pack(label := 'NAME_STUDENT', s := 3, n := length(c_name)), struct_pack(label := 'AGE', s := 9 + length(c_name), n := length((c_custkey % 90)::VARCHAR)),
            struct_pack(label := 'SSN', s := 9 + length(c_name) + length((c_custkey % 90)::VARCHAR), n := 1)], recursive := true) FROM customer)""",
    "token_metrics": """SELECT tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(26 * p * r / (25 * p + r), 6) AS f5 FROM (SELECT *, tp / (tp + fp)::DOUBLE AS p, tp / (tp + fn)::DOUBLE AS r FROM (
        SELECT count(*) FILTER (g > 0 AND g = q) AS tp, count(*) FILTER (q > 0 AND g <> q) AS fp, count(*) FILTER (g > 0 AND g <> q) AS fn FROM (SELECT o_orderkey % 5 AS g, (o_orderkey * 7 + o_orderkey % 3) % 5 AS q FROM orders)))""",
    "f_beta": "SELECT c_custkey::BIGINT AS key, CASE WHEN p + r > 0 THEN round(26 * p * r / (25 * p + r), 6) ELSE 0 END AS f5 FROM (SELECT c_custkey, (c_custkey % 101) / 100::DOUBLE AS p, (c_custkey % 97) / 96::DOUBLE AS r FROM customer)",
    "softmax": "SELECT vec_id, round(exp(e[1]) / list_sum([exp(x) FOR x IN e]), 6) AS p0, 1::DOUBLE AS total FROM (SELECT vec_id, [x::DOUBLE FOR x IN embedding[1:8]] AS e FROM embeddings)",
    "argmax": "SELECT vec_id, CAST(list_position(embedding[1:15], list_max(embedding[1:15])) - 1 AS BIGINT) AS cls FROM embeddings",
    "quant_agree": """SELECT round(avg(CAST(list_position(a, list_max(a)) = list_position(b, list_max(b)) AS INT)), 6) AS same_argmax, round(max(list_max([abs(x::DOUBLE - b[i]::DOUBLE) FOR x, i IN a])), 6) AS max_difference
        FROM (SELECT embedding[1:6] AS a, embedding[2:7] AS b FROM embeddings)""",
    "src_manifest": "SELECT name, unnest(CASE WHEN labels IS NULL OR len(labels) = 0 THEN [NULL] ELSE labels END) AS label, coalesce(local_path, hf_id) AS place FROM model_manifest",
    "src_policies": "SELECT name, CAST(cardinality(labels) AS BIGINT) AS labels FROM policies",
    "fp_policy": "SELECT name, sha256(replace(concat_ws(chr(13) || chr(10), name, description), chr(13) || chr(10), chr(10))) AS sha FROM policies",
    "src_limit": "SELECT DISTINCT document FROM labelled_docs WHERE labels IS NOT NULL ORDER BY document LIMIT 100",
    "src_rest": """SELECT CASE WHEN problem IS NULL THEN 200::BIGINT WHEN problem IN ('no text', 'text too long') THEN 422 ELSE 400 END AS status, problem, count(*) AS n FROM (
        SELECT CASE WHEN original_text IS NULL THEN 'no text' WHEN length(original_text) > 200000 THEN 'text too long' WHEN policy NOT IN (SELECT name FROM policies) THEN 'unknown policy' END AS problem
        FROM (SELECT DISTINCT request_id, original_text, policy FROM deid_results)) GROUP BY ALL""",
    "snk_corpus": "SELECT document, CAST(any_value(len(tokens)) AS BIGINT) AS tokens, CAST(any_value(len(labels)) AS BIGINT) AS labels FROM labelled_docs WHERE labels IS NOT NULL GROUP BY document",
    "snk_json": f"SELECT {MASKED} AS deidentified_text, 5::BIGINT AS n, false AS has_values FROM customer",
    "regulation_map": "SELECT rule, item, label, status, coalesce(n, 0) AS n FROM (VALUES " + ", ".join("(" + ", ".join("'" + v.replace("'", "''") + "'" for v in r) + ")" for r in REGULATION)
    + ") m(rule, item, label, status) LEFT JOIN (SELECT label, count(*) AS n FROM spans GROUP BY label) USING (label)",
    "src_text": "SELECT 'My name is [STUDENT]. We like [STUDENT]' || chr(39) || 's ideas and [STUDENT].' AS line, count(*) AS n FROM nation",
    "src_dataset": """WITH d AS (SELECT document, len(list_filter(any_value(labels), lambda x: upper(trim(coalesce(x, 'O'))) <> 'O')) > 0 AS pos, md5('42|' || document::VARCHAR) AS turn FROM labelled_docs WHERE labels IS NOT NULL GROUP BY document),
        n AS (SELECT *, row_number() OVER (ORDER BY turn, document) - 1 AS k, count(*) OVER () AS size FROM d),
        rest AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY turn, document) - 1 AS j, count(*) OVER (PARTITION BY pos) AS m FROM n WHERE k >= floor(size * 0.1))
        SELECT part, count(*) AS n FROM (SELECT 'validation' AS part FROM n WHERE k < floor(size * 0.1) UNION ALL SELECT 'train' FROM rest WHERE pos OR j < floor(m * 0.3)) GROUP BY part""",
    "snk_report": f"{JUDGED},{PRF} SELECT coalesce(label, 'overall') AS label, tp, fp, fn FROM pr",
    "resolve_model": "SELECT name, any_value(hf_id) AS place FROM model_manifest GROUP BY name UNION ALL SELECT 'other/model', 'other/model'",
    "r_mask": "SELECT span_id, '[' || label || ']' AS out FROM (SELECT DISTINCT * FROM spans)",
    "r_hash": f"SELECT span_id, substr(sha256('{redact.SALT}' || text), 1, 10) AS out FROM (SELECT DISTINCT * FROM spans)",
    "r_keep": "SELECT span_id, text AS out FROM (SELECT DISTINCT * FROM spans)",
    "r_shift": rf"""SELECT span_id, CASE WHEN label <> 'DATE' THEN '[' || label || ']' ELSE coalesce({SHIFTED}, '[DATE]') END AS out
        FROM (SELECT *, regexp_replace(replace(text, 'Sept', 'Sep'), '\s+', ' ', 'g') AS v FROM (SELECT DISTINCT * FROM spans))""",
    "shift_days": "SELECT doc_id, true AS within FROM documents",
    "leak_gaps": f"SELECT n_nationkey::BIGINT AS key, {NAME} AS leak FROM nation",
    "spoken_email": "SELECT CAST(0 AS BIGINT) AS found",
    "explode_windows": """SELECT document, w AS "window", CAST(least(n - 96 * w, 128) AS BIGINT) AS tokens FROM (
        SELECT document, n, unnest(range(0, CAST(greatest(0, ceil((n - 128) / 96.0)) AS BIGINT) + 1)) AS w FROM (SELECT document, any_value(len(tokens)) AS n FROM labelled_docs WHERE labels IS NOT NULL GROUP BY document))""",
    "label_counts_by_day": "SELECT CAST(detected_at AS DATE) AS day, label, count(*) AS n FROM (SELECT DISTINCT * FROM spans) GROUP BY ALL",
}
SQL |= {name: b.sql() for name, b in BUILT.items()}


def queries():
    return {name: b.spans for name, b in BUILT.items()} | OTHERS


def oracle_sql():
    return dict(SQL)
