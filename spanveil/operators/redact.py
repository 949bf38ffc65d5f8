"""Acting on spans: policy filter, rendering, splicing, leak check and audit record, all as column expressions."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

import spanveil
from spanveil.functions.spans import by_start, fenced, let, no_spans, quoted
from spanveil.operators.policy import METHODS
from spanveil.schema import AUTHORITY_LABELS, SPANS_DDL

# They show in the results.
SALT, HASH_LENGTH, LEAST_LEAK = "spanveil", 10, 3
FIRST = "Ada Bela Cato Dina Enzo Fay Gus Hedy Ivo Jana Kip Lena Milo Nora Otis Pia Rolf Sia Theo Uma Vito Wanda Xeno Yves Zora".split()
LAST = "Abel Birch Crane Drum Elm Frost Gale Heath Ives Jarvis Kline Lark Marsh North Oaks Pratt Quist Reeve Stone Thorn Upton Vance West York Zeller".split()
ENDINGS = "bank bell bourne bury by combe dale den field ford gate ham hurst land ley man mere more ridge shaw son ton well wick".split()
STREETS = "Amber Birch Cedar Dogwood Elder Fir Gorse Hazel Ivy Juniper".split()
KINDS = "Street Avenue Road Lane Court".split()
DATE_FORMATS = (("M/d/yyyy", "MM/dd/yyyy"), ("M-d-yyyy", "MM-dd-yyyy"), ("yyyy-M-d", "yyyy-MM-dd"), ("MMMM d, yyyy", "MMMM dd, yyyy"), ("MMM d, yyyy", "MMM dd, yyyy"), ("MMMM d yyyy", "MMMM dd yyyy"))


def hash_value(value: Column, salt: Column | str = SALT, length: int = HASH_LENGTH) -> Column:
    s = F.lit(salt) if isinstance(salt, str) else salt
    return F.substring(F.sha2(F.concat(s, value), 256), 1, length)


def shift_date(value: Column, days: Column | int) -> Column:
    """The date moved by some days in the same format, ``[DATE]`` if it is in none."""
    n = F.lit(days) if isinstance(days, int) else days
    v = F.regexp_replace(F.replace(value, F.lit("Sept"), F.lit("Sep")), r"\s+", " ")
    shifted = [F.date_format(F.date_add(F.try_to_timestamp(v, F.lit(a)).cast("date"), n), b) for a, b in DATE_FORMATS]
    return F.coalesce(*shifted, F.lit("[DATE]"))


def shift_days(document: Column, seed: int) -> Column:
    """A document's own shift: between 1 and 365 days forward or back, never 0."""
    h = F.xxhash64(document.cast("string"), F.lit(seed))
    return ((F.pmod(h, F.lit(365)) + 1) * F.when(F.pmod(F.shiftright(h, 17), F.lit(2)) == 0, 1).otherwise(-1)).cast("int")


def surrogate(label: Column, value: Column, seed: int = 0) -> Column:
    """A made-up value of the label's shape: the same for equal values (case and outer blanks aside) in every document, never
    the value itself."""
    same = F.lower(F.trim(value))

    def made(turn: int) -> Column:
        def pick(words: list[str], salt: str) -> Column:
            h = F.pmod(F.xxhash64(F.lit(seed), F.lit(turn), F.lit(salt), label, same), F.lit(len(words)))
            return F.get(F.split(F.lit("|".join(words)), r"\|"), h.cast("int"))

        def number(digits: Column | int, salt: str) -> Column:
            n = F.lit(digits) if isinstance(digits, int) else digits
            h = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.lit(str(turn)), F.lit(salt), label, same), 256)
            return F.substring(F.repeat(F.translate(h, "abcdef", "012345"), F.ceil(n / 64).cast("int")), F.lit(1), n)

        user = F.concat(F.lower(pick(FIRST, "u")), number(3, "u"))
        digits = F.length(F.regexp_replace(value, r"(?U)\D", ""))
        date = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.pmod(F.xxhash64(F.lit(seed), F.lit(turn), same), F.lit(18262)).cast("int")), "MM/dd/yyyy")
        # A family name of two parts: 24 first names by 24 by 24 endings.
        family = F.concat(pick(LAST, "l"), pick(ENDINGS, "e"))
        return (
            F.when(label.isin("NAME_STUDENT", "NAME_RELATED"), F.when(F.trim(value).rlike(r"(?U)\s"), F.concat_ws(" ", pick(FIRST, "f"), family)).otherwise(pick(FIRST, "f")))
            .when(label == "EMAIL", F.concat(user, F.lit("@mail.example.com")))
            .when(label == "USERNAME", user)
            .when(label == "ID_NUM", number(F.greatest(F.lit(6), digits), "i"))
            .when(label == "PHONE_NUM", F.concat(F.lit("555-"), number(3, "p"), F.lit("-"), number(4, "q")))
            .when(label == "URL_PERSONAL", F.concat(F.lit("https://example.com/"), user))
            .when(label == "STREET_ADDRESS", F.concat_ws(" ", number(3, "s"), pick(STREETS, "s"), pick(KINDS, "k")))
            .when(label == "SSN", F.concat(F.lit("900-"), number(2, "a"), F.lit("-"), number(4, "b")))
            .when(label == "DATE", date)
            .otherwise(F.concat(F.lit("["), label, F.lit("]")))
        )

    return let(made(0), lambda one: F.when(one != value, one).otherwise(_other(label, one)))


def _other(label: Column, made: Column) -> Column:
    """A value of the same shape that differs from a given one: its last digit or, without any, its first word changed to the next one."""
    digit = F.regexp_extract(made, r"(\d)\D*\z", 1)
    turned = F.regexp_replace(made, r"\d(\D*)\z", F.concat(F.pmod(digit.cast("int") + 1, F.lit(10)).cast("string"), F.lit("$1")))
    first = F.substring_index(made, " ", 1)
    following = F.create_map(*[F.lit(x) for k, w in enumerate(FIRST) for x in (w, FIRST[(k + 1) % len(FIRST)])])
    renamed = F.concat(F.coalesce(F.try_element_at(following, first), F.concat(F.lit("New "), first)), F.substring(made, F.length(first) + 1, F.length(made)))
    return F.when(digit != "", turned).when(made.startswith("["), F.concat(F.lit("["), label, F.lit("_X]"))).otherwise(renamed)


def label_rule(policy: Column, label: Column) -> Column:
    return F.try_element_at(policy["labels"], label)


def acted_on(spans: Column, policy: Column) -> Column:
    """Spans whose label the policy enables, at its confidence; a label that is absent or null is not enabled."""

    def keep(s: Column) -> Column:
        rule = label_rule(policy, s.label)
        low = F.coalesce(rule["min_confidence"], policy["min_confidence"], F.lit(0.0))
        return rule.isNotNull() & F.coalesce(rule["enabled"], F.lit(True)) & (s.confidence >= low)

    return by_start(F.filter(spans, lambda s: F.coalesce(keep(s), F.lit(False))))


def method_of(policy: Column, asked: Column | str | None) -> Column:
    """The caller's method if given and allowed, else the policy's."""
    ask = F.lit(asked).cast("string") if asked is None or isinstance(asked, str) else asked
    allowed = F.coalesce(policy["allow_method_override"], F.lit(True))
    return F.when(ask.isNotNull() & allowed, ask).otherwise(F.coalesce(policy["default_method"], F.lit("mask")))


def rendered(s: Column, policy: Column, method: Column, days: Column, salt: str, seed: int, methods: Collection[str] = METHODS) -> Column:
    """What takes the place of a span; a label's own method wins.  ``methods`` are those that can occur: the others stay out of
    the plan."""
    rule = label_rule(policy, s.label)
    m = F.coalesce(rule["method"], method)
    tag = F.concat(F.lit("["), s.label, F.lit("]"))
    how = {
        "mask": lambda: F.coalesce(rule["mask"], tag),
        "replace": lambda: surrogate(s.label, s["text"], seed),
        "hash": lambda: hash_value(s["text"], salt),
        "shift_dates": lambda: F.when(s.label == "DATE", shift_date(s["text"], days)).otherwise(tag),
        "keep": lambda: s["text"],
    }
    wrong = F.raise_error(F.concat(F.lit("unknown method "), F.coalesce(m, F.lit("null"))))
    out = None
    for name in METHODS:
        if name in methods:
            out = F.when(m == name, how[name]()) if out is None else out.when(m == name, how[name]())
    return wrong.cast("string") if out is None else out.otherwise(wrong)


ACTED_DDL = "array<struct<label:string,text:string,start:int,end:int,out:string>>"


def render_all(spans: Column, policy: Column, method: Column, days: Column, salt: str = SALT, seed: int = 0, methods: Collection[str] = METHODS) -> Column:
    return F.transform(
        spans,
        lambda s: F.struct(
            s.label.alias("label"), s["text"].alias("text"), s["start"].alias("start"), s["end"].alias("end"),
            rendered(s, policy, method, days, salt, seed, methods).alias("out"),
        ),
    )


def splice(text: Column, acted: Column) -> Column:
    """``parts`` (the output in pieces) and ``gaps`` (what was left in place), for spans in order without overlap."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"), F.array().cast("array<string>").alias("gaps"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc.at + 1, s["start"] - acc.at)
        return F.struct(s["end"].alias("at"), F.concat(acc.parts, F.array(gap, s.out)).alias("parts"), F.array_append(acc.gaps, gap).alias("gaps"))

    def finish(acc: Column) -> Column:
        tail = F.substring(text, acc.at + 1, F.length(text))
        return F.struct(F.array_append(acc.parts, tail).alias("parts"), F.array_append(acc.gaps, tail).alias("gaps"))

    return F.aggregate(acted, start, step, finish)


def leaks_in(text: Column, values: Column) -> Column:
    """Values of three characters or more that stand in a text as whole words, once each, in order."""
    clean = F.transform(values, lambda v: F.regexp_replace(v, r"(?U)^\s+|\s+\z", ""))
    return F.array_distinct(
        # Plain containment first: a pattern of its own is made only for the few values that are there at all.
        F.filter(clean, lambda v: (F.length(v) >= LEAST_LEAK) & F.contains(text, v) & F.regexp_like(text, F.concat(F.lit(r"(?U)(?<!\w)"), quoted(v), F.lit(r"(?!\w)"))))
    )


def counts_by_label(acted: Column) -> Column:
    """Spans per label, labels in order."""
    labels = F.array_sort(F.array_distinct(F.transform(acted, lambda s: s.label)))
    return F.map_from_entries(F.transform(labels, lambda l: F.struct(l, F.size(F.filter(acted, lambda s: s.label == l)).cast("bigint"))))


def replacements(acted: Column) -> Column:
    """Original to replacement; the last one wins."""
    back = F.reverse(acted)
    keys = F.array_distinct(F.transform(back, lambda s: s["text"]))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.filter(back, lambda s: s["text"] == k)[0].out)))


def apply(
    df: DataFrame,
    policy: str,
    text: str = "text",
    spans: str = "spans",
    method: Column | str | None = None,
    date_shift_days: int | None = None,
    document: str | None = None,
    seed: int = 0,
    salt: str = SALT,
    policy_sha256: Column | None = None,
    detector: str | None = "detector",
    o_threshold: float | None = None,
    authority: Collection[str] = AUTHORITY_LABELS,
    verify: bool = True,
    methods: Collection[str] = METHODS,
) -> DataFrame:
    """Add ``method_used, acted, deidentified_text, replacements, leaks, audit`` to texts with spans.

    ``policy`` names a struct column with the fields of a policy row (see ``spanveil.schema.POLICY_DDL``).  Without a shift of its
    own, a policy shifts dates by an amount drawn per document.  A null text gives null text, no leaks and an audit with zero counts.
    """
    if date_shift_days == 0:
        raise ValueError("a shift of 0 days leaves every date as it is")
    pol, t = F.col(policy), F.col(text)
    own = F.when(pol["date_shift_days"] != 0, pol["date_shift_days"])
    drawn = shift_days(F.col(document), seed) if document else shift_days(F.coalesce(t, F.lit("")), seed)
    days = F.lit(date_shift_days) if date_shift_days else F.coalesce(own, drawn)
    df = df.withColumn("method_used", method_of(pol, method)).withColumn("_days", days.cast("int"))
    df = df.withColumn("_kept", acted_on(F.coalesce(F.col(spans), no_spans()).cast(SPANS_DDL), pol))
    df = fenced(df, "acted", render_all(F.col("_kept"), pol, F.col("method_used"), F.col("_days"), salt, seed, methods))
    df = df.withColumn("_cut", F.when(t.isNotNull(), splice(t, F.col("acted"))))
    df = df.withColumn("deidentified_text", F.array_join("_cut.parts", ""))
    df = df.withColumn("_same", F.array_distinct(F.transform(F.filter("acted", lambda s: s.out == s["text"]), lambda s: s["text"])))
    left = F.coalesce(F.array_join("_cut.gaps", "\n"), F.lit(""))
    df = df.withColumn("_left", left)
    stay = leaks_in(F.col("_left"), F.transform("acted", lambda s: s["text"]))
    df = fenced(df, "leaks", F.concat(F.col("_same"), F.array_except(stay, F.col("_same"))))
    df = df.withColumn("replacements", replacements(F.col("acted")))
    model = F.col(detector) if detector else F.lit("rules")
    df = df.withColumn(
        "audit",
        F.struct(
            F.lit(spanveil.__version__).alias("version"),
            F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("ts"),
            pol["name"].alias("policy"),
            (policy_sha256 if policy_sha256 is not None else F.lit(None).cast("string")).alias("policy_sha256"),
            F.col("method_used").alias("method"),
            F.size("acted").cast("bigint").alias("entities_acted_on"),
            (F.size(F.coalesce(F.col(spans), no_spans())) - F.size("acted")).cast("bigint").alias("entities_below_policy_threshold"),
            counts_by_label(F.col("acted")).alias("by_label"),
            F.coalesce(F.length(t), F.lit(0)).cast("bigint").alias("input_chars"),
            F.sha2(F.coalesce(F.col("deidentified_text"), F.lit("")), 256).alias("output_sha256"),
            F.size("leaks").cast("bigint").alias("leaks_found"),
            model.alias("detector"),
            F.when(model == "rules", F.array().cast("array<string>")).otherwise(F.array(*[F.lit(l) for l in sorted(authority)]).cast("array<string>")).alias("model_authority"),
            F.lit(o_threshold).cast("double").alias("o_threshold"),
            F.lit(verify).alias("verified"),
        ),
    )
    return df.drop("_days", "_kept", "_cut", "_same", "_left")


def verified(df: DataFrame) -> DataFrame:
    """Strict mode: the query fails at the first row that leaks."""
    broken = F.raise_error(F.concat(F.lit("de-identification leak in "), F.size("leaks").cast("string"), F.lit(" values")))
    return df.withColumn("deidentified_text", F.when(F.size("leaks") > 0, broken.cast("string")).otherwise(F.col("deidentified_text")))


def quarantined(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows without leaks, and the ones that must not be released."""
    return df.filter(F.size("leaks") == 0), df.filter(F.size("leaks") > 0)


def as_record(spans: str = "spans", include_values: bool = True) -> Column:
    """A result as a nested record, with or without the values found."""
    s = F.col(spans) if include_values else F.transform(spans, lambda x: x.dropFields("text"))
    return F.struct(
        F.col("deidentified_text"), s.alias("entities"), F.col("method_used").alias("method"), F.col("audit.policy").alias("policy"),
        F.size(spans).alias("n_entities"), F.col("audit"),
    )
