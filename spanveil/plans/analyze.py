"""Top-level detection and de-identification of a DataFrame of texts."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.functions.spans import fenced, no_spans, resolve
from spanveil.operators import detectors, propagate as names, scorer
from spanveil.schema import ALL_LABELS, AUTHORITY_LABELS, SPANS_DDL


@dataclass(frozen=True)
class Model:
    """A token classifier: the id it is known by, what loads it on a worker, and its classes in order."""

    name: str
    load: Callable
    classes: Sequence[str]


def analyze(
    df: DataFrame,
    text: str = "text",
    labels: Iterable[str] | None = None,
    model_spans: str | None = None,
    use_rules: bool = True,
    propagate: bool = True,
    authority: Iterable[str] = AUTHORITY_LABELS,
    out: str = "spans",
    model: Model | None = None,
    model_name: str | None = None,
    threshold: float = 0.5,
    o_threshold: float | None = None,
) -> DataFrame:
    """Add the array of spans of a text column, and ``detector``, what made them.

    With a ``model`` its spans are added, at ``threshold`` or, with ``o_threshold``, wherever P(O) is below that.  ``model_name`` "rules"
    leaves it out; a model asked for by its name must load, otherwise rules run alone when it can't (``scorer.model_gate``).
    ``model_spans`` names a column of spans a scorer has made; then the labels of ``authority`` come from it alone and
    their detectors stay out of the plan.  An empty ``labels`` means all.  A null text has no spans.
    """
    if model_name not in (None, "rules") and (model is None or model.name != model_name):
        raise scorer.ModelUnavailable(f"model {model_name!r} is not available")
    ran = "rules" if model_spans is None else "model"
    if model_spans is None and scorer.model_gate(model_name, model and model.load) == "model":
        df = scorer.detect_model(df, model.load, model.classes, text, model.name, threshold, o_threshold, out="_model_spans")
        model_spans, ran = "_model_spans", model.name
    wanted = list(labels or ())
    authority = set(authority or ())
    rule_labels = [l for l in (wanted or ALL_LABELS) if model_spans is None or l not in authority]
    t = F.col(text)
    found = detectors.detect(t, rule_labels) if use_rules and rule_labels else no_spans()
    if model_spans is not None:
        mine = F.coalesce(F.col(model_spans).cast(SPANS_DDL), no_spans())
        if wanted:
            mine = F.filter(mine, lambda s: s.label.isin(*wanted))
        found = F.concat(found, F.transform(mine, lambda s, i: s.withField("seq", (F.lit(30_000_000) + i).cast("int"))))
    df = df.withColumn("_found", found)
    if propagate:
        df = df.withColumn("_needles", names.needles(F.col("_found")))
        every = resolve(names.propagate(t, F.col("_found"), F.col("_needles")))
        df = fenced(df, out, F.when(t.isNull(), no_spans()).otherwise(every)).drop("_needles")
    else:
        df = fenced(df, out, resolve(F.col("_found")))
    return df.drop("_found", "_model_spans").withColumn("detector", F.lit(ran))


def exploded(df: DataFrame, keys: list[str], spans: str = "spans") -> DataFrame:
    """One row per span.

    An outer explode with a filter after it: a plain one makes the optimizer put "not empty" below the projection, where
    all detectors would run a second time.
    """
    s = F.col("_s")
    return df.select(*keys, F.explode_outer(spans).alias("_s")).filter("_s is not null").select(
        *keys, s.label.alias("label"), s["text"].alias("span_text"), s["start"].alias("span_start"), s["end"].alias("span_end"), s.confidence.alias("confidence"), s.source.alias("source")
    )


def by_label(df: DataFrame, key: str, spans: str = "spans") -> DataFrame:
    """Values of each label of a text in order of appearance, and the order in which labels first appear."""
    e = df.select(key, F.posexplode_outer(spans).alias("at", "_s")).filter("_s is not null").select(key, "at", F.col("_s.label").alias("label"), F.col("_s.text").alias("v"))
    return e.groupBy(key, "label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x.v).alias("values"), F.min("at").alias("first_at")
    )


def deidentify(
    df: DataFrame,
    policy: str | DataFrame = "ferpa",
    text: str = "text",
    policy_name: str | None = None,
    method=None,
    model_spans: str | None = None,
    verify: bool = True,
    model: Model | None = None,
    model_name: str | None = None,
    threshold: float = 0.5,
    o_threshold: float | None = None,
    **options,
) -> DataFrame:
    """Detect and transform; the audit record says which model and threshold on P(O) were used.

    ``policy`` is the name or path of one policy, or a table of policies that ``policy_name`` (a column of ``df``) looks up; a row
    whose policy is not in the table gets nothing acted on.  ``verify`` makes the query fail on a leak; use
    ``redact.quarantined`` without it to set leaking rows aside.
    """
    from spanveil.operators import policy as policies
    from spanveil.operators import redact

    found = analyze(df, text, model_spans=model_spans, model=model, model_name=model_name, threshold=threshold, o_threshold=o_threshold)
    options["o_threshold"] = o_threshold
    if isinstance(policy, str):
        sha = F.lit(policies.fingerprint(policy))
        chosen = policies.load(policy)
        if method is None or isinstance(method, str):
            # Only what can occur enters the plan.
            options.setdefault("methods", {m for m in (method, chosen["default_method"], *(r[1] for r in chosen["labels"].values())) if m})
        found = found.withColumn("policy_row", policies.literal(chosen))
    else:
        rows, sha = policies.checked(policy), None
        side = rows.select(F.col("name").alias("_policy"), F.struct(*rows.columns).alias("policy_row"))
        found = found.join(F.broadcast(side), F.col(policy_name) == F.col("_policy"), "left").drop("_policy")
    out = redact.apply(found, "policy_row", text, method=method, policy_sha256=sha, verify=verify, **options).drop("policy_row")
    return redact.verified(out) if verify else out
