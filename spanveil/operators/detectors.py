"""Detectors: one builder per label, text column in, array of spans out.

Only the detectors of the wanted labels enter the plan.  Each is guarded by a cheap test, and its pattern is a literal, so it
is compiled once per task.  ``seq`` keeps the order of emission, which decides full ties.
"""

from __future__ import annotations

import re
import string
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanveil.functions import lexicon as X
from spanveil.functions.spans import drop_blank, guarded, hits, let, no_spans, resolve, span, union, unmarked
from spanveil.schema import ALL_LABELS


DIGITS, CAPITALS = string.digits, string.ascii_uppercase


def digits_only(value: Column) -> Column:
    return F.regexp_replace(value, r"(?U)\D", "")


def any_word(words: Iterable[str]) -> str:
    """A pattern for one of some words, taken literally: one literal in the plan, not one per word."""
    return "(?:" + "|".join(re.escape(w) for w in words) + ")"


STOP_FIRST = r"(?U)^\s*" + any_word(X.NAME_STOP) + r"(?!\S)"
STOP_WORD, KIND_WORD = "^" + any_word(X.NAME_STOP) + r"\z", "^" + any_word(X.SCHOOL_KINDS) + r"\z"


def is_stopword(value: Column) -> Column:
    """Whether a value starts with a word that starts no name."""
    return value.rlike(STOP_FIRST)


def is_luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def url_is_personal(url: Column, before: Column) -> Column:
    """A link to a person's page: a known kind of profile, or else not an allowed site, and with a path or called one's own."""
    u = F.lower(url)
    path = F.regexp_replace(u, r"^(?:https?://)?[^/]+", "")
    path = F.regexp_replace(path, r"""^[/.,;:)\]}'"]+|[/.,;:)\]}'"]+\z""", "")
    return F.when(u.rlike(any_word(X.URL_PERSONAL)), True).when(u.rlike(any_word(X.URL_ALLOWED)), False).when(path == "", before.rlike(X.OWN_SITE)).otherwise(True)


def starting(chars: str, pattern: str) -> str:
    """A pattern whose matches start with one of some characters, or one outside ASCII: this is tested first at each place of a text,
    which is cheaper than anything else in a pattern and fails at most of them.

    The test names the ASCII characters that can't start a match, one by one: the JVM looks those up in a table of bits, while ranges
    and unions are tested one after the other.
    """
    never = "".join(f"\\x{c:02x}" for c in range(128) if chr(c) not in chars)
    return f"(?![{never}])(?:{pattern})"


def _whole(label: str, pattern: str, conf: float, base: int, guard: Callable[[Column], Column] | None = None, keep=None) -> Callable[[Column], Column]:
    def build(text: Column) -> Column:
        found = hits(text, pattern)
        if keep is not None:
            found = F.filter(found, lambda h: keep(text, h))
        made = F.transform(found, lambda h, i: span(label, h["start"], h["text"], conf, i + base))
        return made if guard is None else guarded(text, guard(text), made)

    return build


def _group(h: Column, count: int) -> Column:
    """The first group that took part."""
    return F.coalesce(*[F.when(h.groups[k] != "", h.groups[k]) for k in range(count)], F.lit(""))


def _at_end(h: Column, value: Column) -> Column:
    return h["end"] - F.length(value)


def _tail(label: str, pattern: str, groups: int, conf: float, base: int, keep) -> Callable[[Column], Column]:
    """Detectors whose value is a group that ends the match."""

    def build(text: Column) -> Column:
        found = F.filter(hits(text, pattern, groups), lambda h: keep(_group(h, groups)))
        return F.transform(found, lambda h, i: span(label, _at_end(h, _group(h, groups)), _group(h, groups), conf, i + base))

    return build


def _phone_keep(text: Column, h: Column) -> Column:
    return F.length(digits_only(h["text"])).between(*X.PHONE_DIGITS)


def _url(pattern: str, base: int, guard: Callable[[Column], Column]) -> Callable[[Column], Column]:
    def keep(text: Column, h: Column) -> Column:
        begin = F.greatest(F.lit(0), h["start"] - X.URL_CONTEXT)
        before = F.substring(text, begin + 1, h["start"] - begin)
        return ~before.endswith("@") & url_is_personal(h["text"], before)

    return _whole("URL_PERSONAL", pattern, 0.9, base, guard, keep)


def _username(text: Column) -> Column:
    def value(h: Column) -> Column:
        return F.regexp_replace(_group(h, 5), r"\.+\z", "")

    def which(h: Column) -> Column:
        out = F.lit(0)
        for k in (5, 4, 3, 2, 1):
            out = F.when(h.groups[k - 1] != "", k).otherwise(out)
        return out

    def keep(h: Column) -> Column:
        v, g = value(h), which(h)
        begin = F.greatest(F.lit(0), h["start"] - 1)
        around = F.substring(text, begin + 1, h["end"] + 1 - begin)
        heading = (g == 2) & v.rlike(r"(?U)^\p{L}+\z") & v.rlike(r"^\p{Lu}")
        return (
            (g > 0) & ~around.rlike(X.EMAIL) & (F.length(v) >= 3) & v.rlike(r"(?U)\p{L}") & ~heading
            & ~((g == 3) & F.lower(v).rlike("^" + any_word(X.USERNAME_STOP) + r"\z"))
        )

    found = F.filter(hits(text, starting("@uUsSgGhHlLdDiItTrRxXpP", X.USERNAME), 5), keep)
    return F.transform(found, lambda h, i: span("USERNAME", _at_end(h, _group(h, 5)), _group(h, 5), 0.9, i + 6_000_000))


def _id_bare(text: Column) -> Column:
    def keep(h: Column) -> Column:
        return (F.length(digits_only(h["text"])) >= X.ID_LEAST_DIGITS) & ~h["text"].rlike(X.NOT_ID)

    def conf(h: Column) -> Column:
        d = digits_only(h["text"])
        return F.when((F.length(d) >= 13) & is_luhn(d), 0.95).when(F.length(d) >= 7, 0.75).otherwise(0.6)

    found = F.filter(hits(text, starting(CAPITALS + DIGITS + "-", f"(?=[{CAPITALS}{DIGITS}-]{{7}})" + X.ID_BARE)), keep)
    return F.transform(found, lambda h, i: span("ID_NUM", h["start"], h["text"], conf(h), i + 8_000_000))


def _school(text: Column) -> Column:
    """Leading words that open a sentence are no part of the name, and a name of generic words only is none."""

    def words(h: Column) -> Column:
        return F.regexp_extract_all(h.groups[0], F.lit(r"\S+\s*"), F.lit(0))

    def name(h: Column) -> Column:
        start = F.struct(F.lit(True).alias("lead"), F.lit(0).alias("skip"), F.lit(True).alias("generic"))

        def step(acc: Column, w: Column) -> Column:
            bare = F.regexp_replace(w, r"\s+\z", "")
            drop = acc.lead & bare.rlike(STOP_WORD)
            return F.struct(
                drop.alias("lead"),
                F.when(drop, acc.skip + F.length(w)).otherwise(acc.skip).alias("skip"),
                (acc.generic & (drop | bare.rlike(KIND_WORD))).alias("generic"),
            )

        return F.aggregate(words(h), start, step)

    cut = F.transform(hits(text, starting(CAPITALS, X.SCHOOL), 1), lambda h: F.struct(h["start"].alias("start"), h["text"].alias("text"), (h.groups[0] == "").alias("of"), name(h).alias("n")))
    found = F.filter(cut, lambda c: c.of | ~c.n.generic)

    def make(c: Column, i: Column) -> Column:
        skip = F.when(c.of, 0).otherwise(c.n.skip)
        return span("SCHOOL", c["start"] + skip, F.substring(c["text"], skip + 1, F.length(c["text"])), 0.75, i + 14_000_000)

    return guarded(text, text.rlike(X.SCHOOL_GUARD), F.transform(found, make))


def _location(text: Column) -> Column:
    found = F.filter(hits(text, starting(CAPITALS + "imwb", X.LOCATION), 2), lambda h: ~is_stopword(_group(h, 2)))

    def make(h: Column, i: Column) -> Column:
        first = h.groups[0] != ""
        return span("LOCATION", F.when(first, h["start"]).otherwise(_at_end(h, h.groups[1])), _group(h, 2), 0.75, i + 15_000_000)

    return F.transform(found, make)


def _age(text: Column) -> Column:
    found = F.filter(hits(text, starting(DIGITS + "aAtTiI", X.AGE), 4), lambda h: _group(h, 4).cast("int") > 0)

    def make(h: Column, i: Column) -> Column:
        early = (h.groups[0] != "") | (h.groups[1] != "")
        return span("AGE", F.when(early, h["start"]).otherwise(_at_end(h, _group(h, 4))), _group(h, 4), 0.8, i + 16_000_000)

    return F.transform(found, make)


_name_ok = lambda v: ~is_stopword(v)
_any = lambda v: F.lit(True)
HEX = string.hexdigits

#: Name of a detector, its label and its builder, in order of emission.
DETECTORS: tuple[tuple[str, str, Callable[[Column], Column]], ...] = (
    ("email", "EMAIL", _whole("EMAIL", X.EMAIL, 0.99, 0, lambda t: t.contains("@"))),
    ("ssn", "SSN", _whole("SSN", starting(DIGITS, X.SSN), 0.97, 1_000_000)),
    ("phone", "PHONE_NUM", _whole("PHONE_NUM", starting(DIGITS + "(+", X.PHONE), 0.95, 2_000_000, None, _phone_keep)),
    ("url", "URL_PERSONAL", _url(starting("hHwW", X.URL), 3_000_000, lambda t: t.rlike(r"(?i)://|www\."))),
    ("domain", "URL_PERSONAL", _url(X.BARE_DOMAIN, 4_000_000, lambda t: t.rlike(r"\.(?:com|net|org|io|me|edu|co|dev|app|info)"))),
    ("user", "USERNAME", _username),
    ("id_cue", "ID_NUM", _tail("ID_NUM", starting("sSiIoOlLbBaArR", X.ID_CUED), 1, 0.92, 7_000_000, _any)),
    ("id_bare", "ID_NUM", _id_bare),
    ("street", "STREET_ADDRESS", _whole("STREET_ADDRESS", starting(DIGITS, X.STREET), 0.85, 9_000_000)),
    ("date", "DATE", _whole("DATE", starting(DIGITS + "jJfFmMaAsSoOnNdD", X.DATE), 0.8, 10_000_000, lambda t: t.rlike(r"[12]\d{3}|[^\x00-\x7f]"))),
    ("name", "NAME_STUDENT", _tail("NAME_STUDENT", starting("mMiItTnNsSrRlLyYwWbB", X.NAME), 3, 0.7, 11_000_000, _name_ok)),
    ("related", "NAME_RELATED", _tail("NAME_RELATED", starting("mMoOhHtT", X.RELATED), 1, 0.7, 12_000_000, _name_ok)),
    ("title", "NAME_RELATED", _tail("NAME_RELATED", starting("MDCP", X.TITLED), 1, 0.7, 13_000_000, _name_ok)),
    ("school", "SCHOOL", _school),
    ("loc", "LOCATION", _location),
    ("age", "AGE", _age),
    ("bday", "DATE", _tail("DATE", starting("bB", X.BIRTHDAY), 1, 0.8, 17_000_000, _any)),
    ("ipv4", "IP_ADDRESS", _whole("IP_ADDRESS", starting(DIGITS, X.IPV4), 0.95, 18_000_000)),
    ("ipv6", "IP_ADDRESS", _whole("IP_ADDRESS", starting(HEX, f"(?=[{HEX}]{{1,4}}:)" + X.IPV6), 0.9, 19_000_000)),
    ("mac", "DEVICE_ID", _whole("DEVICE_ID", starting(HEX, f"(?=[{HEX}]{{2}}[:-])" + X.MAC), 0.95, 20_000_000)),
    ("uuid", "DEVICE_ID", _whole("DEVICE_ID", starting(HEX, f"(?=[{HEX}]{{8}}-)" + X.UUID), 0.95, 21_000_000)),
    ("geo", "GEO", _whole("GEO", starting(DIGITS + "-", X.GEO), 0.9, 22_000_000)),
)
NAMES = tuple(n for n, _, _ in DETECTORS)


def detector(text: Column, name: str) -> Column:
    """Spans of one detector, before any choice among overlaps."""
    build = dict((n, b) for n, _, b in DETECTORS)[name]
    return let(unmarked(text), lambda t: drop_blank(build(t)))


def detect(text: Column, labels: Iterable[str] | None = None) -> Column:
    """Non-overlapping spans of the wanted labels; no label named means all of them."""
    wanted = list(labels or ())
    unknown = set(wanted) - set(ALL_LABELS)
    if unknown:
        raise ValueError(f"unknown labels: {sorted(unknown)}")
    parts = [b for _, l, b in DETECTORS if not wanted or l in wanted]
    return F.when(text.isNotNull(), let(unmarked(text), lambda t: resolve(drop_blank(union([b(t) for b in parts]))))).otherwise(no_spans()) if parts else no_spans()
