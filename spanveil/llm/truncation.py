"""Problem 8: texts that were cut off.

A stack automaton reads a text and holds what is open: quotes, brackets, braces, markup elements, and the sentence it is in.  What is
left on the stack at the end, broken multibyte sequences and escapes, an unfinished tag and the marks a transfer leaves are the
evidence.  A sentence left open is judged against the baseline of its source and genre (how many of those texts end properly) and,
since a complete text may merely lack its last full stop, needs a tie-break: counts over the corpus say whether the last words go on
elsewhere, or are only the beginnings of longer ones.

A quote or bracket counts only if it was opened in the last sentence and line; what stays open longer is forgotten punctuation.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanveil.plans.session import Scratch

#: A length is a limit of its source, and a source reports sizes honestly, when this many texts of that length (or shorter
#: than reported) show by themselves that they were cut, and these are at least half of them.
LEAST = 5
HALF = 0.5
#: A last word that ends a sentence or line in a smaller share of its other uses stands inside one.
INSIDE = 0.02
#: A word or pair used less than ``KNOWN`` times elsewhere, of which longer ones are known, is a fragment; shares need
#: ``TRUSTED`` uses.
KNOWN = 8
TRUSTED = 40
#: A closing is habitual when texts end in this share of all uses of its last two words.
HABIT = 0.01

_LEFT = re.compile(r"\s*[\[(<{]\s*(?:\.\.\.|…|truncated|cut(?: off)?|more|continued|snip)\s*[\])>}]\s*\Z", re.I)
_ESCAPE = re.compile(r"(?:&(?:#x?[0-9a-fA-F]*|[a-zA-Z]{1,6})?|\\(?:u[0-9a-fA-F]{0,3}|x[0-9a-fA-F]?)?|(?<=%[0-9a-fA-F]{2})%[0-9a-fA-F]?)\Z")
_TAG = re.compile(r"<(?:/?[a-zA-Z][^<>\n]*|!--[^<>]*|/)?\Z")
_ENDS = re.compile(r"[.!?…。！？](?:[\"'”’»)\]*_]|\s)*\Z")
# An emoticon, or a symbol outside ASCII that is no punctuation.
_SMILE = re.compile(r"(?:[:;=8][-'^]?[)(DPpoO3\]/|]|<3|[^\x00-\x7f\w\s…‥–—‒“”„‘’‚«»‹›¿¡�])\Z")
_DOTS = re.compile(r"(?:\.\.\.+|…)\s*\Z")
_OPEN = re.compile(r"[\"“”«»()\[\]{}\n]|<(/?)([a-zA-Z][\w-]*)(?:[^<>\n]*?)(/?)>")
_PAIR = {")": "(", "]": "[", "}": "{", "”": "“", "»": "«"}
#: Elements that needn't be closed.
LOOSE = frozenset("br hr img input meta link wbr p li dt dd td th tr option".split())


def open_at_end(text: str) -> list[tuple[str, int]]:
    """Stack of quotes, brackets, braces and markup elements still open at the end of the text, with their positions.

    Straight quotes toggle; a closer pops down to its opener; quotes and brackets die at a blank line, where writing starts anew, elements
    don't.
    """
    stack: list[tuple[str, int]] = []
    held: Counter = Counter()
    last_break = -2
    for m in _OPEN.finditer(text):
        c, at = m.group(), m.start()
        if m.group(2):
            name = m.group(2).lower()
            want = f"<{name}>"
            if name in LOOSE or m.group(3):
                continue
            if not m.group(1):
                stack.append((want, at))
                held[want] += 1
                continue
        elif c == "\n":
            if at == last_break + 1:
                stack = [x for x in stack if x[0][0] == "<"]
                held = Counter(x[0] for x in stack)
            last_break = at
            continue
        elif c in "([{“«" or (c == '"' and not held['"']):
            stack.append((c, at))
            held[c] += 1
            continue
        else:
            want = _PAIR.get(c, '"')
        if held[want]:
            while True:
                top = stack.pop()[0]
                held[top] -= 1
                if top == want:
                    break
    return stack


def ending(text: str) -> dict:
    """How a text ends: ``mark`` (hard evidence left by the transfer), ``open`` (kind of what is left open: quote, bracket or element),
    ``done`` (terminator), ``dots``,
    ``smile`` (emoticon or symbol), ``word`` (last word in lower case, if the text ends in it) and ``pair`` (with the word before it in its sentence)."""
    body = text.rstrip()
    mark = None
    if _LEFT.search(body):
        mark = "residue"
    elif body.endswith("�") or 0xD800 <= ord(body[-1]) <= 0xDFFF:
        mark = "bytes"
    elif _ESCAPE.search(body):
        mark = "escape"
    elif _TAG.search(body):
        mark = "markup"
    dots = bool(_DOTS.search(body))
    core = _DOTS.sub("", body).rstrip() if dots else body
    done = bool(_ENDS.search(core)) or (dots and not core)
    left = open_at_end(core)
    kind = None
    if any(x[0][0] == "<" for x in left):
        kind = "element"
    elif left and not done:
        since = core[left[-1][1] :]
        if not re.search(r"[.!?…]\s", since) and "\n" not in since:
            kind = "quote" if left[-1][0] in '"“«' else "bracket"
    tail = core[-1:]
    word = pair = None
    if tail.isalnum():
        lowered = core.lower()
        at = len(lowered)
        while at and (lowered[at - 1].isalnum() or lowered[at - 1] in "'’"):
            at -= 1
        word = lowered[at:].lstrip("'’") or None
        before = _BEFORE.search(lowered, max(0, at - 80), at)
        pair = f"{before.group(1)} {word}" if before and word else None
    return {
        "mark": mark,
        "open": kind,
        "done": done,
        "dots": dots,
        "smile": bool(_SMILE.search(core)) and kind is None,
        "word": word,
        "pair": pair,
        "tail": tail,
    }


ENDINGS = T.StructType(
    [
        T.StructField("mark", T.StringType()),
        T.StructField("open", T.StringType()),
        T.StructField("done", T.BooleanType()),
        T.StructField("dots", T.BooleanType()),
        T.StructField("smile", T.BooleanType()),
        T.StructField("word", T.StringType()),
        T.StructField("pair", T.StringType()),
        T.StructField("tail", T.StringType()),
    ]
)


def clean_source(source) -> Column:
    """Spellings of one source (case, blanks, separator) under one name; null is its own source."""
    return F.regexp_replace(F.lower(F.trim(source)), r"[\s_-]+", "_")


def endings(documents: DataFrame) -> DataFrame:
    """``doc_id, source, genre, chars, bytes, reported, ending`` of each document with text that isn't blank."""
    base = documents.filter("doc_id is not null and text is not null and trim(translate(text, '\n\r\t', '   ')) <> ''").select(
        "doc_id", clean_source("source").alias("source"), F.col("genre").cast("string").alias("genre"),
        F.length("text").alias("chars"), F.octet_length("text").alias("bytes"), F.col("n_chars").cast("bigint").alias("reported"), "text",
    )
    keep = [c for c in base.columns if c != "text"]
    schema = T.StructType([*[base.schema[c] for c in keep], *ENDINGS.fields])
    arrow = {"string": pa.string(), "boolean": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = [i for i, t in enumerate(b.column("text").to_pylist()) if t.strip()]
            b = b.take(pa.array(good, pa.int64()))
            found = [ending(t) for t in b.column("text").to_pylist()]
            more = [pa.array([f[x.name] for f in found], arrow[x.dataType.typeName()]) for x in ENDINGS.fields]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], *more], [*keep, *ENDINGS.names])

    return base.mapInArrow(run, schema)


_WORD_OR_END = re.compile(r"([^\W_]+(?:['’][^\W_]+)*)|([.!?…\n])")
_BEFORE = re.compile(r"([^\W_]+(?:['’][^\W_]+)*)[^\w.!?…\n]*\Z")
_FLUSH = 400_000


def count_uses(text: str, uses: Counter, ends: Counter) -> None:
    """Count the words of a text and its pairs of neighbours within a sentence, all but the last word's, and those before
    a terminator or line break."""
    before = None
    words = _WORD_OR_END.findall(text.lower())
    while words and not words[-1][0]:
        words.pop()
    if words:
        words.pop()
    seen = []
    stops = []
    pair = None
    for w, e in words:
        if w:
            seen.append(w)
            pair = None
            if before is not None:
                pair = before + " " + w
                seen.append(pair)
            before = w
        else:
            if before is not None:
                stops.append(before)
                if pair is not None:
                    stops.append(pair)
            before = pair = None
    uses.update(seen)
    ends.update(stops)


def word_uses(documents: DataFrame) -> DataFrame:
    """``term, uses, ends`` over all texts: uses of a word or pair of words but for the last word of a text, and how many
    stand before a terminator or a line break.  Counted in each task first, so little is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uses: Counter = Counter()
        ends: Counter = Counter()

        def flush():
            terms = list(uses)
            batch = pa.RecordBatch.from_arrays(
                [pa.array(terms, pa.string()), pa.array([uses[t] for t in terms], pa.int64()), pa.array([ends[t] for t in terms], pa.int64())],
                ["term", "uses", "ends"],
            )
            uses.clear()
            ends.clear()
            return batch

        for b in batches:
            for t in b.column("text").to_pylist():
                count_uses(t, uses, ends)
                if len(uses) > _FLUSH:
                    yield flush()
        yield flush()

    part = documents.filter("text is not null").select("text").mapInArrow(run, "term string, uses bigint, ends bigint")
    return part.groupBy("term").agg(F.sum("uses").alias("uses"), F.sum("ends").alias("ends"))


def _known(terms: DataFrame, uses: DataFrame) -> DataFrame:
    """``term, uses, ends, longer``: for each term its counts, and the uses of longer terms it begins."""
    often = uses.filter(F.col("uses") >= KNOWN)
    opened = often.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("term") - 1), lambda k: F.substring(often.term, F.lit(1), k))).alias("term"), "uses")
    longer = opened.filter("length(term) > 0 and not term like '% '").groupBy("term").agg(F.sum("uses").alias("longer"))
    return terms.join(uses, "term", "left").join(longer, "term", "left").na.fill(0)


def judged(documents: DataFrame) -> DataFrame:
    """Every document with text that isn't blank: ``doc_id, source, genre, cut, why, tie``.

    ``why`` names the first evidence: residue, bytes, escape, markup (an unfinished tag), quote, bracket, element (left open), sentence (left
    open), limit (left open at a length at which the source cuts), reported (left open and shorter than reported), tail (stops after a comma
    or the like where texts of the source and genre end properly).  ``tie`` says what speaks against a forgotten full stop: fragment (the
    last word is only the beginning of others) or inside (the last words go on elsewhere).  Texts that end in a
    terminator, an emoticon, a habitual closing or merely without punctuation are whole; dots count as whole after words that can end a
    sentence.  Null and blank texts and rows without an id give no row; repeated rows of a ``doc_id`` count once.
    """
    scratch = Scratch(documents.sparkSession)
    stage = scratch.stage
    uses = stage(word_uses(documents), "uses")
    ends = stage(endings(documents).dropDuplicates(["doc_id"]), "endings")
    terms = ends.select(F.explode(F.array("word", "pair")).alias("term")).filter("term is not null").groupBy("term").agg(F.count("*").alias("finals"))
    known = stage(_known(terms, uses), "known")
    stat = lambda c, p: known.select(F.col("term").alias(c), *[F.col(x).alias(p + x) for x in ("finals", "uses", "ends", "longer")])
    base = ends.groupBy("source", "genre").agg(F.avg(F.col("done").cast("int")).alias("finished"))
    # Most texts end in no word: they have nothing to look up, and would all meet in one task.
    worded = ends.filter("word is not null").join(stat("word", "w_"), "word", "left").join(stat("pair", "p_"), "pair", "left")
    x = worded.unionByName(ends.filter("word is null"), allowMissingColumns=True)
    x = x.join((base.select(F.col("source").alias("s"), F.col("genre").alias("g"), "finished")), x.source.eqNullSafe(F.col("s")) & x.genre.eqNullSafe(F.col("g")), "left")
    digits = F.col("word").rlike(r"^\d+$")
    used = lambda c, least: F.coalesce(F.col(c) >= least, F.lit(False))
    habit = (
        (F.col("p_finals") >= LEAST)
        & (F.col("p_finals") >= HABIT * (F.col("p_uses") + F.col("p_finals")))
        & (used("p_uses", KNOWN) | ~used("p_longer", KNOWN))
    )
    unfinished = ~F.col("done") & ~F.col("smile")
    plain = unfinished & F.col("word").isNotNull() & ~digits & ~F.coalesce(habit, F.lit(False))
    inside = (
        F.when(used("p_uses", TRUSTED), F.col("p_ends") < INSIDE * F.col("p_uses"))
        .when(used("p_uses", KNOWN) & (F.col("p_ends") > 0), False)
        .when(used("w_uses", TRUSTED), F.col("w_ends") < INSIDE * F.col("w_uses"))
        .otherwise(False)
    )
    fragment = ~used("p_uses", KNOWN) & (used("p_longer", KNOWN) | (~used("w_uses", KNOWN) & used("w_longer", KNOWN)))
    tie = F.when(plain & fragment, "fragment").when(plain & inside, "inside")
    own = (
        F.when(F.col("mark").isNotNull(), F.col("mark"))
        .when(F.col("open").isNotNull(), F.col("open"))
        .when(tie.isNotNull(), "sentence")
        .when(unfinished & F.col("tail").isin(*",;:(–-/&") & (F.col("finished") >= HALF), "tail")
    )
    # A reported size that equals the bytes is no hint.
    short = F.coalesce((F.col("reported") > F.col("chars")) & (F.col("reported") != F.col("bytes")), F.lit(False))
    seen = stage(
        x.select("doc_id", "source", "genre", "chars", "bytes", own.alias("own"), F.when(own == "sentence", tie).alias("tie"), short.alias("short"), (plain & ~F.col("dots")).alias("bare"), (unfinished & ~F.coalesce(habit, F.lit(False)) & ~F.col("dots")).alias("loose")),
        "seen",
    )
    hits = F.count("own").alias("hits")
    enough = (F.col("hits") >= LEAST) & (F.col("hits") >= HALF * F.col("n"))
    lengths = seen.select("source", "own", F.explode(F.array(F.struct(F.lit("c").alias("unit"), F.col("chars").alias("length")), F.struct(F.lit("b").alias("unit"), F.col("bytes").alias("length")))).alias("l"))
    lengths = lengths.groupBy("source", "l.unit", "l.length").agg(hits, F.count("*").alias("n")).filter(enough)
    honest = seen.filter("short").groupBy("source").agg(hits, F.count("*").alias("n")).filter(enough)
    # Exact lengths with many cuts: a small part of the histogram, at most a third of the cut texts.
    chars = lengths.filter("unit = 'c'").select(F.col("source").alias("cs"), F.col("length").alias("cl"))
    size = lengths.filter("unit = 'b'").select(F.col("source").alias("bs"), F.col("length").alias("bl"))
    y = (
        seen.join(chars, seen.source.eqNullSafe(F.col("cs")) & (seen.chars == F.col("cl")), "left")
        .join(size, seen.source.eqNullSafe(F.col("bs")) & (seen.bytes == F.col("bl")), "left")
        .join(honest.select(F.col("source").alias("hs"), F.lit(True).alias("honest")), seen.source.eqNullSafe(F.col("hs")), "left")
    )
    why = (
        F.when(F.col("own").isNotNull(), F.col("own"))
        .when(F.col("loose") & (F.col("cl").isNotNull() | F.col("bl").isNotNull()), "limit")
        .when(F.col("bare") & F.col("short") & F.col("honest"), "reported")
    )
    return y.select("doc_id", "source", "genre", why.isNotNull().alias("cut"), why.alias("why"), "tie")


def truncated(documents: DataFrame) -> DataFrame:
    """``doc_id`` of the texts that were cut off."""
    return judged(documents).filter("cut").select("doc_id")


def truncation_report(documents: DataFrame) -> DataFrame:
    """Per source: texts, texts cut off and their share."""
    by = judged(documents).groupBy("source").agg(F.count("*").alias("texts"), F.sum(F.col("cut").cast("int")).alias("cut"))
    return by.withColumn("share", F.col("cut") / F.col("texts"))
