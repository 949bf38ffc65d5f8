"""Problem 4: personal values in free text, found as typed spans and replaced.

Spans are found by format and context; names are then followed through their text.  Placeholders name the type.
Pseudonyms keep the format: numbers and dates that validate are permuted by a keyed Feistel network within the values of
their own format, so equal values stay linked across documents and columns without a table.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from bisect import bisect_left
from collections.abc import Collection, Iterator
from datetime import date, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.functions.lexicon import STATES
from spanveil.llm.textkit import record_text

LABELS = ("NAME", "EMAIL", "PHONE_NUM", "ID_NUM", "STREET_ADDRESS")

# ---- vocabulary of cues --------------------------------------------------------------------------------------------

SUFFIXES = "street st avenue ave road rd drive dr lane ln court ct boulevard blvd terrace ter place pl circle cir way trail trl parkway pkwy highway hwy square sq".split()
RELATIONS = (
    "mother mom mum father dad brother sister stepbrother stepsister half-brother half-sister aunt uncle cousin grandmother grandma grandpa grandfather nana "
    "niece nephew friend best friend lab partner partner neighbor neighbour roommate teammate classmate buddy study buddy stepmom stepdad stepmother stepfather "
    "godmother godfather guardian twin girlfriend boyfriend husband wife son daughter tutor teacher coach counselor"
)
DIGIT_WORDS = "zero oh one two three four five six seven eight nine".split()
#: Words that end a name written in lower case, or that no name starts with.
PLAIN = frozenset(
    """a about after again all already also although am an and are as at be because been before but btw by came can cant could cuz did do does for from
    get got great had has have he hello help helped her here hey hi him his how i if im in into is it its just lets like likes lol me my no nope not now of ok okay nobody everybody somebody someone people scholars monday tuesday wednesday thursday friday saturday sunday january february march april july
    august october november december
    omg on or our out page period pg please pls same she should so some that the their them then there they thing this those thx tho to too u um until us wait was we were what when where
    which while who why with would wow yeah yes yet you your today tomorrow tutor student teacher first next finally however instead once since both each every
    fine good nice sorry thanks thank well really very one two three four five six seven eight nine ten said says asked""".split()
)
PARTICLES = frozenset("van von de del della der den da di dos la le al bin ibn el ten ter mac san".split())
#: Ordinary words that are names too: as names they need a capital and a name after them, or a cue around them.
TWOFOLD = frozenset("will may".split())
HOUSES = frozenset("one two three four five six seven eight nine ten".split())
TITLES = "mr mrs ms miss mx dr prof professor coach principal nurse officer sir madam"

# ---- patterns ------------------------------------------------------------------------------------------------------

_W = r"[^\W\d_]+(?:['’‘-][^\W\d_]+)*"
_GAP = r"[^\S\n]+"
_NEXT = re.compile(rf"(?:({_W})(\.?))(?:(?={_GAP})|(?=\W|\Z))")
_SKIP = re.compile(_GAP)
_COMMA = re.compile(rf",{_GAP}")

_EMAIL = re.compile(r"[^\W_](?:[\w.+%-]*\w)?@[^\W_](?:[\w-]*[^\W_])?(?:\.[^\W_](?:[\w-]*[^\W_])?)+")
_TLD = "com|org|net|edu|gov|us|uk|ca|io|me|info|example|test|invalid|local"
_DOT, _AT = r"(?:\s+dot\s+|\s*[\[(]dot[\])]\s*|\.)", r"(?:\s+at\s+|\s*[\[({]\s*at\s*[\])}]\s*|\s+@\s+)"
_SPELLED = re.compile(rf"(?<![\w.+-])[\w+%-]+(?:{_DOT}[\w+%-]+)*({_AT})[\w-]+((?:{_DOT}[\w-]+){{0,3}}?{_DOT}(?:{_TLD}))(?![\w-])(?!{_DOT}(?:{_TLD})(?![\w-]))", re.I)
_TRIGGER = re.compile(r" dot |[\[({]\s?at\s?[\])}]| @ |[\[(]dot[\])]")
_LOCAL_PART = re.compile(r"[^\W_](?:[\w.+%-]*\w)?\Z")
_DOMAIN = re.compile(r"[^\W_](?:[\w-]*[^\W_])?(?:\.[^\W_](?:[\w-]*[^\W_])?)+")
_HANDLE = re.compile(r"@[\w.]*\w")
_LINK = re.compile(r"(?:https?://|www\.)\S+", re.I)
_HOST = re.compile(rf"\.(?:{_TLD}|app|dev)(?![\w-])(?:/\S*)?", re.I)
_HOST_LEFT = re.compile(r"[\w.-]+\Z")
_DIGIT = re.compile(r"\d")
_RUN = re.compile(r"(?:[A-Za-z]{1,3}-?)?\d[\dA-Za-z]*")
_US_PHONE = re.compile(r"(?:\+?1[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)")
_INTL = re.compile(r"\+\d{1,3}[ .-]?(?:\(?\d{1,4}\)?[ .-]?){2,5}\d(?!\d)")
_LOCAL = re.compile(r"(?:0\d{1,4}[ .-]\d{3,4}[ .-]\d{3,4}|\d{3}[ .-]\d{4})(?!\d|[.-]\d| \d{3})")
_SOLID = re.compile(r"1?\d{10}(?!\d)")
_EXTENSION = re.compile(r"[,;]?\s{0,2}(?:ext(?:ension)?\b\.?|x)\s{0,2}\d{1,6}\b", re.I)
_DIGITS = "|".join(DIGIT_WORDS)
_SPOKEN = re.compile(rf"\b(?:{_DIGITS})(?:[\s-]+(?:{_DIGITS})){{6,14}}\b", re.I)
_PHONE_CUE = re.compile(r"(?:\b(?:call|text|phone|cell|mobile|reach|dial|whatsapp|tel|fax|number|contact)\b[^.!?\n]{0,24})\Z", re.I)

_ID_VALUE = re.compile(
    r"\d{4} \d{4} \d{4} \d{2,4}\b|\d{3}[ -]\d{2}[ -]\d{4}\b|[A-Za-z]{1,3}-\d{2,6}-\d{1,4}[A-Za-z]?\b|[A-Za-z]{0,3}\d[\dA-Za-z]*(?:-[\dA-Za-z]+){0,3}\b"
)
_ID_BEFORE = re.compile(
    r"\b(?:(?:student|lunch|library|school|badge|roll|pupil|learner|member|osis|employee|state|national|passport|license|licence|account)\b(?:\W{1,2}(?:card|id|number|no|num|pin|code|they gave me|barcode)\b\.?)*"
    r"|ssn|social(?: security)?(?: number| no\.?)?|\bid|sasid|osis)(?:\W{1,3}(?:is|was|reads|says|number|no\.?|=|it is|it's))?[\s:#,=]{1,3}\Z",
    re.I,
)
_ID_AFTER = re.compile(r"[^\S\n]+(?:is|was|are)\b[^.!?\n]{0,60}?\b(?:card|id|badge|tag|ssn|pass|barcode|lanyard)\b", re.I)
_NOT_PERSON = re.compile(r"\b(?:model|barcode|invoice|order|version|page|pg|problem|room|part|tracking|serial|isbn|kit|code for|score|equation)\b[^.!?\n]{0,30}\Z", re.I)

_DIRECTION = r"(?:(?:north|south|east|west|upper|lower|old|new|n|s|e|w)\.?\s)?"
_SUFFIX = rf"(?:{'|'.join(SUFFIXES)})\b\.?"
_UNIT = r"(?:(?<!\.),?[^\S\n]{0,2}(?:#|(?:apt|apartment|unit|suite|ste)\b\.?)[^\S\n]?[\w-]{1,6})?"
_STATE = STATES
_CITY = rf"(?:(?:,[^\S\n]*\n?[^\S\n]*|[^\S\n]*\n[^\S\n]*|[^\S\n]+)(?:[^\W\d_][\w'’.-]*[^\S\n]){{0,2}}[^\W\d_][\w'’.-]*,[^\S\n]*(?:{_STATE})\b(?:[^\S\n]*\d{{5}}(?:-\d{{4}})?)?)?"
_HOUSE = r"\d{1,6}(?:[^\S\n]?-[^\S\n]?(?:\d{1,6}|[A-Za-z])\b|[A-Za-z]\b|½)?"
_ROAD = r"(?:\d{1,3}(?:st|nd|rd|th)|[^\W\d_][\w'’-]*)"
_STREET = re.compile(rf"(?<![\w-]){_HOUSE}[^\S\n]+((?:{_ROAD}[^\S\n]+){{1,4}}?)({_SUFFIX}){_UNIT}{_CITY}", re.I)
_ROAD_ONLY = re.compile(rf"((?:{_ROAD}[^\S\n]+){{1,4}}?)({_SUFFIX}){_UNIT}{_CITY}", re.I)
_BOX = re.compile(rf"\bP\.?[^\S\n]?O\.?[^\S\n]?Box[^\S\n]\d+{_CITY}", re.I)
_LIVES = re.compile(r"\b(?:live|lives|living|lived|stay|stays|staying|house|home|apartment|place|moved|address|mail|reside)s?(?: is| was)? (?:on|at|in|to|is|was) \Z|\baddress(?: is)?:? \Z|\bpickup: \Z|\b(?:send|ship|mail|deliver|bring) (?:[\w-]+ ){1,5}to \Z|\bplace is \Z", re.I)

_KIN = re.compile(rf"my (?:{'|'.join(sorted(set(re.split(r'(?<!best)(?<!study)(?<!lab) ', RELATIONS)), key=len, reverse=True))}){_GAP}(?=[^\W\d_])", re.I)

#: Literal cue before a name, what must follow the name (None: anything), most words of a name.
CUES = tuple(
    (cue, None if follow is None else re.compile(follow, re.I))
    for cue, follow in (
        ("name is ", None), ("name's ", None), ("calls me ", None), ("call me ", r"\s*(?:[.,!?\n]|because|cuz|but|and|so)"), ("sat with ", r"\W+(?:at|in|on|near|by|for|during|until|and|while)\b|\W*(?:\n|\Z)"),
        ("made by ", r"\W"), ("thanks, ", r"\s*[!.\n]"), ("hi, ", r"\s+here\b"), ("hey ", r"\s+here\b"),
        ("then ", r"\s+said\b"), ("its ", r"\s+again\b"), ("it's ", r"\s+again\b"), ("im ", r"\s+btw\b"), ("i'm ", r"\s+(?:btw|and i)\b"), ("i am ", r"\s+btw\b"), ("add ", r"\s+to the (?:group|chat|list)\b"),
        ("thx ", r"\s+(?:u|for|you)\b"), ("thanks ", r"\s+(?:u|for)\b"), ("is ", r"\s+(?:on the (?:call|line|phone)\b|here\b|there\b|coming\b)"), ("with love, ", None), ("student name: ", None), ("author: ", None), ("name: ", None),
        ("mi nombre es ", None), ("me llamo ", None), ("se llama ", None), ("je m'appelle ", None), ("je m’appelle ", None), ("il s'appelle ", None), ("elle s'appelle ", None), ("mon nom est ", None),
    )
)
#: Said of people and of things: here a name needs two capitalised words.
WEAK_CUES = ("met ", "contact ", "email ", "ask for ", "thank ", "visited ", "spoke to ", "spoke with ", "talked to ", "talked with ", "conocí a ", "con mi amigo ", "con mi amiga ", "avec mon ami ", "avec mon amie ")
_TWO_WORDS = re.compile(rf"[A-ZÀ-Þ][^\W\d_]+{_GAP}(?:[A-Z]\.{_GAP})?[A-ZÀ-Þ][^\W\d_]+")
#: A person spoken to, at the end of what is said to them.
_CLAUSE_END = re.compile(r"[.!?\n,]")
_PRAISE = re.compile(r"\b(?:great|good|nice|well|excellent|perfect|bravo|welcome|hello|hi|thanks|thank you|congratulations)\b")
_SAID = re.compile(r"\s*[!.?\n]|\s*\Z")
SIGN_OFFS = ("sincerely,", "regards,", "yours truly,", "best wishes,", "respectfully,", "love,", "your friend,", "cheers,")
_BY = re.compile(rf"by{_GAP}(?=[^\W\d_])", re.I)
_BY_END = re.compile(r"[^\S\n]*(?:[\n.;(]|period\b|\Z)", re.I)
_OPENS = re.compile(r"(?:\n\s*|[.!?…;:\"”)][^\S\n]+|\A\s*|\bwritten )\Z", re.I)
#: A third full word is part of a name only before a stop or a word that goes on about the person.
_AFTER_THIRD = re.compile(r"\s*(?:[^\w\s]|\n|\Z)|\s+(?:and|is|was|who|at|in|from|on|said|helped)\b", re.I)
_INITIAL = re.compile(r"(?<!\w)[^\W\d_]\.")
_TO_LINE, _TO_WORD = re.compile(r"[^\S\n]*\n\s*"), re.compile(r"\s+")
_TITLE_GAP = re.compile(rf"\.?{_GAP}(?=[^\W\d_])")
_PERIOD = re.compile(rf"(?:\n[^\S\n]*|{_GAP})period{_GAP}\d{{1,2}}\b", re.I)
_SPEAKER = re.compile(rf"[^\S\n]*({_W}(?:{_GAP}(?:[A-Z]\.|{_W})){{0,2}}):(?=\s)")
_COLON = re.compile(":")
_HELPED = re.compile(r"\s+(?:helped|said|is|was|and)\b", re.I)
_OWNED = re.compile(r"(?:report|project|essay|poster|notebook|story|speech|poem|drawing|presentation|homework|answer|idea)\b")
_LAST_WORD = re.compile(rf"{_W}\Z")


def _back(text: str, at: int, more: str) -> int:
    """Where the unbroken run of word characters and some others begins that ends at ``at``."""
    while at and (text[at - 1].isalnum() or text[at - 1] in more):
        at -= 1
    return at


#: A capitalised word that opens a sentence and does something to something.
_STARTS = re.compile(
    rf"(?:(?<=[.!?…][ \n\xa0])|(?<=\n)|\A)([A-ZÀ-Þ][^\W\d_]+){_GAP}([a-z]+(?:ed|ew|ote|ook|ade|ought|aught|ound|ept|elt|oke|ore|old|ang|an|ut|ot)){_GAP}(?:(?:to|at|with|for|on|about){_GAP})?(?:the|a|an|my|our|his|her|their|one|two|three|four|five|six|some|many){_GAP}"
)


class Cover:
    """Disjoint intervals in order."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def free(self, a: int, b: int) -> bool:
        i = bisect_left(self.starts, b)
        return i == 0 or self.ends[i - 1] <= a

    def add(self, a: int, b: int) -> None:
        i = bisect_left(self.starts, a)
        self.starts.insert(i, a)
        self.ends.insert(i, b)


class Names:
    """Reads names at given places of one text."""

    def __init__(self, text: str, low: str):
        self.text, self.low = text, low

    def read(self, at: int, most: int = 4, comma: bool = True) -> int:
        """End of the name that starts at ``at``; ``at`` itself if none does."""
        text = self.text
        m = _NEXT.match(text, at)
        if not m:
            return at
        first = m.group(1)
        if first in PARTICLES:
            g = _SKIP.match(text, m.end(1))
            if g and text[g.end() : g.end() + 1].isupper():
                end = self.read(g.end(), most - 1, comma=False)
                return end if end > g.end() else at
        lower = first.islower()
        if (first.lower() in PLAIN and not (len(first) == 1 and first.isupper() and m.group(2))) or (lower and len(first) < 2):
            return at
        upper = first.isupper() and len(first) > 1
        end, words, pos, pending = (m.end(1) if len(first) > 1 or not m.group(2) else m.end()), 1, m.end(), None
        initial = len(first) == 1 and bool(m.group(2))
        if len(first) == 1 and not m.group(2):
            return at
        if m.group(2) and not initial:
            return self._possessive(at, end)
        full = 1
        while words < most:
            g = _SKIP.match(text, pos)
            if not g:
                break
            m = _NEXT.match(text, g.end())
            if not m:
                break
            w, dot = m.group(1), m.group(2)
            wl = w.lower()
            if wl in PLAIN and not (len(w) == 1 and dot and w.isupper()):
                break
            if wl in PARTICLES and not (w.isupper() and not upper):
                pos, pending = m.end(1), True
                words += 0
                if dot:
                    break
                continue
            if len(w) == 1 and dot:
                if not w.isupper() and not lower:
                    break
                pos, words = m.end(), words + 1
                pending = True
                continue
            if len(w) == 1:
                break
            if not lower and not w[0].isupper():
                break
            if upper and not w.isupper():
                break
            if lower and not w[0].islower():
                break
            full += 1
            if full > 2 and not _AFTER_THIRD.match(text, m.end(1)):
                break
            end, pos, words, pending, initial = m.end(1), m.end(), words + 1, None, False
            if dot or (lower and words >= 2 + bool(initial)):
                break
        if initial:
            return at
        end = self._possessive(at, end)
        if comma and words == 1 and not lower:
            c = _COMMA.match(text, end)
            m = _NEXT.match(text, c.end()) if c else None
            if m and m.group(1)[0].isupper() and len(m.group(1)) > 1 and m.group(1).lower() not in PLAIN and (not m.group(1).isupper() or upper):
                stop = self._possessive(c.end(), m.end(1))
                tail = text[stop : stop + 3]
                k = re.match(rf"{_GAP}([A-Z])\.", text[stop : stop + 6])
                if k:
                    stop += k.end()
                    tail = text[stop : stop + 3]
                if not tail[:1].isalnum():
                    end = stop
        return end

    def _possessive(self, at: int, end: int) -> int:
        if end - at > 3 and self.low[end - 2 : end] in ("'s", "’s", "‘s"):
            return end - 2
        return end


def _find_all(low: str, what: str) -> Iterator[int]:
    at = low.find(what)
    while at >= 0:
        yield at
        at = low.find(what, at + 1)


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _cue_end(text: str, low: str, at: int, cue: str) -> int | None:
    if at and (low[at - 1].isalnum() or low[at - 1] in "_@'’"):
        return None
    return at + len(cue)


def find_names(text: str, low: str, taken: Cover) -> list[tuple[int, int]]:
    """Spans of the names in a text that overlap nothing of ``taken``, where they are added."""
    names = Names(text, low)
    seeds: dict[int, int] = {}

    def seed(at: int, follow=None, most: int = 4) -> None:
        gap = _SKIP.match(text, at)
        at = gap.end() if gap else at
        end = names.read(at, most)
        while follow is not None and end > at and not follow.match(text, end):
            cut = text.rfind(" ", at, end)
            end = cut if cut > at else at
        if end > at and end > seeds.get(at, 0):
            seeds[at] = end

    for cue, follow in CUES:
        for at in _find_all(low, cue):
            start = _cue_end(text, low, at, cue)
            if start is not None:
                seed(start, follow)
    for cue in WEAK_CUES:
        for at in _find_all(low, cue):
            start = _cue_end(text, low, at, cue)
            if start is not None and _TWO_WORDS.match(text, start):
                seed(start)
    begun = 0
    for m in _CLAUSE_END.finditer(text) if ", " in low else ():
        end = m.end()
        if text[end - 1] == "," and text[end : end + 1].isspace() and text[end + 1 : end + 2].isupper() and _PRAISE.search(low, begun, end):
            seed(end + 1, _SAID)
        begun = end
    for cue in SIGN_OFFS:
        for at in _find_all(low, cue):
            m = (_TO_LINE if cue == "love," else _TO_WORD).match(text, at + len(cue))
            if m and not text[m.end() : m.end() + 1].islower() or (m and "\n" in m.group()):
                seed(m.end())
    for title in TITLES.split():
        for at in _find_all(low, title):
            end = at + len(title)
            if at and (low[at - 1].isalnum() or low[at - 1] in "_@-"):
                continue
            m = _TITLE_GAP.match(text, end)
            if m and text[at:end].isupper() and len(title) > 3 and not low.endswith("asked ", 0, at):
                continue
            if m and text[m.end() : m.end() + 1].isupper():
                seed(m.end())
    for at in _find_all(low, "my "):
        if at == 0 or not low[at - 1].isalnum():
            m = _KIN.match(low, at)
            if m and text[m.end()].isupper():
                seed(m.end(), _HELPED if text[at : m.end()].isupper() else None)
    for at in _find_all(low, "by"):
        m = _BY.match(text, at)
        if not m or not (at == 0 or _OPENS.search(text, max(0, at - 10), at)):
            continue
        end = names.read(m.end())
        if end == m.end():
            continue
        ends = _BY_END.match(text, end)
        if not ends:
            end = names.read(m.end(), 3 if _INITIAL.search(text, m.end(), end) else 2)
        if ends or (_SKIP.search(text, m.end(), end) and text[m.end()].isupper()):
            seeds[m.end()] = max(end, seeds.get(m.end(), 0))
    for at in _find_all(low, "period"):
        m = _PERIOD.search(text, max(0, at - 4), min(len(text), at + 12))
        if m:
            line = max([text.rfind("\n", 0, m.start()) + 1, *(text.rfind(p, 0, m.start()) + 2 for p in (". ", "! ", "? ", "… ", "; ") if text.rfind(p, 0, m.start()) >= 0)])
            words = [w.start() for w in re.finditer(r"\S+", text[line : m.start()])]
            for w in words[-4:]:
                if text[line + w].isalpha() and names.read(line + w, 5) == m.start():
                    seeds[line + w] = m.start()
                    break
    at = 0
    while at < len(text):
        stop = text.find("\n", at)
        stop = len(text) if stop < 0 else stop
        colon = text.find(":", at, stop)
        if colon > 0:
            m = _SPEAKER.match(text, at)
            if m:
                w = m.group(1)
                if w[:1].isupper() and w.lower() not in PLAIN and w.lower() not in HEADINGS and names.read(m.start(1)) == m.end(1) and len(text[m.end() : stop].split()) >= 3:
                    seeds[m.start(1)] = m.end(1)
        at = stop + 1
    for at in _find_all(low, ": "):
        w = _LAST_WORD.search(text, _back(text, at, "'’‘-"), at)
        if w and w.group()[0].isupper() and not w.group().isupper() and len(w.group()) > 1 and w.group().lower() not in PLAIN and w.group().lower() not in HEADINGS and _OPENS.search(text, max(0, w.start() - 10), w.start()):
            seed(w.start(), _COLON)
    for mark in ("'s ", "’s "):
        for at in _find_all(low, mark):
            m = _OWNED.match(low, at + 3 + len(_SKIP.match(low, at + 2).group()) - 1)
            w = _LAST_WORD.search(text, _back(text, at, "'’‘-"), at) if m else None
            if w and w.group()[0].isupper() and len(w.group()) > 1 and w.group().lower() not in PLAIN and w.group().lower() not in COMMON_OWNERS:
                seeds[w.start()] = at
    for at in _find_all(low, " and i "):
        w = _LAST_WORD.search(text, _back(text, at, "'’‘-"), at)
        if w and w.group()[0].isupper() and len(w.group()) > 1 and w.group().lower() not in PLAIN and _OPENS.search(text, max(0, w.start() - 10), w.start()):
            seed(w.start())
    for m in _STARTS.finditer(text):
        w = m.group(1)
        if w.lower() not in PLAIN and not w.isupper() and w.lower() not in COMMON_OWNERS and not m.group(2).lower() in PLAIN:
            seeds.setdefault(m.start(1), m.end(1))
    found: dict[int, int] = {}
    for a, b in sorted(seeds.items(), key=lambda x: (x[0] - x[1], x[0])):
        if taken.free(a, b):
            taken.add(a, b)
            found[a] = b
    return sorted(_spread(text, low, found, taken).items())


COMMON_OWNERS = frozenset("today yesterday everyone everybody somebody someone nobody mom dad teacher student tutor it that this there here who what let".split())


HEADINGS = frozenset("sources source notes note title subject date period class pickup question answer answers problem step example tutor student teacher contact ps re to from summary abstract introduction conclusion".split())

#: After these a name that is an ordinary word too is that word ("Dawn came", "Grant money").
_NO_MENTION = re.compile(r"\s+(?:the|was|is|are|came|trees?|of|money)\b", re.I)
_ONE_WORD = re.compile(_W)


#: From this many names on, their mentions are looked up word by word instead of searched for one by one; the places are the same.
MANY_NAMES = 40


def _mentions(low: str, wanted: Collection[str]) -> Iterator[tuple[int, int]]:
    """Where one of some names may stand, in order of place, there longer ones first."""
    if len(wanted) <= MANY_NAMES:
        yield from sorted(((at, at + len(name)) for name in wanted for at in _find_all(low, name)), key=lambda x: (x[0], -x[1]))
        return
    first: dict[str, list[str]] = {}
    for name in sorted(wanted, key=len, reverse=True):
        first.setdefault(_ONE_WORD.match(name).group() if _ONE_WORD.match(name) else name, []).append(name)
    for m in _ONE_WORD.finditer(low):
        word = m.group()
        for key in (word, word[:-2] if word[-2:] in ("'s", "’s", "‘s") else None):
            for name in first.get(key, ()):
                if low.startswith(name, m.start()):
                    yield m.start(), m.start() + len(name)


def _spread(text: str, low: str, found: dict[int, int], taken: Cover) -> dict[int, int]:
    """Every other mention of the names found: full names, and their parts where they are capitalised or stand alone."""
    full, parts = {}, {}
    for a, b in found.items():
        name = low[a:b]
        words = [w for w in re.findall(_W, name) if len(w) > 1 and w not in PARTICLES]
        if len(words) > 1:
            full[name] = True
        for w in words:
            if len(w) > 2 and w not in PLAIN:
                parts.setdefault(w, text[a].isupper())
    out = dict(found)

    def take(a: int, b: int) -> None:
        taken.add(a, b)
        out[a] = b

    def bounded(a: int, b: int) -> bool:
        if a and (text[a - 1].isalnum() or text[a - 1] in "_@-'’./"):
            return False
        nxt = text[b : b + 2]
        return not (nxt[:1].isalnum() or nxt[:1] in "_@/" or (nxt[:1] in "-.'’" and nxt[1:].isalnum() and not re.match(r"['’]s\b", text[b : b + 3])))

    for at, end in _mentions(low, full):
        if bounded(at, end) and taken.free(at, end):
            take(at, end)
    names = Names(text, low)
    for at, end in _mentions(low, parts):
        if not bounded(at, end) or not taken.free(at, end):
            continue
        shape = text[at:end]
        if shape.islower() and not low.endswith(("@ ", "thx ", "its ", "im ", "add "), 0, at):
            continue
        if not shape.islower() and not shape.isupper() and _NO_MENTION.match(text, end):
            continue
        stop = names.read(at)
        if stop > end and taken.free(at, stop) and all(p in parts for p in re.findall(_W, low[at:stop]) if len(p) > 1 and p not in PARTICLES):
            end = stop
        take(at, end)
    return out


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """``(label, start, end)`` of every personal value in a text, in order and without overlap.

    An address, number or email beats a name; handles, links and whatever stands inside them are no values.
    """
    if not text:
        return []
    low = _lower(text).replace("\xa0", " ")
    out: list[tuple[str, int, int]] = []
    taken = Cover()

    def put(label: str | None, a: int, b: int) -> None:
        if taken.free(a, b):
            taken.add(a, b)
            if label:
                out.append((label, a, b))

    for at in _find_all(text, "@"):
        left, right = _LOCAL_PART.search(text, _back(text, at, "_.+%-"), at), _DOMAIN.match(text, at + 1)
        if left and right:
            put("EMAIL", left.start(), right.end())
    for t in _TRIGGER.finditer(low):
        for m in _SPELLED.finditer(text, max(0, t.start() - 90), min(len(text), t.end() + 90)):
            if m.group(1).strip().lower() == "at" and " dot" not in m.group(2).lower():
                continue
            put("EMAIL", m.start(), m.end())
    for what in ("://", "www."):
        for at in _find_all(low, what):
            m = _LINK.match(text, at - (5 if low[at - 5 : at] == "https" else 4 if low[at - 4 : at] == "http" else 0))
            if m:
                put(None, m.start(), m.end())
    for at in _find_all(text, "@"):
        m = _HANDLE.match(text, at)
        if m:
            put(None, at, m.end())
    for m in _HOST.finditer(text):
        left = _HOST_LEFT.search(text, _back(text, m.start(), "_.-"), m.start())
        if left:
            put(None, left.start(), m.end())
    for m in _BOX.finditer(text) if "box" in low else ():
        put("STREET_ADDRESS", m.start(), m.end())
    # Every run of digits, with the letters it begins with; formats are tried at its start.
    runs = [m.start() for m in _RUN.finditer(text) if not m.start() or not (text[m.start() - 1].isalnum() or text[m.start() - 1] == "_")] if _DIGIT.search(text) else []
    for at in runs:
        if text[at].isdigit():
            m = _STREET.match(text, at)
            if m and text[at - 1 : at] != "-" and _is_street(text, m):
                put("STREET_ADDRESS", at, _street_end(text, m))
    for cue in (" on ", " at ", " is ", " to ", "pickup: ", "address: "):
        for at in _find_all(low, cue):
            start = at + len(cue)
            if _LIVES.search(text, max(0, start - 60), start):
                m = _ROAD_ONLY.match(text, start)
                if m and _cased(m) and m.group(1).split()[0].lower() not in PLAIN - HOUSES:
                    put("STREET_ADDRESS", start, _street_end(text, m))
    for at in runs:
        a = at
        if text[at - 1 : at] == "+" or text[at - 1 : at] == "(":
            a = at - 1
        before = _SKIP.sub(" ", text[max(0, a - 80) : a])
        if before[-1:] in "-.#$/_" and before[-1:]:
            continue
        m, cued = _INTL.match(text, a) or _US_PHONE.match(text, a), False
        if not m:
            m, cued = _SOLID.match(text, a) or _LOCAL.match(text, a), True
        if m:
            b = m.end()
            stop = text[b : b + 1].isalnum() or (text[b : b + 1] in ("-", "/") and text[b + 1 : b + 2].isalnum())
            inside = before[-1:] == " " and before[-2:-1].isdigit() and cued
            known = not cued or _PHONE_CUE.search(before)
            if not stop and not inside and known and not _ID_BEFORE.search(before) and not _NOT_PERSON.search(before):
                x = _EXTENSION.match(text, b)
                put("PHONE_NUM", a, x.end() if x else b)
    for at in runs:
        m = _ID_VALUE.match(text, at)
        if m and text[at - 1 : at] not in ("-", ".", "/", "@") and sum(c.isdigit() for c in m.group()) >= 4:
            if _ID_BEFORE.search(_SKIP.sub(" ", text[max(0, at - 80) : at])) or _ID_AFTER.match(_SKIP.sub(" ", text[m.end() : m.end() + 80])):
                put("ID_NUM", at, m.end())
    # A spoken number has at least seven digit words.
    if sum(map(low.count, DIGIT_WORDS)) >= 7:
        for m in _SPOKEN.finditer(text):
            put("PHONE_NUM", m.start(), m.end())
    out += [("NAME", a, b) for a, b in find_names(text, low, taken)]
    return sorted(out, key=lambda s: (s[1], s[2]))


_ORDINAL = re.compile(r"\d+(?:st|nd|rd|th)", re.I)


def _cased(m: re.Match) -> bool:
    words = re.findall(r"[^\W\d_][\w'’-]*", _ORDINAL.sub("", m.group(1)) + m.group(2))
    return all(w[0].isupper() for w in words) or all(w.islower() for w in words)


def _street_end(text: str, m: re.Match) -> int:
    end = m.end()
    return end - 1 if text[end - 1] == "." and m.end(2) == end else end


def _is_street(text: str, m: re.Match) -> bool:
    if not _cased(m):
        return False
    words = re.findall(r"[^\W\d_][\w'’-]*", _ORDINAL.sub("", m.group(1)) + m.group(2))
    return words[0][0].isupper() or bool(_LIVES.search(text, max(0, m.start() - 60), m.start()))


# ---- spans of tables -----------------------------------------------------------------------------------------------

def with_values(rows: DataFrame, text: str, keep: list[str], key: str) -> DataFrame:
    """``keep`` and, of every personal value of a text, ``label, span_start, span_end, pseudonym``: one row each.

    The pseudonym stands for the value in every document: a number keeps its format, check digit and validity under a keyed Feistel
    permutation, other values get a typed tag.  Null and blank texts give no row.
    """
    secret, most = key.encode(), 1 << 18

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict = {}
        for b in batches:
            row, label, start, end, out = [], [], [], [], []
            for i, t in enumerate(b.column("_text").to_pylist()):
                for l, a, e in find_spans(t) if t else ():
                    value = (l, t[a:e])
                    if value not in made:
                        if len(made) >= most:
                            made.clear()
                        made[value] = pseudonym(*value, secret)
                    row.append(i)
                    label.append(l)
                    start.append(a)
                    end.append(e)
                    out.append(made[value])
            held = b.select(keep).take(pa.array(row, pa.int64()))
            columns = [pa.array(label, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(out, pa.string())]
            yield pa.RecordBatch.from_arrays([*held.columns, *columns], [*keep, "label", "span_start", "span_end", "pseudonym"])

    base = rows.select(*keep, (F.col(text) if isinstance(text, str) else text).alias("_text"))
    kept = [f"`{n}` {t}" for n, t in base.dtypes if n != "_text"]
    return base.mapInArrow(run, ", ".join([*kept, "label string, span_start int, span_end int, pseudonym string"]))


def tables(labelled: DataFrame, results: DataFrame) -> DataFrame:
    """``src, rec_id, _text`` of both tables."""
    a = labelled.select(F.lit("labelled_docs").alias("src"), F.col("document").alias("rec_id"), record_text().alias("_text"))
    b = results.select(F.lit("deid_results").alias("src"), F.col("request_id").alias("rec_id"), F.col("original_text").alias("_text"))
    return a.unionAll(b)


def values(labelled: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """``src, rec_id, label, span_start, span_end, pseudonym``, distinct: the personal values of both tables, equal ones under equal
    pseudonyms.  Null and blank texts give none, nor do rows without an id."""
    return with_values(tables(labelled, results).filter("_text is not null and rec_id is not null"), "_text", ["src", "rec_id"], key).distinct()


def linked(labelled: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """``label, pseudonym, records, uses``: what the pseudonyms link, for those in more than one record."""
    by = values(labelled, results, key).groupBy("label", "pseudonym", "src", "rec_id").agg(F.count("*").alias("uses"))
    return by.groupBy("label", "pseudonym").agg(F.count("*").alias("records"), F.sum("uses").alias("uses")).filter("records > 1")


# ---- replacement ---------------------------------------------------------------------------------------------------


class Feistel:
    """Keyed permutation of the integers below ``size``: a balanced Feistel network with cycle walking."""

    ROUNDS = 8

    def __init__(self, key: bytes, size: int, tweak: str = ""):
        self.key, self.size, self.tweak = key, size, tweak
        self.half = max(1, ((size - 1).bit_length() + 1) // 2)

    def _round(self, i: int, x: int) -> int:
        d = hmac.new(self.key, f"{self.tweak}|{self.size}|{i}|{x}".encode(), hashlib.sha256).digest()
        return int.from_bytes(d[:16], "big") & ((1 << self.half) - 1)

    def _once(self, v: int) -> int:
        left, right = v >> self.half, v & ((1 << self.half) - 1)
        for i in range(self.ROUNDS):
            left, right = right, left ^ self._round(i, right)
        return left << self.half | right

    def _back(self, v: int) -> int:
        left, right = v >> self.half, v & ((1 << self.half) - 1)
        for i in reversed(range(self.ROUNDS)):
            left, right = right ^ self._round(i, left), left
        return left << self.half | right

    def forward(self, v: int) -> int:
        v = self._once(v)
        while v >= self.size:
            v = self._once(v)
        return v

    def backward(self, v: int) -> int:
        v = self._back(v)
        while v >= self.size:
            v = self._back(v)
        return v


def _luhn(digits: str) -> int:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10


def permute_number(value: str, key: bytes, back: bool = False) -> str:
    """A value of digits and letters, permuted within its format: separators, letter case and the place of digits and
    letters stay, and of 13 digits or more a valid check digit stays valid and an invalid one invalid.  ``back`` undoes it."""
    shape = "".join("9" if c in "0123456789" else "A" if "A" <= c <= "Z" else "a" if "a" <= c <= "z" else c for c in value)
    places = [i for i, s in enumerate(shape) if s in "9Aa"]
    card = len(places) >= 13 and all(shape[i] == "9" for i in places)
    valid = card and _luhn("".join(value[i] for i in places)) == 0
    free = places[:-1] if valid else places
    rank, size = 0, 1
    for i in free:
        base = 10 if shape[i] == "9" else 26
        rank = rank * base + (int(value[i]) if base == 10 else ord(value[i].lower()) - 97)
        size *= base
    if size < 2:
        return value
    f = Feistel(key, size, shape + ("|valid" if valid else ""))
    while True:
        rank = f.backward(rank) if back else f.forward(rank)
        out, rest = list(value), rank
        for i in reversed(free):
            rest, v = divmod(rest, 10 if shape[i] == "9" else 26)
            out[i] = str(v) if shape[i] == "9" else chr((97 if shape[i] == "a" else 65) + v)
        digits = "".join(out[i] for i in places)
        if valid:
            out[places[-1]] = str((10 - _luhn(digits[:-1] + "0")) % 10)
        # Values without a valid check digit walk on past those that have one.
        if valid or not card or _luhn(digits):
            return "".join(out)


_DATES = (
    (re.compile(r"\A(\d{4})-(\d{2})-(\d{2})\Z"), (1, 2, 3), "{0:04d}-{1:02d}-{2:02d}"),
    (re.compile(r"\A(\d{2})/(\d{2})/(\d{4})\Z"), (3, 1, 2), "{1:02d}/{2:02d}/{0:04d}"),
)
_FIRST, _DAYS = date(1900, 1, 1), (date(2100, 1, 1) - date(1900, 1, 1)).days


def permute_date(value: str, key: bytes, back: bool = False) -> str | None:
    """A valid date of 1900 to 2099 as another one in the same format; null if it isn't one."""
    for rx, order, form in _DATES:
        m = rx.match(value)
        if m:
            try:
                n = (date(*(int(m.group(i)) for i in order)) - _FIRST).days
            except ValueError:
                return None
            if 0 <= n < _DAYS:
                f = Feistel(key, _DAYS, "date")
                d = _FIRST + timedelta(days=f.backward(n) if back else f.forward(n))
                return form.format(d.year, d.month, d.day)
    return None


def pseudonym(label: str, value: str, key: bytes) -> str:
    """Numbers keep their format; other values become a typed placeholder with a keyed tag, the same for equal values
    whatever their case and spacing."""
    if label in ("PHONE_NUM", "ID_NUM") and any(c in "0123456789" for c in value):
        return permute_date(value, key) or permute_number(value, key)
    same = " ".join(value.casefold().split())
    return f"[{label}_{hmac.new(key, f'{label}|{same}'.encode(), hashlib.sha256).hexdigest()[:16]}]"


_FORMAT_DATE = re.compile(r"(?<![\w/-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4})(?![\w/-])")


def replace(text: str, spans: list[tuple[str, int, int]], key: bytes | None = None) -> str:
    """The text with every span replaced: by its type in brackets, or by its pseudonym under ``key`` (dates outside spans too)."""
    out, at = [], 0
    if key is not None:
        dates = [("DATE", m.start(), m.end()) for m in _FORMAT_DATE.finditer(text) if permute_date(m.group(), key)]
        spans = sorted([*spans, *(d for d in dates if not any(a < d[2] and d[1] < b for _, a, b in spans))], key=lambda s: s[1])
    for label, a, b in spans:
        value = text[a:b]
        new = f"[{label}]" if key is None else permute_date(value, key) if label == "DATE" else pseudonym(label, value, key)
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]])


def redacted(labelled: DataFrame, results: DataFrame, key: str | None = None) -> DataFrame:
    """``src, rec_id, values, text``: the texts with placeholders, or with pseudonyms under ``key``, the rest unchanged.

    A null text stays null, with 0 values.
    """
    secret = None if key is None else key.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, counts = [], []
            for t in b.column("_text").to_pylist():
                spans = find_spans(t) if t else []
                counts.append(len(spans))
                texts.append(replace(t, spans, secret) if t else t)
            yield pa.RecordBatch.from_arrays([b.column("src"), b.column("rec_id"), pa.array(counts, pa.int32()), pa.array(texts, pa.string())], ["src", "rec_id", "values", "text"])

    return tables(labelled, results).mapInArrow(run, "src string, rec_id bigint, values int, text string").distinct()
