"""Variant spellings of names: noisy-channel attribution.

Spellings (names and aliases) are cleaned, cut into frequent words (classes of things, given names: a bounded vocabulary
found by document frequency), initials, numerals and rare core tokens, and made distinct with their frequency. Frequent
spellings are the candidate canonical forms. A variant meets candidates through deletion neighbourhoods of its core
tokens; the score of a candidate is its log frequency (prior) plus the log likelihood of the typos, dropped parts,
initials, nicknames and abbreviations that turn it into the variant. Every variant is attached to its maximum posterior.
Attachments, and the spellings that stand side by side in one record, are then consolidated into groups.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.components import _mixed, contract
from weftgraph.operators.skew import HOT_LEAST, HOT_PARTS, skew_safe_lookup
from weftgraph.runtime import cut

# Words around a name that say nothing about which one is meant.
DECOR = set(
    "the of and for an der die das des von und la le les el los las de du da di et mr mrs ms miss mx dr prof professor ing dipl sir dame herr frau "
    "jr sr jun sen snr phd md msc bsc mba esq".split()
)
LEGAL = set("inc incorporated ltd limited llc llp gmbh ag kg kgaa sarl sas sa sl srl spa bv nv plc corp corporation co oy ab as aps pty".split())
# Words that name no one in particular.
GENERIC = set(
    "he she it they him her his hers its this that these those who we i you me us them someone anyone client customer author applicant company firm institute "
    "institution organisation organization person patient tool product system project place location city hq headquarters office above below see same ditto document "
    "unknown none null nan na n tbd unnamed nil anonymous various other others".split()
)
# Words of German, French and Spanish names beside their English counterparts.
SAME_WORD = {
    "universitat": "university", "universidad": "university", "universite": "university", "universita": "university", "institut": "institute", "instituto": "institute",
    "stiftung": "foundation", "fondation": "foundation", "fundacion": "foundation", "gesellschaft": "society", "societe": "society", "sociedad": "society",
    "verband": "association", "verein": "association", "asociacion": "association", "kommission": "commission", "comision": "commission", "foderation": "federation",
    "federacion": "federation", "bund": "federation", "agentur": "agency", "agence": "agency", "agencia": "agency", "abteilung": "department", "departement": "department",
    "departamento": "department", "industrien": "industries", "industrias": "industries", "systeme": "systems", "systemes": "systems", "sistemas": "systems", "logistik": "logistics",
    "logistique": "logistics", "logistica": "logistics", "dienste": "services", "servicios": "services", "bruder": "brothers", "freres": "brothers", "hermanos": "brothers",
    "technologien": "technologies", "tecnologias": "technologies", "labore": "laboratories", "laboratoires": "laboratories", "laboratorios": "laboratories", "partner": "partners",
    "socios": "partners", "programm": "programme", "programa": "programme", "program": "programme", "projekt": "project", "hochschule": "college", "nord": "north", "sud": "south",
    "norte": "north", "sur": "south", "unter": "lower", "ober": "upper", "bros": "brothers", "svcs": "services", "intl": "international",
}
# Common short forms of given names.
NICKNAMES = {
    "william": "will bill billy willy liam", "robert": "rob bob bobby robbie bert", "richard": "rick dick rich richie", "charles": "charlie chuck chas", "anthony": "tony ant toni",
    "lawrence": "larry laurie", "michael": "mike mick mickey", "edward": "ed eddie ted ned", "theodore": "ted teddy theo", "elizabeth": "liz beth betty lizzie eliza", "margaret": "maggie meg peggy",
    "josephine": "jo josie", "patricia": "pat patty trish", "alexander": "alex sandy sascha sasha xander", "benjamin": "ben benny", "nicholas": "nick nicky klaus", "francisco": "paco pancho curro",
    "jose": "pepe", "ignacio": "nacho", "guadalupe": "lupe lupita", "dolores": "lola loli", "soledad": "sole", "isabel": "isa bella chabela", "magdalena": "lena magda", "katharina": "kathe kati kathi katja",
    "wilhelmina": "mina wilma willa", "barbara": "babs barb barbel", "susanne": "susi sanne", "johannes": "hannes hans jan", "maximilian": "max maxi", "frederick": "fred freddy fritz", "gregory": "greg",
    "henrietta": "etta hettie hetty", "veronika": "vroni nika", "antoinette": "toni nettie", "ursula": "uschi ulla", "ulrike": "uli rike", "leonie": "leo", "helga": "helle", "charlotte": "lotte",
    "thomas": "tom tommy", "james": "jim jimmy", "john": "jack johnny", "joseph": "joe joey", "samuel": "sam sammy", "katherine": "kate kathy", "jennifer": "jen jenny", "rebecca": "becky",
}

#: A word is frequent if it occurs in this share of the different names (so there are fewer than avg. words / SHARE of
#: them) and beside so many different beginnings of other words.
SHARE, LEAST_NAMES, LEAST_COMPANY = 0.001, 4, 4
#: Log cost of one typo; the other costs are multiples of it.
LAMBDA = 3.0
COST = {"edit": 1.0, "initial": 0.5, "short": 0.5, "dropped": 1.5, "class_dropped": 3.5}
MOST_COST = 3.0
#: Blocks with more spellings than this are cut into parts of PART times as many, and part meets part: the pairs are the same, the tasks smaller.
BLOCK, PART = 400, 8

_MARKS = "\"'“”„‘’«»‹›`´"
_SPECIAL = str.maketrans({"ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "ß": "ss", "æ": "ae", "Æ": "Ae", "œ": "oe", "đ": "d", "ı": "i"})
_DOTTED_LEGAL = re.compile(r"(?i)[\s,]+(s\.?\s?a\.?\s?r\.?\s?l|s\.?\s?a|s\.?\s?l|b\.?\s?v|n\.?\s?v|s\.?\s?p\.?\s?a|p\.?l\.?c|l\.?l\.?c)\.?\s*$")
_LEGAL_FIRST = re.compile(r"^(?:S\.A\.R\.L\.|S\.A\.|S\.L\.|B\.V\.|N\.V\.)\s+(?=\w+ \w)")
_DIGITS = str.maketrans("015689", "olsbbg")
_NUM = re.compile(r"^(?:\d+|ii|iii|iv|v|vi|vii|viii|ix|x|xi|xii)$")
_SIGNS = re.compile(r"[®™©\u200b\ufeff]|TM\b(?<=\wTM)")
_BRACKETS = re.compile(r"\s*[\(\[][^)\]]*[\)\]]\s*")
_QUOTED = re.compile(rf"(?<=\s)[{_MARKS}]\w+[{_MARKS}](?=\s)")
_CAPITALS = re.compile(r"(?:[A-Z0-9]\.?){2,6}")
_POINTED = re.compile(r"\b([A-Za-z])\.(?=\s*[A-Za-z])")
_JOINED = re.compile(r"(?<=[a-z]{3})([A-Z][a-z]{2})")
_POSSESSIVE = re.compile(r"['’](?=[a-z]\b)")
_TOKEN = re.compile(r"[a-z0-9]+")


def clean(raw: str | None) -> str:
    """Tokens of a typed name in reading order, lower case, without accents, marks, titles and legal forms; a trailing
    numeral is kept as ``#n``, an initial as ``x.``; an all-capital single word of up to six letters as ``!word``."""
    if raw is None:
        return ""
    s, plain = raw, raw.isascii()  # what needs a sign that is not there is left out
    if not plain:
        s = unicodedata.normalize("NFKD", raw.translate(_SPECIAL))
        s = "".join(c for c in s if not unicodedata.combining(c))
    s = s.replace("_", " ")
    if not plain or "TM" in s:
        s = _SIGNS.sub("", s)
    s = " ".join(s.split()).strip(_MARKS + " .,;:")
    if "(" in s or "[" in s:
        s = _BRACKETS.sub(" ", s).strip()
    if " " in s and (not plain or '"' in s or "'" in s or "`" in s):
        s = _QUOTED.sub(" ", s)
    if s[1:2] == ".":
        s = _LEGAL_FIRST.sub("", s)
    if s.rstrip(" .")[-1:] in ("l", "a", "v", "c", "L", "A", "V", "C"):
        s = _DOTTED_LEGAL.sub("", s)
    if s.count(",") == 1:
        head, tail = (x.strip() for x in s.split(","))
        if head and tail and tail.lower().strip(".") not in LEGAL:
            s = f"{tail} {head}"
    if _CAPITALS.fullmatch(s) and not s.isdigit():
        return "!" + re.sub(r"[^a-z0-9]", "", s.lower())
    if "." in s:
        s = _POINTED.sub(r"\1. ", s)
    s = _JOINED.sub(r" \1", s).lower()
    if "'" in s or "’" in s:
        s = _POSSESSIVE.sub("", s)
    tokens = _TOKEN.findall(s)
    out: list[str] = []
    for i, t in enumerate(tokens):
        if t in DECOR or (t in LEGAL and (i or len(tokens) > 2)):
            continue
        if _NUM.match(t) and (t.isdigit() or i == len(tokens) - 1 or len(t) > 1) and len(tokens) > 1:
            out.append("#" + t)
        elif len(t) == 1:
            out.append(t + ".")
        else:
            if not t.isalpha() and not t.isdigit():
                t = t.translate(_DIGITS)
            out.append(SAME_WORD.get(t, t))
    return " ".join(out)


def _subsequence(short: str, word: str) -> bool:
    it = iter(word)
    return all(c in it for c in short)


class Vocabulary:
    """The frequent words, with what is within one edit of them or short for them."""

    def __init__(self, words: list[str]):
        self.words = set(words)
        self.by_first: dict[str, list[str]] = {}
        for w in sorted(self.words):
            self.by_first.setdefault(w[:1], []).append(w)
        # a frequent short form is no word of its own
        self.words -= {w for w in words if (len(w) <= 4 or not re.search("[aeiou]", w[1:])) and self._short_for(w)}
        self.by_first = {k: [w for w in ws if w in self.words] for k, ws in self.by_first.items()}
        self.near: dict[str, str] = {}
        for w in sorted(self.words):
            if len(w) >= 5:
                for i in range(len(w)):
                    self.near.setdefault(w[:i] + w[i + 1 :], w)
        self.nick = {n: full for full, ns in NICKNAMES.items() for n in ns.split() if full in self.words}
        self.cache: dict[str, tuple[str, str]] = {}

    def classify(self, t: str) -> tuple[str, str]:
        """('word', w), ('short', its possible words, joined by /) or ('core', t)."""
        if t in self.cache:
            return self.cache[t]
        out = ("core", t)
        if t in self.words:
            out = ("word", t)
        elif t in self.nick:
            out = ("short", self.nick[t])
        elif len(t) >= 5 and (hit := self._fuzzy(t)):
            out = ("word", hit)
        elif for_word := self._short_for(t):
            out = ("short", "/".join(for_word))
        if len(self.cache) < 200_000:
            self.cache[t] = out
        return out

    def _short_for(self, t: str) -> list[str]:
        """Frequent words that ``t`` may be short for: their beginning, or some of their letters, mostly consonants."""
        if not 3 <= len(t) <= 7:
            return []
        vowels = sum(c in "aeiou" for c in t[1:])
        thin = vowels == 0 or (vowels == 1 and len(t) <= 6)
        return [w for w in self.by_first.get(t[:1], []) if len(w) >= len(t) + 2 and (w.startswith(t) or (thin and w[-1] == t[-1] or vowels == 0) and _subsequence(t, w))]

    def _fuzzy(self, t: str) -> str | None:
        forms = [t, *(t[:i] + t[i + 1 :] for i in range(len(t)))]
        if not self.words.isdisjoint(forms):
            for f in forms:
                if f in self.words and abs(len(f) - len(t)) <= 1 and len(f) >= 5:
                    return f
        if self.near.keys().isdisjoint(forms):
            return None
        for f in forms:
            w = self.near.get(f)
            if w and w[0] == t[0] and abs(len(w) - len(t)) <= 1 and len(w) >= 6:
                return w
        return None

    @staticmethod
    def _names_someone(core: list[str], sig: list[str], ini: list[str]) -> bool:
        """Not words that name no one, and not a short word alone, which may be anyone's given name or short form."""
        return any(c not in GENERIC for c in core) and (len(core) > 1 or bool(sig) or bool(ini) or len(core[0]) >= 9)

    def parse(self, cleaned: str) -> tuple[list[str], list[str], list[str], str, bool]:
        """(core tokens in order, frequent words sorted, initials in order, numeral, strong: names someone by itself)."""
        if not cleaned or cleaned[0] == "!":
            return [], [], [], "", False
        core, sig, ini, num = [], [], [], ""
        for t in cleaned.split():
            if t[0] == "#":
                num = f"{num} {t[1:]}".strip()
            elif t[-1] == ".":
                ini.append(t[0])
            else:
                kind, w = self.classify(t)
                (core if kind == "core" else sig).append(w)
        if not core and len(sig) == 1 and not ini:
            return [], sig, ini, num, False
        return core, sorted(set(sig)), ini, num, self._names_someone(core, sig, ini)


@lru_cache(maxsize=1 << 16)
def _base(num: str, letter: str, kind: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{num}|{letter}|{kind}".encode(), digest_size=8).digest())


#: An odd factor and its inverse modulo 2^64, so that the letters behind a deleted one move up by a product.
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)


def block_keys(typed: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, as_c): hashed keys under which spellings meet those within one edit of one of their core tokens, or of
    them joined: as a candidate, and (not as_c) those they have as a variant only.

    Keys are the tokens (kind a) and the tokens joined (kind c), each whole and without any one of its letters, and the tokens
    joined in reverse order (c), all with the numeral and a letter. A candidate shows the letter of its first word, or none.
    A variant must have that word, a short form or an initial of it, so it looks under the letters of all its words and
    initials, and under none if it has no word. All hashes of a batch are sums over the letters of all its texts; a key may
    occur twice in a row.
    """
    texts: list[str] = []
    row: list[int] = []
    base: list[int] = []
    both: list[bool] = []
    cuts: list[bool] = []
    for i, t in enumerate(typed):
        core, sig, ini, num = _unpack(t)
        joined = "".join(core)
        stems = [(x, "a", True) for x in dict.fromkeys(core)]
        if len(core) > 1:
            stems += [(joined, "c", True), ("".join(reversed(core)), "c", False)]
        elif len(joined) >= 9:
            stems.append((joined, "c", True))
        first = sig[0][:1] if sig else ""
        for letter in (first, *({w[0] for w in [*sig, *ini]} - {first})):
            for x, kind, cut_too in stems:
                texts.append(x)
                row.append(i)
                base.append(_base(num, letter, kind))
                both.append(letter == first)
                cuts.append(cut_too)
    if not texts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    letters = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    start = np.cumsum(size) - size
    of = np.repeat(np.arange(len(texts)), size)
    power = np.ones(size.max(initial=0) + 1, np.uint64)
    with np.errstate(over="ignore"):
        power[1:] = np.cumprod(np.full(len(power) - 1, _STEP, np.uint64))
        at = np.arange(len(letters)) - start[of]
        before = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(letters, 1) * power[at], dtype=np.uint64)])
        whole = before[start + size] - before[start]
        # deleting any letter of a run gives the same text
        keep = np.array(cuts)[of]
        keep[1:] &= (letters[1:] != letters[:-1]) | (at[1:] == 0)
        i = np.flatnonzero(keep)
        o = of[i]
        without = before[i] - before[start[o]] + (before[(start + size)[o]] - before[i + 1]) * np.uint64(_BACK)
        text = np.concatenate([np.arange(len(texts)), o])
        key = _mixed(_mixed(np.concatenate([whole, without]), 2) + np.array(base, np.uint64)[text], 3)
    return np.array(row)[text], key.view(np.int64), np.array(both)[text]


MET = "key bigint, v bigint, c bigint, w int, as_c boolean"


def _met(v: np.ndarray, c: np.ndarray | None = None, key: np.ndarray | None = None, w: np.ndarray | None = None, as_c: np.ndarray | None = None) -> pa.RecordBatch:
    """A batch of MET: pairs ``v``, ``c`` without a key, or rows of a large block without ``c``."""
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.nulls(len(v), t) if x is None else pa.array(x, t) for x, t in zip((key, v, c, w, as_c), types, strict=True)], ["key", "v", "c", "w", "as_c"])


def _met_in_blocks(key: np.ndarray, ids: np.ndarray, w: np.ndarray, as_c: np.ndarray, most: int, step: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Pairs of whole blocks of rows in the order of ``key``; the rows of blocks of more than ``most`` as they are."""
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[start, len(key)])
    n = np.repeat(size, size)
    if len(large := np.flatnonzero(n > most)):
        yield _met(ids[large], None, key[large], w[large], as_c[large])
    i = np.flatnonzero((n > 1) & (n <= most))
    n, first = n[i], np.repeat(start, size)[i]
    upto = np.cumsum(n)
    lo = 0
    while lo < len(i):  # about ``step`` pairs at a time
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + step, "right")))
        m = n[lo:hi]
        a = np.repeat(i[lo:hi], m)
        b = np.repeat(first[lo:hi] - (np.cumsum(m) - m), m) + np.arange(len(a))
        ok = as_c[b] & (ids[a] != ids[b]) & ((w[a] == w[b]) | (w[a] == 0) | (w[b] == 0))
        if ok.any():
            found = pd.DataFrame({"v": ids[a[ok]], "c": ids[b[ok]]}).drop_duplicates()
            yield _met(found["v"].to_numpy(), found["c"].to_numpy())
        lo = hi


@lru_cache(maxsize=1 << 17)
def _letters(t: str) -> int:
    """The letters of ``t`` as bits of a small set."""
    m = 0
    for c in t:
        m |= 1 << (ord(c) & 31)
    return m


def _apart(a: str, b: str, most: int) -> bool:
    """More than ``most`` edits apart by lengths or letters alone."""
    if abs(len(a) - len(b)) > most:
        return True
    x, y = _letters(a), _letters(b)
    # one edit takes away one letter and brings one at most (two for one in the look-alikes below, of which most >= 2 allows one)
    return (x & ~y).bit_count() > most or (y & ~x).bit_count() > most


def _middles(a: str, b: str) -> tuple[str, str]:
    """What is left of both without their common beginning and, after it, their common end."""
    i, j, n = 0, 0, min(len(a), len(b))
    while i < n and a[i] == b[i]:
        i += 1
    while j < n - i and a[-1 - j] == b[-1 - j]:
        j += 1
    return a[i : len(a) - j], b[i : len(b) - j]


def _within_one(a: str, b: str) -> bool:
    a, b = _middles(a, b)
    return len(a) + len(b) < 2 or len(a) == len(b) and (len(a) == 1 or len(a) == 2 and a == b[::-1])


def _osa(a: str, b: str, most: int) -> int:
    """Edit distance with neighbouring letters swapped as one edit; anything above ``most`` is most + 1."""
    if a == b:
        return 0
    if _apart(a, b, most):
        return most + 1
    if ("rn" in a or "rn" in b or "ph" in a or "ph" in b) and a.replace("rn", "m").replace("ph", "f") == b.replace("rn", "m").replace("ph", "f"):  # look or sound alike
        return 1
    a, b = _middles(a, b)
    if not a or not b:
        return min(len(a) + len(b), most + 1)
    if len(a) == len(b) and (len(a) == 1 or len(a) == 2 and a == b[::-1]):
        return min(1, most + 1)
    if most < 2:  # any other difference takes two edits
        return most + 1
    if most == 2:  # the first letters differ, so one edit is there: is the rest one edit at most?
        rests = [(a[1:], b), (a, b[1:]), (a[1:], b[1:])] + [(a[2:], b[2:])] * (a[:2] == b[1::-1])
        return 2 if any(abs(len(x) - len(y)) < 2 and _within_one(x, y) for x, y in rests) else 3
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if two is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, two[j - 2] + 1)
            row.append(v)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return min(one[-1], most + 1)


def _allowed(t: str) -> int:
    return 0 if len(t) <= 2 else 1 if len(t) <= 5 else 2


def _core_cost(v: list[str], c: list[str], ini: list[str]) -> tuple[float, list[str]]:
    """Cost of the core tokens of variant ``v`` as a rendering of ``c``, and the initials of ``ini`` left over."""
    best = 99.0
    if len(v) != len(c) or len(v) == 1:
        jv, jc = "".join(v), "".join(c)
        for alt in {jc, "".join(reversed(c))} if abs(len(jv) - len(jc)) <= 2 else ():
            d = _osa(jv, alt, 2)
            if d <= (2 if len(alt) >= 9 else _allowed(alt)):
                best = min(best, d * COST["edit"])
    left, used, cost = list(c), list(ini), 0.0
    rest = []
    for t in v:  # equal tokens first
        if t in left:
            left.remove(t)
        else:
            rest.append(t)
    for t in rest:
        most = _allowed(t)
        options = [(d, x) for x in left if most and len(x) > 2 and abs(len(t) - len(x)) <= 2 and (d := _osa(t, x, 2)) <= min(_allowed(x), most)]
        if not options:
            cost = 99.0
            break
        d, x = min(options)
        cost += d * COST["edit"]
        left.remove(x)
    if cost < 99:
        for x in left:
            if x[0] in used:
                used.remove(x[0])
                cost += COST["initial"]
            else:
                cost += COST["dropped"]
        if len(left) >= len(c):
            cost = 99.0
    if cost <= best:
        return cost, used
    return best, list(ini)


def _sig_cost(v: list[str], c: list[str], ini: list[str], core_c: list[str]) -> float:
    left, cost = list(c), 0.0
    rest: list[str] = []
    for t in v:
        if t in left:
            left.remove(t)
        else:
            rest.append(t)
    for t in rest:
        options = set(t.split("/"))
        hit = next((x for x in left if options & set(x.split("/"))), None)
        if hit is None:
            return 99.0
        left.remove(hit)
        cost += COST["short"]
    for i in ini:
        hit = next((x for x in left if x[0] == i), None)
        if hit is not None:
            left.remove(hit)
            cost += COST["initial"]
        elif not any(x[0] == i for x in core_c) and not any(x[0] == i for x in c):
            return 99.0
    return cost + COST["class_dropped"] * len(left)


def channel_cost(v: tuple, c: tuple) -> float:
    """Cost of canonical form ``c`` being typed as ``v``; each is (core, words, initials, numeral). 99: not at all."""
    if v[3] != c[3]:
        return 99.0
    same_initials = v[2] == c[2]
    if c[2] and not same_initials:  # an initialled form is canonical for its own typos only
        return 99.0
    cost, ini = _core_cost(v[0], c[0], [] if same_initials else v[2])
    if cost > MOST_COST:
        return 99.0
    return cost + _sig_cost(v[1], c[1], ini, c[0])


@lru_cache(maxsize=1 << 17)
def _unpack(s: str) -> tuple:
    core, sig, ini, num = s.split("|")
    return core.split(), sig.split(), ini.split(), num


PARSED = "norm string, typed string, strong boolean"


def spellings(df: DataFrame, record: str, name: str, aliases: str) -> tuple[DataFrame, DataFrame]:
    """(records, forms): ``rec, id, is_name`` for every strong spelling of a record, and ``id, norm, freq, typed`` of each form.

    ``norm`` is ``core|words|initials|numeral``, equal for all spellings that differ in case, accents, order, titles,
    legal form or marks only.
    """
    rows = df.select(F.col(record).cast("bigint").alias("rec"), F.explode(F.concat(F.array(F.struct(F.col(name).alias("raw"), F.lit(True).alias("is_name"))), F.coalesce(F.transform(F.col(aliases), lambda a: F.struct(a.alias("raw"), F.lit(False).alias("is_name"))), F.array()))).alias("s"))
    rows = rows.select("rec", "s.raw", "s.is_name").where("rec is not null and raw is not null and length(trim(raw)) > 0")

    @F.pandas_udf("string")
    def cleaned(raw: pd.Series) -> pd.Series:
        return raw.map(clean)

    texts = cut(rows.groupBy("raw").agg(F.count(F.lit(1)).alias("n"), F.max("is_name").alias("named")).withColumn("cleaned", cleaned("raw")))
    names = texts.where("named and cleaned <> ''").select("cleaned").distinct()
    total = names.count()
    words = names.select("cleaned", F.explode(F.array_distinct(F.split("cleaned", " "))).alias("t")).where("length(t) > 2 and substring(t, 1, 1) not in ('#', '!')")
    others = F.expr("filter(split(cleaned, ' '), x -> x <> t and length(x) > 3)")
    stats = words.select("t", F.substring(F.element_at(F.concat(others, F.array(F.lit(""))), 1), 1, 2).alias("beside"))
    stats = stats.groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("beside").alias("beside"))
    least = max(LEAST_NAMES, int(SHARE * total))
    # fewer than words per name / SHARE, whatever the number of names
    frequent = [r["t"] for r in stats.where((F.col("n") >= least) & (F.col("beside") >= LEAST_COMPANY)).select("t").collect()]
    vocabulary = Vocabulary(frequent)

    @F.pandas_udf(PARSED)
    def parsed(c: pd.Series) -> pd.DataFrame:
        norms, typed, strong = [], [], []
        for core, sig, ini, num, names_someone in map(vocabulary.parse, c):
            rest = f"|{' '.join(sig)}|{' '.join(ini)}|{num}"
            norms.append(" ".join(sorted(core)) + rest)
            typed.append(" ".join(core) + rest)
            strong.append(names_someone)
        return pd.DataFrame({"norm": norms, "typed": typed, "strong": strong})

    known = cut(texts.withColumn("p", parsed("cleaned")).where("p.strong").select("raw", "p.norm", "p.typed"))
    typed = cut(known.groupBy("norm").agg(F.min("typed").alias("typed")).withColumn("id", F.monotonically_increasing_id()))
    # a spelling that very many records bear: its rows are counted already
    spelled = texts.agg(F.sum("n")).first()[0] or 0
    hot = [r["raw"] for r in texts.where(F.col("n") > max(HOT_LEAST, spelled // HOT_PARTS)).select("raw").collect()]  # fewer than HOT_PARTS
    ids = known.select("raw", "norm").join(typed.select("norm", "id"), "norm").select("raw", "id")
    recs = cut(skew_safe_lookup(rows, ids, "raw", spelled, hot).where("id is not null").select("rec", "id", "is_name").distinct())
    freq = recs.select("rec", "id").distinct().groupBy("id").agg(F.count(F.lit(1)).alias("freq"))
    return recs, cut(typed.join(freq, "id"))


def _met_in_parts(key: np.ndarray, ids: np.ndarray, w: np.ndarray, letters: np.ndarray, as_v: np.ndarray, step: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Pairs of the variants and the candidates under each key that may stand for each other; rows are in the order of ``key``."""
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    for lo, hi in zip(start, [*start[1:], len(key)], strict=True):
        if hi - lo == 1 or hi - lo == 2 and ids[lo] == ids[lo + 1]:
            continue
        is_v = as_v[lo:hi]
        v, c = lo + np.flatnonzero(is_v), lo + np.flatnonzero(~is_v)
        if not len(c):
            continue
        some = max(1, step // len(c))  # about ``step`` pairs at a time
        for x in (v[i : i + some] for i in range(0, len(v), some)):
            wv, wc = w[x][:, None], w[c][None, :]
            ok = (ids[x][:, None] != ids[c][None, :]) & ((wv == wc) | (wv == 0) | (wc == 0)) & _may_stand(letters[x], letters[c])
            a, b = np.nonzero(ok)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(ids[x[a]]), pa.array(ids[c[b]])], ["v", "c"])


#: Letters that look-alikes (rn and m, ph and f) leave alone, each counted up to three times in two bits of a bigint; the number of tokens lies above them.
_COUNTED = "abcdegijkloqstuvwxyz"
_TOKENS_AT = 2 * len(_COUNTED)


def letter_counts(core: str) -> int:
    """The letters of the core tokens and their number, for ``_may_stand``."""
    n = min(core.count(" ") + 1, 1 << 20) << _TOKENS_AT
    for i, c in enumerate(_COUNTED):
        n |= min(core.count(c), 3) << (2 * i)
    return n


def _unary(counts: np.ndarray) -> np.ndarray:
    """A column for each of up to three occurrences of each letter: products of rows are the letters in common."""
    n = (counts[:, None] >> (2 * np.arange(len(_COUNTED)))) & 3
    return (n[:, :, None] > np.arange(3)).reshape(len(counts), -1).astype(np.float32)


def _may_stand(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Which of ``letter_counts`` ``v`` may be variants of which ``c`` by their letters; whatever ``channel_cost`` accepts is among them.

    An edit brings and takes away one counted letter at most, a look-alike none. Tokens edited one by one have at most ``edits``
    of them; as many tokens on both sides leave none of the candidate's out. A dropped token costs at least COST["initial"] of
    that. Otherwise the tokens joined are at most two edits apart.
    """
    x, y = _unary(v), _unary(c)
    common = x @ y.T
    brought, taken = x.sum(1)[:, None] - common, y.sum(1)[None, :] - common
    nv, nc = (v >> _TOKENS_AT)[:, None], (c >> _TOKENS_AT)[None, :]
    edits, beside_dropped = (max(2, int((MOST_COST - x) / COST["edit"])) for x in (0.0, COST["initial"]))
    same = (nv == nc) & (brought <= edits) & (taken <= edits)
    return same | (nv > nc) & (brought <= 2) & (taken <= 2) | (nv < nc) & (brought <= beside_dropped)


def in_parts(block: DataFrame) -> DataFrame:
    """Rows of large blocks (``key, id, w, as_c, letters``) under finer keys with their roles ``as_v`` and ``as_c``; no pair is lost.

    Spellings of fixed words meet those of the same words; those with loose words (0) meet all. What is still large is
    cut into parts by id, and every part as variants meets every part as candidates.
    """
    same, loose_v, loose_c = F.xxhash64("key", F.lit(1), "w"), F.xxhash64("key", F.lit(2)), F.xxhash64("key", F.lit(3))
    role = lambda key, as_v, as_c: F.struct(key.alias("sub"), F.lit(as_v).alias("as_v"), (F.lit(as_c) & F.col("as_c")).alias("as_c"))
    fixed = F.array(role(same, True, True), role(loose_v, False, True), role(loose_c, True, False))
    loose = F.array(role(loose_v, True, True), role(loose_c, False, True))
    subs = block.select("id", "w", "letters", F.explode(F.when(F.col("w") == 0, loose).otherwise(fixed)).alias("s")).select("id", "w", "letters", "s.*")
    subs = subs.withColumn("m", F.ceil(F.count(F.lit(1)).over(Window.partitionBy("sub")) / (PART * BLOCK))).withColumn("part", F.pmod(F.xxhash64("id"), "m"))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m") - 1))
    as_v = subs.where("as_v").select("*", other.alias("o")).select(F.xxhash64("sub", "part", "o").alias("key"), "id", "w", "letters", F.lit(True).alias("as_v"), F.lit(False).alias("as_c"))
    as_c = subs.where("as_c").select("*", other.alias("o")).select(F.xxhash64("sub", "o", "part").alias("key"), "id", "w", "letters", F.lit(False).alias("as_v"), F.lit(True).alias("as_c"))
    return as_v.unionByName(as_c)


def attach(forms: DataFrame) -> DataFrame:
    """``a``, ``b``: every form with its canonical form of maximum posterior, where one is likely enough."""

    most = BLOCK

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, key, as_c = block_keys(b.column("typed").to_pylist())
            ids, w = (b.column(x).to_numpy()[row] for x in ("id", "w"))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids), pa.array(w), pa.array(as_c)], ["key", "id", "w", "as_c"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, large = None, None  # the rows of the last key, which may go on; the key of a block that is large already
        for b in batches:
            rows = [b.column(x).to_numpy(zero_copy_only=False) for x in ("key", "id", "w", "as_c")]
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
            if large is not None and (n := int(np.searchsorted(rows[0], large, "right"))):
                yield _met(rows[1][:n], None, *(rows[i][:n] for i in (0, 2, 3)))
                rows = [x[n:] for x in rows]
            held, large = None, large if not len(rows[0]) else None
            if len(rows[0]):
                n = int(np.searchsorted(rows[0], rows[0][-1]))
                if n:
                    yield from _met_in_blocks(*(x[:n] for x in rows), most)
                held = [x[n:] for x in rows]
                if len(held[0]) > most:
                    yield _met(held[1], None, held[0], held[2], held[3])
                    held, large = None, held[0][0]
        if held is not None:
            yield from _met_in_blocks(*held, most)

    # words must agree, so their hash goes along; 0 where short forms or initials may still stand for others
    part = F.split("typed", r"\|")
    loose = part[1].contains("/") | (part[2] != "")
    words = F.when(loose, F.lit(0)).otherwise(F.hash(part[1]))
    keyed = forms.select("id", "typed", words.alias("w")).mapInArrow(keys, "key bigint, id bigint, w int, as_c boolean")
    # blocks come whole and in order, so a task pairs them one after the other; large ones are left to in_parts
    met = cut(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(meet, MET))
    core, sig, ini, num = (F.split("typed", r"\|")[i] for i in range(4))
    said = F.size(F.split(F.concat_ws(" ", core, sig), " "))
    info = cut(forms.select("id", "freq", "typed", said.alias("words"), sig.alias("sig"), num.alias("num"), sig.contains("/").alias("open"), (ini != "").alias("ini")))
    large = met.where("key is not null").select("key", F.col("v").alias("id"), "w", "as_c")

    @F.pandas_udf("bigint")
    def letters(core: pd.Series) -> pd.Series:
        return core.map(letter_counts)

    counted = forms.join(large.select("id").distinct(), "id", "left_semi").select("id", letters(part[0]).alias("letters"))

    def meet_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for b in batches:
            rows = [b.column(x).to_numpy(zero_copy_only=False) for x in ("key", "id", "w", "letters", "as_v")]
            held = [np.concatenate(x) for x in zip(held, rows, strict=True)] if held else rows
            if len(held[0]) and (n := int(np.searchsorted(held[0], held[0][-1]))):
                yield from _met_in_parts(*(x[:n] for x in held))
                held = [x[n:] for x in held]
        if held and len(held[0]):
            yield from _met_in_parts(*held)

    split = in_parts(large.join(counted, "id")).select("key", "id", "w", "letters", "as_v")
    pairs = split.repartition("key").sortWithinPartitions("key").mapInArrow(meet_parts, "v bigint, c bigint")
    # spread by v, they are distinct and meet their variant's text without another shuffle
    pairs = pairs.unionByName(met.where("key is null").select("v", "c")).repartition("v").distinct()
    renamed = lambda p: info.select(*[F.col(x).alias(p if x == "id" else p + x) for x in info.columns])
    # a candidate is at least as frequent as the variant, or says more; words that differ can only be short forms or stand for initials
    pairs = pairs.join(renamed("v"), "v").join(renamed("c"), "c").where("cwords > vwords or cfreq >= vfreq")
    likely = pairs.where("vnum = cnum and (vsig = csig or vopen or copen or vini)")

    @F.pandas_udf("double")
    def cost(vt: pd.Series, ct: pd.Series) -> pd.Series:
        return pd.Series([channel_cost(_unpack(a), _unpack(b)) for a, b in zip(vt, ct, strict=True)])

    scored = likely.withColumn("cost", cost("vtyped", "ctyped")).where(F.col("cost") <= MOST_COST)
    posterior = F.log(F.col("cfreq")) - LAMBDA * F.col("cost")
    # of equal ones the form that is last by its text, whatever ids the forms were given
    best = scored.groupBy("v").agg(F.max(F.struct(posterior.alias("p"), F.col("ctyped"), F.col("c"))).alias("m"))
    return best.select(F.col("v").alias("a"), F.col("m.c").alias("b"))


def same_names(df: DataFrame, record: str, name: str, aliases: str) -> DataFrame:
    """``rec``, ``grp``: the group of every record that names someone.

    Records whose name and aliases are null, blank, a single given name, an acronym or words that name no one in particular
    are in no group. Rows delivered again count once. An alias that stands beside many different names links nothing.
    """
    of, forms = spellings(df, record, name, aliases)
    # an alias is too general if the names beside it begin in many ways
    head = F.substring("norm", 1, 2)
    named = of.where("is_name").join(forms.select("id", head.alias("head")), "id").select("rec", F.col("id").alias("name_id"), "head")
    beside = of.where("not is_name").join(named, "rec")
    heads = beside.groupBy("id", "head").agg(F.count(F.lit(1)).alias("n")).groupBy("id").agg(F.sum("n").alias("n"), F.max("n").alias("top"))
    general = heads.where("n >= 4 and top * 2 < n").select("id")
    good = cut(of.where("not is_name").join(general, "id", "left_anti").select("rec", "id").unionByName(of.where("is_name").select("rec", "id")))
    first = cut(good.groupBy("rec").agg(F.min("id").alias("hub")))
    together = good.join(first, "rec").where("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()
    edges = together.unionByName(attach(forms)).distinct()
    comp = contract(edges)
    return first.join(comp.withColumnRenamed("v", "hub"), "hub", "left").select("rec", F.coalesce("r", "hub").alias("grp"))


def same_name_pairs(groups: DataFrame) -> DataFrame:
    """Every pair of different records of one group, smaller id first: as many rows as the required result has."""
    a, b = groups.alias("a"), groups.alias("b")
    return a.join(b, F.expr("a.grp = b.grp and a.rec < b.rec")).select(F.col("a.rec").alias("rec_a"), F.col("b.rec").alias("rec_b"))


