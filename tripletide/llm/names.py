"""Reading names that people typed: titles, particles, legal forms, word order, nicknames, initials, spelling."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

#: Words before a person's name, and particles of surnames.
TITLES = "herr frau lady sir dr prof dipl ing mr mrs ms miss doktor professor madame monsieur".split()
PARTICLES = "van der de zu von den zum zur vom la le du".split()
#: Words that say what kind of organisation a name belongs to, each line one kind, with short forms; the first word stands for all.
SECTORS = """stiftung stftg
werke wke
gesellschaft ges klangforschung
orchester orch
verein heimatkunde
laboratory laboratories lab
maschinenbau masch
archiv arch stadtgeschichte
research res association assoc
gebrüder gebr söhne
sportgemeinschaft sg
optical opt
shipping shpg
foundation fdn
akademie akad
institut inst messtechnik
verlag vlg
technische techn universität uni tu""".split("\n")
#: Legal forms and joining words of organisations' names.
LEGAL = "the und and fur für f bau gmbh mbh ag inc incorporated corporation corp co company ltd limited ev v kg haus group gruppe for of".split()
#: Common German given names, each with its short and pet forms.
GIVEN = {
    "adele": "", "albrecht": "albi", "alena": "", "alexander": "alex sascha", "alma": "", "andreas": "andi", "annika": "anni", "anselm": "", "antonia": "toni", "arvid": "", "astrid": "", "august": "",
    "beate": "", "benedikt": "ben bene", "bettina": "betti", "birger": "", "brigitte": "gitte gitta biggi", "bruno": "", "carla": "", "christoph": "stoffel chris", "clemens": "", "cordula": "", "dagmar": "",
    "daniel": "dani", "dorothea": "thea doro", "edgar": "", "elisabeth": "lisbeth elli liesel", "elmar": "", "emilia": "emmi", "erik": "", "eva": "evi", "fabian": "", "felicitas": "", "ferdinand": "ferdl ferdi",
    "florian": "flori", "frieda": "", "gabriele": "gabi", "georg": "schorsch", "gerda": "", "gregor": "", "gustav": "", "hanna": "", "hedwig": "hedi", "heinrich": "heiner heini", "helene": "lene leni", "henrik": "",
    "hubert": "", "ida": "", "ingrid": "", "isolde": "", "jakob": "", "jasmin": "", "johannes": "hannes hans", "josephine": "josi", "julius": "", "karoline": "line", "kaspar": "", "katharina": "kathi",
    "konrad": "conny", "kristina": "", "laurenz": "", "leonore": "lore", "lorenz": "", "ludmilla": "", "luise": "", "magdalena": "lena magda", "malte": "", "margarete": "grete gretel", "martin": "", "mathilde": "",
    "maximilian": "max", "michael": "michel michi", "mina": "", "moritz": "", "nadine": "", "nikolaus": "klaus niko", "nora": "", "oda": "", "oskar": "", "ottilie": "", "paula": "", "peter": "", "philippa": "",
    "quirin": "", "raimund": "", "rebekka": "becky", "richard": "", "rosalie": "rosi", "rudolf": "rudi", "sabine": "", "samuel": "sam", "sebastian": "basti", "sibylle": "", "sophia": "fia", "stefan": "",
    "susanne": "susi", "theodor": "theo", "theresa": "resi", "thomas": "tom", "ulrike": "ulla", "ursula": "uschi", "valentin": "veit", "veronika": "vroni", "viktor": "vic", "walburga": "", "werner": "",
    "wilhelm": "willi", "winfried": "", "yvonne": "", "zacharias": "",
}

_SOUNDS = (("ß", "s"), ("ä", "a"), ("ö", "o"), ("ü", "u"), ("ae", "a"), ("oe", "o"), ("ue", "u"), ("ph", "f"), ("th", "t"), ("ck", "k"), ("c", ""), ("ie", "i"), ("ai", "ei"), ("tz", "z"))
_HARD_C = re.compile("c(?!h)")
_TWICE = re.compile(r"(.)\1+")


@lru_cache(50_000)
def fold(word: str) -> str:
    """Lower case, umlauts and spellings of one sound alike, doubled letters single."""
    w = (word if word.isascii() else unicodedata.normalize("NFC", word)).lower()
    for a, b in _SOUNDS:
        if a in w:
            w = w.replace(a, b) if b else _HARD_C.sub("k", w)
    if not (w.isascii() and w.isalpha()):
        w = "".join(c for c in unicodedata.normalize("NFKD", w) if c.isalpha())
    return _TWICE.sub(r"\1", w)


def within(a: str, b: str, k: int) -> int | None:
    """Edits between two words, a swap of neighbours being one, if at most ``k``; else None."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > k:
        return None
    lo, n = 0, min(len(a), len(b))
    while lo < n and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < n - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    if not a or not b:
        return len(a) + len(b)
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        if min(new) > k:
            return None
        before, row = row, new
    return row[-1] if row[-1] <= k else None


def cuts(w: str) -> set[str]:
    """``w`` and what is left of it without one letter."""
    return {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}


class _Words:
    """Words that stand for others, found with one edit for words of four letters and more, with two for long ones."""

    #: Letters from which two edits are allowed if the first letter is right, and in any case.
    LONG, LONGER = 8, 10

    def __init__(self, pairs: list[tuple[str, str]]):
        self.of = dict(pairs)
        self.longest = max(map(len, self.of))
        self.by_cut: dict[str, list[str]] = {}
        self.by_pair: dict[str, list[str]] = {}
        for w in self.of:
            if len(w) > 3:
                for c in cuts(w):
                    self.by_cut.setdefault(c, []).append(w)
            if len(w) >= self.LONG:
                for x in {w[i : i + 2] for i in range(len(w) - 1)}:
                    self.by_pair.setdefault(x, []).append(w)

    def find(self, w: str, most: int = 1) -> tuple[str | None, int]:
        """(what it stands for or None, edits)."""
        if w in self.of:
            return self.of[w], 0
        if 3 < len(w) <= self.longest + 1:
            for c in cuts(w):
                for x in self.by_cut.get(c, ()):
                    if within(w, x, 1):
                        return self.of[x], 1
        if most > 1 and len(w) >= self.LONG - 1:
            shared: dict[str, int] = {}
            for i in range(len(w) - 1):
                for x in self.by_pair.get(w[i : i + 2], ()):
                    shared[x] = shared.get(x, 0) + 1
            for x, n in shared.items():  # two edits leave all but six pairs of neighbours
                if n >= len(x) - 7 and (x[0] == w[0] or len(x) >= self.LONGER) and within(w, x, 2):
                    return self.of[x], 2
        return None, 0


_TITLES = {fold(t) for t in TITLES}
_PARTICLES = {fold(t) for t in PARTICLES}
_PLAIN = str.maketrans("äöüß", "aous")
_SPLIT = re.compile(r"(?<=[a-zäöüß]{2})(?=[A-ZÄÖÜ][a-zäöüß])")
#: What organisations' words stand for: their sector, or nothing for legal forms. Words are met plain and folded.
_ORG = _Words([(x, fold(line.split()[0]) if line else "") for line, w in [*((s, w) for s in SECTORS for w in s.split()), *(("", w) for w in LEGAL)] for x in {w.lower().translate(_PLAIN), fold(w)}])
_GIVEN = _Words([(w, f) for f, nicks in GIVEN.items() for n in [*nicks.split(), f] for w in (fold(n), n)])
#: Two-letter words that only organisations have.
_SHORT_ORG = {"sg", "ag", "kg", "tu"}


@lru_cache(50_000)
def _org(plain: str, folded: str) -> tuple[str | None, int]:
    """(sector, empty for legal forms, None for other words; edits)."""
    a = _ORG.find(plain, 2)
    if a[0] is not None and not a[1] or plain == folded:
        return a
    b = _ORG.find(folded, 2)
    return min((x for x in (a, b) if x[0] is not None), key=lambda x: x[1], default=a)


def _is_org(p: str, x: str) -> bool:
    """The word tells an organisation where no type does."""
    what, off = _org(p, x)
    return what is not None and (len(x) > 5 or not off and (len(x) > 2 or x in _SHORT_ORG))


@lru_cache(50_000)
def _given(plain: str, folded: str) -> tuple[str | None, bool]:
    """The given name that a word means as it stands, else by its sound; and whether it is spelt right."""
    a, b = _GIVEN.find(plain), _GIVEN.find(folded)
    g = min(a, b, key=lambda g: (g[0] is None, g[1]))
    return g[0], not g[1]


_LETTERS = re.compile(r"[^\W\d_]+").findall


@lru_cache(50_000)
def _word(w: str) -> tuple[str, str]:
    """(plain, folded)."""
    return w.lower().translate(_PLAIN), fold(w)


_HIDDEN = re.compile(r"[\u0000-\u0008\u000e-\u001f\u007f\u00ad\u200b-\u200f\u2028-\u202e\u2060\ufeff]")


def clean(s: str) -> str:
    """Compatible characters as one, without invisible ones."""
    return s if s.isascii() and s.isprintable() else _HIDDEN.sub("", unicodedata.normalize("NFKC", s))


def words(name: str) -> list[tuple[str, str]]:
    """(plain, folded) words of a name, what follows a comma first; a name written as one word is cut at its inner capital."""
    s = clean(name)
    if not re.search(r"[\s\-,.]", s.strip(" \"'.")):
        s = _SPLIT.sub(" ", s)
    before, _, after = s.partition(",")
    return [x for w in _LETTERS(f"{after} {before}") if (x := _word(w))[1]]


def read(name: str | None, kind: str | None) -> tuple[str, str, str] | None:
    """(P or O, core, extra) of a name; None where nothing is left.

    core is the folded surname or the distinctive word of an organisation; extra is the formal given name, an initial or
    empty, of an organisation its sectors, joined by ``+``. ``kind`` is a type as written; without a known one the words decide, and a single word counts as O.
    """
    if not name:
        return None
    w = words(name)
    k = fold(kind or "")
    known = k.startswith("pers") or k.startswith("org")
    if k.startswith("org") or not known and (len(w) == 1 or any(_is_org(p, x) for p, x in w)):
        means = [_org(p, x) for p, x in w]
        # The longest word of its own; where all are known words, the one most misspelt is the name.
        at = max((i for i, (_, x) in enumerate(w) if len(x) > 2), key=lambda i: (means[i][0] is None, means[i][1], len(w[i][1]), -i), default=None)
        if at is None or means[at] == (means[at][0], 0) and means[at][0] is not None:
            return None
        return "O", w[at][1], "+".join(sorted({m for i, (m, _) in enumerate(means) if m and i != at}))
    w = [(p, x) for p, x in w if x not in _TITLES and x not in _PARTICLES]
    if len(w) == 1:  # both names as one word
        p, x = w[0]
        cut = next((i for i in range(len(p) - 5, 3, -1) if p[:i] in _GIVEN.of), None)
        if cut:
            w = [(p[:cut], fold(p[:cut])), (p[cut:], fold(p[cut:]))]
    if not w:
        return None
    got = [_given(p, x) for p, x in w]
    # The surname: no initial, no given name, of the rest the longest (a misspelt given name only if nothing else is there).
    rank = [(len(x) > 1, g is None, not sure, len(x), i) for i, ((_, x), (g, sure)) in enumerate(zip(w, got))]
    at = max(range(len(w)), key=lambda i: rank[i])
    rest = [(p, g) for i, ((p, _), (g, _)) in enumerate(zip(w, got)) if i != at]
    if len(w[at][1]) < 2:
        return None
    p, g = rest[0] if rest else ("", None)
    return "P", w[at][1], g or p


#: Words that places, events, documents and concepts are named with.
THING_WORDS = {
    fold(w)
    for w in (
        "bad sankt neu city landkreis am see bei von über weltausstellung festival konferenz vertrag schlacht expedition hochwasser "
        "protokoll handschrift bericht chronik almanach band teil satz protocol ansatz effekt theorie verfahren"
    ).split()
}
_THING_TYPES = _Words([(fold(w), "X") for w in "ort location lage ereignis event dokument document konzept concept".split()])
_DIGITS = re.compile(r"\d+")


@lru_cache(20_000)
def _hint(kind: str) -> str:
    """P, O, X or empty for a type as people write it."""
    for part in re.split(r"[/(\s]", kind):
        f = fold(part)
        if f[:4] == "pers" or within(f, "person", 1) is not None:
            return "P"
        if f[:3] == "org" or within(f[:12], "organisation", 1) is not None or within(f[:12], "organization", 1) is not None:
            return "O"
        if _THING_TYPES.find(f)[0]:
            return "X"
    return ""


@lru_cache(50_000)
def read_any(name: str | None, kind: str | None) -> tuple[str, str, str] | None:
    """`read` for things of any type: places, events, documents and concepts give (X, folded text, numbers)."""
    if not name:
        return None
    h = _hint(kind or "")
    if not h:
        w = words(name)
        thing = any(x in THING_WORDS for _, x in w) or any(c.isdigit() for c in name)
        if not thing and any(_is_org(p, x) for p, x in w):
            h = "O"
        elif not thing and len(w) > 1 and any(len(x) == 1 or x in _TITLES or _given(p, x)[0] for p, x in w):
            h = "P"
        else:
            h = "X"
    if h != "X":
        return read(name, "pers" if h == "P" else "org")
    s = clean(name)
    text = " ".join(f for x in _LETTERS(s) if (f := fold(x)))
    return ("X", text, ".".join(_DIGITS.findall(s))) if text else None


def edits(n: int) -> int:
    """Edits that `same` allows between two cores, the shorter of ``n`` letters."""
    return 0 if n < 5 else 1 if n < 8 else 2


def same_extra(kind: str, g: str, h: str) -> bool:
    """Given names equal, the initial of the other, or two edits apart where one is no known name; sectors of which one is shared; numbers equal."""
    if g == h:
        return True
    if kind == "P":
        return g[:1] == h[:1] and min(len(g), len(h)) == 1 or min(len(g), len(h)) > 4 and not (g in GIVEN and h in GIVEN) and within(g, h, 2) is not None
    return kind == "O" and not set(g.split("+")).isdisjoint(h.split("+"))


def same(a: tuple[str, str, str], b: tuple[str, str, str]) -> bool:
    """Two readings that name one thing: cores a few edits apart and what stands beside them alike."""
    if a == b:
        return True
    return a[0] == b[0] and same_extra(a[0], a[2], b[2]) and within(a[1], b[1], edits(min(len(a[1]), len(b[1])))) is not None


def half(n: int) -> int:
    """Letters of the two ends of a word by which those of ``n`` letters and more are met."""
    return 4 if n < 10 else 5 if n < 12 else 6


def ends(word: str, h: int) -> set[str]:
    """What is left of the first and of the last ``h`` letters with none or one letter taken out."""
    return {f"{h}<{c}" for c in cuts(word[:h])} | {f"{h}>{c}" for c in cuts(word[-h:])}


def _all_ends(word: str) -> set[str]:
    """`ends` for all lengths, from eight letters, of words up to two letters shorter."""
    return set().union(*(ends(word, h) for h in {half(m) for m in range(max(8, len(word) - 2), len(word) + 1)}))


def leads(kind: str, extra: str) -> tuple[list[str], list[str]]:
    """(own, sought): rewritings of a given name or of sectors, under which names are looked for; two that `same_extra` accepts share one.

    An initial seeks all names that begin with it, and they do not seek it. A given name that is no known one meets the known
    names within two edits, and others of its kind as cores of two edits meet, short ones by what is left without two letters.
    """
    if kind == "O":
        own = [f"O={x}" for x in extra.split("+")]
        return own, own
    if len(extra) == 1:
        return [f"P={extra}"], [f"P={extra}", f"P.{extra}"]
    own, sought = [f"P={extra}"], [f"P={extra}"]
    if len(extra) > 4 and extra not in GIVEN:
        known = [f"P={g}" for g in GIVEN if len(g) > 4 and within(g, extra, 2) is not None]
        short = {y for x in cuts(extra) for y in cuts(x)} if len(extra) < 10 else set()
        own += known + [f"P~{x}" for x in (short if len(extra) < 8 else ends(extra, half(len(extra))))]
        sought += known + [f"P~{x}" for x in short | _all_ends(extra)]
    return [*own, f"P.{extra[:1]}"] if extra else own, sought


def forms(kind: str, core: str, extra: str) -> tuple[list[str], list[str]]:
    """(own, sought) keys: of two spellings that `same` accepts, one has among its own keys one that the other seeks: that with the shorter core.

    Cores that allow no edit meet as they are, for one edit by what is left without a letter. Of two edits, at most one lies in the
    first half or in the last one, a swap across the middle counting in both as one: so one end of the cores meets with one letter taken out.
    """
    n = len(core)
    short = {f"={core}"} if n < 5 else {f"={c}" for c in cuts(core)} if n < 9 else set()
    own = short if n < 8 else ends(core, half(n))
    sought = short if n < 8 else short | _all_ends(core)
    lead = leads(kind, extra)
    return [f"{x}|{y}" for x in lead[0] for y in sorted(own)], [f"{x}|{y}" for x in lead[1] for y in sorted(sought)]


def forget() -> None:
    """Empty the caches of words and names."""
    for f in (fold, _org, _given, _word, _hint, read_any):
        f.cache_clear()
