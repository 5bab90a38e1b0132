"""Text scalars as column expressions: normalisation, templates, keyword typing, claim heuristics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ARTICLES_DE_EN = r"\b(a|an|the|der|die|das|ein|eine|einer|eines|einem|einen)\b"
_ARTICLES_EN = r"\b(a|an|the)\b"
_ASCII_PUNCTUATION = r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"""


def normal_answer(text: Column, german: bool = True) -> Column:
    """Lower case, ja/nein as yes/no, no articles, no ASCII punctuation, single spaces; null stays null."""
    t = F.lower(text)
    if german:
        bare = F.trim(t)
        t = F.when(bare == "ja", "yes").when(bare == "nein", "no").otherwise(t)
    t = F.regexp_replace(t, "(?U)" + (_ARTICLES_DE_EN if german else _ARTICLES_EN), " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, _ASCII_PUNCTUATION, ""), r"(?U)\s+", " "))


def tokens(text: Column) -> Column:
    """Words between spaces; none for null and empty text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), " "), lambda x: x != "")


def exact_match(prediction: Column, gold: Column) -> Column:
    return normal_answer(prediction).eqNullSafe(normal_answer(gold))


def common_tokens(a: Column, b: Column) -> Column:
    """Size of the overlap of two bags of words."""
    count = lambda arr, w: F.size(F.filter(arr, lambda x: x == w))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda acc, w: acc + F.least(count(a, w), count(b, w)))


def token_f1(prediction: Column, gold: Column, empty_is_one: bool = False, german: bool = True) -> Column:
    """Struct (f1, precision, recall) over bags of normalised words; all 0 where either side is empty, or 1 where both are and that is asked for."""
    zero = F.struct(F.lit(0.0).alias("f1"), F.lit(0.0).alias("precision"), F.lit(0.0).alias("recall"))
    one = F.struct(F.lit(1.0).alias("f1"), F.lit(1.0).alias("precision"), F.lit(1.0).alias("recall"))

    def score(z: Column) -> Column:
        p, r = F.try_divide(z["n"], F.size(z["a"])), F.try_divide(z["n"], F.size(z["b"]))
        full = F.struct((2 * p * r / (p + r)).alias("f1"), p.alias("precision"), r.alias("recall"))
        both = (F.size(z["a"]) == 0) & (F.size(z["b"]) == 0)
        return F.when(both, one if empty_is_one else zero).when(z["n"] == 0, zero).otherwise(full)

    # Bound in lambdas, the words are cut once for a row and not wherever they are used.
    words = F.array(F.struct(tokens(normal_answer(prediction, german)).alias("a"), tokens(normal_answer(gold, german)).alias("b")))
    counted = F.transform(words, lambda z: F.struct(z["a"].alias("a"), z["b"].alias("b"), common_tokens(z["a"], z["b"]).alias("n")))
    return F.get(F.transform(counted, score), F.lit(0))


# Sentences for relations, %s: subject and object.
CLAIMS_DE = {
    "HAUPTSTADT_VON": "%s ist die Hauptstadt von %s", "GEBOREN_IN": "%s wurde in %s geboren", "GESTORBEN_IN": "%s ist in %s gestorben", "ARBEITET_BEI": "%s arbeitet bei %s",
    "WOHNT_IN": "%s wohnt in %s", "MITGLIED_VON": "%s ist Mitglied von %s", "TEIL_VON": "%s ist Teil von %s", "RELATED_TO": "%s steht in Beziehung zu %s", "SUPPORTS": "%s unterstützt %s",
}
ANSWERS_DE = {"HAS_ANSWER": "Die Antwort auf die Frage ist %s", "ANSWERS": "Die Antwort lautet %s"}
HYPOTHESES_EN = {
    "BORN_IN": "%s was born in %s", "DIED_IN": "%s died in %s", "DIRECTED_BY": "%s was directed by %s", "WRITTEN_BY": "%s was written by %s", "LOCATED_IN": "%s is located in %s",
    "CAPITAL_OF": "%s is the capital of %s", "MEMBER_OF": "%s is a member of %s", "PART_OF": "%s is part of %s", "CLAIMS": "%s %s", "RELATED_TO": "%s is related to %s", "SUPPORTS": "%s supports %s",
}
ANSWERS_EN = {"HAS_ANSWER": "The answer is %s", "ANSWERS": "The answer is %s"}


def sentence(subject: Column, predicate: Column, obj: Column, templates: dict[str, str], answers: dict[str, str]) -> Column:
    """A sentence for a fact: by template, else subject, relation in lower-case words, object."""
    p = F.upper(predicate)
    c = None
    for k, t in templates.items():
        v = F.format_string(t, subject, obj)
        c = F.when(p == k, v) if c is None else c.when(p == k, v)
    for k, t in answers.items():
        c = c.when(p == k, F.format_string(t, obj))
    return c.otherwise(F.concat_ws(" ", subject, F.lower(F.replace(p, F.lit("_"), F.lit(" "))), obj))


# Words in a name that tell a type, tried in this order; a name with none is a person.
TYPE_WORDS = {
    "realistic": {
        "Ort": "city country river state mountain lake", "Organisation": "university company inc ltd school band team",
        "Ereignis": "war battle championship election festival award", "Konzept": "film movie album song book novel series",
    },
    "fever": {
        "Ort": "city country state province river mountain lake ocean island continent valley street",
        "Organisation": "university company inc ltd corp school band team organization association institute foundation agency department studio records",
        "Ereignis": "war battle championship election festival award ceremony tournament olympics concert tour",
        "Konzept": "film movie album song book novel series theory law principle concept genre style",
    },
    "stream": {
        "Ort": "city country state province river mountain lake ocean island continent valley",
        "Organisation": "university company inc ltd corp school band team organization association institute foundation agency department",
        "Ereignis": "war battle championship election festival award ceremony tournament olympics concert",
        "Konzept": "film movie album song book novel series theory law principle concept",
    },
    "comprehensive": {
        "Ort": "city country river mountain lake island state county village town",
        "Organisation": "university company corporation inc ltd organization institute foundation college school hospital museum library bank",
        "Ereignis": "war battle election festival championship world_cup olympics conference summit",
    },
    "hybrid": {
        "Ort": "city country state river mountain island", "Organisation": "university company inc corp organization band team",
        "Ereignis": "war battle election festival championship",
    },
}


def entity_type(name: Column, variant: str = "realistic") -> Column:
    """Type by the first list with a word that occurs anywhere in the name; else Person. ``hybrid`` also knows works by a bracket, and lower-case names are concepts."""
    low = F.lower(name)
    c = None
    for kind, words in TYPE_WORDS[variant].items():
        hit = None
        for w in words.split():
            one = low.contains(w.replace("_", " "))
            hit = one if hit is None else hit | one
        c = F.when(hit, kind) if c is None else c.when(hit, kind)
    if variant == "hybrid":
        inner = F.lower(F.regexp_extract(name, r"\(([^)]*)\)", 1))
        first = F.substring(name, 1, 1)
        return c.when(inner.isin("film", "album", "book", "song", "tv series"), "Konzept").when(first != F.lower(first), "Person").otherwise("Konzept")
    return c.otherwise("Person")


# Words in a question that tell a relation, in this order.
QUESTION_WORDS = (
    ("GEBOREN_IN", "born birthplace"), ("GESTORBEN_IN", "died death"), ("ARBEITET_BEI", "work employ"), ("REGIE_BEI", "direct film movie"), ("GRUENDETE", "found establish"),
    ("BEFINDET_SICH_IN", "locat where"), ("MITGLIED_VON", "member belong"), ("SPIELT_FUER", "play sport"), ("VERHEIRATET_MIT", "marr spouse"), ("VERWANDT_MIT", "child parent son daughter"),
)


def relation_type(question: Column, s_type: Column, o_type: Column) -> Column:
    low = F.lower(question)
    c = None
    for rel, words in QUESTION_WORDS:
        hit = None
        for w in words.split():
            hit = low.contains(w) if hit is None else hit | low.contains(w)
        c = F.when(hit, rel) if c is None else c.when(hit, rel)
    person = s_type == "Person"
    return c.when(person & (o_type == "Organisation"), "ASSOZIIERT_MIT").when(person & (o_type == "Ort"), "VERBUNDEN_MIT").when(person & (o_type == "Ereignis"), "TEILNAHME_AN").otherwise("RELATED_TO")


def question_type(question: Column, hint: Column | None = None) -> Column:
    low = F.lower(question)
    has = lambda words: low.rlike("|".join(words))
    c = F.when(has(["compare", "difference", "both", "either"]), "comparison").when(has(["when", "where", "who", "what"]), "bridge").otherwise("unknown")
    return c if hint is None else F.when(hint.isin("comparison", "bridge"), hint).otherwise(c)


#: Auxiliaries that take a negation.
AUXILIARIES = (" is ", " was ", " are ", " were ", " has ", " have ", " can ", " will ")


def negate(text: Column) -> Column:
    """The first listed auxiliary that occurs is negated once; else ``not`` goes before the third word, if there is one."""
    c = None
    for a in AUXILIARIES:
        neg = " cannot " if a == " can " else a + "not "
        at = F.instr(text, a)
        v = F.concat(F.substring(text, F.lit(1), at - 1), F.lit(neg), F.substring(text, at + len(a), F.length(text)))
        c = F.when(at > 0, v) if c is None else c.when(at > 0, v)
    w = F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")
    return c.when(F.size(w) >= 3, F.array_join(F.concat(F.slice(w, 1, 2), F.array(F.lit("not")), F.slice(w, F.lit(3), F.size(w))), " ")).otherwise(F.array_join(w, " "))


def sentences(text: Column) -> Column:
    """Pieces that end in . ! or ? before white space, trimmed, none empty."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda x: F.trim(x)), lambda x: x != "")


_COPULAS = ("is", "was", "are", "were", "has", "had", "have", "became", "becomes")


def claim_parts(claim: Column, least: int = 4) -> Column:
    """Struct (subject, predicate, object): the words up to the first lower-case one (articles count along), the first copula after them, the rest.

    Null for claims of fewer than ``least`` words or with nothing left for an object. Without a copula the predicate is STATES and the object the last four words at most.
    """
    w = F.filter(F.split(F.coalesce(claim, F.lit("")), r"(?U)\s+"), lambda x: x != "")
    n = F.size(w)
    lower_first = F.transform(w, lambda x: (F.substring(x, 1, 1) == F.lower(F.substring(x, 1, 1))) & ~F.lower(x).isin("the", "a", "an"))
    at = F.array_position(lower_first, True)  # 1-based, 0: all capitalised
    head = F.when(at == 0, n).when(at == 1, F.least(n, F.lit(3))).otherwise(at - 1).cast("int")
    rest = F.slice(w, head + 1, F.greatest(n - head, F.lit(0)))
    verb = F.array_position(F.transform(rest, lambda x: F.lower(x).isin(*_COPULAS)), True).cast("int")
    m = F.size(rest)
    start = F.when(verb > 0, F.when(verb >= m, F.greatest(m - 4, F.lit(0))).otherwise(verb)).otherwise(F.lit(0))
    obj = F.regexp_replace(F.array_join(F.slice(rest, start + 1, F.greatest(m - start, F.lit(0))), " "), r"[.,!?;:]+$", "")
    pred = F.when(verb > 0, F.upper(F.get(rest, verb - 1))).otherwise("STATES")
    return F.when((n >= least) & (m > 0) & (F.length(obj) >= 2), F.struct(F.array_join(F.slice(w, F.lit(1), head), " ").alias("subject"), pred.alias("predicate"), obj.alias("object")))


#: Verbs that part a claim.
CLAIM_VERBS = ("is", "was", "are", "were", "has", "have", "had", "became", "becomes", "plays", "played", "stars", "starred", "directed", "wrote", "born", "died", "founded", "created")


def enhanced_claim(claim: Column) -> Column:
    """Struct (subject, predicate, object) of a claim, the first that fits: around its first listed verb; its capitalised start STATES the rest; its first half CLAIMS the second.

    An article before the subject and marks after the object fall away; either is to have two letters, but for the halves. Null for claims of fewer than three words.
    """
    w = F.filter(F.split(F.coalesce(claim, F.lit("")), r"(?U)\s+"), lambda x: x != "")
    n = F.size(w)
    cut = lambda lo, k: F.array_join(F.slice(w, lo, F.greatest(k, F.lit(0))), " ")
    bare = lambda x: F.regexp_replace(x, r"[.,!?;:]+$", "")
    at = F.array_position(F.transform(w, lambda x: F.lower(x).isin(*CLAIM_VERBS)), True).cast("int")
    s1, o1 = F.regexp_replace(cut(F.lit(1), at - 1), r"^(?i)(The|A|An)\s+", ""), bare(cut(at + 1, n - at))
    article = lambda x: F.lower(x).isin("the", "a", "an")
    low = F.array_position(F.transform(w, lambda x, i: ~(article(x) | (i == 0) | (F.substring(x, 1, 1) != F.lower(F.substring(x, 1, 1))))), True).cast("int")
    caps = F.filter(F.slice(w, F.lit(1), F.greatest(low - 1, F.lit(0))), lambda x: ~article(x))
    o2 = bare(cut(F.greatest(low, F.lit(1)), n - low + 1))
    three = lambda s, p, o: F.struct(s.alias("subject"), p.alias("predicate"), o.alias("object"))
    mid = F.floor(n / 2).cast("int")
    x = F.when((at > 1) & (F.length(s1) > 1) & (F.length(o1) > 1), three(s1, F.upper(F.get(w, at - 1)), o1))
    x = x.when((low > 0) & (F.size(caps) > 0) & (F.length(o2) > 1), three(F.array_join(caps, " "), F.lit("STATES"), o2))
    return F.when(n > 2, x.otherwise(three(cut(F.lit(1), mid), F.lit("CLAIMS"), bare(cut(mid + 1, n - mid)))))


def simple_claim(claim: Column) -> Column:
    """Struct (subject, predicate, object): the first word (with an article before it), CLAIMS, the last three words; null for claims under three words."""
    w = F.filter(F.split(F.coalesce(claim, F.lit("")), r"(?U)\s+"), lambda x: x != "")
    n = F.size(w)
    article = F.lower(F.get(w, F.lit(0))).isin("the", "a", "an")
    head = F.when(article & (n > 1), F.concat_ws(" ", F.get(w, F.lit(0)), F.get(w, F.lit(1)))).otherwise(F.get(w, F.lit(0)))
    tail = F.regexp_replace(F.array_join(F.slice(w, F.greatest(n - 2, F.lit(1)), F.lit(3)), " "), r"[.]+$", "")
    return F.when(n >= 3, F.struct(head.alias("subject"), F.lit("CLAIMS").alias("predicate"), tail.alias("object")))


def parse_date(text: Column) -> Column:
    """The first of five formats that fits, else null."""
    formats = ("yyyy-MM-dd", "dd.MM.yyyy", "yyyy-MM-dd'T'HH:mm:ss", "dd/MM/yyyy", "yyyy")
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def snippet(text: Column, n: int = 100) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)
