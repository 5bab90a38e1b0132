"""The ontology as data: types, relations and the constraints on them. All tables here are fixed and small."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The ontology of the checked graphs.
ENTITY_TYPES = ("Person", "Organisation", "Ort", "Ereignis", "Dokument", "Konzept")
TYPE_ALIASES = {"Organization": "Organisation", "Location": "Ort", "Event": "Ereignis", "Document": "Dokument", "Concept": "Konzept"}
RELATION_TYPES = (
    "GEBOREN_IN", "GESTORBEN_IN", "WOHNT_IN", "ARBEITET_BEI", "STUDIERT_AN", "LEITET", "TEIL_VON", "BEFINDET_SICH_IN", "VERHEIRATET_MIT", "KIND_VON", "KENNT", "ENTWICKELTE",
    "ERFAND", "SCHRIEB", "ERHIELT", "BETEILIGT_AN", "HAT_BEZIEHUNG_ZU", "GEBOREN_AM", "GESTORBEN_AM", "GRUENDETE", "REGIERT", "MITGLIED_VON", "GEWANN", "BEEINFLUSSTE",
)
RELATION_MAPPING = {
    "REGIERTE": "LEITET", "HERRSCHTE_UEBER": "LEITET", "FUEHRTE": "LEITET", "LEITETE": "LEITET", "KOMPONIST_VON": "SCHRIEB", "AUTOR_VON": "SCHRIEB", "VERFASSTE": "SCHRIEB",
    "GESCHRIEBEN_VON": "SCHRIEB", "ENTDECKTE": "ERFAND", "ERFUNDEN_VON": "ERFAND", "ENTWICKELT_VON": "ENTWICKELTE", "GEHOERT_ZU": "TEIL_VON", "LIEGT_IN": "BEFINDET_SICH_IN",
    "HAUPTSTADT_VON": "BEFINDET_SICH_IN", "GEBOREN_AM": "GEBOREN_IN", "GESTORBEN_AM": "GESTORBEN_IN", "GEWANN": "ERHIELT", "ERHIELT_VON": "ERHIELT", "GRUENDETE": "ENTWICKELTE",
    "BEEINFLUSSTE": "HAT_BEZIEHUNG_ZU",
}
CARDINALITY = {"GEBOREN_IN": 1, "GEBOREN_AM": 1, "GESTORBEN_IN": 1, "GESTORBEN_AM": 1, "VERHEIRATET_MIT": 3, "KIND_VON": 2}
_ANY = ("Person", "Organisation", "Ort", "Ereignis", "Konzept")
DOMAIN_RANGE = {
    "GEBOREN_IN": (("Person",), ("Ort",)),
    "GEBOREN_AM": (("Person",), ("Ort", "Ereignis")),
    "GESTORBEN_IN": (("Person",), ("Ort",)),
    "GESTORBEN_AM": (("Person",), ("Ort", "Ereignis")),
    "WOHNT_IN": (("Person",), ("Ort",)),
    "ARBEITET_BEI": (("Person",), ("Organisation",)),
    "STUDIERT_AN": (("Person",), ("Organisation",)),
    "LEITET": (("Person",), ("Organisation", "Ereignis")),
    "TEIL_VON": (("Organisation", "Ort", "Konzept"), ("Organisation", "Ort", "Konzept")),
    "BEFINDET_SICH_IN": (("Ort", "Organisation"), ("Ort",)),
    "VERHEIRATET_MIT": (("Person",), ("Person",)),
    "KIND_VON": (("Person",), ("Person",)),
    "KENNT": (("Person",), ("Person",)),
    "HAT_BEZIEHUNG_ZU": (_ANY, _ANY),
}
REFLEXIVE = ("HAT_BEZIEHUNG_ZU",)
ACYCLIC = ("TEIL_VON", "BEFINDET_SICH_IN", "KIND_VON")
SYMMETRIC = ("VERHEIRATET_MIT", "KENNT", "HAT_BEZIEHUNG_ZU")
ASYMMETRIC = ("LEITET", "KIND_VON", "TEIL_VON", "ARBEITET_BEI", "STUDIERT_AN")
INVERSE = {
    "VATER_VON": "KIND_VON", "MUTTER_VON": "KIND_VON", "KIND_VON": "ELTERNTEIL_VON", "PARENT_OF": "CHILD_OF", "CHILD_OF": "PARENT_OF", "FATHER_OF": "CHILD_OF", "MOTHER_OF": "CHILD_OF",
    "VERHEIRATET_MIT": "VERHEIRATET_MIT", "MARRIED_TO": "MARRIED_TO", "GESCHWISTER_VON": "GESCHWISTER_VON", "SIBLING_OF": "SIBLING_OF", "KOLLEGE_VON": "KOLLEGE_VON",
    "COLLEAGUE_OF": "COLLEAGUE_OF", "KENNT": "KENNT", "KNOWS": "KNOWS", "ARBEITET_BEI": "HAT_MITARBEITER", "WORKS_AT": "EMPLOYS", "LEITET": "GELEITET_VON", "LEADS": "LED_BY",
    "MITGLIED_VON": "HAT_MITGLIED", "MEMBER_OF": "HAS_MEMBER", "GEBOREN_IN": "GEBURTSORT_VON", "BORN_IN": "BIRTHPLACE_OF", "GESTORBEN_IN": "STERBEORT_VON", "DIED_IN": "DEATHPLACE_OF",
    "WOHNT_IN": "HAT_EINWOHNER", "LIVES_IN": "HAS_RESIDENT", "LIEGT_IN": "ENTHÄLT", "LOCATED_IN": "CONTAINS", "TEIL_VON": "HAT_TEIL", "PART_OF": "HAS_PART",
    "HAUPTSTADT_VON": "HAT_HAUPTSTADT", "CAPITAL_OF": "HAS_CAPITAL",
}
TRANSITIVE = (
    "LIEGT_IN", "LOCATED_IN", "TEIL_VON", "PART_OF", "ENTHÄLT", "CONTAINS", "VORGESETZTER_VON", "SUPERVISOR_OF", "VORFAHRE_VON", "ANCESTOR_OF", "NACHFAHRE_VON", "DESCENDANT_OF",
    "UNTERKLASSE_VON", "SUBCLASS_OF",
)
DISJOINT = (
    ("Person", "Organisation", "Ort", "Ereignis"),
    ("Stadt", "Land", "Kontinent"),
    ("Firma", "Universität", "Regierung"),
    ("Lebend", "Tot"),
    ("Männlich", "Weiblich"),
)
IMPLIED = {
    "GEBOREN_IN": ("person", "ort"), "BORN_IN": ("person", "location"), "GESTORBEN_IN": ("person", "ort"), "DIED_IN": ("person", "location"), "HAUPTSTADT_VON": ("stadt", "land"),
    "CAPITAL_OF": ("city", "country"), "CEO_VON": ("person", "organisation"), "CEO_OF": ("person", "organization"), "GRUENDETE": ("person", "organisation"), "FOUNDED": ("person", "organization"),
}
BIRTH = ("GEBOREN_AM", "GEBOREN_IN", "BIRTH_DATE", "BORN", "BORN_IN")
DEATH = ("GESTORBEN_AM", "GESTORBEN_IN", "DEATH_DATE", "DIED", "DIED_IN")
LIFETIME = (
    "GEWANN", "ERHIELT", "WON", "AWARDED", "RECEIVED", "VERHEIRATET_MIT", "MARRIED_TO", "MARRIED", "SPOUSE", "GESCHIEDEN_VON", "DIVORCED", "ARBEITET_BEI", "ARBEITETE_BEI", "WORKS_AT",
    "WORKED_AT", "EMPLOYED_BY", "GRUENDETE", "FOUNDED", "SCHRIEB", "WROTE", "AUTHORED", "SPIELTE_IN", "STARRED_IN", "APPEARED_IN",
)
AWARDS = ("GEWANN", "WON", "ERHIELT", "AWARDED")
PRESENT = ("ARBEITET_BEI", "WORKS_AT", "VERHEIRATET_MIT", "MARRIED_TO", "IST_LEBENDIG", "IS_ALIVE")
DANGEROUS = ("KIND_VON", "VATER_VON", "MUTTER_VON", "VERHEIRATET_MIT", "GESCHWISTER_VON", "GROSSELTERN_VON", "ENKEL_VON", "LEITET", "ARBEITET_BEI", "STUDIERT_AN")
INCOMPATIBLE = (
    (("VERHEIRATET_MIT",), ("MUTTER_VON", "VATER_VON", "KIND_VON")),
    (("MUTTER_VON",), ("VATER_VON",)),
    (("GESCHWISTER_VON",), ("KIND_VON", "VATER_VON", "MUTTER_VON")),
    (("GROSSELTERN_VON", "ENKEL_VON"), ("KIND_VON", "VATER_VON", "MUTTER_VON")),
    (("LEITET",), ("ARBEITET_BEI",)),
    (("STUDIERT_AN",), ("LEITET",)),
)
TRUSTED = {"wikipedia": 0.9, "wiki": 0.9, "wikidata": 0.95, "dbpedia": 0.85, "freebase": 0.85, "academic": 0.8, "pubmed": 0.85, "arxiv": 0.8, "gov": 0.85, "edu": 0.8}
UNTRUSTED = ("blog", "forum", "reddit", "twitter", "social", "user_generated")
HIGH, MEDIUM, LOW_TRIGGER = 0.9, 0.7, 0.6


def incompatible_pairs() -> list[tuple[str, str]]:
    """Both directions, each pair once."""
    return sorted({p for a, b in INCOMPATIBLE for x in a for y in b for p in ((x, y), (y, x))})


def disjoint_pairs() -> list[tuple[str, str]]:
    """(type, other) in lower case."""
    return sorted({(a.lower(), b.lower()) for group in DISJOINT for a in group for b in group if a != b})


def domain_rows() -> list[tuple[str, list[str], list[str]]]:
    return [(r, list(s), list(o)) for r, (s, o) in DOMAIN_RANGE.items()]


def frame(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A fixed table of this module."""
    return spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)
