"""Facts from text by patterns, and the frames around a model that extracts them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NAME = r"(\p{Lu}\p{Ll}+(?:\s+\p{Lu}\p{Ll}+)*)"
#: Fixed values: (pattern, relation, subject type, object type). Names begin with capitals, verbs are in lower case: without regard to case a name would swallow the words after it.
PATTERNS = (
    (_NAME + r"\s+(?:was\s+)?born\s+(?:on\s+[\w\s,]+\s+)?in\s+" + _NAME, "GEBOREN_IN", "Person", "Ort"),
    (_NAME + r"\s+wurde\s+(?:am\s+[\w\s.]+\s+)?in\s+" + _NAME + r"\s+geboren", "GEBOREN_IN", "Person", "Ort"),
    (_NAME + r"\s+(?:studied|studierte)\s+(?:\w+\s+)?(?:at|an)\s+(?:the\s+)?" + _NAME, "STUDIERT_AN", "Person", "Organisation"),
    (_NAME + r"\s+(?:worked|arbeitete)\s+(?:at|bei)\s+(?:the\s+)?" + _NAME, "ARBEITET_BEI", "Person", "Organisation"),
    (_NAME + r"\s+(?:received|erhielt|won)\s+(?:the\s+)?(\p{Lu}\p{Ll}+(?:\s+\p{Lu}\p{Ll}+)*(?:\s+Prize)?)", "ERHIELT", "Person", "Ereignis"),
    (_NAME + r"\s+was\s+a\s+friend\s+of\s+" + _NAME, "KENNT", "Person", "Person"),
)
CONFIDENCE = 0.7


def _stated(rel: str, s: str, o: str) -> Callable[[Column], Column]:
    return lambda z: F.struct(z["s"].alias("subject"), F.lit(s).alias("s_type"), F.lit(rel).alias("predicate"), z["o"].alias("object"), F.lit(o).alias("o_type"))


def relations(chunks: DataFrame, text: str = "chunk") -> DataFrame:
    """(doc_id, chunk_index, subject, s_type, predicate, object, o_type, confidence): what the patterns say, once per chunk."""
    t = F.col(text)
    each = []
    for p, rel, s, o in PATTERNS:
        # Both groups of one match go together: the lists are of one length and order.
        pairs = F.arrays_zip(F.regexp_extract_all(t, F.lit(p), F.lit(1)).alias("s"), F.regexp_extract_all(t, F.lit(p), F.lit(2)).alias("o"))
        each.append(F.transform(pairs, _stated(rel, s, o)))
    x = chunks.select("doc_id", "chunk_index", F.explode(F.concat(*each)).alias("x")).select("doc_id", "chunk_index", "x.*")
    return x.distinct().withColumn("confidence", F.lit(CONFIDENCE))


#: What a name of a kind holds.
ORG_HINTS, EVENT_HINTS = ("institute", "university", "eth", "company"), ("prize", "award", "nobel")


def _guess(name: Column) -> Column:
    low = F.lower(name)
    has = lambda ws: low.rlike("|".join(ws))
    return F.when(has(ORG_HINTS), "Organisation").when(has(EVENT_HINTS), "Ereignis").when(F.size(F.split(name, r"\s+")) == 2, "Person").otherwise("Konzept")


def entities(chunks: DataFrame, found: DataFrame, text: str = "chunk") -> DataFrame:
    """(doc_id, name, type, confidence): the ends of relations and all runs of capitalised words; one row per document and lower-case name, typed by a relation if there is one."""
    ends = found.select("doc_id", F.col("subject").alias("name"), F.col("s_type").alias("type"), F.lit(0).alias("k")).union(found.select("doc_id", "object", "o_type", F.lit(0)))
    caps = chunks.select("doc_id", F.explode(F.regexp_extract_all(F.col(text), F.lit(r"(?U)\b(\p{Lu}\p{Ll}+(?:\s+\p{Lu}\p{Ll}+)*)\b"), F.lit(1))).alias("name"))
    every = ends.union(caps.select("doc_id", "name", _guess(F.col("name")), F.lit(1)))
    g = every.groupBy("doc_id", F.lower("name").alias("key")).agg(F.min(F.struct("k", "name", "type")).alias("m"))
    return g.select("doc_id", F.col("m.name").alias("name"), F.col("m.type").alias("type"), F.lit(CONFIDENCE).alias("confidence"))


def build(found: DataFrame, ents: DataFrame, least: float = 0.5, evidence: int = 500) -> DataFrame:
    """(doc_id, subject, s_type, predicate, object, o_type, confidence): relations whose two names are entities of the document, sure enough; the predicate in upper case with underscores."""
    s = ents.select("doc_id", F.lower("name").alias("sk"), F.col("name").alias("s_name"), F.col("type").alias("st"))
    o = ents.select("doc_id", F.lower("name").alias("ok"), F.col("name").alias("o_name"), F.col("type").alias("ot"))
    j = found.where(F.col("confidence") >= least).withColumn("sk", F.lower("subject")).withColumn("ok", F.lower("object")).join(s, ["doc_id", "sk"]).join(o, ["doc_id", "ok"])
    return j.select("doc_id", F.col("s_name").alias("subject"), F.col("st").alias("s_type"), F.upper(F.replace("predicate", F.lit(" "), F.lit("_"))).alias("predicate"), F.col("o_name").alias("object"), F.col("ot").alias("o_type"), "confidence").distinct()


def with_model(chunks: DataFrame, extract: Callable[[list[str]], list[list[tuple[str, str, str, float]]]]) -> DataFrame:
    """(doc_id, chunk_index, subject, predicate, object, confidence) from a model: texts of a batch in, a list of facts for each out. A batch that fails gives none."""
    import pyarrow as pa
    from pyspark.sql import types as T

    def run(batches):
        for b in batches:
            try:
                got = extract(b.column(2).to_pylist())
            except Exception:  # the model is foreign code: its failure costs its batch, not the job
                got = [[] for _ in range(b.num_rows)]
            rows = [(i, *f) for i, fs in enumerate(got) for f in fs]
            at = pa.array([r[0] for r in rows], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), *[pa.array([r[k] for r in rows], pa.string()) for k in (1, 2, 3)], pa.array([r[4] for r in rows], pa.float64())], names=["doc_id", "chunk_index", "subject", "predicate", "object", "confidence"])

    st, s = T.StructType, T.StringType()
    f = chunks.schema
    return chunks.select("doc_id", "chunk_index", "chunk").mapInArrow(run, st([f["doc_id"], f["chunk_index"], *[T.StructField(c, s) for c in ("subject", "predicate", "object")], T.StructField("confidence", T.DoubleType())]))


def cached(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of requests (example_id, text) in a cache (example_id, key, result), by the first 16 hex digits of the text's digest."""
    r = requests.withColumn("key", F.substring(F.md5("text"), 1, 16))
    return r.join(cache, ["example_id", "key"]), r.join(cache, ["example_id", "key"], "left_anti")
