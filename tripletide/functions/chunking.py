"""Documents to chunks. Sliding windows are plain expressions; the strategies that carry state along a text run over Arrow batches.

Every strategy gives (doc_id, chunk_index, start_char, end_char, chunk). Null and blank texts have no chunks; texts are read whole, and a
document is independent of all others, so nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Span = tuple[int, int, str]


def sliding(docs: DataFrame, size: int = 1000, overlap: int = 200, least: int = 100) -> DataFrame:
    """Windows of ``size`` every ``size - overlap`` characters. A window that doesn't reach the end is cut after the first sentence end in its last third
    (looked for as '. ', then '! ', '? ', line feed); the next one starts where it would have, so text between may belong to none. Chunks under ``least`` characters are dropped."""
    n = F.length("text")
    step = size - overlap
    d = docs.where(F.length(F.trim("text")) > 0).select("doc_id", "text", n.alias("n"))
    d = d.select("doc_id", "text", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(step))).alias("start"))
    # A window whose predecessor reached the end isn't made.
    far = F.least(F.col("start") + size, F.col("n"))
    look = F.col("start") + 2 * size // 3
    zone = F.substring("text", look + 1, F.greatest(far - look, F.lit(0)))
    cut = None
    for sep in (". ", "! ", "? ", "\n"):
        at = F.locate(sep, zone)
        v = look + at - 1 + len(sep)
        cut = F.when(at > 0, v) if cut is None else cut.when(at > 0, v)
    end = F.when(far < F.col("n"), F.coalesce(cut, far)).otherwise(far)
    d = d.withColumn("end_char", end).where((F.col("start") == 0) | (F.col("start") - step + size < F.col("n")))
    d = d.withColumn("chunk", F.regexp_replace(F.substring("text", F.col("start") + 1, F.col("end_char") - F.col("start")), r"(?U)^\s+|\s+$", ""))
    d = d.where(F.length("chunk") >= least)
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("start")
    return d.select("doc_id", (F.row_number().over(w) - 1).alias("chunk_index"), F.col("start").alias("start_char"), "end_char", "chunk")


def _fixed(text: str, size: int, overlap: int, least: int) -> list[Span]:
    """Windows that end at a space beyond their first ``least`` characters; always moves on, also where the overlap is longer than what was taken."""
    out, start = [], 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            space = text.rfind(" ", start + least + 1, end)
            end = space if space > 0 else end
        piece = text[start:end].strip()
        if piece:
            out.append((start, end, piece))
        if end == len(text):
            break
        start = max(end - overlap, start + 1)
    return out


def _sentence(text: str, size: int, least: int, per: int = 5) -> list[Span]:
    spans = [m.span() for m in re.finditer(r"\S(?:.*?[.!?](?=\s|$)|.*$)", text, re.S)]
    out: list[Span] = []
    held: list[tuple[int, int]] = []
    fresh = False
    for s in spans:
        held.append(s)
        fresh = True
        joined = " ".join(text[a:b].strip() for a, b in held)
        if len(held) >= per or len(joined) >= size:
            out.append((held[0][0], held[-1][1], joined))
            held, fresh = held[-max(1, len(held) // 3) :], False
    joined = " ".join(text[a:b].strip() for a, b in held)
    if held and (fresh or out) and len(joined) >= least:
        out.append((held[0][0], len(text), joined))
    return out


def _paragraph(text: str, size: int, overlap: int, least: int) -> list[Span]:
    paras, at = [], 0
    for m in [*re.finditer(r"\n\s*\n", text), None]:
        a, b = at, m.start() if m else len(text)
        body = text[a:b]
        if body.strip():
            lead = len(body) - len(body.lstrip())
            paras.append((a + lead, a + lead + len(body.strip())))
        at = m.end() if m else b
    out: list[Span] = []
    held: list[tuple[int, int]] = []
    join = lambda h: "\n\n".join(text[a:b] for a, b in h)
    for a, b in paras:
        if b - a > size:
            if held:
                out.append((held[0][0], a, join(held)))
                held = []
            out += [(a + x, a + y, t) for x, y, t in _fixed(text[a:b], size, overlap, least)]
            continue
        held.append((a, b))
        if len(join(held)) >= size:
            out.append((held[0][0], b, join(held)))
            held = held[-1:]
    if held and len(join(held)) >= least:
        out.append((held[0][0], len(text), join(held)))
    return out


def chunk(docs: DataFrame, strategy: str = "sentence", size: int = 1000, overlap: int = 200, least: int = 100) -> DataFrame:
    """Chunks by ``fixed``, ``sentence``, ``paragraph``, ``semantic`` (as sentence) or ``sliding``."""
    if strategy == "sliding":
        return sliding(docs, size, overlap, least)
    cut = {
        "fixed": lambda t: _fixed(t, size, overlap, least),
        "sentence": lambda t: _sentence(t, size, least),
        "semantic": lambda t: _sentence(t, size, least),
        "paragraph": lambda t: _paragraph(t, size, overlap, least),
    }[strategy]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, n, *span) for i, t in enumerate(b.column(1).to_pylist()) if t and t.strip() for n, span in enumerate(cut(t))]
            at, n, s, e, c = zip(*rows) if rows else ((), (), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), pa.array(n, pa.int32()), pa.array(s, pa.int32()), pa.array(e, pa.int32()), pa.array(c, pa.string())], names=["doc_id", "chunk_index", "start_char", "end_char", "chunk"])

    i = T.IntegerType()
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("chunk_index", i), T.StructField("start_char", i), T.StructField("end_char", i), T.StructField("chunk", T.StringType())])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def statistics(chunks: DataFrame) -> DataFrame:
    """(n_chunks, total, mean, min, max) of chunk lengths."""
    n = F.length("chunk")
    return chunks.agg(F.count("*").alias("n_chunks"), F.sum(n).alias("total"), F.round(F.avg(n), 6).alias("mean"), F.min(n).alias("min"), F.max(n).alias("max"))
