"""What a language model is asked, as text columns, and what its answers mean. The model itself is a function handed in: texts in, texts out."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Ask = Callable[[list[str]], list[str | None]]


def fact(s: Column, p: Column, o: Column) -> Column:
    return F.concat(F.lit("("), s, F.lit(", "), p, F.lit(", "), o, F.lit(")"))


def examples(shots: list[tuple[str, list[tuple[str, str, str]]]]) -> str:
    """Worked examples for `extract`: a text and its facts as JSON each."""
    return "\n\n".join(f"Text: {t}\nFacts: {json.dumps([dict(zip(('subject', 'predicate', 'object'), f)) for f in fs], ensure_ascii=False)}" for t, fs in shots)


def extract(text: Column, relations: list[str], types: list[str], shots: str = "") -> Column:
    head = f"List the facts that the text states, as a JSON list of objects with subject, predicate, object and confidence. Relations: {', '.join(relations)}. Types: {', '.join(types)}.\n"
    return F.concat(F.lit(head + (shots + "\n\n" if shots else "") + "Text: "), text)


def relate(text: Column, s: Column, o: Column, relations: list[str]) -> Column:
    return F.concat(F.lit("Which relation does the text state from "), s, F.lit(" to "), o, F.lit(f"? One of {', '.join(relations)}, or none.\nText: "), text)


def resolve_mentions(text: Column, names: Column) -> Column:
    return F.concat(F.lit("Which of these names mean the same thing in the text? Answer with a JSON list of lists.\nNames: "), F.array_join(names, "; "), F.lit("\nText: "), text)


def verify(s: Column, p: Column, o: Column, text: Column | None = None) -> Column:
    """Is the fact true? The answer is JSON with is_true (true, false or null) and confidence."""
    source = F.lit("") if text is None else F.coalesce(F.concat(F.lit("\nSource: "), text), F.lit(""))
    return F.concat(F.lit('Is this fact true? Answer {"is_true": true, false or null, "confidence": 0 to 1}.\nFact: '), fact(s, p, o), source)


def consistency(s: Column, p: Column, o: Column, known: Column) -> Column:
    """Does the fact agree with what is known, in time, state, logic and content? The answer is JSON with consistent and confidence."""
    return F.concat(F.lit('Does the fact agree with what is known, in time, state, logic and content? Answer {"consistent": true or false, "confidence": 0 to 1}.\nFact: '), fact(s, p, o), F.lit("\nKnown:\n"), F.coalesce(known, F.lit("nothing")))


def arbitrate(s: Column, p: Column, o: Column, conflict: Column, known: Column) -> Column:
    """What is to be done about a conflict? The answer is JSON with action and confidence."""
    return F.concat(F.lit('What is to be done? Answer {"action": "accept", "reject", "merge" or "human_review", "confidence": 0 to 1}.\nNew fact: '), fact(s, p, o), F.lit("\nConflict: "), conflict, F.lit("\nKnown:\n"), F.coalesce(known, F.lit("nothing")))


def ask(requests: DataFrame, model: Callable[[], Ask], prompt: str = "prompt", attempts: int = 2) -> DataFrame:
    """``requests`` with ``response``: each distinct prompt once, batch by batch, one model per Python worker.

    A batch that fails is asked again, ``attempts`` times in all; what then has no answer, and null prompts, get null. Other columns are kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        talk = model()
        for b in batches:
            texts, got = b.column(0).to_pylist(), None
            for _ in range(attempts):
                try:
                    got = talk(texts)
                    break
                except Exception:  # the model is foreign code: its failure costs its batch an answer, not the job
                    got = None
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got or [None] * len(texts), pa.string())], names=["prompt", "response"])

    once = requests.where(F.col(prompt).isNotNull()).select(F.col(prompt).alias("prompt")).distinct().mapInArrow(run, "prompt string, response string")
    return requests.join(once.withColumnRenamed("prompt", "_p"), F.col(prompt) == F.col("_p"), "left").drop("_p")


def _object(response: Column) -> Column:
    """The JSON object in an answer, whatever stands around it."""
    return F.regexp_extract(response, r"(?s)\{.*\}", 0)


def verified(response: Column) -> Column:
    """Struct (action, confidence) of an answer to `verify`: true accepts, false rejects, null or no JSON asks for a human."""
    j = F.from_json(_object(response), "is_true boolean, confidence double")
    return F.struct(F.when(j["is_true"], "accept").when(~j["is_true"], "reject").otherwise("human_review").alias("action"), F.coalesce(j["confidence"], F.lit(0.5)).alias("confidence"))


def consistent(response: Column) -> Column:
    """Struct (outcome, confidence) of an answer to `consistency`: UNCERTAIN where it can't be read."""
    j = F.from_json(_object(response), "consistent boolean, confidence double")
    return F.struct(F.when(j["consistent"], "PASS").when(~j["consistent"], "FAIL").otherwise("UNCERTAIN").alias("outcome"), F.coalesce(j["confidence"], F.lit(0.5)).alias("confidence"))


def extracted(response: Column) -> Column:
    """Array of (subject, predicate, object, confidence) of an answer to `extract`; empty where it can't be read."""
    kind = "array<struct<subject:string,predicate:string,object:string,confidence:double>>"
    return F.coalesce(F.from_json(F.regexp_extract(response, r"(?s)\[.*\]", 0), kind), F.array().cast(kind))
