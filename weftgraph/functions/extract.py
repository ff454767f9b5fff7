"""Extraction: from texts to entities and relationships. A model is any function from texts to answers in JSON."""

from __future__ import annotations

import json
import re
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from weftgraph import vocab
from weftgraph.functions.text import chunk_rows, strip

#: Texts to answers, one for each.
Extractor = Callable[[list[str]], list[str]]
ITEMS = "struct<extractions: array<struct<extraction_class: string, extraction_text: string, attributes: map<string,string>, confidence: string>>>"


def first_object(raw: str | None, brackets: str = "{") -> str | None:
    """The first balanced JSON object (or array, if brackets has `[`) of an answer, code fences taken off; else null.

    Brackets are counted without regard to strings.
    """
    if raw is None:
        return None
    text = re.sub(r"^```(?:json)?[ \t]*|```[ \t]*$", "", raw, flags=re.M)
    starts = [i for i in (text.find(b) for b in brackets) if i >= 0]
    if not starts:
        return None
    at = min(starts)
    up, down = text[at], {"{": "}", "[": "]"}[text[at]]
    depth = 0
    for m in re.finditer(re.escape(up) + "|" + re.escape(down), text[at:]):
        depth += 1 if m[0] == up else -1
        if not depth:
            return text[at : at + m.end()]
    return None


@F.pandas_udf(StringType())
def first_object_udf(raw: pd.Series) -> pd.Series:
    return raw.map(first_object)


def valid(df: DataFrame, literal_confidence: float = 1.0) -> DataFrame:
    """class, text, attributes, confidence of what can be used, from columns of the same names with confidence as text.

    Dropped: empty class or text, unknown classes, less than even confidence, relationships without both ends. Confidence
    is held between 0 and 1; what is no number, or not given, counts as 1.
    """
    number = F.expr("try_cast(confidence as double)")
    confidence = F.when(number.isNull() | F.isnan(number), literal_confidence).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)))
    kind = F.lower(strip(F.coalesce("class", F.lit(""))))
    ends = (F.coalesce(F.col("attributes")["source"], F.lit("")) != "") & (F.coalesce(F.col("attributes")["target"], F.lit("")) != "")
    known = kind.isin(*vocab.ENTITY_CLASSES) | ((kind == vocab.RELATIONSHIP) & ends)
    clean = df.withColumns({"class": strip(F.coalesce("class", F.lit(""))), "text": strip(F.coalesce("text", F.lit(""))), "confidence": confidence})
    return clean.filter(known & (F.col("text") != "") & (F.col("confidence") >= 0.5))


def parse_answers(answers: DataFrame) -> DataFrame:
    """From answers (key columns and answer): the same keys, pos, class, text, attributes, confidence, parse_error.

    A faulty answer gives one row with parse_error, and nothing else of its chunk.
    """
    keys = [c for c in answers.columns if c != "answer"]
    parsed = answers.withColumn("json", first_object_udf("answer")).withColumn("x", F.from_json("json", ITEMS))
    fault = F.when(F.col("json").isNull(), "no JSON object").when(F.col("x").isNull() | F.col("x.extractions").isNull(), "no extractions")
    parsed = parsed.withColumn("parse_error", fault)
    item = F.posexplode("x.extractions").alias("pos", "item")
    items = parsed.filter("parse_error is null").select(*keys, item).select(*keys, "pos", F.col("item.extraction_class").alias("class"), F.col("item.extraction_text").alias("text"), "item.attributes", "item.confidence")
    nothing = F.lit(None)
    faults = parsed.filter("parse_error is not null").select(*keys, F.lit(-1).alias("pos"), nothing.cast("string").alias("class"), nothing.cast("string").alias("text"), nothing.cast("map<string,string>").alias("attributes"), nothing.cast("double").alias("confidence"), "parse_error")
    return valid(items).select(*keys, "pos", "class", "text", "attributes", "confidence", nothing.cast("string").alias("parse_error")).unionByName(faults)


def extract(docs: DataFrame, extractor: Extractor, id_: str = "doc_id", most: int = 8000, overlap: int = 400) -> DataFrame:
    """Chunks documents, asks the extractor in batches, and parses its answers."""

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            yield pd.DataFrame({id_: x[id_], "chunk": x["chunk"], "answer": extractor(x["text"].tolist())})

    rows = chunk_rows(docs, id_, most, overlap).select(id_, "chunk", "text")
    return parse_answers(rows.mapInPandas(ask, f"{id_} {docs.schema[id_].dataType.simpleString()}, chunk int, answer string"))


def service_extractor(address: str, model: str, instructions: str = "", timeout: float = 120) -> Extractor:
    """An extractor that posts each text to a model service (`prompt` in, `response` out, as JSON) and gives its answers.

    A service that can't be reached, or doesn't answer in JSON, raises: that is no fault of a chunk, and its task is tried again. What
    the model says is judged later; an answer that holds no JSON object is its chunk's fault alone.
    """

    def run(texts: list[str]) -> list[str]:
        out = []
        for text in texts:
            body = json.dumps({"model": model, "prompt": f"{instructions}{text}", "stream": False}).encode()
            request = urllib.request.Request(address, body, {"Content-Type": "application/json"})
            with urllib.request.urlopen(request, timeout=timeout) as r:
                out.append(str(json.loads(r.read()).get("response", "")))
        return out

    return run


def lexicon_extractor(names: dict[str, str], verbs: dict[str, str]) -> Extractor:
    """A model stand-in that finds known names (to their class) and, between two names of a sentence, known verbs."""
    find = re.compile("|".join(rf"\b{re.escape(n)}\b" for n in sorted(names, key=len, reverse=True)) or r"(?!)")

    def run(texts: list[str]) -> list[str]:
        out = []
        for text in texts:
            items, seen = [], set()
            for sentence in re.split(r"(?<=[.!?])\s+", text):
                hits = list(find.finditer(sentence))
                for m in hits:
                    if m[0] not in seen:
                        seen.add(m[0])
                        items.append({"extraction_class": names[m[0]], "extraction_text": m[0], "attributes": {}, "confidence": 0.9})
                for a, b in zip(hits, hits[1:]):
                    between = sentence[a.end() : b.start()].lower()
                    label = next((v for k, v in verbs.items() if k in between), None)
                    if label and a[0] != b[0]:
                        items.append({"extraction_class": vocab.RELATIONSHIP, "extraction_text": label, "attributes": {"source": a[0], "target": b[0]}, "confidence": 0.8})
            out.append(json.dumps({"extractions": items}))
        return out

    return run


def dedup_keys(x: DataFrame, literal: bool = False) -> DataFrame:
    """x with a column key of class and text in lower case, and for relationships both ends (unless literal)."""
    ends = F.when((F.lower("class") == vocab.RELATIONSHIP) & F.lit(not literal), F.concat_ws("|", F.lower(F.col("attributes")["source"]), F.lower(F.col("attributes")["target"]))).otherwise("")
    return x.withColumn("key", F.concat_ws("|", F.lower("class"), F.lower("text"), ends))


def unseen(x: DataFrame, seen: DataFrame | None, order: list[str], literal: bool = False) -> DataFrame:
    """The first row of each key that seen (key) doesn't have."""
    rows = dedup_keys(x, literal)
    if seen is not None:
        rows = rows.join(seen.select("key"), "key", "left_anti")
    first = rows.groupBy("key").agg(F.min_by(F.struct(*(F.col(c) for c in x.columns)), F.struct(*order)).alias("x"))
    return first.select("key", "x.*")


def clean_output(entities: DataFrame) -> DataFrame:
    """Entities (id, group, confidence) with ids of 1 to 100 characters; bad groups are unknown, bad confidences one half."""
    ok = F.length("id").between(1, 100)
    group = F.when(F.col("group").isin(*vocab.ENTITY_CLASSES), F.col("group")).otherwise("unknown")
    return entities.filter(ok).select("id", group.alias("group"), F.when(F.coalesce("confidence", F.lit(0.5)).between(0, 1), F.coalesce("confidence", F.lit(0.5))).otherwise(0.5).alias("confidence"))


def clean_relations(relations: DataFrame, most: int = 60) -> DataFrame:
    """Relations (src, dst, label, confidence) with both ends, labels of at most `most` characters; bad confidences one half."""
    ok = (F.coalesce("src", F.lit("")) != "") & (F.coalesce("dst", F.lit("")) != "")
    confidence = F.coalesce("confidence", F.lit(0.5))
    return relations.filter(ok).select("src", "dst", F.substring(F.coalesce("label", F.lit("")), 1, most).alias("label"), F.when(confidence.between(0, 1), confidence).otherwise(0.5).alias("confidence"))


def entity_relation_split(x: DataFrame) -> DataFrame:
    relation = F.lower("class") == vocab.RELATIONSHIP
    return x.agg(F.count_if(~relation).alias("entities"), F.count_if(relation).alias("relations"))
