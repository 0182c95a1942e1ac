"""Where values come from that no template gives: an extraction provider, and a classifier of labels."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import null_like


class TableProvider:
    """Answers from a table ``doc_id, field, value``: for tests, replays and gold data."""

    def __init__(self, table: DataFrame):
        self.table = table

    def extract(self, wanted: DataFrame, texts: DataFrame) -> DataFrame:
        return wanted.select("doc_id", "field").join(self.table, ["doc_id", "field"], "left").select("doc_id", "field", null_like(F.col("value")).alias("value"))


class CallProvider:
    """Asks a service once per document for its missing fields only.

    ``connect`` runs once in each Python worker and gives a function ``(text, {field: description}) ->
    JSON text``. Whatever fails gives nulls for the document's fields; a field that wasn't asked for is left out.
    """

    def __init__(self, connect: Callable[[], Callable[[str, dict], str]], tries: int = 3):
        self.connect, self.tries = connect, tries

    def extract(self, wanted: DataFrame, texts: DataFrame) -> DataFrame:
        connect, tries = self.connect, self.tries
        asked = wanted.groupBy("doc_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("field", F.coalesce("description", F.lit("")))))).alias("schema"))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ask = connect()
            for rows in batches:
                out = []
                for r in rows.itertuples(index=False):
                    schema, answer = json.loads(r.schema), {}
                    for _ in range(tries):
                        try:
                            answer = json.loads(ask(r.text, schema))
                            break
                        except Exception:  # any failure of the service counts as no answer
                            answer = {}
                    out += [(r.doc_id, f, None if answer.get(f) is None else str(answer[f])) for f in schema]
                yield pd.DataFrame(out, columns=["doc_id", "field", "value"])

        kind = asked.schema["doc_id"].dataType.simpleString()
        got = asked.join(texts, "doc_id").select("doc_id", "text", "schema").mapInPandas(run, f"doc_id {kind}, field string, value string")
        return got.select("doc_id", "field", null_like(F.col("value")).alias("value"))


def structure_of(answer: Column) -> Column:
    """A classifier's answer as ``stricted`` or ``flexible``; what is neither counts as flexible."""
    a = F.lower(F.trim(answer))
    return F.when(a.rlike("rígida|rigida|rigid|stricted"), "stricted").otherwise("flexible")


def classify_labels(entries: DataFrame, answers: DataFrame) -> DataFrame:
    """``label, structure``: each label once, by a table ``label, answer``."""
    return entries.select("label").distinct().join(answers, "label", "left").select("label", structure_of(F.coalesce("answer", F.lit(""))).alias("structure"))


def ask_structures(labels: DataFrame, connect: Callable[[], Callable[[str], str]], tries: int = 3) -> DataFrame:
    """``label, structure, error``: a service asked once for each label, with up to ``tries`` attempts.

    ``connect`` runs once in each Python worker and gives a function from a label to an answer. A label for which all
    attempts fail has no structure, and the last failure's text as its error.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = connect()
        for rows in batches:
            out = []
            for label in rows["label"]:
                answer, error = None, None
                for _ in range(tries):
                    try:
                        answer, error = str(ask(label)), None
                        break
                    except Exception as e:  # any failure of the service counts as a failed attempt
                        error = f"{type(e).__name__}: {e}"
                out.append((label, answer, error))
            yield pd.DataFrame(out, columns=["label", "answer", "error"])

    got = labels.select("label").distinct().mapInPandas(run, "label string, answer string, error string")
    return got.select("label", F.when(F.col("error").isNull(), structure_of(F.col("answer"))).alias("structure"), "error")
