"""Many passages looked for in many texts at once."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type


def passages_in(texts: DataFrame, passages: DataFrame, id_col: str = "doc_id", passage_col: str = "item_id", most_chars: int = 32_000_000) -> DataFrame:
    """(id, passage): which texts (id, hay) hold which passages (passage, needle), of any length; a text's passage once.

    One automaton finds all passages in one scan of a text. Passages of over `most_chars` characters in all are dealt by hash to several automata of about that size, and texts are scanned once for each; so what goes to
    the tasks at once has a bound. A null text or passage is left out; every text holds the empty passage.
    """
    spark = texts.sparkSession
    wanted = passages.where(f"{passage_col} is not null and needle is not null").select(passage_col, "needle")
    total = wanted.agg(F.sum(F.length("needle") + 1)).first()[0] or 0
    parts = total // most_chars + 1
    kinds = f"`{id_col}` {texts.schema[id_col].dataType.simpleString()}, `{passage_col}` {passages.schema[passage_col].dataType.simpleString()}"
    found = spark.createDataFrame([], kinds)
    for part in range(parts):
        held: dict[str, list] = {}
        for name, needle in wanted.where(F.pmod(F.xxhash64(passage_col, "needle"), F.lit(parts)) == part).collect():  # about most_chars characters
            held.setdefault(needle, []).append(name)
        if held:
            found = found.unionByName(_scanned(texts, spark.sparkContext.broadcast(held), id_col, passage_col, kinds, to_arrow_type(passages.schema[passage_col].dataType)))
    return found


def _scanned(texts: DataFrame, held, id_col: str, passage_col: str, kinds: str, passage_type: pa.DataType) -> DataFrame:
    def run(batches):
        import ahocorasick

        automaton, everywhere = ahocorasick.Automaton(), held.value.get("", [])
        for needle, names in held.value.items():
            if needle:
                automaton.add_word(needle, names)
        if len(automaton):
            automaton.make_automaton()
        for batch in batches:
            rows, names = [], []
            for k, hay in enumerate(batch.column(1).to_pylist()):
                here = set(everywhere)
                if len(automaton):
                    for _, of in automaton.iter(hay):
                        here.update(of)
                rows += [k] * len(here)
                names += here
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(names, passage_type)], names=[id_col, passage_col])

    return texts.where("hay is not null").select(id_col, "hay").mapInArrow(run, kinds)
