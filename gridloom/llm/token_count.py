"""Token counts with the whole-token shortcut.

Which vocabulary strings encode alone as one token is proven before any text is read;
pre-tokens among them count one, only the rest is merged.
"""

from __future__ import annotations

import functools

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.tokenizing import SpacedCounter, whole_tokens


@functools.lru_cache(maxsize=2)
def _counter(path: str, key: int, held) -> SpacedCounter:
    return SpacedCounter(path, held.value)


class _Held:
    """Hashable handle of a broadcast, so that one counter serves all tasks of a worker."""

    def __init__(self, broadcast):
        self.broadcast = broadcast

    @property
    def value(self):
        return self.broadcast.value

    def __hash__(self):
        return 0

    def __eq__(self, other):
        return isinstance(other, _Held)


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512, text: str = "text", keep=("doc_id",)) -> DataFrame:
    """``keep`` columns, ``n_bytes``, ``n_tokens`` and ``over_limit`` for every row.

    Null texts count as empty (0 bytes, 0 tokens); repeated rows are counted each; an empty
    table gives an empty table; other columns are ignored. Special strings within a text are
    handled as by the library. One pass, no shuffle; the broadcast is bounded by the vocabulary.
    """
    spark = docs.sparkSession
    whole = whole_tokens(tokenizer_path)
    held = _Held(spark.sparkContext.broadcast(whole))
    slim = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("g_text"))

    def run(batches):
        counter = _counter(tokenizer_path, len(whole), held)
        for b in batches:
            n = [counter.count(t.as_py()) for t in b.column("g_text")]
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in keep] + [pc.binary_length(b.column("g_text")).cast(pa.int64()), pa.array(n, pa.int64())],
                names=[*keep, "n_bytes", "n_tokens"],
            )

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema if f.name in keep)
    counted = slim.mapInArrow(run, f"{kept}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
