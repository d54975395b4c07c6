"""Schemas of the tables and the run configuration."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import types as T

_S, _L = T.StringType(), T.LongType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


CONTEXT = _struct(title=T.ArrayType(_S), sentences=T.ArrayType(T.ArrayType(_S)))
EXAMPLES = _struct(example_ord=_L, context=CONTEXT, question=_S, answer=_S)
INDEX = _struct(passage_id=_L, title=_S, text=_S, embedding=T.ArrayType(T.FloatType()))
EVALUATED = _struct(question=_S, gold=_S, predicted=_S, exact_match=T.IntegerType(), retrieved_titles=T.ArrayType(_S))


@dataclass(frozen=True)
class Config:
    """What a run can choose. An index remembers the fields that shape it."""

    embedder: str = "hashing"  # or the name of a sentence model
    dimensions: int = 1024
    generator: str = "stub"  # or the name of a chat model
    service: str = "http://localhost:11434/api/chat"
    top_k: int = 10
    max_passages: int = 90_000
    num_samples: int | None = 100  # None: all
    threshold: float = 0.4
    max_iterations: int = 3

    def index_fields(self) -> dict:
        return {k: v for k, v in asdict(self).items() if k in ("embedder", "dimensions", "max_passages")}
