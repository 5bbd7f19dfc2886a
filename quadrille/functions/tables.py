"""Table functions for SQL text: chunks of a text, findings of an extractor.

    register(spark)
    spark.sql("SELECT doc_id, c.* FROM documents, LATERAL text_chunks(text, 512, 50) c")
    spark.sql("SELECT doc_id, x.* FROM documents, LATERAL text_findings(text) x")

A text is one row and stays in its task; nothing is shuffled for the call.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from quadrille.functions.text import chunk_spans

# Built without a session, as analysis runs in a process of its own.
CHUNKS = StructType([StructField(n, IntegerType()) for n in ("chunk_index", "char_start", "char_end", "token_count")] + [StructField("chunk", StringType())])
FINDINGS = "extraction_type string, text_span string, char_start int, char_end int, confidence double, attributes map<string,string>"


class TextChunks:
    """Chunks of whole sentences, as ``documents.chunk`` makes them."""

    @staticmethod
    def analyze(text: AnalyzeArgument, size: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None) -> AnalyzeResult:
        if text.dataType.simpleString() != "string":
            raise ValueError("text_chunks takes a text")
        for name, argument in (("size", size), ("overlap", overlap)):
            if argument is not None and not argument.isConstantExpression:
                raise ValueError(f"{name} has to be a constant")
        most, shared = 512 if size is None else size.value, 50 if overlap is None else overlap.value
        if not 0 <= shared < most:
            raise ValueError("overlap must be smaller than the chunk size")
        return AnalyzeResult(schema=CHUNKS)

    def eval(self, text: str, size: int = 512, overlap: int = 50) -> Iterator[tuple]:
        if text:
            for i, (a, b, n) in enumerate(chunk_spans(text, size, overlap)):
                yield i, a, b, n, text[a:b]


def findings(extractor: Callable[[str], Sequence[Mapping[str, object]]]):
    """A table function of the caller's own extractor, which takes a text and returns findings as ``documents.extract`` expects them."""

    class TextFindings:
        def eval(self, text: str) -> Iterator[tuple]:
            for x in extractor(text) if text else ():
                span, score = x.get("char_interval") or {}, x.get("confidence")
                attributes = {k: None if v is None else str(v) for k, v in dict(x.get("attributes") or {}).items()}
                yield (x["extraction_type"], x["text_span"], span.get("start"), span.get("end"), 1.0 if score is None else float(score), attributes)

    return udtf(TextFindings, returnType=FINDINGS)


def register(spark: SparkSession, extractor: Callable[[str], Sequence[Mapping[str, object]]] | None = None) -> None:
    """Make ``text_chunks`` and, given an extractor, ``text_findings`` known to SQL in this session."""
    spark.udtf.register("text_chunks", udtf(TextChunks))
    if extractor is not None:
        spark.udtf.register("text_findings", findings(extractor))
