"""The library in SQL text: scalar functions that the optimizer sees through, and a table function that cuts a text into windows."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from lodestone.functions.text import LOWER, UPPER
from lodestone.operators.chunking import OVERLAP, TARGET, text_chunks

#: Name, arguments, result and body of each function; all are expressions of Spark's own.
FUNCTIONS = [
    ("tokenize", "t STRING", "ARRAY<STRING>", f"transform(regexp_extract_all(t, '[A-Za-z0-9]+', 0), x -> translate(x, '{UPPER}', '{LOWER}'))"),
    ("l2_norm", "v ARRAY<DOUBLE>", "DOUBLE", "sqrt(aggregate(v, 0D, (s, x) -> s + x * x))"),
    ("cosine", "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "CASE WHEN size(a) = size(b) AND size(a) > 0 AND l2_norm(a) > 0 AND l2_norm(b) > 0 THEN aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) / (l2_norm(a) * l2_norm(b)) ELSE 0D END"),
    (
        "path_prefix", "p STRING, prefix STRING", "BOOLEAN",
        "rtrim('/', prefix) = '' OR p = rtrim('/', prefix) OR startswith(p, rtrim('/', prefix) || '/') OR (startswith(p, rtrim('/', prefix) || '.') AND NOT rlike(substr(p, length(rtrim('/', prefix)) + 2), '[/.]'))",
    ),
    (
        "snippet", "t STRING, lines INT", "STRING",
        "array_join(slice(split(replace(t, '\\r\\n', '\\n'), '\\n', -1), 1, lines), '\\n') || CASE WHEN size(split(replace(t, '\\r\\n', '\\n'), '\\n', -1)) > lines THEN '\\n…' ELSE '' END",
    ),
]


class TextWindows:
    """The windows of a text, for LATERAL: byte_start, byte_end, line_start, line_end, content.

    ``analyze`` sees the arguments before the query runs: target and overlap are constants, and an impossible pair of them is refused there.
    """

    @staticmethod
    def analyze(text: AnalyzeArgument, target: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None) -> AnalyzeResult:
        if text.dataType != StringType():
            raise ValueError("the first argument is a text")
        for name, a in (("target", target), ("overlap", overlap)):
            if a is not None and (not a.isConstantExpression or a.value is None or a.value < 0):
                raise ValueError(f"{name} is a constant number of lines")
        if target is not None and target.value < 4:
            raise ValueError("a window has at least four lines to aim at")
        kinds = [("byte_start", LongType()), ("byte_end", LongType()), ("line_start", LongType()), ("line_end", LongType()), ("content", StringType())]
        return AnalyzeResult(StructType([StructField(n, t) for n, t in kinds]))

    def eval(self, text: str | None, target: int = TARGET, overlap: int = OVERLAP) -> Iterator[tuple]:
        data = (text or "").encode()
        for c in text_chunks(data, target, overlap):
            body = data[c.start : c.end]
            first = data.count(b"\n", 0, c.start) + 1
            yield c.start, c.end, first, first + body.rstrip(b"\n").count(b"\n"), body.decode()


def register(spark: SparkSession) -> None:
    """Make ``tokenize``, ``l2_norm``, ``cosine``, ``path_prefix``, ``snippet`` and the table function ``text_windows`` known to the session's SQL."""
    for name, arguments, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
    spark.udtf.register("text_windows", udtf(TextWindows))
