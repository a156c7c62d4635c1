"""Table functions: a text becomes rows of (pos, token), in SQL by LATERAL."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.errors import PySparkValueError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import BinaryType, BooleanType, IntegerType, LongType, NullType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from dokuma.functions import turkish
from dokuma.operators import tokens

#: What a text can be cut into, and the columns of each.
KINDS = {
    "words": StructType().add("pos", LongType()).add("token", StringType()),
    "runs": StructType().add("pos", LongType()).add("token", StringType()).add("letters", BooleanType()),
    "pieces": StructType().add("pos", LongType()).add("token", StringType()).add("letters", BooleanType()),
    "bytes": StructType().add("pos", LongType()).add("token", IntegerType()),
}
_OTHER = "[^" + turkish.LETTERS[1:]
_RUNS = re.compile(f"({turkish.LETTERS}+)|{_OTHER}+")
_WORDS = re.compile(r"[^ \n]+")


def _fail(why: str) -> None:
    raise PySparkValueError(f"document_tokens: {why}")


class DocumentTokens:
    """document_tokens(text, kind => 'runs', longest => 100): the tokens of a text with their numbers from 0.

    kind `words`: what stands between spaces and line feeds; `runs`: maximal runs of letters and of other characters; `pieces`:
    runs cut to `longest` bytes between characters, with a null token for each end of passage (a run of line feeds); `bytes`: its
    UTF-8 bytes as numbers. The columns follow from the kind, which must be a constant. A null or empty text has no tokens."""

    @staticmethod
    def analyze(text: AnalyzeArgument, kind: AnalyzeArgument | None = None, longest: AnalyzeArgument | None = None) -> AnalyzeResult:
        if text.isTable or not isinstance(text.dataType, StringType | NullType | BinaryType):
            _fail("the first argument must be a string")
        if kind is not None and not (kind.isConstantExpression and kind.value in KINDS):
            _fail(f"kind must be a constant, one of {', '.join(KINDS)}")
        if longest is not None and not (longest.isConstantExpression and isinstance(longest.value, int) and longest.value >= 4):
            _fail("longest must be a constant of 4 bytes or more")
        return AnalyzeResult(KINDS[kind.value if kind is not None else "runs"])

    def eval(self, text: str | None, kind: str = "runs", longest: int = tokens.PIECE) -> Iterator[tuple]:
        if isinstance(text, bytes | bytearray):
            text = bytes(text).decode("utf-8", "replace")
        text = text or ""
        if kind == "words":
            yield from enumerate(_WORDS.findall(text))
        elif kind == "bytes":
            yield from enumerate(text.encode())
        elif kind == "runs":
            yield from ((i, m[0], m[1] is not None) for i, m in enumerate(_RUNS.finditer(text)))
        else:
            letter = re.compile(turkish.LETTERS).match
            for i, piece in enumerate(tokens.segments(text, longest=longest)):
                yield i, piece, piece is not None and letter(piece) is not None


def register_document_tokens(spark: SparkSession, name: str = "document_tokens") -> str:
    """Make the table function known to the session's SQL."""
    spark.udtf.register(name, udtf(DocumentTokens))
    return name


def register_token_ids(spark: SparkSession, vocabulary: tokens.Vocabulary, known: frozenset[str], frequency: dict[str, int], name: str = "token_ids") -> str:
    """Make token_ids(text) -> (pos, token) known to the session's SQL: the ids that the vocabulary gives a text. A worker analyses
    each piece once and remembers it, up to tokens.REMEMBERED pieces."""
    shared = spark.sparkContext.broadcast((vocabulary, known, frequency))

    @udtf(returnType="pos: bigint, token: int")
    class TokenIds:
        def __init__(self) -> None:
            self.seen: dict[str, list[int]] = {}

        def eval(self, text: str | None) -> Iterator[tuple[int, int]]:
            words, lexicon, counts = shared.value
            pos = 0
            for piece in tokens.segments(text or ""):
                if piece is None:
                    ids = [words.eos]
                else:
                    ids = self.seen.get(piece)
                    if ids is None:
                        if len(self.seen) >= tokens.REMEMBERED:
                            self.seen.clear()
                        ids = self.seen[piece] = words.encode_word(piece, lexicon, counts)
                for token in ids:
                    yield pos, token
                    pos += 1

    spark.udtf.register(name, TokenIds)
    return name


def document_tokens(docs: DataFrame, kind: str = "runs", id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the columns of document_tokens() for each text: one row for each token, without a shuffle."""
    spark = docs.sparkSession
    name = register_document_tokens(spark)
    return spark.sql(f"SELECT d.`{id_col}`, t.* FROM {{docs}} d, LATERAL {name}(d.`{text}`, kind => '{kind}') t", docs=docs.select(id_col, text))
