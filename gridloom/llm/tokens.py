"""Sizes of texts in tokens of a public tokenizer, read from its vocabulary file."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TokenizerFile:
    """Where a vocabulary lies and which library reads it.

    ``path`` must be readable on every executor. ``pattern`` is the splitting pattern
    of a ``tiktoken`` vocabulary.
    """

    library: str
    path: str
    pattern: str = ""


def public_tokenizer(name: str = "byte_bpe_multi_50k.tiktoken") -> TokenizerFile:
    """A vocabulary of the installed collection of public tokenizers."""
    import public_tokenizers

    library = {"json": "tokenizers", "tiktoken": "tiktoken", "model": "sentencepiece"}[name.rsplit(".", 1)[1]]
    return TokenizerFile(library, public_tokenizers.path(name), public_tokenizers.PATTERN if library == "tiktoken" else "")


_READY: dict[TokenizerFile, Callable[[list[str]], list[int]]] = {}


def counter(spec: TokenizerFile) -> Callable[[list[str]], list[int]]:
    """Counts tokens of texts; strings of special tokens count as ordinary text. Loaded once a worker."""
    if spec not in _READY:
        _READY[spec] = _load(spec)
    return _READY[spec]


def _load(spec: TokenizerFile) -> Callable[[list[str]], list[int]]:
    if spec.library == "tiktoken":
        import tiktoken

        with open(spec.path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encode = tiktoken.Encoding("own", pat_str=spec.pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        return lambda texts: [len(encode(t)) for t in texts]
    if spec.library == "sentencepiece":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=spec.path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)] if texts else []
    if spec.library == "tokenizers":
        from tokenizers import Tokenizer

        bpe = Tokenizer.from_file(spec.path)
        bpe.encode_special_tokens = True
        return lambda texts: [len(x) for x in bpe.encode_batch(texts, add_special_tokens=False)]
    raise ValueError(f"unknown tokenizer library {spec.library!r}")


def count_tokens(df: DataFrame, text: str, spec: TokenizerFile, keep: tuple[str, ...]) -> DataFrame:
    """The columns ``keep`` and ``n_tokens`` of every row; a null text has no tokens.

    Whole texts are counted in one narrow pass that reads only the columns named.
    """
    chosen = df.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(spec)
        for batch in batches:
            sizes = count([t or "" for t in batch.column(batch.num_columns - 1).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(sizes, pa.int64())], names=[*batch.schema.names[:-1], "n_tokens"]
            )

    return chosen.mapInArrow(read, f"{schema}, n_tokens bigint")
