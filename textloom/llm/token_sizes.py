"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

#: Where the ranks of the byte-level BPE vocabulary lie on every machine.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the published split pattern of the byte-level BPE of 50,257 ids.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def token_sizes(docs: DataFrame, text: str, keep: list[str], path: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` and ``n_tokens BIGINT`` of each text.

    Special tokens written out in a text are ordinary text. A null or empty
    text has 0 tokens. Whole texts are counted, of any length.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            sizes = [len(enc.encode_ordinary(t)) if t else 0 for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(sizes, pa.int64())], [*[f"k{i}" for i in range(len(keep))], "n_tokens"])

    fields = [docs.schema[c] for c in keep]
    schema = ", ".join(f"k{i} {f.dataType.simpleString()}" for i, f in enumerate(fields)) + ", n_tokens long"
    out = docs.select(text, *keep).mapInArrow(work, schema)
    return out.toDF(*keep, "n_tokens")
