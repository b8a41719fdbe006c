"""Token counts of whole texts by rank-synchronous merging (see ``bpe``).

Defined results: a null or empty text has no tokens; special strings inside a text count as the one token they stand for;
repeated rows count alike, each on its own, so there are no ties; a very long text is counted whole; other columns aren't read;
an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import ByteLevel, Encoder
from .common import as_bytes, chunks, frugal


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


def counted(docs: DataFrame, limit: int = 512, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more tokens than the limit) of every row."""

    def run(batches):
        import pyarrow as pa

        encode = Encoder(path or vocabulary("byte_bpe_50k.json"), ByteLevel, counts=True)
        for b in batches:
            ids, texts = b.column(0), as_bytes(b.column(1))
            for i, j in chunks(list(map(len, texts))):
                n = encode([t.decode() for t in texts[i:j]])
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(list(map(len, texts[i:j])), pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(frugal(run), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
