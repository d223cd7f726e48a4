"""Token counts: overlapping chunks of huge documents, spliced at proven common boundaries."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from nestwell.llm._common import frugal, id_and_text

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_chunks long, n_widened long"


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 1024, chunk_chars: int = 2_048, overlap_chars: int = 192, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: UTF-8 bytes, tokens as the library counts them, and whether they exceed ``limit``.

    Texts of at most ``chunk_chars`` characters are one chunk.  Longer ones, of any length, are encoded in
    overlapping chunks with offsets, so the memory of a task doesn't grow with a text's tokens; neighbours are spliced at the first pre-token boundary that both have, and the
    overlap doubles while there is none (see ``Encoder.resync``).  ``n_chunks`` and ``n_widened`` report it.

    Null text is empty and has 0 tokens; a null id stays null; repeated rows give repeated rows; an empty
    table gives an empty one; other columns are ignored.  The work is one narrow pass over the texts.
    """
    spec = docs.sparkSession.sparkContext.broadcast(open(tokenizer_path, encoding="utf-8").read())

    def run(batches):
        from nestwell.llm._tokens import encoder

        enc = encoder(spec.value)
        enc.chunk, enc.overlap = chunk_chars, overlap_chars
        for batch in batches:
            n_bytes, n_tokens, chunks, widened = [], [], [], []
            for x in batch.column("text"):
                text = x.as_py()
                ids, c, w = enc.encode(text)
                n_bytes.append(x.as_buffer().size)
                n_tokens.append(len(ids))
                chunks.append(c)
                widened.append(w)
            longs = [pa.array(x, pa.int64()) for x in (n_bytes, n_tokens, chunks, widened)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *longs[:2], pa.array([n > limit for n in n_tokens], pa.bool_()), *longs[2:]], ["doc_id", "n_bytes", "n_tokens", "over_limit", "n_chunks", "n_widened"])

    return id_and_text(docs, id_col, text_col).mapInArrow(frugal(run), SCHEMA)
