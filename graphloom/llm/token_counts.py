"""Token counts of a SentencePiece BPE model from distinct pre-tokens.

A pre-token is a run of spaces with the run of other characters behind it.
No piece of the vocabulary has a space behind another character, so no merge
crosses the start of a pre-token and a text's count is the sum over its
pre-tokens.  Each task counts the pieces of a distinct pre-token once, joins
those counts to the documents' pre-token frequencies and sums; ids are never
kept.  The join stays within the task: pre-token frequencies by document are
about as large as the texts, and moving them to a global dictionary would
cost more than counting a pre-token once in each task.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_arrow, utf8

_PRE_TOKEN = re.compile(" *[^ ]+| +")
#: Distinct pre-tokens whose counts a task keeps; longer ones are never kept.
DICTIONARY, KEEP_CHARS = 500_000, 64


class PieceCounter:
    """Counts pieces with a dictionary of pre-tokens.

    Needs a model that adds a dummy space before a text, keeps extra spaces
    and normalises nothing else, and whose pieces hold spaces at the start
    only; anything else is refused, as the sum would not be exact.
    """

    def __init__(self, model_file: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        with open(model_file, "rb") as f:
            proto = pb.ModelProto.FromString(f.read())
        spec = proto.normalizer_spec
        plain = spec.add_dummy_prefix and not spec.remove_extra_whitespaces and spec.escape_whitespaces and not spec.precompiled_charsmap
        if not plain or any("▁" in p.piece.lstrip("▁") or p.type == 4 for p in proto.pieces):
            raise ValueError("pre-token counts would not add up for this model")
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        # a lone space behind the text's last word: the processor would add it to nothing
        self.space = 1 if any(p.piece == "▁" for p in proto.pieces) else 3
        self.counts: dict[str, int] = {}

    def count(self, texts: list[bytes]) -> list[int]:
        """Number of tokens of each text, without added special tokens."""
        # the model's own space character counts as a space
        frequencies = [Counter(_PRE_TOKEN.findall(" " + t.decode("utf-8", "replace").replace("▁", " "))) if t else Counter() for t in texts]
        if len(self.counts) > DICTIONARY:
            self.counts.clear()
        known = self.counts
        new = list({p for f in frequencies for p in f if p not in known})
        # the processor adds the first space itself
        pieces = dict(zip(new, map(len, self.processor.encode([p[1:] for p in new], num_threads=1)))) if new else {}
        if " " in pieces:
            pieces[" "] = self.space
        known.update((p, n) for p, n in pieces.items() if len(p) <= KEEP_CHARS)
        return [sum(k * (known[p] if p in known else pieces[p]) for p, k in f.items()) for f in frequencies]


def count_tokens(docs: DataFrame, model_file: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), limit: int = 4096, group_bytes: int = 2_000_000) -> DataFrame:
    """keep columns, then n_bytes, n_tokens and over_limit for every row.

    Whole texts; null and empty texts have 0 tokens.  Rows repeat as they
    come; other columns are left behind.  model_file must exist on executors.
    """
    rows = docs.select(*keep, F.col(text).cast("string").alias("__text"))

    def run(batches):
        counter = PieceCounter(model_file)
        for batch in batches:
            texts = utf8(batch.column("__text"))
            tokens, group, size = [], [], 0
            for t in texts:
                group.append(t)
                size += len(t)
                if size >= group_bytes:
                    tokens += counter.count(group)
                    group, size = [], 0
            tokens += counter.count(group)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(len(keep))), pa.array(map(len, texts), pa.int64()), pa.array(tokens, pa.int64()), pa.array((n > limit for n in tokens), pa.bool_())],
                names=[*keep, "n_bytes", "n_tokens", "over_limit"],
            )

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    return map_arrow(rows, run, kinds + "n_bytes long, n_tokens long, over_limit boolean")
