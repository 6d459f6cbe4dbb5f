"""SentencePiece encoding and decoding by a table of distinct chunks.

No piece of the vocabulary holds a whitespace marker after another character, so merges never cross from a
non-marker to a marker: a text falls apart into chunks (a run of markers and what follows it) that encode alone.
Each worker keeps a table of the distinct chunks it has met; a chunk is segmented once and its ids are joined back by
position.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession

from . import common

MARK = "▁"
#: Chunks that a task's table holds at most; a full table starts anew. Longer chunks are not kept.
TABLE_CHUNKS, KEPT_CHARS = 400_000, 64
_RUNS = re.compile(f"{MARK}+[^{MARK}]*")


def check_vocabulary(processor) -> None:
    """Raises if the vocabulary has a piece that crosses into a marker, or the model rewrites texts: chunks would not be exact then."""
    for i in range(processor.get_piece_size()):
        if MARK in processor.id_to_piece(i).lstrip(MARK):
            raise ValueError(f"piece {i} crosses a whitespace marker")
    probe = "  a  ﬁ ½　b "
    if processor.decode(processor.encode(probe)) != probe:
        raise ValueError("the model normalises texts")


class Chunks(dict):
    """chunk without its first marker -> its ids as decimal text; `odd` has chunks that don't decode to themselves."""

    def __init__(self, path: str):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        check_vocabulary(self.processor)
        self.mark = self.processor.piece_to_id(MARK)
        self.odd: dict[str, str] = {}

    def split(self, text: str) -> list[str]:
        """Chunks of a text, each without its first marker and with further ones as spaces."""
        if not text:
            return []
        marked = text.replace(MARK, " ")
        if "  " not in marked and not marked.startswith(" ") and not marked.endswith(" "):
            return marked.split(" ")
        return [x[1:].replace(MARK, " ") for x in _RUNS.findall(MARK + marked.replace(" ", MARK))]

    def fill(self, wanted: set[str]) -> None:
        """Segments the chunks that the table lacks."""
        if len(self) > TABLE_CHUNKS:
            self.clear()
            self.odd.clear()
        new = [c for c in wanted if c not in self]
        found = self.processor.encode(new, num_threads=1)
        for chunk, ids, decoded in zip(new, found, self.processor.decode(found), strict=True):
            if not chunk:  # a marker with nothing after it
                ids, decoded = [self.mark], ""
            if decoded != chunk:
                self.odd[chunk] = decoded
            self[chunk] = ",".join(map(str, ids))

    def encode(self, texts: list[str]) -> list[tuple[str, str]]:
        """For each text its decimal ids joined by commas, and the decoded text."""
        chunks = [self.split(t) for t in texts]
        wanted = set().union(*chunks)
        self.fill(wanted)
        odd = self.odd if not self.odd.keys().isdisjoint(wanted) else {}
        out = [(",".join([self[c] for c in own]), " ".join([odd.get(c, c) for c in own] if odd else own)) for own in chunks]
        for c in wanted:
            if len(c) > KEPT_CHARS:
                del self[c]
                self.odd.pop(c, None)
        return out


_TABLES: dict[str, Chunks] = {}


def _table(model: str) -> Chunks:
    """A worker's table, which its next tasks use again."""
    if model not in _TABLES:
        _TABLES[model] = Chunks(model)
    return _TABLES[model]


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every document.

    Null and empty texts have no ids and decode to the empty text. Rows are independent, so ties and repeated rows
    give repeated results; an empty table gives no rows; other columns are ignored. A very long chunk is encoded
    whole, but not kept in the table.
    """

    def make():
        table = _table(model)

        def work(texts: list[str]) -> list[list]:
            n, ids_sha, text_sha = [], [], []
            for ids, decoded in table.encode(texts):
                n.append(ids.count(",") + 1 if ids else 0)
                ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                text_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
            return [n, ids_sha, text_sha]

        return work

    return common.map_texts(docs, ["doc_id"], ["n_tokens", "ids_sha256", "decoded_sha256"], "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", make)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(common.documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
