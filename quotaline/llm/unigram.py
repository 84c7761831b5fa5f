"""Token counts of a unigram vocabulary by dynamic programming over a trie of pre-tokens.

The distinct pre-tokens of a slice of texts are sorted, which walks their trie in depth-first order: two neighbours
share the nodes of their common prefix. For every node the best score of any segmentation of its prefix and the number
of tokens of that segmentation are computed once, from the scores of the nodes above; nodes where a pre-token ends give
its count. A document's count is the sum over its pre-tokens.

The vocabulary and its scores come from a SentencePiece file; nothing is trained. The file's scores are used as unigram
log scores: a segmentation's score is the sum of its pieces' scores, the highest wins, and of equal ones that with
fewer tokens. A pre-token is a run of characters other than ASCII white space with the word mark in front. A character
that no piece covers costs ``UNKNOWN`` and counts one token per UTF-8 byte if the file has byte pieces, else one.

Nothing is shuffled. A null or blank text has 0 tokens; repeated rows give repeated results; columns other than the id
and the text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from quotaline.llm import textbatch as tb
from quotaline.llm.shared import ship

MARK = "▁"


class Vocabulary:
    """The pieces of a SentencePiece file and their scores."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ordinary = [i for i in range(model.get_piece_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
        self.score = {model.id_to_piece(i): model.get_score(i) for i in ordinary}
        self.bytes = any(model.is_byte(i) for i in range(model.get_piece_size()))
        self.widest = max(map(len, self.score))
        #: Below every sum that pieces of the same characters could give.
        self.unknown = 2 * min(self.score.values()) - 10
        self.numbers, self.count = tb.Kept(), np.zeros(0, np.int64)
        #: Pieces by their last character, the one before it, and so on; a node's score is under "".
        self.backward: dict = {}
        for piece, score in self.score.items():
            node = self.backward
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node[""] = score

    def counts(self, pretokens: list[str]) -> list[int]:
        """The number of tokens of each pre-token (with its mark); sorted order shares the work of common prefixes."""
        out = [0] * len(pretokens)
        backward, unknown, by_byte = self.backward, self.unknown, self.bytes
        best, tokens, last = [0.0], [0], ""
        for k in sorted(range(len(pretokens)), key=pretokens.__getitem__):
            word = pretokens[k]
            most, shared = min(len(word), len(last)), 0
            while shared < most and word[shared] == last[shared]:
                shared += 1
            del best[shared + 1 :], tokens[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                c = word[end - 1]
                top, n = best[end - 1] + unknown, tokens[end - 1] + (len(c.encode()) if by_byte else 1)
                node, at = backward.get(c), end - 1
                while node is not None:
                    s = node.get("")
                    if s is not None:
                        s += best[at]
                        if s > top or (s == top and tokens[at] + 1 < n):
                            top, n = s, tokens[at] + 1
                    if not at:
                        break
                    at -= 1
                    node = node.get(word[at])
                best.append(top)
                tokens.append(n)
            out[k], last = tokens[-1], word
        return out

    def _make(self, fresh: list[bytes]) -> None:
        self.count = np.concatenate([self.count, np.array(self.counts([MARK + w.decode() for w in fresh]), np.int64)])

    def _clear(self) -> None:
        self.count = np.zeros(0, np.int64)

    def per_text(self, texts: tb.Texts) -> np.ndarray:
        cut = tb.words(texts)
        numbers = self.numbers.numbers(texts, cut, self._make, self._clear)
        return np.bincount(cut.doc, weights=self.count[numbers], minlength=len(texts)).astype(np.int64)


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The file's vocabulary, read once a worker."""
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def token_counts(documents: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``n_tokens`` of every row; ``path`` is the model file on every machine."""
    ship(documents.sparkSession)
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches):
        v = vocabulary(path)
        for batch in batches:
            for texts in tb.slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(texts.first, len(texts)), pa.array(v.per_text(texts))], ["id", "n_tokens"])

    return documents.select(documents[id_col].alias("id"), documents[text_col].alias("text")).mapInArrow(run, f"id {kind}, n_tokens long").withColumnRenamed("id", id_col)
