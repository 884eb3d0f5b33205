"""Token counts by a linear longest-match automaton.

The vocabulary becomes a trie. Each node gets a failure link and the number of
pieces that greedy longest-match-first has certainly taken when that link is
followed, so a word's pieces are counted in one pass over its characters,
without going back and without building a piece.

A word is matched as the word mark followed by its characters. A word that the
vocabulary cannot cover counts as one unknown piece. A null or wordless text
has no words and no pieces. Repeated rows and null identifiers are kept; an
empty table gives no rows.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from gistworks.llm.common import binary, pick, prepare

#: Stands before each word, as in the vocabulary's word-initial pieces.
MARK = "▁"
#: Words whose counts a task keeps at most before it starts anew.
CACHE = 1 << 18


class Automaton:
    """Trie over a vocabulary, with failure links and popped-piece counts; node 0 is the root."""

    def __init__(self, vocabulary: list[str]):
        self.next: list[dict[str, int]] = [{}]
        whole = [False]
        for piece in vocabulary:
            at = 0
            for char in piece:
                if char not in self.next[at]:
                    self.next[at][char] = len(self.next)
                    self.next.append({})
                    whole.append(False)
                at = self.next[at][char]
            whole[at] = at > 0
        #: -1: nothing may be popped, the word is not covered.
        self.fail = [-1] * len(self.next)
        self.popped = [0] * len(self.next)
        todo = deque([0])
        while todo:
            parent = todo.popleft()
            for char, node in self.next[parent].items():
                todo.append(node)
                if whole[node]:
                    self.fail[node], self.popped[node] = 0, 1
                    continue
                back, count = self.fail[parent], self.popped[parent]
                while back >= 0 and char not in self.next[back]:
                    count += self.popped[back]
                    back = self.fail[back]
                if back >= 0:
                    self.fail[node], self.popped[node] = self.next[back][char], count

    def pieces(self, word: str) -> int:
        """Pieces of the word, or -1 if it is not covered."""
        following, fail, popped = self.next, self.fail, self.popped
        at, count = 0, 0
        for char in word:
            while (to := following[at].get(char)) is None:
                if fail[at] < 0:
                    return -1
                count += popped[at]
                at = fail[at]
            at = to
        while at:
            if fail[at] < 0:
                return -1
            count += popped[at]
            at = fail[at]
        return count


def sentencepiece_vocabulary(path: str) -> list[str]:
    """The ordinary pieces of a model file: neither control, unknown nor byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kept = (i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return [model.id_to_piece(i) for i in kept]


def _count(vocabulary, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, known = Automaton(vocabulary.value), {}
        for batch in batches:
            rows = []
            for text in binary(batch.column("text")).to_pylist():
                words = text.split() if text else []
                total = unknown = 0
                for word in words:
                    n = known.get(word)
                    if n is None:
                        if len(known) >= CACHE:
                            known.clear()
                        n = known[word] = automaton.pieces(MARK + word.decode())
                    if n < 0:
                        unknown += 1
                    else:
                        total += n
                rows.append((len(words), total + unknown, unknown))
            columns = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns)], names)

    return run


def count_pieces(docs: DataFrame, vocabulary: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: words, pieces (an unknown word counts as one) and unknown words."""
    spark = docs.sparkSession
    prepare(spark)
    texts = pick(docs, doc_id=id_col, text=text_col)
    schema = f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, n_words long, n_pieces long, n_unknown long"
    # Shipped once to each executor: as large as the vocabulary, whatever the data.
    shipped = spark.sparkContext.broadcast(list(vocabulary))
    return texts.mapInArrow(_count(shipped, ["doc_id", "n_words", "n_pieces", "n_unknown"]), schema)
