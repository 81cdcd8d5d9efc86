"""Token counts by a linear longest-match automaton: a trie of the vocabulary with failure links and, for each node, how many tokens are popped when its link is followed. Greedy word-piece lengths come out in one pass over a word's bytes, without the pieces."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from kmerloom.llm.bpe import ranks_of, read_ranks
from kmerloom.llm.common import documents, field, only

#: Words that a worker remembers before it starts anew; none is longer than so many bytes.
REMEMBERED, LONGEST = 400_000, 64
NOWHERE = -1


class Automaton:
    """Longest-match-first pieces of words, counted.

    A word is matched with a blank before it: tokens that begin with a blank open a word, others go on with it. A word that the vocabulary can't spell counts as one unknown token.
    """

    def __init__(self, vocabulary: list[bytes]):
        self.child: dict[int, int] = {}
        token = [False]
        for piece in vocabulary:
            node = 0
            for byte in piece:
                edge = node << 8 | byte
                if edge not in self.child:
                    self.child[edge] = len(token)
                    token.append(False)
                node = self.child[edge]
            token[node] |= node > 0
        edges: list[list[tuple[int, int]]] = [[] for _ in token]
        for edge, node in self.child.items():
            edges[edge >> 8].append((edge & 255, node))
        self.link, self.popped = [NOWHERE] * len(token), [0] * len(token)
        queue = deque([0])
        while queue:  # by depth: a link leads to a node that is nearer to the root
            parent = queue.popleft()
            for byte, node in edges[parent]:
                queue.append(node)
                if token[node]:
                    self.link[node], self.popped[node] = 0, 1
                    continue
                at, n = self.link[parent], self.popped[parent]
                while at != NOWHERE and at << 8 | byte not in self.child:
                    n += self.popped[at]
                    at = self.link[at]
                if at != NOWHERE:
                    self.link[node], self.popped[node] = self.child[at << 8 | byte], n

    def count(self, word: bytes) -> int:
        child, link, popped = self.child, self.link, self.popped
        node = n = 0
        for byte in b" " + word:
            while (to := child.get(node << 8 | byte, NOWHERE)) == NOWHERE:
                if link[node] == NOWHERE:
                    return 1
                n += popped[node]
                node = link[node]
            node = to
        while node:
            if link[node] == NOWHERE:
                return 1
            n += popped[node]
            node = link[node]
        return n


class Lengths(dict):
    """Tokens of words, counted when first asked for."""

    def __init__(self, automaton: Automaton, limit: int = REMEMBERED):
        self.automaton, self.limit = automaton, limit

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(word)
        if len(word) <= LONGEST:
            if len(self) >= self.limit:
                self.clear()
            self[word] = n
        return n


@lru_cache(maxsize=2)
def _lengths(file: bytes) -> Lengths:
    return Lengths(Automaton(list(ranks_of(file))))


def _count(text: str, file):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length = _lengths(file.value).__getitem__
        for batch in batches:
            n_words, n_tokens = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for i, x in enumerate(batch.column(text).cast(pa.binary())):
                words = (x.as_py() or b"").split()  # at runs of space and \t to \r
                n_words[i], n_tokens[i] = len(words), sum(map(length, words))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in batch.schema.names if c != text], pa.array(n_words), pa.array(n_tokens)], names=[*[c for c in batch.schema.names if c != text], "n_words", "n_tokens"])

    return run


def count_tokens(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """One row for each row of df: key, n_words and n_tokens of the whole text, words being runs of anything but white space.

    vocabulary: path of a rank file, which the driver reads; its tokens are the pieces. Null and empty texts count 0, texts of any length are read whole. Repeated rows are counted alike; other columns are not read; an empty table gives an empty one.
    """
    df = only(df, [key, text]).select(key, text)
    file = df.sparkSession.sparkContext.broadcast(read_ranks(vocabulary or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    return df.mapInArrow(_count(text, file), T.StructType([df.schema[key], field("n_words", "long"), field("n_tokens", "long")]))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir))
