"""Token counts by greedy longest match, without building pieces.

A vocabulary of byte strings becomes a trie. A node stands for what has been read and not yet given out; its *failure link* leads to the
node for what is left once the longest pieces at its front have been popped, with the number of pieces popped precomputed, so that a word
of any length is counted in time linear in its bytes (the idea of the linear longest-match tokenizer of Song et al., 2021).

A word is a run of anything but ASCII white space, with one space put before it (vocabularies of byte-level BPE mark word beginnings so);
the greedy longest-match pieces of that string are counted. A byte sequence that no piece begins makes its word one unknown token.
Equal words of a batch are counted once, and all distinct words walk the trie together, a byte at a time.

A null text has null counts; an empty or blank one has 0 words and 0 tokens. Rows are counted each, whatever their ``doc_id``.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import tokens
from factloom.llm.shared import texts_of

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Bytes beyond which a word is walked alone, byte by byte: a step of all words together costs much where few are left.
LONG = 256
_DEAD = 0  # the failure link of a node whose front no piece begins


def read_vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """Pieces of a file of lines of a base64 piece and its rank."""
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


class Automaton:
    """Trie with failure links as arrays. Node 0 is dead, node 1 the root; children are found in ``keys``, sorted ``node * 256 + byte``."""

    def __init__(self, pieces: Iterable[bytes]):
        children: list[dict[int, int]] = [{}, {}]
        parent, byte, whole = [0, 0], [0, 0], [False, False]
        for piece in pieces:
            if not piece:
                continue
            node = 1
            for b in piece:
                child = children[node].get(b)
                if child is None:
                    child = len(children)
                    children[node][b] = child
                    children.append({})
                    parent.append(node)
                    byte.append(b)
                    whole.append(False)
                node = child
            whole[node] = True
        order, at = [1], 0
        while at < len(order):  # breadth first: links lead to shorter strings
            order.extend(children[order[at]].values())
            at += 1
        fail, popped = [_DEAD] * len(children), [0] * len(children)
        for node in order[1:]:
            if whole[node]:
                fail[node], popped[node] = 1, 1
                continue
            # pop from what the parent leaves until this node's byte goes on
            rest, count, b = fail[parent[node]], popped[parent[node]], byte[node]
            while rest != _DEAD and b not in children[rest]:
                rest, count = fail[rest], count + popped[rest]
            if rest != _DEAD:
                fail[node], popped[node] = children[rest][b], count
        self.keys = np.array(sorted(n << 8 | b for n, of in enumerate(children) for b in of), dtype=np.int32)
        self.to = np.array([children[k >> 8][k & 255] for k in self.keys.tolist()], dtype=np.int32)
        # a hashed table of the keys: a probe or two per step instead of a binary search
        self.bits = max(4, int(np.ceil(np.log2(len(self.keys) * 4 + 1))))
        self.table = np.full(1 << self.bits, -1, dtype=np.int32)
        self.longest = 0
        left = np.arange(len(self.keys), dtype=np.int32)
        while len(left):
            slot = (self._slot(self.keys[left]) + self.longest) & ((1 << self.bits) - 1)
            free = self.table[slot] < 0
            self.table[slot[free]] = left[free]
            left = left[self.table[slot] != left]
            self.longest += 1
        self.fail, self.popped = np.array(fail, dtype=np.int32), np.array(popped, dtype=np.int32)
        self.known: dict[int, tuple[int, int]] = {}

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint32) * np.uint32(2654435769)) >> np.uint32(32 - self.bits)).astype(np.int64)

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The child of each node by each byte, -1 where there is none."""
        key = node.astype(np.int32) << 8 | byte
        out = np.full(len(key), -1, dtype=np.int32)
        left, slot = np.arange(len(key)), self._slot(key)
        for _ in range(self.longest):
            entry = self.table[slot]
            found = (entry >= 0) & (self.keys[entry] == key[left])
            out[left[found]] = self.to[entry[found]]
            go = (entry >= 0) & ~found
            left, slot = left[go], (slot[go] + 1) & ((1 << self.bits) - 1)
            if not len(left):
                break
        return out

    def _go(self, node: int, byte: int) -> tuple[int, int]:
        """The node after a byte, dead if no piece goes on, and the pieces popped on the way."""
        key, count, at = node << 8 | byte, 0, node
        while at != _DEAD:
            child = int(self.step(np.array([at], np.int32), np.array([byte], np.int32))[0])
            if child >= 0:
                at = child
                break
            count, at = count + int(self.popped[at]), int(self.fail[at])
        if len(self.known) > 1 << 20:
            self.known.clear()
        self.known[key] = found = (at, count)
        return found

    def count(self, word: bytes) -> int:
        """Pieces of one word, however long, in one walk."""
        node, total, known = 1, 0, self.known
        for byte in word:
            node, more = known.get(node << 8 | byte) or self._go(node, byte)
            if node == _DEAD:
                return 1
            total += more
        while node != 1:
            total, node = total + int(self.popped[node]), int(self.fail[node])
            if node == _DEAD:
                return 1
        return total

    def counts(self, raw: np.ndarray, start: np.ndarray, length: np.ndarray, prefix: bytes = b" ") -> np.ndarray:
        """Pieces of each of the words ``prefix + raw[start:start + length]``; 1 for a word with no such pieces, 0 for an empty string."""
        if (long := np.flatnonzero(length > LONG)).size:
            out = np.empty(len(start), dtype=np.int64)
            short = np.flatnonzero(length <= LONG)
            out[short] = self.counts(raw, start[short], length[short], prefix)
            out[long] = [self.count(prefix + raw[start[k] : start[k] + length[k]].tobytes()) for k in long]
            return out
        n = len(start)
        node, count, known = np.ones(n, dtype=np.int32), np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
        order = np.argsort(-length, kind="stable")
        start, length = start[order], length[order]
        longest = int(length[0]) if n else 0
        for k in range(-len(prefix), longest):
            live = int(np.searchsorted(-length, -k, side="left")) if k >= 0 else n  # words with a byte at k
            at = np.flatnonzero(known[:live])
            byte = raw[start[at] + k].astype(np.int32) if k >= 0 else np.full(len(at), prefix[k], dtype=np.int32)
            while len(at):
                child = self.step(node[at], byte)
                went = child >= 0
                node[at[went]] = child[went]
                at, byte = at[~went], byte[~went]
                count[at] += self.popped[node[at]]
                node[at] = self.fail[node[at]]
                dead = node[at] == _DEAD
                known[at[dead]] = False
                at, byte = at[~dead], byte[~dead]
        at = np.flatnonzero(known)
        while len(at := at[node[at] != 1]):  # what is held at the end is popped too
            count[at] += self.popped[node[at]]
            node[at] = self.fail[node[at]]
            dead = node[at] == _DEAD
            known[at[dead]] = False
            at = at[~dead]
        count[~known] = 1
        out = np.empty(n, dtype=np.int64)
        out[order] = count
        return out


def _count(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton: Automaton = shared.value
        for batch in batches:
            texts = batch.column(1)
            for at, to in tokens.slices(texts):
                part = texts.slice(at, to - at)
                n_words, n_tokens = text_counts(automaton, part)
                missing = part.is_null().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array(n_words, mask=missing), pa.array(n_tokens, mask=missing)], names=["doc_id", "n_words", "n_tokens"])

    return run


def text_counts(automaton: Automaton, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words and tokens of each text."""
    w = tokens.words(texts, whitespace=True, fold=False)
    raw, offsets = tokens.buffer(texts)
    _, first, which = np.unique(w.hash, return_index=True, return_inverse=True)
    owner = w.owner()
    begin = offsets[owner[first]] + w.start[first]
    pieces = automaton.counts(raw, begin, (w.end - w.start)[first])
    sums = np.concatenate([[0], np.cumsum(pieces[which])])
    return np.diff(w.first), sums[w.first[1:]] - sums[w.first[:-1]]


def token_counts(docs: DataFrame, vocabulary: str | Iterable[bytes] = VOCABULARY) -> DataFrame:
    """``(doc_id, n_words, n_tokens)`` of every row of ``docs``. ``vocabulary``: a file, read on the driver, or the pieces."""
    pieces = read_vocabulary(vocabulary) if isinstance(vocabulary, str) else vocabulary
    shared = docs.sparkSession.sparkContext.broadcast(Automaton(pieces))
    source = texts_of(docs)
    return source.mapInArrow(_count(shared), "doc_id long, n_words long, n_tokens long")


def brute_count(word: bytes, pieces: set[bytes]) -> int:
    """Pieces of one string by trying the longest first, for tests."""
    at = count = 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return 1
        at, count = end, count + 1
    return count
