"""Token counts by greedy longest match, in time linear in the text.

Method. The vocabulary is a trie over bytes. A node's failure link and popped-token count tell what happens when no
child fits: so many longest tokens at the front of the node's string are settled, and the link's node spells what is
left of it. So a word is read byte by byte, no byte twice, and the tokens are counted without building them. At the
end of a word the links are followed to the root. A byte that no token begins with is one unknown token.

A word is a maximal run of bytes other than ASCII white space, with the vocabulary's word-start byte before it if one
is asked for. Words that were counted before are looked up; what is kept is bounded.
"""

from __future__ import annotations

import json
from collections import deque
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import over_texts

#: Counted words that a Python worker keeps.
KEPT_WORDS = 200_000


def byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabularies.

    Visible Latin-1 characters stand for themselves; the other bytes, in order, for the characters from 256 on.
    """
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def byte_level_vocabulary(path: str) -> list[bytes]:
    """The tokens of a byte-level vocabulary in the format of the tokenizers library."""
    with open(path, encoding="utf-8") as f:
        entries = json.load(f)["model"]["vocab"]
    alphabet = byte_alphabet()
    return [bytes(alphabet[c] for c in token) for token in entries if all(c in alphabet for c in token)]


@dataclass
class Automaton:
    """goto: node * 256 + byte to node; fail: node to node, -1 if nothing is left to try; pops: node to tokens settled."""

    goto: dict[int, int]
    fail: list[int]
    pops: list[int]

    def count(self, word: bytes) -> int:
        goto, fail, pops = self.goto, self.fail, self.pops
        node = total = 0
        for b in word:
            while (to := goto.get(node << 8 | b)) is None:
                if not node:
                    total += 1  # no token begins so
                    break
                total += pops[node]
                node = fail[node]
            else:
                node = to
        while node:
            total += pops[node]
            node = fail[node]
        return total


def automaton(vocabulary: list[bytes]) -> Automaton:
    """The automaton of a vocabulary; empty tokens are passed over.

    Single bytes that begin a longer token but are no token themselves count as one unknown token if they are left
    alone, so that every text has a count.
    """
    goto: dict[int, int] = {}
    token, parent, last = [False], [-1], [-1]
    for t in {*vocabulary, *(t[:1] for t in vocabulary)} - {b""}:
        node = 0
        for b in t:
            to = goto.get(node << 8 | b)
            if to is None:
                to = goto[node << 8 | b] = len(token)
                token.append(False)
                parent.append(node)
                last.append(b)
            node = to
        token[node] = True
    children: list[list[int]] = [[] for _ in token]
    for n in range(1, len(token)):
        children[parent[n]].append(n)
    fail, pops = [0] * len(token), [0] * len(token)
    queue = deque(children[0])
    while queue:
        n = queue.popleft()
        queue.extend(children[n])
        if token[n]:
            pops[n], fail[n] = 1, 0
            continue
        # The longest token at the front of the parent's string is settled; then the byte is tried from what is left.
        up, b = parent[n], last[n]
        settled, at = pops[up], fail[up]
        while (to := goto.get(at << 8 | b)) is None:
            if not at:
                settled += 1
                break
            settled += pops[at]
            at = fail[at]
        pops[n], fail[n] = settled, to or 0
    return Automaton(goto, fail, pops)


def counted(docs: DataFrame, vocabulary: list[bytes], word_start: bytes = b" ", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (doc_id, n_bytes, n_words, n_tokens) for each row of docs; a null or empty text has 0 of each.

    The automaton is broadcast: its size is that of the vocabulary. Other columns of docs are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(automaton(vocabulary))

    class Counts(dict):
        def __missing__(self, word: bytes) -> int:
            if len(self) >= KEPT_WORDS:
                self.clear()
            n = self[word] = shared.value.count(word_start + word)
            return n

    kind = pa.struct([("n_bytes", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64())])

    def column(text: Column) -> Column:
        kept: list[Counts] = []

        def run(texts: list[bytes | None]) -> pa.Array:
            if not kept:
                kept.append(Counts())
            of = kept[0].__getitem__
            words = [(t or b"").split() for t in texts]
            return pa.array([{"n_bytes": len(t or b""), "n_words": len(w), "n_tokens": sum(map(of, w))} for t, w in zip(texts, words, strict=True)], kind)

        return over_texts(run, "n_bytes long, n_words long, n_tokens long")(text)

    return docs.select(F.col(id_col).alias("doc_id"), column(F.col(text_col)).alias("c")).select("doc_id", "c.*")
