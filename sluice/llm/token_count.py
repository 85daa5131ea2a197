"""Greedy word-piece lengths by a linear longest-match automaton.

The vocabulary is a trie. A node that cannot take the next symbol follows its failure link, which pops the
longest pieces that its string begins with; how many it pops is computed with the automaton. So one pass over
a word adds up the number of pieces and never builds one.

The words are those of the vocabulary's own description: NFC, lower case, runs of letters, single numbers, runs of other marks. A piece that ends a word is
another than the same letters inside of one, so a word's last symbol carries the end mark.

Input cases: a null or empty text has no word and no token; a word with a symbol that is no piece counts as one
unknown token; rows are independent, so repeats and ties need no rule; columns of the input that the
result names are replaced by it, all others stay out.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import ship, texts_of

#: The word pattern that the word_bpe_49k vocabulary is described with (contractions, letters, one number, other marks), and the mark of a word's end.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"
END = "</w>"
#: Distinct words whose counts a worker keeps; beyond that it starts anew.
CACHE = 500_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + extra)
            extra += 1
    return [out[b] for b in range(256)]


class PieceCounter:
    """Counts the pieces of greedy longest-match-first cutting, in one step per symbol at most twice over.

    pieces: sequences of symbols (any hashable). A word's symbols must be given as such a sequence too.
    """

    def __init__(self, pieces: Iterable[tuple]):
        self.child: list[dict] = [{}]
        final = [False]
        for piece in pieces:
            at = 0
            for x in piece:
                nxt = self.child[at].get(x)
                if nxt is None:
                    nxt = self.child[at][x] = len(self.child)
                    self.child.append({})
                    final.append(False)
                at = nxt
            final[at] = at != 0
        #: Failure link, -1 for none, and how many pieces going along it pops.
        self.fail, self.pops = [-1] * len(self.child), [0] * len(self.child)
        queue = [0]
        for at in queue:
            for x, nxt in self.child[at].items():
                queue.append(nxt)
                if final[nxt]:
                    self.fail[nxt], self.pops[nxt] = 0, 1
                    continue
                up, n = self.fail[at], self.pops[at]
                while up >= 0 and x not in self.child[up]:
                    n += self.pops[up]
                    up = self.fail[up]
                if up >= 0:
                    self.fail[nxt], self.pops[nxt] = self.child[up][x], n

    def count(self, word: Iterable) -> int:
        """Pieces of the word; -1 if it can't be cut into pieces."""
        child, fail, pops, at, n = self.child, self.fail, self.pops, 0, 0
        for x in word:
            while (nxt := child[at].get(x)) is None:
                n += pops[at]
                at = fail[at]
                if at < 0 or (at == 0 and x not in child[0]):
                    return -1
            at = nxt
        while at > 0:
            n += pops[at]
            at = fail[at]
        return n if at == 0 else -1


def greedy_count(word: tuple, pieces: set[tuple], longest: int) -> int:
    """The plain method, for tests: cut off the longest piece again and again."""
    n = at = 0
    while at < len(word):
        size = next((k for k in range(min(longest, len(word) - at), 0, -1) if word[at : at + k] in pieces), 0)
        if not size:
            return -1
        at, n = at + size, n + 1
    return n


def symbols_of(word: str) -> list[str]:
    """The word's symbols: its bytes' characters, the last one with the end mark."""
    out = [_SYMBOLS[b] for b in word.encode("utf-8", "replace")]
    out[-1] += END
    return out


def load_pieces(path: str) -> list[tuple]:
    """The pieces of a vocabulary as tuples of symbols; those with the end mark have it in their last symbol."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    return [(*p[: -len(END) - 1], p[-len(END) - 1 :]) if p.endswith(END) and len(p) > len(END) else tuple(p) for p in vocab]


_AUTOMATA: dict[str, tuple] = {}


def _automaton(path: str) -> tuple:
    if path not in _AUTOMATA:
        import regex

        _AUTOMATA[path] = PieceCounter(load_pieces(path)), {}, regex.compile(PRETOKEN)
    return _AUTOMATA[path]


def words_of(text: str, path: str) -> list[str]:
    return _automaton(path)[2].findall(unicodedata.normalize("NFC", text).lower())


def count_text(text: str, path: str) -> tuple[int, int, int]:
    """(words, tokens, words that can't be cut) of one text."""
    auto, known, _ = _automaton(path)
    if len(known) > CACHE:
        known.clear()
    found = words_of(text, path)
    tokens = lost = 0
    for w in found:
        n = known.get(w)
        if n is None:
            n = known[w] = auto.count(symbols_of(w))
        if n < 0:
            lost += 1
            n = 1
        tokens += n
    return len(found), tokens, lost


_SYMBOLS = byte_symbols()


def token_counts(docs: DataFrame, vocab_path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, n_words, n_tokens, n_unknown) of each row; vocab_path is read where the workers run."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [count_text(t, vocab_path) for t in texts_of(pdf)]
            yield pd.DataFrame({"id": pdf["id"], **{c: [g[i] for g in got] for i, c in enumerate(("n_words", "n_tokens", "n_unknown"))}})

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, f"id {kind}, n_words long, n_tokens long, n_unknown long").withColumnRenamed("id", id_col)
