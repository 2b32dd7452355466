"""Token counts of a unigram vocabulary by Viterbi, without the tokens.

An Aho-Corasick automaton lists the vocabulary's pieces by where they end; the
dynamic programme keeps, for each position, the best score and the number of
pieces that reach it. Ties are the unigram tokenizer's: of equal scores the piece
that starts first (the longest) stays; a character that is no piece costs the
least score less a penalty and counts as its bytes where the vocabulary has
byte pieces, else runs of them count as one. Words are scored on their own,
each with the word mark before it, so a word's count is worked out once and kept.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame

from quillmark.llm.shared import WORD, map_texts

MARK = "▁"
UNKNOWN_PENALTY = 10.0
WORDS_KEPT = 200_000
_WORD = re.compile(WORD)


def vocabulary(path: str) -> tuple[list[tuple[str, float]], bool]:
    """(piece, log probability) and whether there are byte pieces, from a sentencepiece file.

    A file of ranks has no probabilities; by Zipf's law, the piece of rank r gets 1 / (r + 1), normed.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    usable = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    norm = math.log(sum(1 / (r + 1) for r in range(len(usable))))
    pieces = [(model.id_to_piece(i), -math.log(r + 1) - norm) for r, i in enumerate(usable)]
    return pieces, any(model.is_byte(i) for i in range(model.get_piece_size()))


class Counter:
    """Counts the pieces of words under a vocabulary."""

    def __init__(self, pieces: list[tuple[str, float]], byte_pieces: bool, words_kept: int = WORDS_KEPT):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            automaton.add_word(piece, (len(piece), score))
        automaton.make_automaton()
        self._iter, self._bytes = automaton.iter, byte_pieces
        self._single = {p for p, _ in pieces if len(p) == 1}
        self._unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        count, kept = self.viterbi, words_kept

        class Words(dict):
            def __missing__(self, word):
                if len(self) > kept:
                    self.clear()
                n = self[word] = count(MARK + word)
                return n

        self._words = Words()

    def viterbi(self, word: str) -> int:
        """The number of pieces on the best path; all positions can be reached."""
        n, single, least = len(word), self._single, -math.inf
        best, pieces, unknown = [0.0] + [least] * n, [0] * (n + 1), [False] * (n + 1)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, match in self._iter(word):
            ends[end].append(match)
        for end, matches in enumerate(ends):
            at = end + 1
            matches.sort(reverse=True)  # from the first start on, as the tokenizer relaxes them
            for length, score in matches:
                score += best[at - length]
                if score > best[at]:
                    best[at], pieces[at], unknown[at] = score, pieces[at - length] + 1, False
            if word[end] not in single and (score := best[end] + self._unknown) > best[at]:
                more = len(word[end].encode("utf-8", "surrogatepass")) if self._bytes else 0 if unknown[end] else 1
                best[at], pieces[at], unknown[at] = score, pieces[end] + more, True
        return pieces[n]

    def count(self, text: str | None) -> int:
        return sum(map(self._words.__getitem__, _WORD.findall(text))) if text else 0


def count_tokens(docs: DataFrame, *, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with n_words and n_tokens (long), replaced if there; null, empty and blank texts have 0.

    One pass without a shuffle; equal texts have equal counts.
    """

    def work():
        counter = Counter(*vocabulary(path))
        return lambda texts: [[len(_WORD.findall(t)) if t else 0 for t in texts], [counter.count(t) for t in texts]]

    return map_texts(docs, work, "n_words long, n_tokens long", text=text, keep=keep)
