"""Token counts under a unigram vocabulary: Aho-Corasick matches and a count-only Viterbi pass."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import release

#: Stands for a blank in pieces; what an unknown letter scores below the worst piece.
BLANK, PENALTY = "▁", 10.0
#: Segments that a task remembers before it starts anew, and the letters of one at most.
REMEMBERED, SHORT = 500_000, 32
#: Places of the dynamic programming that are held at once, beside those that a piece can reach back to.
HELD = 1 << 14

_SEGMENT = re.compile(f"{BLANK}+[^{BLANK}\n]*|[^{BLANK}\n]+|\n")


def read_vocabulary(path: str) -> tuple[list[tuple[str, float]], bool]:
    """Pieces with scores of a sentencepiece model file, and whether unknown letters become one piece a byte."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    plain = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return [(model.id_to_piece(i), model.get_score(i)) for i in plain], any(model.is_byte(i) for i in ids)


class Counter:
    """Number of pieces of the best segmentation of a text.

    Ties go to the candidate met first, those with the longest last piece, as in common unigram tokenizers: a later one must score more. A letter that is no
    piece scores PENALTY below the worst piece; it counts as its bytes, or, without byte pieces, once a run.
    Pieces hold a blank at their start only, or blanks only, so texts are cut before blanks and around newlines, which
    no piece holds; scores are added within a cut, which is exact for the whole text where scores are whole numbers.
    """

    def __init__(self, pieces: list[tuple[str, float]], bytewise: bool):
        if any("\n" in p or BLANK in p.lstrip(BLANK) for p, _ in pieces):
            raise ValueError("a piece holds a newline, or a blank after another letter")
        self.bytewise, self.known = bytewise, {}
        self.unknown = min((s for _, s in pieces), default=0.0) - PENALTY
        self.letters = {p for p, _ in pieces if len(p) == 1}
        self.longest = max((len(p) for p, _ in pieces), default=1)
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        if pieces:
            self.automaton.make_automaton()

    def segment(self, text: str) -> int:
        """Pieces of a segment."""
        if len(text) > HELD:
            return self._long_segment(text)
        found: dict[int, list] = {}
        for end, match in self.automaton.iter(text) if len(self.automaton) else ():
            if end in found:
                found[end].append(match)
            else:
                found[end] = [match]
        best, count, odd = [0.0], [0], [False]
        letters, unknown = self.letters, self.unknown
        for end, letter in enumerate(text):  # as _step(), written out
            top, n, strange = None, 0, False
            if ending := found.get(end):
                if len(ending) > 1:
                    ending.sort(reverse=True)
                for size, score in ending:
                    total = best[end + 1 - size] + score
                    if top is None or total > top:
                        top, n = total, count[end + 1 - size] + 1
            if letter not in letters and (top is None or best[-1] + unknown > top):
                top, strange = best[-1] + unknown, True
                n = count[-1] + (len(letter.encode("utf-8", "surrogatepass")) if self.bytewise else int(not odd[-1]))
            best.append(top)
            count.append(n)
            odd.append(strange)
        return count[-1]

    def _step(self, letter: str, ending: list[tuple[int, float]] | tuple, best: list[float], count: list[int], odd: list[bool], end: int) -> tuple[float, int, bool]:
        """Best score, pieces and whether the last letter is unknown, of the text up to place `end` of the lists; ending: pieces that end there."""
        top, n, strange = None, 0, False
        for size, score in ending if len(ending) < 2 else sorted(ending, reverse=True):
            total = best[end - size] + score
            if top is None or total > top:
                top, n = total, count[end - size] + 1
        if letter not in self.letters and (top is None or best[-1] + self.unknown > top):
            top, strange = best[-1] + self.unknown, True
            n = count[-1] + (len(letter.encode("utf-8", "surrogatepass")) if self.bytewise else int(not odd[-1]))
        return top, n, strange

    def _long_segment(self, text: str) -> int:
        """The same, but of the places before only those that a piece can reach back to are held."""
        matches = iter(self.automaton.iter(text)) if len(self.automaton) else iter(())
        following = next(matches, None)
        best, count, odd, base = [0.0], [0], [False], 0  # of the places from base on
        for end, letter in enumerate(text):
            ending = []
            while following is not None and following[0] == end:
                ending.append(following[1])
                following = next(matches, None)
            top, n, strange = self._step(letter, ending, best, count, odd, end + 1 - base)
            best.append(top)
            count.append(n)
            odd.append(strange)
            if len(best) > HELD + self.longest:
                base += HELD
                del best[:HELD], count[:HELD], odd[:HELD]
        return count[-1]

    def count(self, text: str) -> int:
        """Pieces of a text, with a blank put before it; 0 if it is empty."""
        if not text:
            return 0
        text = BLANK + text.replace(" ", BLANK)
        if not self.bytewise:
            return self.segment(text)  # runs of unknown letters may cross cuts
        total = 0
        for found in _SEGMENT.finditer(text):
            part = found.group()
            n = self.known.get(part)
            if n is None:
                n = self.segment(part)
                if len(part) <= SHORT:
                    if len(self.known) >= REMEMBERED:
                        self.known.clear()
                    self.known[part] = n
            total += n
        return total


def token_counts(docs: DataFrame, pieces: list[tuple[str, float]], bytewise: bool) -> DataFrame:
    """doc_id, n_chars, n_tokens of each row, whole texts.

    Null and empty texts have none; rows that repeat or lack an id are counted as any other; an empty table gives an empty
    result; further columns of docs are not read. A text of any length takes little memory beside itself. The vocabulary is one broadcast of fixed size.
    """
    shared = docs.sparkSession.sparkContext.broadcast((pieces, bytewise))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(*shared.value)
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            n = [counter.count(t.as_py()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pc.utf8_length(texts).cast(pa.int64()), pa.array(n, pa.int64())], ["doc_id", "n_chars", "n_tokens"])
        del counter
        release()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_chars long, n_tokens long")
