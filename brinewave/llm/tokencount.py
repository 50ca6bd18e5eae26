"""Token counts of a unigram tokenizer, without tokens.

The pieces and scores of a vocabulary file go into an Aho-Corasick automaton,
which lists every piece that ends at every place of a text. Dynamic programming
carries the best score up to each place and the number of pieces that it takes.
The rules are those of a unigram tokenizer with byte fallback: spaces are U+2581
and one stands before the text; the best sum of scores wins, and of equal sums
the one whose last piece starts first; a character that is no piece of its own
can be taken as unknown, ten below the lowest score, and counts as its bytes.

No piece of the file has another character before U+2581, so the best path
always breaks before a run of it, and at white space that is in no piece. Counts
of the parts between are kept in a bounded memory and add up exactly.

Null and empty texts count 0. Equal texts get equal rows. An empty table gives
an empty result. Only doc_id and text are looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
BELOW = 10.0


def vocabulary(path: str) -> dict[str, float]:
    """The normal pieces of a sentencepiece file and their scores."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    special = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)
    return {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size()) if not special(i)}


class Counter(dict):
    """Part of a text -> (pieces, score); forgets all once there are many parts."""

    def __init__(self, pieces: dict[str, float], most: int = 300_000):
        self.most = most
        self.machine = ahocorasick.Automaton()
        for p, s in pieces.items():
            self.machine.add_word(p, (len(p), s))
        self.machine.make_automaton()
        self.single = {p for p in pieces if len(p) == 1}
        self.unknown = min(pieces.values(), default=0.0) - BELOW
        inner = any(SPACE in p.lstrip(SPACE) for p in pieces)
        # white space that no piece holds is unknown wherever it stands: a part of its own
        held = set("".join(pieces))
        self.alone = "".join(c for c in "\n\t\r" if c not in held)
        rest = f"[^{SPACE}{self.alone}]"
        self.parts = re.compile(r"(?s).+" if inner else f"{SPACE}+{rest}*|{rest}+" + (f"|[{self.alone}]" if self.alone else ""))

    def __missing__(self, part: str) -> tuple[int, float]:
        if len(self) >= self.most:
            self.clear()
        out = self[part] = self.best(part)
        return out

    def best(self, part: str) -> tuple[int, float]:
        """Pieces and score of the best path."""
        n = len(part)
        matches = chain(self.machine.iter(part), [(n, None)])
        score, count = [0.0] * (n + 1), [0] * (n + 1)
        end, found = next(matches)
        for e in range(1, n + 1):
            best, first, pieces = None, n + 1, 0
            while end == e - 1:
                size, s = found
                end, found = next(matches)
                total = score[e - size] + s
                if best is None or total > best or (total == best and e - size < first):
                    best, first, pieces = total, e - size, count[e - size] + 1
            if part[e - 1] not in self.single:
                total = score[e - 1] + self.unknown
                if best is None or total > best:
                    best, pieces = total, count[e - 1] + len(part[e - 1].encode("utf-8", "surrogatepass"))
            score[e], count[e] = best, pieces
        return count[n], score[n]

    def count(self, text: str) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        found = [self[p] for p in self.parts.findall(SPACE + text.replace(" ", SPACE))]
        return sum(n for n, _ in found), float(sum(s for _, s in found))


def counts(df: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the best path's score of every row's whole text."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value)
        for batch in batches:
            out = [counter.count(t.as_py() or "") for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([n for n, _ in out], pa.int64()), pa.array([s for _, s in out], pa.float64())], ["doc_id", "n_tokens", "score"])

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, score double")
