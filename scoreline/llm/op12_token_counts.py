"""Token counts by heap-and-linked-list byte-pair merging.

A unit's symbols form a doubly linked list; a heap holds every adjacent pair whose joined
text is a piece, lowest rank first, then leftmost. The top pair is merged if both of
its symbols are still as they were when it was pushed, and its new neighbours are pushed.
The count is the number of symbols at the start minus that of merges: no piece is looked
up afterwards and no identifier is made. A character that is no piece and was not merged
falls back to its bytes.

Pieces have white space only in front, so that units (see ``units``) merge on their own;
each distinct unit is merged once in a worker process, and texts add up their units.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .units import Growing, Memory, Units, spaced

SPACE = "▁"


class PieceMerges:
    """Ranks of a sentencepiece model's pieces, and counts of merged symbols. The model
    must be byte-pair merging with byte fallback, put a space in front of texts and
    change nothing else in them."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        probe = " a  \tﬁé b "
        if model.normalize(probe) != SPACE + probe.replace(" ", SPACE):
            raise ValueError("the model changes texts; their units can't be counted on their own")
        ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        if any(model.is_unused(i) for i in ids) or not any(model.is_byte(i) for i in range(model.get_piece_size())):
            raise ValueError("the model has unused pieces or no byte fallback")
        score = {model.id_to_piece(i): model.get_score(i) for i in ids}
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in score):
            raise ValueError("pieces reach across white space; units can't be counted on their own")
        place = {s: i for i, s in enumerate(sorted(set(score.values()), reverse=True))}
        self.rank = {p: place[s] for p, s in score.items()}
        #: Two characters that follow each other in some piece; others never merge.
        self.inside = {p[i : i + 2] for p in score for i in range(len(p) - 1)}

    def parts(self, text: str) -> list[str]:
        """``text`` cut between characters that no piece has next to each other."""
        inside = self.inside
        cuts = [i for i in range(1, len(text)) if text[i - 1 : i + 1] not in inside]
        return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]

    def count(self, text: str) -> int:
        """Tokens of a text whose spaces are written as U+2581."""
        rank, symbol = self.rank, list(text)
        n = len(symbol)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        find = rank.get
        heap = []
        for i in range(n - 1):
            r = find(symbol[i] + symbol[i + 1])
            if r is not None:
                heap.append((r, i, 2))
        heapify(heap)
        merges = 0
        while heap:
            _, left, size = heappop(heap)
            right = after[left]
            if right >= n or not symbol[left]:
                continue
            joined = symbol[left] + symbol[right]
            if len(joined) != size:
                continue
            symbol[left], symbol[right] = joined, ""
            merges += 1
            next_ = after[left] = after[right]
            if next_ < n:
                before[next_] = left
                r = find(joined + symbol[next_])
                if r is not None:
                    heappush(heap, (r, left, size + len(symbol[next_])))
            previous = before[left]
            if previous >= 0:
                r = find(symbol[previous] + joined)
                if r is not None:
                    heappush(heap, (r, previous, size + len(symbol[previous])))
        # what is no piece stands for its bytes
        return n - merges + sum(len(s.encode()) - 1 for s in symbol if s and s not in rank)


class UnitCounts:
    """Counts of distinct units, kept by slot, and of their distinct parts."""

    def __init__(self, path: str, most: int = 1 << 21):
        self.merges, self.most = PieceMerges(path), most
        self.memory = Memory(self._learn, self._forget, most)

    def _forget(self):
        self.counts, self.known = Growing(np.int32), {}

    def _learn(self, units: list[bytes]):
        parts, known, out = self.merges.parts, self.known, []
        for unit in units:
            total = 0
            for part in parts(unit.decode().replace(" ", SPACE)):
                n = known.get(part)
                if n is None:
                    n = self.merges.count(part)
                    if len(known) < self.most // 2 and len(part) < 64:
                        known[part] = n
                total += n
            out.append(total)
        self.counts.add(np.array(out, np.int32))

    def of(self, column: pa.Array) -> np.ndarray:
        """Tokens of each text of a column; null and empty ones have none."""
        out = [np.zeros(0, np.int64)]
        for _, _, data, offsets in spaced(column):
            units = Units(self.memory, data, offsets)
            out.append(units.totals(self.counts.values))
        return np.concatenate(out)


_KNOWN: dict[str, UnitCounts] = {}


def count_tokens(docs: DataFrame, tokenizer: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes, n_tokens, over_limit (n_tokens >
    ``limit``). ``tokenizer`` is a file of piece merges that all executors have; begin, end
    and other special tokens are not added, and their strings in texts are plain text.

    Null and empty texts have 0 bytes and 0 tokens. Whole texts are counted, however long;
    a text is a row, so one executor core works on it. Repeated rows and null ids stay
    rows of their own; other columns are not read. An empty table has no rows. Nothing is
    shuffled."""
    def run(batches):
        counts = _KNOWN.get(tokenizer) or _KNOWN.setdefault(tokenizer, UnitCounts(tokenizer))
        for batch in batches:
            n = counts.of(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n)], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.octet_length(text_col).cast("long"), F.lit(0)).alias("n_bytes"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
