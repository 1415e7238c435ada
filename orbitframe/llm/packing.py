"""Order-preserving packing of token streams by dynamic programming.

Each task tokenises its documents in order and cuts the stream into windows of
at most ``window`` tokens. Cuts fall on document ends, sentence ends and, where
sentences are long, on a grid inside them. The cost of a window is its padding,
the cost of a cut its truncation penalty; the cheapest chain of windows comes
from one pass in which a monotone queue keeps the best predecessor of the last
``window`` tokens. No data moves between tasks.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitframe.llm.common import small_batches

#: Tokens after which a task cuts what it holds; bounds its memory, not its result's completeness.
BLOCK_TOKENS = 1 << 19
#: Sequence numbers a task may use.
TASK_SEQUENCES = 1 << 36
#: Longest text that is tokenised in one call.
LONG_TEXT = 1 << 18


@dataclass(frozen=True)
class PackingCosts:
    """In tokens of padding: what a cut at a sentence end, or inside a sentence, and one more sequence are worth."""

    sentence_cut: int = 4
    sequence: int = 4
    hard_cut: int = 24
    grid: int = 64


class DocumentTokenizer:
    """Ids of byte-level BPE texts, as the ``tokenizers`` library gives them.

    ``path`` is the library's file. ``ranks_path`` may name the same vocabulary
    as ranks: texts of plain scripts without control strings then take a faster
    route with equal ids. Long texts are cut where the pre-tokeniser must cut.
    """

    _rare = re.compile("[^\\x00-ɏ]|<\\|")
    _seam = re.compile(r"(?<=\S) (?=\S)")

    def __init__(self, path: str, ranks_path: str | None = None, pattern: str | None = None):
        self._path, self._loaded, self._fast, self._ranks = path, None, None, None
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as lines:
                self._ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self._fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=self._ranks, special_tokens={})

    @property
    def _full(self):
        """The library's own tokeniser, loaded when a text needs it."""
        if self._loaded is None:
            from tokenizers import Tokenizer

            self._loaded = Tokenizer.from_file(self._path)
        return self._loaded

    def ids(self, text: str) -> np.ndarray:
        if len(text) <= LONG_TEXT:
            return self._short(text)
        return np.concatenate([self._short(part) for part in self._parts(text)])

    def _parts(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > LONG_TEXT:
            seam = self._seam.search(text, at + LONG_TEXT)
            if not seam:
                break
            yield text[at : seam.start()]
            at = seam.start()
        yield text[at:]

    def _short(self, text: str) -> np.ndarray:
        if self._fast is None or len(text) > 2 * LONG_TEXT or self._rare.search(text):
            return np.array(self._full.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.frombuffer(array("I", self._fast.encode_ordinary(text)), np.uint32)

    def sentence_ends(self) -> np.ndarray:
        """By id: whether the token closes a sentence or a line."""
        if self._ranks is not None:
            closing = [i for token, i in self._ranks.items() if token.endswith((b".", b"!", b"?")) or b"\n" in token]
        else:
            closing = [i for token, i in self._full.get_vocab().items() if token.endswith((".", "!", "?")) or "\u010a" in token]
        out = np.zeros(1 << 17, bool)  # beyond any id of a byte-level vocabulary
        out[closing] = True
        return out


@lru_cache(maxsize=2)
def _tokenizer(path: str, ranks_path: str | None, pattern: str | None) -> tuple[DocumentTokenizer, np.ndarray]:
    """One per worker process and vocabulary."""
    made = DocumentTokenizer(path, ranks_path, pattern)
    closes = made.sentence_ends()
    made._ranks = None
    return made, closes


def candidate_cuts(doc_ends: np.ndarray, sentence_ends: np.ndarray, total: int, window: int, costs: PackingCosts) -> tuple[np.ndarray, np.ndarray]:
    """Cut positions in rising order, from 0 to ``total``, and the penalty of each."""
    firm = np.union1d(np.union1d(sentence_ends, doc_ends), [0, total])
    gaps = np.diff(firm)
    grid = min(costs.grid, max(1, window // 2))  # neighbours may not be further apart than a window
    inner = [np.arange(a + grid, a + gap, grid) for a, gap in zip(firm[:-1][gaps > 2 * grid], gaps[gaps > 2 * grid], strict=True)]
    tail = np.arange(max(0, total - window), total)  # lets the rest fall into unpadded powers of two
    points = np.unique(np.concatenate([firm, tail, *inner]))
    penalty = np.full(len(points), costs.hard_cut)
    penalty[np.searchsorted(points, sentence_ends)] = costs.sentence_cut
    penalty[np.searchsorted(points, doc_ends)] = 0
    penalty[[0, -1]] = 0
    return points, penalty


def best_cuts(points: np.ndarray, penalty: np.ndarray, window: int, sequence: int = 0) -> np.ndarray:
    """The chain of cuts of least padding plus penalties, ``sequence`` for each window.

    A window of ``n`` tokens pads ``window - n``, or nothing if ``n`` is a power
    of two. The first kind needs ``min(cost[i] + points[i])`` over the last
    ``window`` tokens: a monotone queue. The second looks up the few cuts that
    lie a power of two before. Neighbouring points are at most ``window`` apart.
    """
    m = len(points)
    powers = [1 << k for k in range(window.bit_length()) if 1 << k < window]
    partner: dict[int, list[int]] = {}
    for size in powers:
        at = np.searchsorted(points, points - size)
        hit = np.flatnonzero(points[np.minimum(at, m - 1)] == points - size)
        for j, i in zip(hit.tolist(), at[hit].tolist(), strict=True):
            partner.setdefault(j, []).append(i)
    where, extra = points.tolist(), (penalty + sequence).tolist()
    cost, back = [0] * m, [0] * m
    queue: deque[int] = deque([0])
    for j in range(1, m):
        here = where[j]
        while where[queue[0]] < here - window:
            queue.popleft()
        i = queue[0]
        best = cost[i] + where[i] + window - here
        for k in partner.get(j, ()):
            if cost[k] < best:
                best, i = cost[k], k
        cost[j], back[j] = best + extra[j], i
        level = cost[j] + here
        while queue and cost[queue[-1]] + where[queue[-1]] >= level:
            queue.pop()
        queue.append(j)
    chain = [m - 1]
    while chain[-1]:
        chain.append(back[chain[-1]])
    return points[chain[::-1]]


def _pieces(ids: np.ndarray, starts: np.ndarray, cuts: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """``(document, window, from, to)`` in stream positions, in order."""
    edges = np.union1d(starts[:-1], cuts[:-1])
    ends = np.append(edges[1:], len(ids))
    docs = np.searchsorted(starts, edges, "right") - 1
    windows = np.searchsorted(cuts, edges, "right") - 1
    return zip(docs.tolist(), windows.tolist(), edges.tolist(), ends.tolist(), strict=True)


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    ranks_path: str | None = None,
    pattern: str | None = None,
    window: int = 1024,
    end_id: int = 0,
    costs: PackingCosts = PackingCosts(),
    with_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces of documents and their places in sequences of at most ``window`` tokens.

    Returns ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    sequence_length`` and, if asked for, ``ids``. A document is its token ids
    and ``end_id``; each id lies in exactly one piece; sequences follow the
    order of rows in their task and are filled without gaps from offset 0.

    Null and empty texts are the ``end_id`` alone; texts of any length are cut
    like others; equal rows are packed once each; a null id stays null; an empty
    table gives no rows; other columns are ignored. Files at the given paths
    must be readable on executors. ``sequence_id`` depends on the task, so it is
    unique, not gapless.
    """
    small_batches(docs.sparkSession)
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(picked.dtypes)["doc_id"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, closes = _tokenizer(tokenizer_path, ranks_path, pattern)
        number = TaskContext.get().partitionId() * TASK_SEQUENCES
        keys: list = []
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, size
            lengths = np.array([len(x) for x in held])
            starts = np.concatenate([[0], np.cumsum(lengths)])
            ids = np.concatenate(held)
            ends = np.flatnonzero(closes[ids]) + 1
            points, penalty = candidate_cuts(starts[1:], ends, len(ids), window, costs)
            cuts = best_cuts(points, penalty, window, costs.sequence)
            out: dict[str, list] = {n: [] for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length")}
            tokens = []
            for d, w, a, b in _pieces(ids, starts, cuts):
                values = (keys[d], a - starts[d], b - a, zlib.crc32(ids[a:b]), lengths[d], number + w, a - cuts[w], cuts[w + 1] - cuts[w])
                for name, value in zip(out, values, strict=True):
                    out[name].append(value)
                if with_ids:
                    tokens.append(ids[a:b].astype(np.int32))
            number += len(cuts) - 1
            columns = [pa.array(out["doc_id"], type=key_type), *(pa.array(np.array(out[n], np.int64)) for n in list(out)[1:])]
            if with_ids:
                columns.append(pa.array(tokens, pa.list_(pa.int32())))
            keys.clear()
            held.clear()
            size = 0
            return pa.RecordBatch.from_arrays(columns, [*out, *(["ids"] if with_ids else [])])

        key_type = pa.int64()
        for batch in batches:
            key_type = batch.schema.field(0).type
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(tokenizer.ids(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                keys.append(key)
                held.append(ids)
                size += len(ids)
                if size >= BLOCK_TOKENS:
                    yield flush()
        if held:
            yield flush()

    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long"
    return picked.mapInArrow(pack, schema + (", ids array<int>" if with_ids else ""))
