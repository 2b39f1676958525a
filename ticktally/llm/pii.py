"""Personal information in free text: a semi-Markov conditional random field over whole spans.

A segmentation of a text scores the sum of its segments' scores and of the transitions between
neighbours; what lies outside of segments scores 0.  Every span of ``pii_spans.candidates`` is a
possible segment, with features of the whole span.  The weights are those of greatest likelihood
(``pii_train``: forward and backward sums over all segmentations) on generated labelled sentences;
they start from 0, and nothing of the corpus is used.  Viterbi over segments (bounded-entity
dynamic programming, as no segment is longer than its type's bound) chooses boundaries and types
jointly: a name inside an address, or the digits of an identity number inside a phone number,
compete as wholes.

Every text is read from end to end by one pass over all of its tokens; there is no filter before it.
A segment has at most as many tokens as its type's bound in ``pii_spans``; longer ones are not found.

Cases: null and empty texts have no findings; a finding repeated in a text is reported once;
very long texts are read whole; the text is otherwise unchanged by ``redact``; ties between
segmentations go to the earlier one.
"""

from __future__ import annotations

import bisect
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .pii_spans import KINDS, OUTSIDE, Lexicon, Span, Tokens, candidates, tokens

__all__ = ["KINDS", "Lexicon", "Span", "decode", "find", "redact"]

LONG, MARGIN = 1_000_000, 5_000  # characters of a stretch of a very long text, and of its overlap to either side
REACH = 6  # characters between two segments that a transition may span
_SPACES = re.compile(r"[^\S\n]*\n\s*|\s+")


def transition(text: str, a: Span, b: Span) -> str:
    """Name of the transition's feature: the two types and what stands between."""
    between = _SPACES.sub(lambda m: "|" if "\n" in m[0] else "_", text[a.end : b.start]).lower()
    return f"{a.kind}>{b.kind}:{between}"


def viterbi(spans: list[Span], text: str, weights: dict[str, float]) -> list[Span]:
    """The best set of spans that don't overlap; ``spans`` in order of their starts, linear in their number."""
    best, back = [0.0] * len(spans), [-1] * len(spans)
    open_: list[tuple[int, int]] = []  # (end, span) of spans that are not yet behind
    top, at = 0.0, -1  # the best segmentation of what is behind
    recent: list[tuple[int, int]] = []
    for i, s in enumerate(spans):
        while open_ and open_[0][0] <= s.start:
            end, j = heapq.heappop(open_)
            recent.append((end, j))
            if best[j] > top + 1e-12:
                top, at = best[j], j
        value, previous = top, at
        if recent:
            recent = [x for x in recent if x[0] >= s.start - REACH]
            for _, j in recent:
                w = weights.get(transition(text, spans[j], s))
                if w is not None and best[j] + w > value:
                    value, previous = best[j] + w, j
        best[i], back[i] = value + s.score, previous
        heapq.heappush(open_, (s.end, i))
    if not spans:
        return []
    i = int(np.argmax(best))
    if best[i] <= 0:
        return []
    out = []
    while i >= 0:
        out.append(spans[i])
        i = back[i]
    return out[::-1]


def segments(t: Tokens, weights: dict[str, float]) -> list[Span]:
    """The best segmentation of a batch of texts laid end to end."""
    spans = candidates(t)
    get = weights.get
    for s in spans:
        s.score = sum([get(f, 0.0) for f in s.features])
    return viterbi(spans, t.text, weights)


def decode(texts: list[str | None], lex: Lexicon, weights: dict[str, float]) -> list[list[Span]]:
    """Segments of every text."""
    out: list[list[Span]] = [[] for _ in texts]
    batch: list[int] = []
    size = 0

    def flush() -> None:
        t, offsets = tokens([texts[i] for i in batch], lex)
        starts = offsets.tolist()
        for s in segments(t, weights):
            k = bisect.bisect_right(starts, s.start) - 1
            s.start, s.end = s.start - starts[k], s.end - starts[k]
            out[batch[k]].append(s)

    for i, text in enumerate(texts):
        if text and len(text) > LONG:
            out[i] = _in_stretches(text, lex, weights)
        elif text:
            if batch and size + len(text) > OUTSIDE:
                flush()
                batch, size = [], 0
            batch.append(i)
            size += len(text)
    if batch:
        flush()
    return out


def _in_stretches(text: str, lex: Lexicon, weights: dict[str, float]) -> list[Span]:
    """Segments of a very long text, read in stretches that overlap by twice ``MARGIN`` characters, so that memory
    is bounded.  A segment is taken from the stretch in which it starts at least ``MARGIN`` before the end."""
    out: list[Span] = []
    at, begin = 0, 0  # of the stretch, and from where on its segments count
    while True:
        end = min(len(text), at + LONG)
        limit = len(text) if end == len(text) else end - MARGIN
        t, _ = tokens([text[at:end]], lex)
        for s in segments(t, weights):
            s.start, s.end = s.start + at, s.end + at
            if begin <= s.start < limit and (not out or s.start >= out[-1].end):
                out.append(s)
        if end == len(text):
            return out
        begin, at = limit, limit - MARGIN


# --- tables ------------------------------------------------------------------------------------


def find(docs: DataFrame, key: str, text: str, lex: Lexicon, weights: dict[str, float]) -> DataFrame:
    """(key, kind, found): one row per distinct finding of a text."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            schema = pa.schema([(key, b.schema.field(0).type), ("kind", pa.string()), ("found", pa.string())])
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                keys, texts = part.column(0), part.column(1).to_pylist()
                rows = [(i, *x) for i, segs in enumerate(decode(texts, lex, weights)) for x in sorted({(s.kind, texts[i][s.start : s.end]) for s in segs})]
                if rows:
                    own, kinds, found = zip(*rows)
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(own)), pa.array(kinds), pa.array(found)], schema=schema)

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, kind string, found string")


def redact(docs: DataFrame, key: str, text: str, lex: Lexicon, weights: dict[str, float]) -> DataFrame:
    """(key, text, replaced): findings replaced by ``[EMAIL]``, ``[PHONE]`` and so on, all else unchanged."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                texts, out, n = part.column(1).to_pylist(), [], []
                for t, segs in zip(texts, decode(texts, lex, weights)):
                    last, pieces = 0, []
                    for s in segs:
                        pieces += [t[last : s.start], f"[{s.kind.upper()}]"]
                        last = s.end
                    out.append(t if t is None else "".join(pieces) + t[last:])
                    n.append(len(segs))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.string()), pa.array(n, pa.int32())], names=[key, text, "replaced"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, `{text}` string, replaced int")
