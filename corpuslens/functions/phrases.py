"""Counts of many phrases in one pass over each text.

The phrases of all groups form one automaton over bytes: a trie whose missing edges lead to the
longest suffix that is a prefix of some phrase, as arrays of next states. Python steps over bytes
would be slow, so a batch of texts, which Arrow holds as one run of bytes, is cut into lanes that
take each step together. A state depends on no more bytes than the longest phrase has, so every
lane starts that much earlier; occurrences that began before the lane or cross texts do not count.
The cost of a byte does not depend on the number of phrases.
"""

from collections import deque
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Lanes that step together, and bytes that are cut into lanes at a time.
LANES, BLOCK = 4096, 4 << 20
#: States times byte classes that are sent with the function itself; a larger table is broadcast.
SMALL = 1 << 18


class Automaton:
    """Next states by state and byte class, and the phrases that end in a state.

    States are numbered by whether a phrase ends in them, so that one comparison finds those.
    """

    def __init__(self, phrases: Sequence[bytes]):
        if any(not p for p in phrases):
            raise ValueError("an empty phrase cannot be counted")
        self.sizes = np.array([len(p) for p in phrases], dtype=np.int64)
        self.longest = int(self.sizes.max(initial=1))
        used = sorted({b for p in phrases for b in p})
        self.classes = np.zeros(256, dtype=np.int32)
        self.classes[used] = np.arange(1, len(used) + 1)
        width = len(used) + 1
        trie: list[dict[int, int]] = [{}]
        ends: list[list[int]] = [[]]
        for k, p in enumerate(phrases):
            at = 0
            for c in self.classes[np.frombuffer(p, dtype=np.uint8)].tolist():
                if c not in trie[at]:
                    trie[at][c] = len(trie)
                    trie.append({})
                    ends.append([])
                at = trie[at][c]
            ends[at].append(k)
        step = np.zeros((len(trie), width), dtype=np.int32)
        suffix = np.zeros(len(trie), dtype=np.int32)
        queue = deque([0])
        while queue:
            at = queue.popleft()
            if at:
                step[at] = step[suffix[at]]
                ends[at] = ends[at] + ends[suffix[at]]
            for c, to in trie[at].items():
                suffix[to] = step[suffix[at], c] if at else 0
                queue.append(to)
            for c, to in trie[at].items():
                step[at, c] = to
        # States without ends first, and each state as the place of its row.
        order = np.argsort([len(e) > 0 for e in ends], kind="stable")
        number = np.empty(len(order), dtype=np.int32)
        number[order] = np.arange(len(order))
        self.step = (number[step[order]] * width).astype(np.int32).ravel()
        self.width = width
        self.final = int(sum(not e for e in ends)) * width
        some = [ends[i] for i in order[self.final // width :]]
        self.first = np.cumsum([0] + [len(e) for e in some])
        self.ends = np.array([k for e in some for k in e], dtype=np.int64)
        # Only a phrase that ends as it begins can overlap itself.
        self.bordered = np.array([any(p[n:] == p[:-n] for n in range(1, len(p))) for p in phrases], dtype=bool)

    def find(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place after, phrase) of every occurrence in the bytes, by place."""
        places, states = [], []
        warm = self.longest - 1
        for lo in range(0, len(data), BLOCK):
            n = min(BLOCK, len(data) - lo)
            run = -(-n // min(LANES, max(1, n // (4 * self.longest))))
            lanes = -(-n // run)
            # Row t has the bytes at step t of all lanes; lanes overlap by the warm-up.
            at = lo + np.arange(lanes) * run
            padded = np.zeros(warm + lanes * run, dtype=np.int32)
            from_ = max(0, lo - warm)
            own = self.classes[data[from_ : lo + n]]
            padded[warm - (lo - from_) : warm - (lo - from_) + len(own)] = own
            rows = np.lib.stride_tricks.sliding_window_view(padded, warm + run)[::run].T
            state = np.zeros(lanes, dtype=np.int32)
            for t in range(warm + run):
                state = self.step[state + rows[t]]
                if t >= warm:
                    hit = state >= self.final
                    if hit.any():
                        k = np.flatnonzero(hit)
                        places.append(at[k] + (t - warm + 1))
                        states.append(state[k])
        if not places:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        place, state = np.concatenate(places), (np.concatenate(states) - self.final) // self.width
        inside = place <= len(data)
        place, state = place[inside], state[inside]
        n = self.first[state + 1] - self.first[state]
        phrase = self.ends[np.repeat(self.first[state] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        place = np.repeat(place, n)
        order = np.argsort(place, kind="stable")
        return place[order], phrase[order]

    def count(self, data: np.ndarray, offsets: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
        """Occurrences per text and group; those of one phrase that overlap count as str.count does."""
        place, phrase = self.find(data[offsets[0] : offsets[-1]])
        place = place + offsets[0]
        text = np.searchsorted(offsets, place, side="left") - 1
        own = place - self.sizes[phrase] >= offsets[text]
        place, phrase, text = place[own], phrase[own], text[own]
        keep = np.ones(len(place), dtype=bool)
        last: dict[tuple[int, int], int] = {}
        for i in np.flatnonzero(self.bordered[phrase]).tolist():
            key = (int(text[i]), int(phrase[i]))
            if place[i] - self.sizes[phrase[i]] < last.get(key, 0):
                keep[i] = False
            else:
                last[key] = int(place[i])
        cell = text[keep] * groups + group[phrase[keep]]
        return np.bincount(cell, minlength=(len(offsets) - 1) * groups).reshape(-1, groups)


def phrase_counts(text: Column, *groups: Iterable[str]) -> Column:
    """Array with an entry per group: the non-overlapping occurrences of each phrase in the lower-cased text, summed.

    Phrases of a group that overlap each other all count, and a phrase listed twice counts twice. Null
    texts have none.
    """
    lists = [list(g) for g in groups]
    automaton = Automaton([p.encode() for g in lists for p in g])
    group = np.repeat(np.arange(len(lists)), [len(g) for g in lists])
    sent: Automaton | Broadcast = automaton
    session = SparkSession.getActiveSession()
    if len(automaton.step) > SMALL and session is not None:
        sent = session.sparkContext.broadcast(automaton.__dict__)
    n = len(lists)

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def counts(texts: pa.Array) -> pa.Array:
        found = sent
        if isinstance(sent, Broadcast):
            found = Automaton.__new__(Automaton)
            found.__dict__ = sent.value
        if not len(texts):
            return pa.array([], pa.list_(pa.int64()))
        whole = texts.cast(pa.large_string()) if texts.type != pa.large_string() else texts
        offsets = np.frombuffer(whole.buffers()[1], dtype=np.int64)[whole.offset : whole.offset + len(whole) + 1]
        data = np.frombuffer(whole.buffers()[2] or b"", dtype=np.uint8)
        per = found.count(data, offsets, group, n)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(per) * n + 1, n), pa.int32()), pa.array(per.ravel()))

    return counts(F.coalesce(F.lower(text), F.lit("")))
