"""An external priority queue: a bounded heap in memory, sorted runs on the task's own disk."""

from __future__ import annotations

import heapq
import pickle
import tempfile
from collections.abc import Iterator


class MessageQueue:
    """Messages ordered by label; ``limit`` of them at most are held in memory.

    Beyond that the heap is written as a sorted run to an unnamed temporary file
    (gone with the task, whatever ends it), read back one message at a time.
    """

    def __init__(self, limit: int = 1 << 16):
        self.limit, self.heap, self.runs, self.spilled = limit, [], [], 0

    def send(self, label: tuple, message) -> None:
        """``label`` must tell all messages apart."""
        if len(self.heap) >= self.limit:
            self._spill()
        heapq.heappush(self.heap, (label, message))

    def _spill(self) -> None:
        held = tempfile.TemporaryFile()
        self.heap.sort()
        for entry in self.heap:
            pickle.dump(entry, held, pickle.HIGHEST_PROTOCOL)
        held.seek(0)
        self.spilled += 1
        self.heap = []
        self._advance(held)

    def _advance(self, held) -> None:
        """Puts a run's next message in line, or closes the run."""
        try:
            heapq.heappush(self.runs, (pickle.load(held), self.spilled, id(held), held))
        except EOFError:
            held.close()

    def _least(self):
        a = self.heap[0] if self.heap else None
        b = self.runs[0][0] if self.runs else None
        return a if b is None or (a is not None and a[0] < b[0]) else b

    def __bool__(self) -> bool:
        return bool(self.heap or self.runs)

    def next_label(self) -> tuple:
        return self._least()[0]

    def receive(self) -> tuple:
        """The message with the smallest label, with it."""
        least = self._least()
        if self.heap and least is self.heap[0]:
            return heapq.heappop(self.heap)
        entry, _, _, held = heapq.heappop(self.runs)
        self._advance(held)
        return entry

    def until(self, label: tuple) -> Iterator[tuple]:
        """All messages whose label is below ``label``, smallest first, later ones included."""
        while self and self.next_label() < label:
            yield self.receive()
