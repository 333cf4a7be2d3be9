"""A live recording: chunks of samples in, ticks out as soon as their audio is there. A decoder that falls behind ends the session; nothing is
dropped to catch up."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

from ..config import Stream
from ..functions.decoder import Decoded, Window
from ..functions.live import RATE, Buffer
from .engine import Engine

BACKLOG_SEC, SESSION_SEC = 30.0, 3600.0


class Behind(RuntimeError):
    """More audio waits than a session may hold back."""


class Session:
    """hear(samples, window, prompt) decodes a window's samples. emit gets each tick's row, on_finish the validation."""

    def __init__(self, hear: Callable[[np.ndarray, Window, str], Decoded], stream: Stream | None = None, *, rate: int = RATE, backlog: float = BACKLOG_SEC, longest: float = SESSION_SEC, emit: Callable[[dict], None] | None = None, on_finish: Callable[[dict], None] | None = None, **engine):
        self.stream, self.backlog, self.longest, self.emit, self.on_finish = stream or Stream(), backlog, longest, emit or (lambda row: None), on_finish or (lambda v: None)
        self.buffer = Buffer(self.stream.context_sec + self.stream.step_sec + backlog, rate)
        self.engine = Engine(lambda w, prompt: hear(self.buffer.read(w.start, w.end), w, prompt), self.stream, **engine)
        self.ticks = 0

    @property
    def heard_sec(self) -> float:
        return self.buffer.end / self.buffer.rate

    def feed(self, samples: np.ndarray, sequence: int) -> None:
        self.buffer.append(samples, sequence)
        if self.heard_sec > self.longest:
            raise ValueError(f"a session holds {self.longest} s at most")
        if self.heard_sec - self.ticks * self.stream.step_sec > self.backlog:
            self.engine.fail(Behind(f"{self.backlog} s of audio wait"))
            raise Behind(f"{self.backlog} s of audio wait")

    def _window(self, tick: float) -> Window:
        return Window(tick, max(0.0, tick - self.stream.context_sec), tick)

    def work(self) -> Iterator[dict]:
        """The ticks whose audio is there. The tick that ends with the audio waits, as it may be the recording's last."""
        while (self.ticks + 1) * self.stream.step_sec < self.heard_sec - 1e-9:
            self.ticks += 1
            row = self.engine.tick(self._window(self.ticks * self.stream.step_sec))
            self.emit(row)
            yield row

    def finish(self) -> dict:
        """No more audio comes: the last, maybe short tick, and the run's validation."""
        for _ in self.work():
            pass
        if self.heard_sec > 0:
            self.emit(self.engine.tick(self._window(self.heard_sec), final=True))
        v = self.engine.finish(self.ticks + (self.heard_sec > 0))
        self.on_finish(v)
        return v
