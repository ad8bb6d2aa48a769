"""A language model as an answerer: calls with retries, one for each question, from the tasks that hold the questions."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame

#: Replies worth another try, and replies that no try will change. Fixed values.
AGAIN, NEVER = (408, 409, 429, 500, 502, 503, 504, 529), (400, 401, 403, 404)

#: Seconds waited at most between two tries.
LONGEST = 30.0


class ModelError(RuntimeError):
    """What a model's service replied instead of an answer. status: of the reply, None for no reply in time."""

    def __init__(self, message: str, status: int | None = None, retry_after: float | None = None):
        super().__init__(message)
        self.status, self.retry_after = status, retry_after


@dataclass(frozen=True)
class Retrying:
    """call(prompt) -> reply, tried up to `tries` times. It waits as long as the service asks for, or else twice as long
    each time and a little more by chance, LONGEST at most. An empty reply is an error."""

    call: Callable[[str], str]
    tries: int = 3
    sleep: Callable[[float], None] = time.sleep

    def __call__(self, prompt: str) -> str:
        for n in range(1, self.tries + 1):
            try:
                reply = (self.call(prompt) or "").strip()
                if reply:
                    return reply
                raise ModelError("the model gave an empty reply")
            except ModelError as e:
                hopeless = e.status in NEVER or e.status is not None and e.status not in AGAIN
                if hopeless or n == self.tries:
                    raise
                self.sleep(min(LONGEST, e.retry_after if e.retry_after is not None else 2 ** (n - 1) + random.random()))
        raise ModelError("no try is allowed")


def prompt(question: str, excerpts: str, mode: str, note: str | None) -> str:
    """What a model reads of a question and its passages."""
    about = f"The excerpts are spread over the documents{note or ''}. Say what they cover, by topic.\n\n" if mode == "overview" else ""
    return f"{about}Excerpts:\n\n{excerpts}\n\nQuestion: {question}"


def answerer(call: Callable[[str], str], tries: int = 3) -> Callable[[DataFrame], DataFrame]:
    """For `Engine`: rows (query_id, question, mode, note, excerpts) -> (query_id, answer, error)."""

    def run(frames) -> Iterator:
        import pandas as pd

        ask = Retrying(call, tries)
        for frame in frames:
            out = []
            for r in frame.itertuples():
                try:
                    out.append((r.query_id, ask(prompt(r.question, r.excerpts, r.mode, r.note)), None))
                except ModelError as e:
                    out.append((r.query_id, None, str(e)))
            yield pd.DataFrame(out, columns=["query_id", "answer", "error"])

    return lambda given: given.mapInPandas(run, "query_id long, answer string, error string")
