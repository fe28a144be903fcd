"""Outside models behind narrow protocols: a page detector, a character detector and a judge, each with a recorded
backend for tests. Calls run in `mapInArrow`, one client for each task; results are to be written once, as models
need not answer alike twice."""

from __future__ import annotations

import base64
import json
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame

from .schema import REPLY

#: The judge's instruction asks for exactly the fields that `functions.text.verdict` reads.
PROMPT = "Look at the image of one printed character. Answer with a JSON object only: single_character, recognizable and has_noise as booleans, character and comment as strings."


class Recorded:
    """Answers from a table of recorded replies; a missing one is an error of that call only."""

    def __init__(self, replies: dict[str, str]):
        self.replies = replies

    def __call__(self, key: str, png: bytes) -> str:
        if key not in self.replies:
            raise KeyError(f"no recorded reply for {key}")
        return self.replies[key]


class HttpDetector:
    """Posts an image to `/ocr/predict` of a server; `health` and `info` ask it about itself."""

    def __init__(self, url: str, timeout: float = 60.0, probe_timeout: float = 5.0):
        self.url, self.timeout, self.probe_timeout = url.rstrip("/"), timeout, probe_timeout

    def _session(self):
        import requests

        if not hasattr(self, "_s"):
            self._s = requests.Session()
        return self._s

    def health(self) -> bool:
        try:
            return self._session().get(f"{self.url}/health", timeout=self.probe_timeout).status_code == 200
        except OSError:
            return False

    def info(self) -> dict:
        return self._session().get(f"{self.url}/", timeout=self.probe_timeout).json()

    def __call__(self, key: str, png: bytes) -> str:
        answer = self._session().post(f"{self.url}/ocr/predict", files={"file": (key, png, "image/png")}, timeout=self.timeout)
        answer.raise_for_status()
        return answer.text

    def single(self, key: str, png: bytes) -> tuple[str, float]:
        """Text and confidence of the first region; empty and 0 without one."""
        regions = json.loads(self(key, png)).get("text_regions") or [{}]
        return regions[0].get("text", ""), float(regions[0].get("confidence", 0.0))


class HttpJudge:
    """A chat-completions endpoint that is sent the image as a data URL."""

    def __init__(self, url: str, key: str, model: str, temperature: float = 0.0, max_tokens: int = 256, timeout: float = 60.0):
        if not key:
            raise ValueError("the judge needs an API key")
        self.url, self.key, self.model, self.temperature, self.max_tokens, self.timeout = url, key, model, temperature, max_tokens, timeout

    def __call__(self, key: str, png: bytes) -> str:
        import requests

        image = {"type": "image_url", "image_url": {"url": "data:image/png;base64," + base64.b64encode(png).decode()}}
        body = {"model": self.model, "temperature": self.temperature, "max_tokens": self.max_tokens, "messages": [{"role": "user", "content": [image, {"type": "text", "text": PROMPT}]}]}
        answer = requests.post(self.url, json=body, headers={"Authorization": f"Bearer {self.key}"}, timeout=self.timeout)
        answer.raise_for_status()
        return answer.json()["choices"][0]["message"]["content"]


def _refused(error: Exception) -> bool:
    """An answer that asking again will not change: the request itself is at fault, not the line or the load."""
    status = getattr(getattr(error, "response", None), "status_code", None)
    return status is not None and 400 <= status < 500 and status not in (408, 425, 429)


def patient(call: Callable[[str, bytes], str], retries: int = 3, pause: float = 0.5, most: float = 8.0) -> Callable[[str, bytes], tuple[str | None, float, str | None]]:
    """(reply, seconds, error) of a call, tried again with growing pauses on input and output errors."""

    def run(key: str, png: bytes):
        began, wait = time.perf_counter(), pause
        for attempt in range(retries + 1):
            try:
                return call(key, png), time.perf_counter() - began, None
            except (OSError, TimeoutError) as e:
                if attempt == retries or _refused(e):
                    return None, time.perf_counter() - began, str(e)
                time.sleep(wait)
                wait = min(most, 2 * wait)
            except Exception as e:  # one bad row is a row, not the end of the batch
                return None, time.perf_counter() - began, str(e)

    return run


def ask(rows: DataFrame, call: Callable[[str, bytes], str], key: str = "key", image: str = "png", workers: int = 4, retries: int = 3) -> DataFrame:
    """`key` with raw, response_time and error of a call for each row. At most `workers` calls run in a task at once,
    so partitions times workers bound the load on the service."""

    def run(batches):
        with ThreadPoolExecutor(workers) as pool:
            for batch in batches:
                keys, images = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                found = list(pool.map(patient(call, retries), keys, images))
                raw, seconds, error = zip(*found, strict=True) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.string()), pa.array(seconds, pa.float64()), pa.array(error, pa.string())], names=[key, "raw", "response_time", "error"])

    return rows.select(key, image).mapInArrow(run, f"{key} string, {REPLY}")
