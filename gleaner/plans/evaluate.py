"""Language-model calls as an operator: an injected client, retries, and a status instead of an exception."""

from __future__ import annotations

import base64
import http.client
import json
import time
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.fixed import CHAT_PATH, GENERATE_PATH, MODEL_PATH, MODELS_PATH


class Client(Protocol):
    """Anything that answers a prompt; it is sent to the workers, so it must be picklable."""

    def generate(self, prompt: str, system: str | None = None, images: list[str] | None = None) -> str: ...


@dataclass
class StubClient:
    """A deterministic stand-in: the grade follows from the prompt's length."""

    fail_on: str = ""

    def generate(self, prompt: str, system: str | None = None, images: list[str] | None = None) -> str:
        if self.fail_on and self.fail_on in prompt:
            raise OSError("refused")
        return f"Recommended Grade: {('PASS', 'MERIT', 'REFERRAL')[len(prompt) % 3]}"


def said(part: dict, field: str) -> str:
    """The text of an answer or of a part of one: a field, or the content of a message in it."""
    value = part.get(field) or ""
    return value.get("content") or "" if isinstance(value, dict) else value


@dataclass
class HttpClient:
    """A client of a server that takes {model, prompt, stream, options} and answers {response}, at once or line by line."""

    url: str
    model: str
    timeout: float = 120
    retries: int = 3
    delay: float = 2.0
    temperature: float = 0.3
    max_tokens: int = 1024

    def _open(self, path: str, body: dict) -> http.client.HTTPResponse:
        request = urllib.request.Request(f"{self.url}{path}", json.dumps(body).encode(), {"Content-Type": "application/json"})
        return urllib.request.urlopen(request, timeout=self.timeout)

    def _whole(self, path: str, body: dict) -> dict:
        """An answer given at once, however many lines it has; one that is no object is an error that may pass."""
        with self._open(path, body) as answer:
            data = answer.read()
        try:
            found = json.loads(data)
        except ValueError as error:
            raise OSError(f"no JSON in the answer: {data[:200]!r}") from error
        if not isinstance(found, dict):
            raise OSError(f"no object in the answer: {data[:200]!r}")
        return found

    def _tried(self, path: str, body: dict, field: str) -> str:
        for turn in range(self.retries):
            try:
                found = self._whole(path, body)
                if "error" in found:
                    raise OSError(str(found["error"]))
                return said(found, field)
            except OSError:
                if turn + 1 == self.retries:
                    raise
                time.sleep(self.delay)
        raise ValueError("retries must be positive")

    def stream(self, path: str, body: dict, field: str = "response") -> Iterator[str]:
        """The parts of an answer as they come, an object a line, until one is marked done; other lines are passed over."""
        with self._open(path, body | {"stream": True}) as answer:
            for line in answer:
                try:
                    part = json.loads(line)
                except ValueError:
                    continue
                if not isinstance(part, dict):
                    continue
                yield said(part, field)
                if part.get("done"):
                    return

    def generate(self, prompt: str, system: str | None = None, images: list[str] | None = None) -> str:
        body = {"model": self.model, "prompt": prompt, "stream": False, "options": {"temperature": self.temperature, "num_predict": self.max_tokens}}
        body |= {k: v for k, v in (("system", system), ("images", images)) if v}
        return self._tried(GENERATE_PATH, body, "response")

    def chat(self, messages: list[dict[str, str]]) -> str:
        return self._tried(CHAT_PATH, {"model": self.model, "messages": messages, "stream": False}, "message")

    def look(self, prompt: str, image: bytes) -> str:
        """An answer about an image."""
        return self.generate(prompt, images=[base64.b64encode(image).decode()])

    def info(self) -> dict:
        """What the server says of the model; empty if it says nothing."""
        try:
            return self._whole(MODEL_PATH, {"name": self.model})
        except OSError:
            return {}

    def available(self) -> bool:
        """Whether the server answers and has the model (its name up to a colon is enough)."""
        try:
            with urllib.request.urlopen(f"{self.url}{MODELS_PATH}", timeout=5) as answer:
                names = [m.get("name", "") for m in json.load(answer).get("models", [])]
        except (OSError, ValueError):
            return False
        return any(self.model.split(":")[0] in n for n in names)


def generate(prompts: DataFrame, client: Client, system: str | None = None) -> DataFrame:
    """prompts: criterion, prompt. criterion, text, status (OK, or ERROR with the error as text).

    A call may run again with its task, so a client must bear repetition.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for key, prompt in zip(pdf["criterion"], pdf["prompt"], strict=True):
                try:
                    rows.append((key, client.generate(prompt, system), "OK"))
                except Exception as error:  # any failure of one call is that row's status
                    rows.append((key, str(error), "ERROR"))
            yield pd.DataFrame(rows, columns=["criterion", "text", "status"])

    return prompts.select("criterion", "prompt").mapInPandas(run, "criterion string, text string, status string")
