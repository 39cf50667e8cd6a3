"""Optional language models behind an HTTP interface (M01, M03, M04, T13, Y09). Nothing needs one: rules alone make an audit.

A model speaks one of two wire formats. `connect` tries the address once and gives an offline client if nothing answers.
Over tables, clients are made in the tasks, so calls are spread over the executors; an unanswered row stays unanswered.
"""

from __future__ import annotations

import json
import re
import time
import urllib.request
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofloom.functions.hashing import hashed_vector


class ModelError(RuntimeError):
    """A model that does not answer."""


@dataclass(frozen=True)
class Wire:
    """Paths of a wire format, and how to ask and to read."""

    alive: str
    chat: str
    embed: str
    ask: Callable[[str, list, float, int, bool], dict]
    read: Callable[[dict], str]
    vector: Callable[[dict], list]
    text_field: str
    vectors: Callable[[dict], list] | None = None  # of many texts in one call, where the format knows it


def _ask_messages(model: str, messages: list, temperature: float, tokens: int, as_json: bool) -> dict:
    return {"model": model, "messages": messages, "temperature": temperature, "max_tokens": tokens, "stream": False} | ({"response_format": {"type": "json_object"}} if as_json else {})


def _ask_options(model: str, messages: list, temperature: float, tokens: int, as_json: bool) -> dict:
    return {"model": model, "messages": messages, "stream": False, "options": {"temperature": temperature, "num_predict": tokens}} | ({"format": "json"} if as_json else {})


WIRES = {
    "openai_compatible": Wire("/models", "/chat/completions", "/embeddings", _ask_messages, lambda d: d["choices"][0]["message"]["content"], lambda d: d["data"][0]["embedding"], "input", lambda d: [x["embedding"] for x in sorted(d["data"], key=lambda x: x.get("index", 0))]),
    "ollama": Wire("/api/tags", "/api/chat", "/api/embeddings", _ask_options, lambda d: d["message"]["content"], lambda d: d["embedding"], "prompt"),
}


def loose_json(text: str | None) -> dict:
    """The object in an answer, with words or code fences around it; {} if there is none."""
    held = re.search(r"\{.*\}", text or "", re.S)
    try:
        return json.loads(held[0]) if held else {}
    except json.JSONDecodeError:
        return {}


@dataclass
class Client:
    """Calls one model and notes how long each call took."""

    url: str
    model: str = "local-model"
    wire: str = "openai_compatible"
    key: str = ""
    temperature: float = 0.1
    tokens: int = 2048
    timeout: float = 120.0
    took: list[float] = field(default_factory=list)

    def _send(self, path: str, body: dict | None, timeout: float) -> dict:
        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        request = urllib.request.Request(self.url.rstrip("/") + path, None if body is None else json.dumps(body).encode(), head)
        try:
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                return json.loads(answer.read() or b"{}")
        except Exception as e:
            raise ModelError(f"{type(e).__name__}: {e}") from e

    def alive(self, timeout: float = 5.0) -> bool:
        try:
            self._send(WIRES[self.wire].alive, None, timeout)
        except ModelError:
            return False
        return True

    def chat(self, messages: list[dict], as_json: bool = False) -> str:
        """The model's answer."""
        began, wire = time.monotonic(), WIRES[self.wire]
        answer = self._send(wire.chat, wire.ask(self.model, messages, self.temperature, self.tokens, as_json), self.timeout)
        self.took.append(1000 * (time.monotonic() - began))
        return wire.read(answer) or ""

    def embed(self, text: str) -> np.ndarray:
        """The model's unit vector of a text."""
        return self.embed_all([text])[0]

    def embed_all(self, texts: list[str]) -> list[np.ndarray]:
        """The model's unit vectors of several texts: one call where the wire format takes many, else one each."""
        wire = WIRES[self.wire]
        ask = lambda given: self._send(wire.embed, {"model": self.model, wire.text_field: given}, 15.0)
        try:
            made = wire.vectors(ask(list(texts))) if wire.vectors and len(texts) > 1 else [wire.vector(ask(t)) for t in texts]
        except (KeyError, IndexError, TypeError) as e:
            raise ModelError(f"no vectors in the answer: {type(e).__name__}: {e}") from e
        if len(made) != len(texts):
            raise ModelError(f"{len(made)} vectors for {len(texts)} texts")
        rows = [np.array(v, dtype=np.float64) for v in made]
        return [v / (np.linalg.norm(v) or 1.0) for v in rows]

    def stats(self) -> dict:
        """Number of calls and their mean time in ms."""
        return {"calls": len(self.took), "wire": self.wire, "model": self.model} | ({"mean_ms": round(float(np.mean(self.took)), 1)} if self.took else {})


@dataclass
class Offline(Client):
    """Answers nothing of its own; hashed vectors stand in for embeddings."""

    url: str = ""
    model: str = "rules"

    def alive(self, timeout: float = 5.0) -> bool:
        return False

    def chat(self, messages: list[dict], as_json: bool = False) -> str:
        self.took.append(0.0)
        return "{}" if as_json else ""

    def embed(self, text: str) -> np.ndarray:
        return hashed_vector(text)

    def embed_all(self, texts: list[str]) -> list[np.ndarray]:
        return [hashed_vector(t) for t in texts]


def connect(settings: Mapping | None) -> Client:
    """The client that settings name (url, model, wire, key, ...), the offline one without a url or, unless `required` is set,
    where nothing answers (M04)."""
    given = dict(settings or {})
    required = given.pop("required", False)
    if not given.get("url"):
        return Offline()
    client = Client(**given)
    if client.alive():
        return client
    if required:
        raise ModelError(f"{client.url} does not answer")
    return Offline()


def _asked(rows: DataFrame, settings: Mapping | None, prompt: str, out: str, as_json: bool) -> DataFrame:
    """rows with the model's answer to the text in `prompt` as `out`; '' where there is none."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, `{out}` string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = connect(settings)

        def answer(text: str) -> str:
            try:
                return client.chat([{"role": "user", "content": text}], as_json)
            except ModelError:
                return ""

        for batch in batches:
            yield batch.assign(**{out: [answer(t) for t in batch[prompt]]})

    return rows.mapInPandas(run, schema)


def verdicts(targets: DataFrame, settings: Mapping | None) -> DataFrame:
    """doc_id, issue_id, accept, note for the issues that a model judged (O10): input of `resolve.apply_verdicts`."""
    text = F.format_string("Is this finding right? Answer as JSON {\"is_valid\": true or false, \"reason\": text}.\nrule: %s\nfound: %s\nfinding: %s\ngrounds: %s", "rule_id", "original", "message", "explain")
    rows = _asked(targets.select("doc_id", "issue_id", text.alias("prompt")), settings, "prompt", "answer", True)
    said = F.from_json(F.regexp_extract("answer", r"(?s)\{.*\}", 0), "is_valid boolean, reason string")
    return rows.withColumn("said", said).filter("said.is_valid IS NOT NULL").select("doc_id", "issue_id", F.col("said.is_valid").alias("accept"), F.coalesce("said.reason", F.lit("")).alias("note"))


def parts_of(text: str, longest: int) -> list[str]:
    """A text in parts of at most `longest` characters, cut behind line ends where that can be; joined they are the text."""
    out: list[str] = []
    for line in text.splitlines(keepends=True):
        if out and len(out[-1]) + len(line) <= longest:
            out[-1] += line
        else:
            out += [line[i : i + longest] for i in range(0, len(line), longest)]
    return out


def rewrites(docs: DataFrame, plans: DataFrame, settings: Mapping | None, longest: int = 6000) -> DataFrame:
    """doc_id, rewritten: texts rewritten by their style plan (`style.transfer_plan`), those of over `longest` characters in parts
    (Y09). A part without an answer keeps its text; documents without any answer are left out, empty and null texts too. Rows of
    one id and text are one."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([parts_of(t, longest) for t in texts])

    plan = plans.select(F.col("doc_id").alias("d_"), "plan")
    own = docs.filter("text IS NOT NULL").select("doc_id", "text").distinct().join(plan, F.col("doc_id").eqNullSafe(F.col("d_")))
    parts = own.select("doc_id", F.xxhash64("text").alias("h_"), "plan", F.posexplode(cut("text")).alias("i_", "part"))
    text = F.concat(F.lit("Rewrite the text by this plan, keep its facts: "), "plan", F.lit("\n\n"), "part")
    said = _asked(parts.select("doc_id", "h_", "i_", "part", text.alias("prompt")), settings, "prompt", "answer", False)
    # an answer ends as its part did
    tail = F.regexp_extract("part", r"(\s*)\z", 1)
    made = F.when(F.col("answer") == "", F.col("part")).otherwise(F.concat(F.regexp_replace("answer", r"\s+\z", ""), tail))
    held = said.groupBy("doc_id", "h_").agg(F.max(F.col("answer") != "").alias("any_"), F.array_sort(F.collect_list(F.struct("i_", made.alias("t")))).alias("parts_"))
    return held.filter("any_").select("doc_id", F.array_join(F.transform("parts_", lambda x: x["t"]), "").alias("rewritten"))
