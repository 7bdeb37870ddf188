"""Models that are not test doubles: local encoders, and chat models behind an OpenAI-compatible server.

Nothing here is imported until a model is used, and then on the executors. Encoders need the package
sentence_transformers there; chat models need a server and nothing but the standard library. Every model is a small
object that pickles: executors load weights once a Python worker, and make one request for each row.
"""

from __future__ import annotations

import functools
import json
import time
import urllib.error
import urllib.request
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom import schema


@functools.cache
def _loaded(kind: str, model: str) -> Any:
    import sentence_transformers

    return getattr(sentence_transformers, kind)(model)


@dataclass(frozen=True)
class SentenceEmbedder:
    """A bi-encoder; documents and questions are encoded with the same prompt, to unit vectors."""

    model: str
    size: int = 1024
    prompt_name: str | None = "query"

    def encode(self, texts: list[str]) -> np.ndarray:
        return np.asarray(_loaded("SentenceTransformer", self.model).encode(texts, prompt_name=self.prompt_name, normalize_embeddings=True))


@dataclass(frozen=True)
class PairReranker:
    """A cross-encoder over pairs of question and text."""

    model: str

    def score(self, question: Column, text: Column) -> Column:
        @F.pandas_udf("double")
        def predict(questions: pd.Series, texts: pd.Series) -> pd.Series:
            pairs = list(zip(questions.fillna(""), texts.fillna("")))
            return pd.Series(np.asarray(_loaded("CrossEncoder", self.model).predict(pairs), float) if pairs else [], dtype=float)

        return predict(question, text)


class Refused(RuntimeError):
    """The server did not give an answer of the form asked for."""


@dataclass(frozen=True)
class ChatServer:
    """An OpenAI-compatible server at url; answers are JSON objects of a given schema."""

    url: str
    model: str
    key: str = field(default="none", repr=False)
    max_tokens: int = 2048
    temperature: float = 0.0
    timeout: float = 120.0
    tries: int = 3
    at_once: int = 8

    def ask(self, messages: list[dict[str, str]], name: str, form: dict) -> dict:
        """The answer as an object with all of form's keys. Errors of the server and of its answers are tried again."""
        body = {
            "model": self.model, "messages": messages, "max_tokens": self.max_tokens, "temperature": self.temperature,
            "response_format": {"type": "json_schema", "json_schema": {"name": name, "schema": form, "strict": True}},
        }
        request = urllib.request.Request(f"{self.url.rstrip('/')}/chat/completions", json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"})
        for n in range(self.tries):
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as response:
                    found = json.loads(json.load(response)["choices"][0]["message"]["content"])
                if not isinstance(found, dict) or not set(form["required"]) <= set(found):
                    raise Refused(f"an answer without {form['required']}")
                return found
            except (urllib.error.URLError, TimeoutError, KeyError, IndexError, TypeError, ValueError, Refused) as e:
                gone = isinstance(e, urllib.error.HTTPError) and e.code < 500 and e.code != 429
                if gone or n + 1 == self.tries:
                    raise Refused(f"{name}: {e}") from e
                time.sleep(min(2**n, 10) / 10)
        raise AssertionError

    def each(self, messages: list[list[dict[str, str]]], name: str, form: dict) -> list[dict]:
        """Answers in order; some requests at a time."""
        with ThreadPoolExecutor(self.at_once) as pool:
            return list(pool.map(lambda m: self.ask(m, name, form), messages))


def _form(**properties: dict) -> dict:
    return {"type": "object", "properties": properties, "required": list(properties), "additionalProperties": False}


_TEXT, _LIST = {"type": "string"}, lambda items: {"type": "array", "items": items}
ROUTE = _form(use_rag={"type": "boolean"}, rewritten_query={"type": ["string", "null"]})
ANSWER = _form(answer=_TEXT, references=_LIST(_form(document_name=_TEXT, images=_LIST(_TEXT))))
GRADES = ("accuracy", "completeness", "relevance")
GRADE = _form(feedback=_TEXT, **{g: {"type": "number", "minimum": 1, "maximum": 5} for g in GRADES})
_MESSAGES = T.ArrayType(T.StructType().add("role", "string").add("content", "string"))
JUDGED = T.StructType().add("feedback", "string")
for _grade in GRADES:
    JUDGED.add(_grade, "double")

ROUTING = (
    "Decide whether the user's last message needs facts from the document library, or only the conversation itself, such as a translation, a summary or small talk. "
    "If it needs the library, rewrite it as one question that can be understood without the conversation, in the user's language; otherwise leave the rewritten query null."
)
JUDGING = (
    "Grade an answer against a reference answer, from 1 (worst) to 5 (best): accuracy, how much of it is right; completeness, how much of the reference it covers; "
    "relevance, how much of it bears on the question. A wrong answer has accuracy 1. First give a short feedback."
)


@dataclass(frozen=True)
class ChatRouter:
    server: ChatServer

    def route(self, question: Column, history: Column) -> Column:
        @F.pandas_udf(schema.ROUTE)
        def routed(questions: pd.Series, histories: pd.Series) -> pd.DataFrame:
            asked = [[{"role": "system", "content": ROUTING}, *_plain(h), {"role": "user", "content": q or ""}] for q, h in zip(questions, histories)]
            found = self.server.each(asked, "route", ROUTE)
            # A query is of use only where documents are looked up.
            return pd.DataFrame({"use_rag": [bool(f["use_rag"]) for f in found], "rewritten_query": [f["rewritten_query"] if f["use_rag"] else None for f in found]})

        return routed(question, history.cast(_MESSAGES))


@dataclass(frozen=True)
class ChatGenerator:
    server: ChatServer

    def answer(self, messages: Column) -> Column:
        @F.pandas_udf(schema.ANSWER)
        def answered(lists: pd.Series) -> pd.DataFrame:
            found = self.server.each([_plain(m) for m in lists], "answer", ANSWER)
            return pd.DataFrame({"answer": [str(f["answer"]) for f in found], "references": [f["references"] or [] for f in found]})

        return answered(messages.cast(_MESSAGES))


@dataclass(frozen=True)
class ChatJudge:
    server: ChatServer

    def judge(self, question: Column, answer: Column, reference: Column) -> Column:
        @F.pandas_udf(JUDGED)
        def judged(questions: pd.Series, answers: pd.Series, references: pd.Series) -> pd.DataFrame:
            text = "Question:\n{}\n\nAnswer:\n{}\n\nReference answer:\n{}"
            asked = [[{"role": "system", "content": JUDGING}, {"role": "user", "content": text.format(*(x or "" for x in row))}] for row in zip(questions, answers, references)]
            found = self.server.each(asked, "grades", GRADE)
            return pd.DataFrame({"feedback": [str(f["feedback"]) for f in found], **{g: [min(5.0, max(1.0, float(f[g]))) for f in found] for g in GRADES}})

        return judged(question, answer, reference)


def _plain(messages) -> list[dict[str, str]]:
    return [{"role": m["role"], "content": m["content"] or ""} for m in (messages if messages is not None else [])]
