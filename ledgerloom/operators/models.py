"""Models behind small interfaces, called once per Arrow batch inside tasks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


class TextModel(Protocol):
    """Turns prompts into responses. Instances are created inside tasks."""

    def generate(self, prompt: str, temperature: float, sample: int) -> str: ...


class FirstNumbersModel:
    """Deterministic stand-in: computes the difference of the first two numbers of
    the evidence, and answers other prompts with its first numeric sentence."""

    def generate(self, prompt: str, temperature: float, sample: int) -> str:
        bodies = re.findall(r"Content: (.*)", prompt) or [prompt.split("EXCERPTS\n")[-1]]
        text = re.sub(r"\[[^\]]*\]", " ", " ".join(bodies)).replace(",", "")
        numbers = re.findall(r"-?\d+\.?\d*", text)
        if "PROGRAM:" not in prompt:
            sentences = [s for s in re.split(r"[.!?]\s", text) if re.search(r"\d", s)]
            return "PASS " + (sentences or ["no figures"])[0]
        if len(numbers) < 2:
            return "REASONING: too few numbers\nPROGRAM:\nanswer = add(missing, missing)"
        return (
            "REASONING: difference of the first two figures\nPROGRAM:\n"
            f"const_0 = {numbers[0]}\nconst_1 = {numbers[1]}\n"
            "answer = subtract(const_0, const_1)"
        )


class HostedModel:
    """Client of a hosted model; the vendor package is imported when first used."""

    PROVIDERS = ("anthropic", "openai")

    def __init__(self, provider: str, model: str, max_tokens: int = 2000):
        if provider not in self.PROVIDERS:
            raise ValueError(f"Unknown provider: {provider}")
        self.provider, self.model, self.max_tokens = provider, model, max_tokens
        self._client = None

    def generate(self, prompt: str, temperature: float, sample: int) -> str:
        message = [{"role": "user", "content": prompt}]
        limits = dict(model=self.model, max_tokens=self.max_tokens, temperature=temperature)
        if self.provider == "anthropic":
            import anthropic

            self._client = self._client or anthropic.Anthropic()
            return self._client.messages.create(messages=message, **limits).content[0].text
        import openai

        self._client = self._client or openai.OpenAI()
        reply = self._client.chat.completions.create(messages=message, **limits)
        return reply.choices[0].message.content


def ask(
    rows: DataFrame,
    prompt: Column,
    model: Callable[[], TextModel],
    temperature: float,
    sample: Column | None = None,
) -> DataFrame:
    """rows with `response` and `model_error`; one model instance per task."""

    @F.pandas_udf("response string, model_error string")
    def call(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        client = model()
        for prompts, samples in batches:
            replies = []
            for text, number in zip(prompts, samples):
                try:
                    replies.append((client.generate(text, temperature, int(number)), None))
                except Exception as problem:
                    replies.append((None, str(problem)))
            yield pd.DataFrame(replies, columns=["response", "model_error"], dtype=object)

    number = (F.lit(0) if sample is None else sample).cast("int")
    # not deterministic: the optimizer must neither repeat nor move model calls
    reply = call.asNondeterministic()(prompt, number)
    return rows.withColumn("reply", reply).select(*rows.columns, "reply.*")


def cross_scores(score: Callable[[list[tuple[str, str]]], list[float]]) -> Callable:
    """Wrap a batch pair scorer as the `scorer` of a rerank."""

    @F.pandas_udf("double")
    def scored(query: pd.Series, content: pd.Series) -> pd.Series:
        return pd.Series(score(list(zip(query, content))), dtype="float64")

    return scored


def embedder(encode: Callable[[list[str]], list[list[float]]], batch_size: int = 32) -> Callable:
    """Wrap a batch text encoder as a Column function."""

    @F.pandas_udf("array<float>")
    def encoded(texts: pd.Series) -> pd.Series:
        vectors = []
        for start in range(0, len(texts), batch_size):
            vectors.extend(encode(list(texts[start : start + batch_size])))
        return pd.Series(vectors)

    return encoded
