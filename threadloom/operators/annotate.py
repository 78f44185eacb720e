"""Annotation by a pluggable text model, in Arrow batches, with retries, then validation."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from .perspectives import build_prompts, validate
from .profile import percent

BATCH_SIZE, RETRIES, DELAY = 16, 3, 2.0
Backend = Callable[[list[str]], list[str]]


def fake_backend() -> Backend:
    """A deterministic stand-in for a model: finds the id and text in the prompt and answers with one annotation."""

    def answer(prompts: list[str]) -> list[str]:
        out = []
        for prompt in prompts:
            tweet = prompt.partition("Tweet ID: ")[2].partition("\n")[0]
            text = prompt.partition('Tweet Text: "')[2].rpartition('"\n\nProvide')[0]
            span = " ".join(text.split(None, 4)[:4])
            item = {"label": "Information Providing", "evidence_span": span, "confidence": 0.9, "rationale": "The text states something."}
            out.append(json.dumps({tweet: [item]}, ensure_ascii=False))
        return out

    return answer


def annotate(prompts: DataFrame, make_backend: Callable[[], Backend], batch: int = BATCH_SIZE, retries: int = 1, delay: float = DELAY) -> DataFrame:
    """``prompts`` (tweet_id, text, prompt) with response, ok and seconds.

    A worker makes one backend for all its batches and returns as many rows at once as it was sent, however small a batch is. A batch succeeds or fails as a whole; a failed one is tried again
    ``retries`` times at most, then its responses are the error's text.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend: Backend | None = None
        for frame in frames:
            asked, responses, fine, seconds = frame["prompt"].tolist(), [], [], []
            for low in range(0, len(asked), batch):
                part = asked[low : low + batch]
                begun, answers, ok = time.monotonic(), [""] * len(part), False
                for attempt in range(max(1, retries)):
                    try:
                        backend = backend or make_backend()
                        answers, ok = backend(part), True
                        break
                    except Exception as error:  # any failure of a model is an outcome of the row
                        answers = [str(error)] * len(part)
                        if attempt + 1 < retries:
                            time.sleep(delay)
                if len(answers) != len(part):
                    raise ValueError(f"{len(answers)} answers to {len(part)} prompts")
                responses += answers
                fine += [ok] * len(part)
                seconds += [(time.monotonic() - begun) / len(part)] * len(part)
            yield pd.DataFrame({"tweet_id": frame["tweet_id"], "text": frame["text"], "response": responses, "ok": fine, "seconds": seconds})

    return prompts.select("tweet_id", "text", "prompt").mapInPandas(run, "tweet_id string, text string, response string, ok boolean, seconds double")


def inference_stats(responses: DataFrame, chars_per_token: int = 4) -> DataFrame:
    tokens = F.sum(F.length("response")) / chars_per_token
    return responses.agg(
        F.count("*").alias("requests"), percent(F.count_if("ok"), F.count("*")).alias("success_rate"),
        F.avg("seconds").alias("mean_seconds"), F.try_divide(tokens, F.sum("seconds")).alias("tokens_per_second"),
    )


def checked(answers: DataFrame, strict: bool = False) -> DataFrame:
    """Answers with their validation; those that the model failed to give are invalid."""
    good = validate(answers.where("ok").select("tweet_id", "text", "response"), strict)
    lost = answers.where("NOT ok").select("tweet_id", "text", "response")
    return good.unionByName(lost.withColumns({"is_valid": F.lit(False), "error": F.lit("inference_failed")}), allowMissingColumns=True)


def run(tweets: DataFrame, make_backend: Callable[[], Backend], strict: bool = False, **settings) -> DataFrame:
    """Prompts, answers, validation. Answers are written before they branch, so no later step calls the model again."""
    return checked(Scratch(tweets.sparkSession, "annotate").write(annotate(build_prompts(tweets), make_backend, **settings), "responses"), strict)


def one_answer(backend: Backend, prompt: str) -> tuple[str, bool]:
    """(answer, True), or (what went wrong, False)."""
    try:
        return backend([prompt])[0], True
    except Exception as error:  # any failure of a model is an outcome
        return str(error), False


def collate(rows: DataFrame, make_tokenizer: Callable[[], Callable[[list[str]], list[list[int]]]], width: int = 128, pad: int = 1) -> DataFrame:
    """(id, input_ids, attention_mask, label, perspectives) of (id, text, label, perspectives): ids cut or padded to ``width``."""
    fields = f"id {rows.schema['id'].dataType.simpleString()}, input_ids array<int>, attention_mask array<int>, label {rows.schema['label'].dataType.simpleString()}, perspectives array<double>"

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = make_tokenizer()
        for frame in frames:
            ids = [x[:width] for x in tokenizer(frame["text"].fillna("").tolist())]
            yield pd.DataFrame({
                "id": frame["id"], "input_ids": [x + [pad] * (width - len(x)) for x in ids], "attention_mask": [[1] * len(x) + [0] * (width - len(x)) for x in ids],
                "label": frame["label"], "perspectives": frame["perspectives"],
            })

    return rows.select("id", "text", "label", F.col("perspectives").cast("array<double>").alias("perspectives")).mapInPandas(encode, fields)


def embed(texts: DataFrame, make_encoder: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = 32) -> DataFrame:
    """(id, vector) of (id, text) by a pluggable encoder."""

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = make_encoder()
        for frame in frames:
            vectors = [v for low in range(0, len(frame), batch) for v in encoder(frame["text"].fillna("").tolist()[low : low + batch])]
            yield pd.DataFrame({"id": frame["id"], "vector": vectors})

    return texts.select("id", "text").mapInPandas(encode, f"id {texts.schema['id'].dataType.simpleString()}, vector array<float>")
