"""Windows to labels by a language model: prompt, call, distribution, confidence.

The call is the only step outside Spark's own functions: a scorer gets the
prompts of a batch in a Python worker. Everything before and after is columns.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import confidence as C
from ..functions.responses import EXTRACTORS, answer_text
from . import WINDOW_KEY
from .answers import score_once
from .blind import require_blind
from .diagnose import diagnose
from .features import fill_prompt, legend, node_features, render
from .signals import window_signals

#: Statuses worth another try, most tries, most candidates a service gives.
RETRY_STATUS = (429, 500, 502, 503, 504)
MOST_TRIES, FIRST_WAIT_SEC, MOST_CANDIDATES = 6, 2.0, 20
#: Votes of a service that only samples are drawn at this temperature; at 0 all would be the same.
VOTE_TEMPERATURE = 0.7
#: Texts that say so where more tries are of no use.
QUOTA_SPENT = ("insufficient_quota", "credit_balance_exhausted", "no credits remaining", "billing_hard_limit_reached", "exceeded your current quota")
FLAGS = {"trust_reweighting": False, "abstention": False, "requery": False}
SAMPLED = "anthropic"


class ScoringError(RuntimeError):
    """No answer that can be read, or a backend that may not be used here."""


def payload(style: str, model: str, prompt: str, n_probs: int, temperature: float = 0.0, vote_temperature: float = VOTE_TEMPERATURE) -> dict:
    """The request body of a service style for one next token; a sampled vote has a temperature of its own, above 0."""
    if style == SAMPLED and vote_temperature <= 0:
        raise ScoringError("votes need a temperature above 0")
    n = min(int(n_probs), MOST_CANDIDATES)
    chat = [{"role": "user", "content": prompt}]
    bodies: dict[str, Callable[[], dict]] = {
        "llamacpp": lambda: {"prompt": prompt, "n_predict": 1, "n_probs": n_probs, "post_sampling_probs": False, "temperature": temperature, "cache_prompt": True},
        "vllm": lambda: {"model": model, "prompt": prompt, "max_tokens": 1, "logprobs": n_probs, "echo": True, "temperature": temperature},
        "ollama_native": lambda: {"model": model, "prompt": prompt, "stream": False, "logprobs": True, "top_logprobs": n_probs, "options": {"temperature": temperature, "num_predict": 1}},
        "openai": lambda: {"model": model, "messages": chat, "max_tokens": 1, "temperature": temperature, "logprobs": True, "top_logprobs": n},
        "gemini": lambda: {"contents": [{"role": "user", "parts": [{"text": prompt}]}], "generationConfig": {"temperature": temperature, "maxOutputTokens": 1, "responseLogprobs": True, "logprobs": n, "thinkingConfig": {"thinkingBudget": 0}}},
        SAMPLED: lambda: {"model": model, "max_tokens": 1, "temperature": vote_temperature, "messages": chat},
    }
    bodies["vertex"] = bodies["gemini"]
    if style not in bodies:
        raise ScoringError(f"no service style {style!r}")
    return bodies[style]()


def http_sender(url: str, headers: Mapping[str, str], timeout_sec: float = 60.0) -> Callable[[dict], tuple[int, Mapping[str, str], str]]:
    """A ``send`` for ``post_with_retry``: POSTs a body as JSON and gives (status, headers, text), for refusals too."""

    def send(body: dict) -> tuple[int, Mapping[str, str], str]:
        request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
        try:
            with urllib.request.urlopen(request, timeout=timeout_sec) as r:
                return r.status, dict(r.headers), r.read().decode("utf-8", "replace")
        except urllib.error.HTTPError as e:
            return e.code, dict(e.headers), e.read().decode("utf-8", "replace")

    return send


def post_with_retry(send: Callable[[dict], tuple[int, Mapping[str, str], str]], body: dict, wait: Callable[[float], None] = time.sleep) -> str:
    """The response text of a 200 answer.

    After a passing failure, of the service or of the network, waits 2, 4, 8 ... seconds, or longer
    where the service asks for it; gives up at once on other statuses and on a spent quota.
    """
    said = ""
    for attempt in range(MOST_TRIES):
        asked = 0.0
        try:
            status, headers, text = send(body)
        except OSError as e:  # no connection, or a time-out
            said = f"{type(e).__name__}: {e}"
        else:
            if status == 200:
                return text
            said = f"status {status}: {text[:300]}"
            if status not in RETRY_STATUS or (status == 429 and any(q in text.lower() for q in QUOTA_SPENT)):
                raise ScoringError(said)
            given = {k.lower(): v for k, v in headers.items()}.get("retry-after", "")
            asked = float(given) if given.replace(".", "", 1).isdigit() else 0.0
        if attempt + 1 < MOST_TRIES:
            wait(max(asked, FIRST_WAIT_SEC * 2**attempt))
    raise ScoringError(f"no answer in {MOST_TRIES} tries; last {said}")


def resolve_backend(settings: Mapping, override: str | None, env: Mapping[str, str]) -> list[str]:
    """Backends to try: the argument, then the environment, then the settings; 'auto' is the fallback order.

    Where log-probabilities are required, a backend that only samples is refused.
    """
    chosen = override or env.get("SCORING_BACKEND", "").strip() or env.get("LLM_PROVIDER", "").strip() or settings.get("backend", "llamacpp")
    if chosen == "auto":
        return list(settings.get("fallback_order", ["llamacpp"]))
    if settings.get("require_logprobs") and confidence_method(chosen) != "logprob":
        raise ScoringError(f"{chosen} samples answers; its shares are not log-probabilities and may not be pooled with them")
    return [chosen]


def confidence_method(style: str) -> str:
    return "logprob" if style in EXTRACTORS else "self_consistency"


def offline(logprobs: Mapping[str, float]) -> Callable[[list[str]], list[str]]:
    """A scorer without a network: the same candidates for every prompt, in one service's response format."""
    body = json.dumps({"choices": [{"logprobs": {"content": [{"top_logprobs": [{"token": k, "logprob": v} for k, v in logprobs.items()]}]}}]})
    return lambda prompts: [body] * len(prompts)


def call(prompts: DataFrame, scorer: Callable[[list[str]], list[str]], prompt_col: str = "prompt") -> DataFrame:
    """``prompts`` with ``response``, the scorer's text for each prompt; batches are the scorer's unit."""
    from ..session import ship

    ship(prompts.sparkSession)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema.fields)

    def task(batches: Iterator) -> Iterator:
        for pdf in batches:
            yield pdf.assign(response=scorer(pdf[prompt_col].tolist()))

    return prompts.mapInPandas(task, f"{fields}, response string")


def readouts(responses: DataFrame, style: str, labels: Sequence[str], provider: str, model: str) -> DataFrame:
    """Distribution, predicted label and confidence of each response; every row says how it was obtained."""
    rows = responses.withColumn("logprobs", C.label_logprobs(EXTRACTORS[style](F.col("response")), labels))
    none = F.size(F.filter("logprobs", lambda r: r["logprob"].isNotNull())) == 0
    dist = F.when(none, F.raise_error(F.lit("no label is among the candidates")).cast("array<struct<label:string,p:double>>")).otherwise(C.distribution(F.col("logprobs")))
    return _with_tags(rows.withColumn("distribution", dist), C.log_margin(F.col("logprobs")), "logprob", provider, model).drop("logprobs")


def sampled_readouts(responses: DataFrame, keys: Sequence[str], labels: Sequence[str], provider: str, model: str) -> DataFrame:
    """As ``readouts`` from several sampled answers a key: vote shares, no margin, and the resolution of the shares."""
    votes = responses.groupBy(*keys).agg(F.collect_list(answer_text(F.col("response"))).alias("answers")).withColumn("distribution", C.vote_distribution(F.col("answers"), labels))
    none = F.col("distribution")[0]["p"].isNull()
    votes = votes.withColumn("distribution", F.when(none, F.raise_error(F.lit("no answer names a label")).cast("array<struct<label:string,p:double>>")).otherwise(F.col("distribution")))
    valid = F.size(F.filter("answers", lambda a: F.substring(C.label_token(a), 1, 1).isin([x.upper() for x in labels])))
    votes = votes.withColumns({"n_valid": valid, "probability_resolution": F.try_divide(F.lit(1.0), valid)})
    return _with_tags(votes, F.lit(None).cast("double"), "self_consistency", provider, model).drop("answers")


def _with_tags(rows: DataFrame, margin: Column, method: str, provider: str, model: str) -> DataFrame:
    d = F.col("distribution")
    return rows.withColumns({"predicted": C.predicted(d), "max_p": C.max_p(d), "log_margin": margin, "entropy": C.entropy(d), "confidence_method": F.lit(method), "provider": F.lit(provider), "model": F.lit(model)})


def context(frames: DataFrame, references: DataFrame, template: str, labels: Sequence[str], few_shot: str = "", per_second: float = 1.0) -> DataFrame:
    """WINDOW_KEY, prompt and the verdicts behind it. The verdict is shown to the model and not acted upon."""
    require_blind(frames, "context")
    text = render(node_features(frames))
    verdicts = diagnose(window_signals(frames, per_second), references)
    note = F.format_string("%s HEALTH %s (%s) -- %s", F.rpad("node", 6, " "), F.col("state"), F.col("diagnosis"), F.col("rule"))
    notes = verdicts.groupBy(*WINDOW_KEY).agg(F.sort_array(F.collect_list(F.struct("node", note.alias("note")))).alias("n"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("node", "state")))).alias("health_states"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("node", "trust_weight")))).alias("trust_weights"))
    joined = text.join(notes, list(WINDOW_KEY))
    lines = F.array_join(F.transform("n", lambda r: r["note"]), "\n")
    query = F.concat(F.col("text"), F.lit("\n\nNode health, inferred by a separate monitor from signal statistics:\n"), lines)
    return joined.select(*WINDOW_KEY, fill_prompt(template, legend=legend(labels), few_shot=few_shot, query=query).alias("prompt"), "health_states", "trust_weights")


def run(frames: DataFrame, references: DataFrame, template: str, labels: Sequence[str], scorer: Callable[[list[str]], list[str]], style: str = "openai", provider: str = "offline", model: str = "offline", few_shot: str = "", store: str | None = None) -> DataFrame:
    """One call a window: prediction, confidence, and what the monitor thought. With a ``store`` answers are kept there and no prompt is asked again."""
    letters = [chr(65 + i) for i in range(len(labels))]
    asked = context(frames, references, template, labels, few_shot)
    called = score_once(asked, store, scorer, style, model).drop("repeat") if store else call(asked, scorer)
    out = readouts(called, style, letters, provider, model)
    return out.withColumn("flags", F.create_map(*[x for k, v in FLAGS.items() for x in (F.lit(k), F.lit(v))]))
