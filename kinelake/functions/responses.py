"""Model responses (JSON text) to candidates, loudly: a missing level is an error, never a guess."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PAIR = "struct<token:string,logprob:double>"
CANDIDATES = f"array<{_PAIR}>"


def _or_fail(value: Column, empty: Column, why: str) -> Column:
    return F.when(empty | value.isNull(), F.raise_error(F.lit(why)).cast(CANDIDATES)).otherwise(value)


def _kept(pairs: Column) -> Column:
    return F.filter(pairs, lambda p: p["token"].isNotNull() & p["logprob"].isNotNull())


def from_llamacpp(body: Column) -> Column:
    """Either field naming; a probability without its logarithm is taken over."""
    entry = "array<struct<tok_str:string,token:string,logprob:double,prob:double>>"
    parsed = F.from_json(body, f"completion_probabilities array<struct<probs:{entry},top_logprobs:{entry}>>")
    first = F.get(parsed["completion_probabilities"], F.lit(0))
    rows = F.coalesce(F.when(F.size(first["probs"]) > 0, first["probs"]), first["top_logprobs"])
    logprob = lambda e: F.coalesce(e["logprob"], F.when(e["prob"] > 0, F.log(e["prob"])).when(e["prob"] == 0, F.lit(float("-inf"))))
    pairs = _kept(F.transform(rows, lambda e: F.struct(F.coalesce(e["tok_str"], e["token"]).alias("token"), logprob(e).alias("logprob"))))
    return _or_fail(pairs, F.size(pairs) <= 0, "the response has no completion_probabilities with log-probabilities")


def from_vllm(body: Column) -> Column:
    """The last token that has a distribution."""
    parsed = F.from_json(body, "choices array<struct<logprobs:struct<top_logprobs:array<map<string,double>>>>>")
    tops = F.get(parsed["choices"], F.lit(0))["logprobs"]["top_logprobs"]
    last = F.element_at(F.filter(tops, lambda m: m.isNotNull() & (F.size(m) > 0)), -1)
    safe = F.when(F.size(F.filter(tops, lambda m: m.isNotNull() & (F.size(m) > 0))) > 0, last)
    pairs = F.transform(F.map_entries(safe), lambda e: F.struct(e["key"].alias("token"), e["value"].alias("logprob")))
    return _or_fail(pairs, F.size(pairs) <= 0, "the response has no choices[0].logprobs.top_logprobs")


def from_ollama(body: Column) -> Column:
    parsed = F.from_json(body, f"logprobs array<struct<top_logprobs:{CANDIDATES}>>")
    pairs = _kept(F.get(parsed["logprobs"], F.lit(0))["top_logprobs"])
    return _or_fail(pairs, F.size(pairs) <= 0, "the response has no logprobs[0].top_logprobs")


def from_gemini(body: Column) -> Column:
    parsed = F.from_json(body, "candidates array<struct<logprobsResult:struct<topCandidates:array<struct<candidates:array<struct<token:string,logProbability:double>>>>>>>")
    top = F.get(F.get(parsed["candidates"], F.lit(0))["logprobsResult"]["topCandidates"], F.lit(0))["candidates"]
    pairs = _kept(F.transform(top, lambda c: F.struct(c["token"].alias("token"), c["logProbability"].alias("logprob"))))
    return _or_fail(pairs, F.size(pairs) <= 0, "the response has no logprobsResult.topCandidates")


def from_openai(body: Column) -> Column:
    parsed = F.from_json(body, f"choices array<struct<logprobs:struct<content:array<struct<top_logprobs:{CANDIDATES}>>>>>")
    pairs = _kept(F.get(F.get(parsed["choices"], F.lit(0))["logprobs"]["content"], F.lit(0))["top_logprobs"])
    return _or_fail(pairs, F.size(pairs) <= 0, "the response has no choices[0].logprobs.content[0].top_logprobs")


EXTRACTORS = {"llamacpp": from_llamacpp, "vllm": from_vllm, "ollama_native": from_ollama, "gemini": from_gemini, "vertex": from_gemini, "openai": from_openai}


def answer_text(body: Column) -> Column:
    """The first text block of a sampled answer; '' without one."""
    parsed = F.from_json(body, "content array<struct<type:string,text:string>>")
    texts = F.filter(parsed["content"], lambda b: (b["type"] == "text") & (F.length(b["text"]) > 0))
    return F.coalesce(F.get(texts, F.lit(0))["text"], F.lit(""))
