"""Normalise stored raw provider payloads to one response shape.

openai:    choices[0].message.content (NULL -> ''), usage.prompt_tokens / completion_tokens
           (an empty list of choices or contents is a malformed payload: an error row)
anthropic: content[0].text, usage.input_tokens / output_tokens
ollama:    message.content, prompt_eval_count / eval_count (absent -> 0)
other:     an error row (the request is not priced)
Provider names are matched lower-case; the text is stripped of white space.
One ``from_json`` per provider schema, evaluated only on its own rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.text import py_strip

# One schema covering the three providers' fields (no field has two types), so
# each payload is parsed once.
PAYLOAD = ("struct<choices: array<struct<message: struct<content: string>>>, "
           "usage: struct<prompt_tokens: bigint, completion_tokens: bigint, input_tokens: bigint, output_tokens: bigint>, "
           "content: array<struct<text: string>>, message: struct<content: string>, "
           "prompt_eval_count: bigint, eval_count: bigint>")
SUPPORTED = ["openai", "anthropic", "ollama"]


def normalise_responses(raw: DataFrame, provider: str = "provider", payload: str = "raw_json",
                        model: str = "model_key", keep: list[str] | None = None) -> DataFrame:
    staged = raw.select(*(keep or []), F.lower(F.col(provider)).alias("_p"), F.col(model),
                        F.when(F.lower(F.col(provider)).isin(SUPPORTED), F.from_json(F.col(payload), PAYLOAD))
                        .alias("_r"))
    p, r = F.col("_p"), F.col("_r")
    text = (F.when(p == "openai", F.coalesce(F.get(r["choices"], 0)["message"]["content"],
                                            F.when(F.size(r["choices"]) > 0, F.lit(""))))
             .when(p == "anthropic", F.get(r["content"], 0)["text"])
             .when(p == "ollama", r["message"]["content"]))
    tin = (F.when(p == "openai", r["usage"]["prompt_tokens"])
            .when(p == "anthropic", r["usage"]["input_tokens"])
            .when(p == "ollama", F.coalesce(r["prompt_eval_count"], F.lit(0).cast("bigint"))))
    tout = (F.when(p == "openai", r["usage"]["completion_tokens"])
             .when(p == "anthropic", r["usage"]["output_tokens"])
             .when(p == "ollama", F.coalesce(r["eval_count"], F.lit(0).cast("bigint"))))
    staged = staged.select(*(keep or []), "_p", model, text.alias("_text"), tin.alias("_in"), tout.alias("_out"))
    unsupported = ~F.col("_p").isin(SUPPORTED)
    malformed = ~unsupported & (F.col("_text").isNull() | F.col("_in").isNull() | F.col("_out").isNull())
    prefix = F.concat(F.lit(C.PROVIDER_ERROR_BEFORE), F.col("_p"), F.lit(C.PROVIDER_ERROR_MIDDLE), F.col(model))
    error = (F.when(unsupported, F.concat(prefix, F.lit(C.PROVIDER_ERROR_AFTER), F.col("_p")))
              .when(malformed, F.concat(prefix, F.lit(". Error: malformed provider payload"))))
    ok = error.isNull()
    return staged.select(*(keep or []), F.col("_p").alias("provider"), F.col(model),
                         F.when(ok, py_strip(F.col("_text"))).alias("output_text"),
                         F.when(ok, F.col("_in")).alias("input_tokens"),
                         F.when(ok, F.col("_out")).alias("output_tokens"),
                         error.alias("error"))
