"""Readers of what language models answer: JSON in any wrapping, prose, and verdicts."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import vocab
from .labels import lookup
from .text import strip

ENTITIES = "array<struct<text:string,label:string>>"
#: Names under which models give entities, texts, labels and verdicts.
ENTITY_KEYS = ("entities", "spans", "pii", "items", "results", "detections")
TEXT_KEYS, LABEL_KEYS = ("text", "entity", "value", "span"), ("label", "type", "entity_type")
VERDICT_KEYS = ("verdicts", "results", "decisions", "items")


def strip_fence(reply: Column) -> Column:
    """What stands in the first code fence, or the reply itself, without white space around."""
    fence = r"(?Uis)```(?:json)?\s*(.*?)\s*```"
    return strip(F.when(reply.rlike(fence), F.regexp_extract(reply, fence, 1)).otherwise(reply))


def entities(reply: Column) -> Column:
    """Entities of a JSON reply: a list of objects, or an object that has such a list under a known name.

    Objects lacking a text or label are left out. The first name whose list gives an entity counts.
    """
    inner = "array<struct<" + ",".join(f"{k}:string" for k in dict.fromkeys((*TEXT_KEYS, *LABEL_KEYS))) + ">>"
    body = strip_fence(reply)
    as_object = F.from_json(body, "struct<" + ",".join(f"{k}:{inner}" for k in ENTITY_KEYS) + ">")

    def clean(found: Column) -> Column:
        def pick(x: Column, keys: tuple[str, ...]) -> Column:
            # The first name counts if it is there at all, even empty; of the others the first that says something.
            return F.coalesce(x[keys[0]], *(F.nullif(x[k], F.lit("")) for k in keys[1:]))

        pairs = F.transform(
            found,
            lambda x: F.struct(strip(pick(x, TEXT_KEYS)).alias("text"), F.lower(strip(pick(x, LABEL_KEYS))).alias("label")),
        )
        return F.filter(pairs, lambda p: (p["text"] != "") & (p["label"] != ""))

    def some(found: Column) -> Column:
        return F.when(F.size(clean(found)) > 0, clean(found))

    lists = [some(as_object[k]) for k in ENTITY_KEYS]
    whole = clean(F.from_json(body, inner))
    found = F.when(body.startswith("["), whole).otherwise(F.coalesce(*lists))
    return F.coalesce(found, F.array().cast(ENTITIES))


def prose_entities(reply: Column) -> Column:
    """Entities of lines like ``**Full Name**: Asha``; also of ``**Full Name:** Asha``. Known names only, each once."""
    pattern = r"(?U)\*\*([^*\n:]+?)\s*(?::\s*\*\*|\*\*\s*:)[ \t:]*([^\n*]+)"
    names, values = F.regexp_extract_all(reply, F.lit(pattern), 1), F.regexp_extract_all(reply, F.lit(pattern), 2)
    pairs = F.transform(
        F.arrays_zip(names.alias("n"), values.alias("v")),
        lambda p: F.struct(strip(p["v"]).alias("text"), lookup(F.lower(strip(p["n"])), vocab.PROSE_LABELS).alias("label")),
    )
    return F.array_distinct(F.filter(pairs, lambda p: (p["text"] != "") & p["label"].isNotNull()))


def verdicts(reply: Column) -> Column:
    """Verdicts by candidate: map of id to truth, from the first list there is; items without a whole id are left out."""
    inner = "array<struct<id:string,is_pii:string,pii:string>>"
    body = F.from_json(strip_fence(F.coalesce(reply, F.lit(""))), "struct<" + ",".join(f"{k}:{inner}" for k in VERDICT_KEYS) + ">")
    items = F.filter(
        F.coalesce(*(body[k] for k in VERDICT_KEYS), F.array().cast(inner)),
        lambda x: x["id"].try_cast("int").isNotNull() & F.coalesce(x["is_pii"], x["pii"]).isNotNull(),
    )
    pairs = F.transform(
        items,
        lambda x: F.struct(
            x["id"].try_cast("int").alias("id"), F.lower(strip(F.coalesce(x["is_pii"], x["pii"]))).isin("true", "1", "yes", "y").alias("is_pii")
        ),
    )
    # The last word on an id counts.
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q["id"] == p["id"]))
    return F.map_from_entries(last)


def balanced_lists(text: str) -> Iterator[tuple[list, int]]:
    """Every JSON list in a text that begins at a bracket and closes it, with where it ends."""
    depth_at: list[int] = []
    closing: dict[int, int] = {}
    for i, c in enumerate(text):
        if c == "[":
            depth_at.append(i)
        elif c == "]" and depth_at:
            closing[depth_at.pop()] = i
    for start in sorted(closing):
        try:
            found = json.loads(text[start : closing[start] + 1])
        except json.JSONDecodeError:
            continue
        if isinstance(found, list):
            yield found, closing[start]


def best_list(text: str | None) -> str:
    """The longest list of objects in a reply, as JSON; of equals the one that ends last; [] if there is none."""
    lists = [(len(x), end, x) for x, end in balanced_lists(text or "") if all(isinstance(y, dict) for y in x)]
    return json.dumps(max(lists, key=lambda x: x[:2])[2], ensure_ascii=False) if lists else "[]"


def json_like(text: str | None) -> str:
    """A reply as a JSON object: whole, fenced, or from any bracket to the last one that closes; else under raw_response."""
    text = (text or "").strip()
    if not text:
        return json.dumps({"error": "Empty text"})
    tries = [text]
    if "```" in text:
        inner = text.split("```")[1].strip()
        tries.append(inner.removeprefix("json").strip())
    end = max(text.rfind("}"), text.rfind("]"))
    tries += [text[i : end + 1] for i, c in enumerate(text) if c in "{[" and i < end]
    for t in tries:
        try:
            found = json.loads(t)
        except json.JSONDecodeError:
            continue
        return json.dumps(found if isinstance(found, dict) else {"result": found}, ensure_ascii=False)
    return json.dumps({"raw_response": text}, ensure_ascii=False)


def detected_in_prompt(prompt: Column) -> Column:
    """The first line of a prompt that is a JSON list: what was detected, as (value, pii_type)."""
    kind = "array<struct<value:string,pii_type:string,confidence:double>>"
    lines = F.filter(F.transform(F.split(prompt, "\n"), strip), lambda x: x.startswith("[") & F.from_json(x, kind).isNotNull())
    return F.coalesce(F.from_json(F.get(lines, F.lit(0)), kind), F.array().cast(kind))


def _by_row(reply: Column, read: Callable[[str | None], str]) -> Column:
    """``read`` of every reply. The UDF is made here: a used one holds a JVM handle, and this module is pickled by value."""

    @F.pandas_udf(StringType())
    def run(replies: pd.Series) -> pd.Series:
        return replies.map(read)

    return run(reply)


def best_list_column(reply: Column) -> Column:
    """``best_list`` of every reply; a null reply has none."""
    return _by_row(reply, best_list)


def json_like_column(reply: Column) -> Column:
    """``json_like`` of every reply; a null reply is an empty text."""
    return _by_row(reply, json_like)
