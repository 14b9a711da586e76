"""Language models as plug-ins: a chat client, and a detector, a judge and a source of replacements that use it.

No model is part of this repository. Clients are made on the executors, one a worker; a failing call never fails the job.
"""

from __future__ import annotations

import json
import os
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import checkpoint
from ..functions import parsers, vocab
from ..functions.labels import shared_label_or_spelled, slm_label
from ..functions.text import strip
from ..workers.calls import persistent, side_by_side
from ..workers.children import answered
from .detect import CHUNK_KEY, DETECTION, Detector, Source, recognised, supplement

#: Places of what patterns add, behind those of what a model says.
AFTER = 1 << 20

FIND = "List every piece of personal data in the text. Labels: " + ", ".join(vocab.SLM_LABELS) + '. Answer with JSON only: {"entities": [{"text": "...", "label": "..."}]}'
DECIDE = 'Each item is a span with its context. Say for each whether it is personal data. Answer with JSON only: {"verdicts": [{"id": 0, "is_pii": true}]}'
REPLACE = 'Give one made-up replacement of the same type, shape and language for each item. Answer with JSON only: {"replacements": [{"original_value": "...", "anonymized_value": "...", "pii_type": "..."}]}'


@dataclass(frozen=True)
class Chat:
    """A chat endpoint: an OpenAI-like one, or with ``native`` one that takes ``format`` and gives ``message``.

    The key is read from the environment of the worker, by name, so that it is in no plan.
    """

    url: str
    model: str
    native: bool = False
    key_variable: str | None = None
    timeout: float = 300.0
    #: Calls that a task has under way; and how often one is tried where the endpoint is busy, with the first wait in seconds.
    at_once: int = 8
    tries: int = 4
    back_off: float = 0.5
    temperature: float = 0.1
    most_tokens: int = 4096

    def ask(self, system: str, user: str, as_json: bool = True) -> str:
        """The reply; where the endpoint refuses the JSON format it is asked once more without, and where it is busy again later."""
        try:
            return persistent(lambda: self._post(system, user, as_json), busy, self.tries, self.back_off)
        except urllib.error.HTTPError as e:
            if not as_json or e.code != 400:
                raise
            return persistent(lambda: self._post(system, user, False), busy, self.tries, self.back_off)

    def _post(self, system: str, user: str, as_json: bool) -> str:
        body: dict = {"model": self.model, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}]}
        if self.native:
            body |= {"stream": False, "think": False, "options": {"temperature": self.temperature, "num_predict": self.most_tokens}}
            body |= {"format": "json"} if as_json else {}
        else:
            body |= {"temperature": self.temperature, "max_tokens": self.most_tokens}
            body |= {"response_format": {"type": "json_object"}} if as_json else {}
        head = {"Content-Type": "application/json"}
        if self.key_variable and (key := os.environ.get(self.key_variable)):
            head["Authorization"] = f"Bearer {key}"
        request = urllib.request.Request(self.url, json.dumps(body).encode(), head)
        with urllib.request.urlopen(request, timeout=self.timeout) as reply:
            got = json.load(reply)
        message = got.get("message") or (got.get("choices") or [{}])[0].get("message") or {}
        return message.get("content") or message.get("thinking") or ""


def busy(e: Exception) -> float | None:
    """The least seconds to wait after a call that may do later: too many requests, an endpoint that is not up, a connection refused."""
    if isinstance(e, urllib.error.HTTPError):
        asked = e.headers.get("Retry-After", "") if e.headers else ""
        return (float(asked) if asked.isdigit() else 0.0) if e.code in (429, 502, 503, 504) else None
    return 0.0 if isinstance(e, (urllib.error.URLError, ConnectionError)) and not isinstance(getattr(e, "reason", None), TimeoutError) else None


def entities_of(reply: str) -> list[tuple[str, str]]:
    """(text, label) pairs of a reply: from its JSON object under any known name, else from its best list; each once."""
    whole = json.loads(parsers.json_like(reply))
    lists = [whole[k] for k in (*parsers.ENTITY_KEYS, "result") if isinstance(whole.get(k), list)]
    lists.append(json.loads(parsers.best_list(reply)))
    for found in lists:
        pairs = {}
        for x in found:
            if isinstance(x, dict):
                text, label = (next((str(x[k]).strip() for k in keys if x.get(k)), "") for keys in (parsers.TEXT_KEYS, parsers.LABEL_KEYS))
                if text and label:
                    pairs.setdefault((text.lower(), label.lower()), (text, label.lower()))
        if pairs:
            return list(pairs.values())
    return []


class ChatDetector(Detector):
    """A language model as a detector, with a fixed score.

    A chunk of over ``piece`` characters is asked about in several pieces, which overlap. Labels are made ours, and the supplementary patterns
    add what the model did not name; a chunk on which it fails has neither, but an error. Calls go side by side.
    """

    piece, overlap = 5000, 200
    setting = "slm_threshold"

    def __init__(self, chat: Chat, name: str = "qwen", ord: int = 0, score: float = 0.8, examples: dict[str, str] | None = None):
        self.chat, self.name, self.ord, self.score, self.prompt = chat, name, ord, score, find_prompt(examples)

    def _one(self, text: str) -> list[tuple[str, str, float]]:
        starts = range(0, max(1, len(text) - self.overlap), self.piece - self.overlap) if len(text) > self.piece else (0,)
        pieces = [text[a : a + self.piece] for a in starts]
        pairs = dict.fromkeys(x for p in pieces if p.strip() for x in entities_of(self.chat.ask(self.prompt, p)))
        return [(t, la, self.score) for t, la in pairs]

    def detect(self, texts: list[str]) -> list[list[tuple[str, str, float]]]:
        return [self._one(t) for t in texts]

    def each(self, texts: list[str]) -> list[tuple[list | None, str | None]]:
        return list(side_by_side(texts, self._one, self.chat.at_once))

    def tried(self, chunks: DataFrame) -> DataFrame:
        # A model is asked once: what it said is read several times here.
        said = checkpoint(super().tried(chunks))
        found = said.where("error IS NULL").withColumn("label", slm_label(F.col("label")))
        first = Window.partitionBy(*CHUNK_KEY, F.lower("text"), "label").orderBy("pos")
        found = found.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
        failed = said.where("error IS NOT NULL")
        more = supplement(chunks.join(failed.select(*CHUNK_KEY), CHUNK_KEY, "left_anti"), found)
        pos = F.row_number().over(Window.partitionBy(*CHUNK_KEY).orderBy("rule", F.lower("text"))) + AFTER
        more = more.select(*CHUNK_KEY, F.lit(self.name).alias("detector"), F.lit(self.ord).alias("detector_ord"), pos.alias("pos"), "text", "label", "score")
        return found.unionByName(failed).unionByName(more, allowMissingColumns=True)


def judge_with(chat: Chat):
    """A ``decide`` function for ``ensemble.judge``."""

    def decide(rows: list[dict]) -> dict[int, bool]:
        whole = json.loads(parsers.json_like(chat.ask(DECIDE, json.dumps(rows, ensure_ascii=False, default=str))))
        items = next((whole[k] for k in parsers.VERDICT_KEYS if isinstance(whole.get(k), list)), [])
        said = {}
        for x in items:
            if isinstance(x, dict) and str(x.get("id", "")).strip().lstrip("-").isdigit() and ("is_pii" in x or "pii" in x):
                said[int(x["id"])] = str(x.get("is_pii", x.get("pii"))).strip().lower() in ("true", "1", "yes", "y")
        return said

    return decide


#: One example of each label for prompts that show some.
EXAMPLES = {
    "person": "Asha Rao", "email": "asha@example.com", "phone number": "+44 20 7946 0000", "address": "12 Mill Lane, Leeds", "organization": "Acme Ltd",
    "date": "3 May 2021", "ssn": "123-45-6789", "credit card number": "4111 1111 1111 1111", "aadhaar": "1234 5678 9012", "pan": "ABCDE1234F", "date_of_birth": "1990-08-15",
}
REPLACE_ARABIC = (
    "اكتب بديلا مختلقا واحدا لكل عنصر من النوع والشكل واللغة نفسها. أجب بصيغة JSON فقط: "
    '{"replacements": [{"original_value": "...", "anonymized_value": "...", "pii_type": "..."}]}'
)


def find_prompt(examples: dict[str, str] | None = None) -> str:
    """The question for personal data, with an example of each label where some are given."""
    shown = "; ".join(f"{label}, as {text!r}" for label, text in (examples or {}).items())
    return FIND + (f" Examples: {shown}." if shown else "")


def replace_prompt(lang: str) -> str:
    """The question for replacements, in Arabic for ``ar`` and else in English."""
    return REPLACE_ARABIC if lang == "ar" else REPLACE


def replacement_prompt(chunk: Column, findings: Column) -> Column:
    """The question for replacements of a chunk's findings (value, pii_type, score)."""
    items = F.transform(findings, lambda f: F.struct(f["value"].alias("value"), f["pii_type"].alias("pii_type"), F.bround(f["score"], 4).alias("confidence")))
    return F.concat(F.lit("Detected:\n"), F.to_json(items), F.lit("\n\nText:\n"), chunk)


def replacement_prompts(findings: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, chunk_index, prompt): the question for each chunk that has findings."""
    listed = F.sort_array(F.collect_list(F.struct(F.col("text").alias("value"), F.col("label").alias("pii_type"), "score"))).alias("f")
    asked = findings.groupBy(*CHUNK_KEY).agg(listed).join(chunks, CHUNK_KEY)
    return asked.select(*CHUNK_KEY, replacement_prompt(F.col("chunk"), F.col("f")).alias("prompt"))


def proposals(findings: DataFrame, chunks: DataFrame, chat: Chat, lang: str = "en") -> DataFrame:
    """A model's replacements (original_value, anonymized_value, pii_type, ord) for ``replace.checked``; none where it fails. Calls go side
    by side."""
    asked = replacement_prompts(findings, chunks)

    def replies(prompt: str):
        return json.loads(parsers.json_like(chat.ask(replace_prompt(lang), prompt))).get("replacements")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = ("original_value", "anonymized_value", "pii_type")
        for b in batches:
            rows: list[tuple] = []
            for i, (got, _) in enumerate(side_by_side(b.column(2).to_pylist(), replies, chat.at_once)):
                items = [x for x in got if isinstance(x, dict)] if isinstance(got, list) else []
                rows += [(i, n, *(str(x.get(k, "")) for k in fields)) for n, x in enumerate(items)]
            at = pa.array([r[0] for r in rows], pa.int32())
            columns = [b.column(0).take(at), b.column(1).take(at), *(pa.array([r[j] for r in rows], pa.string()) for j in (2, 3, 4))]
            columns.append(pa.array([r[1] for r in rows], pa.int32()))
            yield pa.RecordBatch.from_arrays(columns, names=[*CHUNK_KEY, *fields, "ord"])

    kind = asked.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, chunk_index int, original_value string, anonymized_value string, pii_type string, ord int"
    return asked.withColumn("chunk_index", F.col("chunk_index").cast("int")).mapInArrow(run, schema)


def proposals_by_command(findings: DataFrame, chunks: DataFrame, command: list[str], timeout: float = 120.0, at_once: int = 1, lang: str = "en") -> DataFrame:
    """As ``proposals``, from child processes: each takes ``{"system_prompt", "user_prompt"}`` and answers ``{"replacements": [...]}``.

    A chunk on which a child fails, is late or answers otherwise has none.
    """
    request = F.struct(F.lit(replace_prompt(lang)).alias("system_prompt"), F.col("prompt").alias("user_prompt"))
    said = answered(replacement_prompts(findings, chunks), request, command, timeout, at_once)
    fields = ("original_value", "anonymized_value", "pii_type")
    items = F.from_json("answer", f"replacements array<struct<{', '.join(f'{f}:string' for f in fields)}>>")["replacements"]
    rows = said.select(*CHUNK_KEY, F.posexplode(items).alias("ord", "r"))
    return rows.select(*CHUNK_KEY, *(F.coalesce(F.col("r")[f], F.lit("")).alias(f) for f in fields), "ord")


class CommandDetector(Source):
    """A recogniser in child processes: each takes ``{"text"}`` and answers ``{"result": [{"start", "end", "entity_type", "score"}]}``, or that list
    by itself. What it finds is treated as the built-in recognisers' findings are."""

    setting = "recogniser_threshold"

    def __init__(self, command: list[str], name: str = "presidio", ord: int = 0, timeout: float = 60.0, at_once: int = 1):
        self.command, self.name, self.ord, self.timeout, self.at_once = command, name, ord, timeout, at_once

    def _said(self, chunks: DataFrame) -> DataFrame:
        return checkpoint(answered(chunks.select(*CHUNK_KEY, "chunk"), F.struct(F.col("chunk").alias("text")), self.command, self.timeout, self.at_once))

    def _found(self, said: DataFrame, threshold: float) -> DataFrame:
        spans = "array<struct<start:int,end:int,entity_type:string,score:double>>"
        listed = F.coalesce(F.from_json("answer", f"result {spans}")["result"], F.from_json("answer", spans))
        rows = said.select(*CHUNK_KEY, "chunk", F.explode(listed).alias("x")).where("x.end > x.start AND x.start >= 0")
        text = strip(F.substring("chunk", F.col("x.start") + 1, F.col("x.end") - F.col("x.start")))
        label = shared_label_or_spelled(F.coalesce("x.entity_type", F.lit("unknown")))
        rows = rows.select(*CHUNK_KEY, text.alias("text"), label.alias("label"), F.coalesce("x.score", F.lit(0.0)).alias("score"))
        return recognised(rows.where("text != ''"), self.name, self.ord, threshold)

    def tried(self, chunks: DataFrame) -> DataFrame:
        said = self._said(chunks)
        return self._found(said, 0.0).unionByName(said.where("error IS NOT NULL").select(*CHUNK_KEY, "error"), allowMissingColumns=True)

    def apply(self, chunks: DataFrame, threshold: float = 0.35) -> DataFrame:
        return self._found(self._said(chunks), threshold).select(*DETECTION)
