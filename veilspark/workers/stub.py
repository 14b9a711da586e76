"""A worker without a model, for trials: ``python -m veilspark.workers.stub``.

It answers requests for replacements, ``{"system_prompt", "user_prompt"}`` with the findings as a JSON list on a line of the prompt, by values of the same shape:
every letter and digit is another one, drawn from a hash of the value, so equal originals get equal answers.
"""

from __future__ import annotations

import hashlib
import json
import sys

from veilspark.workers.children import serve


def reshaped(value: str) -> str:
    """A value of the same shape: digits for digits, letters of the same case for ASCII letters, all else as it was."""
    seed, out = hashlib.sha256(value.lower().encode("utf-8", "replace")).digest(), []
    for i, c in enumerate(value):
        if i and i % len(seed) == 0:
            seed = hashlib.sha256(seed).digest()
        n = seed[i % len(seed)]
        first, size = ("0", 10) if "0" <= c <= "9" else ("a", 26) if "a" <= c <= "z" else ("A", 26) if "A" <= c <= "Z" else (c, 1)
        out.append(chr(ord(first) + n % size))
    return "".join(out)


def findings(prompt: str) -> list[dict]:
    """The first list of objects that stands on a line of its own."""
    for line in map(str.strip, prompt.split("\n")):
        if line.startswith("["):
            try:
                return [x for x in json.loads(line) if isinstance(x, dict)]
            except ValueError:
                continue
    return []


def replacements(request: dict) -> dict:
    """A replacement for each finding, once for each value and type in any case."""
    made: dict[tuple[str, str], dict] = {}
    for x in findings(str(request.get("user_prompt", ""))):
        value, kind = str(x.get("value", "")).strip(), str(x.get("pii_type", "")).strip() or "unknown"
        if value:
            made.setdefault((value.lower(), kind.lower()), {"original_value": value, "anonymized_value": reshaped(value), "pii_type": kind})
    return {"replacements": list(made.values())}


if __name__ == "__main__":
    serve(replacements, sys.stdin, sys.stdout)
