"""Long-lived child processes that answer requests, one JSON object a line each way.

A command is started by the task that first asks it and stays for all of the task's rows. A request has an ``id``, which the answer may
repeat; an answer to an earlier request is passed over. A child that does not answer in time, or ends, is killed with all of its process
group, the request fails, and the next one starts it anew. When a task ends its children are killed; should the task's own process
be killed, the end of their input tells them to end.
"""

from __future__ import annotations

import json
import os
import queue
import selectors
import signal
import subprocess
import time
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .calls import side_by_side

#: Characters of a child's last words that an error has.
SAID = 200


class ChildError(RuntimeError):
    pass


class Child:
    """One child process of a command; not for several threads at once."""

    def __init__(self, command: list[str], timeout: float, env: dict[str, str] | None = None):
        self.command, self.timeout, self.env = command, timeout, env
        self.process: subprocess.Popen | None = None
        self.asked, self.held = 0, b""

    def _start(self) -> None:
        self.held = b""
        self.process = subprocess.Popen(
            self.command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, env=os.environ | (self.env or {}), start_new_session=True
        )
        os.set_blocking(self.process.stdin.fileno(), False)
        os.set_blocking(self.process.stdout.fileno(), False)

    def ask(self, request: dict):
        """The answer to a request; ``ChildError`` if there is none in time."""
        if self.process is None or self.process.poll() is not None:
            self.kill()
            self._start()
        self.asked += 1
        data = memoryview(json.dumps(request | {"id": self.asked}, ensure_ascii=False).encode("utf-8", "replace") + b"\n")
        try:
            return self._talk(data, time.monotonic() + self.timeout)
        except ChildError:
            self.kill()
            raise

    def _talk(self, data: memoryview, end: float):
        into, out = self.process.stdin.fileno(), self.process.stdout.fileno()
        with selectors.DefaultSelector() as ready:
            ready.register(out, selectors.EVENT_READ)
            if data:
                ready.register(into, selectors.EVENT_WRITE)
            while True:
                while b"\n" in self.held:
                    line, _, self.held = self.held.partition(b"\n")
                    if (answer := self._answer(line)) is not None:
                        return answer
                if (left := end - time.monotonic()) <= 0:
                    raise ChildError(f"no answer within {self.timeout:g} seconds")
                for key, _ in ready.select(left):
                    if key.fd == into:
                        try:
                            data = data[os.write(into, data) :]
                        except BrokenPipeError:
                            raise ChildError(f"the child ended: {self.process.wait()}") from None
                        if not data:
                            ready.unregister(into)
                    elif piece := os.read(out, 1 << 16):
                        self.held += piece
                    else:
                        raise ChildError(f"the child ended: {self.process.wait()}")

    def _answer(self, line: bytes):
        """What a line says, None if it answers an earlier request."""
        try:
            said = json.loads(line)
        except ValueError:
            raise ChildError(f"not JSON: {line[:SAID].decode('utf-8', 'replace')}") from None
        return None if isinstance(said, dict) and said.get("id", self.asked) != self.asked else said

    def kill(self) -> None:
        """End the child and all that it started."""
        if self.process is None:
            return
        try:
            os.killpg(self.process.pid, signal.SIGKILL)
        except ProcessLookupError:
            pass
        self.process.wait()
        for pipe in (self.process.stdin, self.process.stdout):
            try:
                pipe.close()
            except OSError:
                pass
        self.process = None


class Children:
    """So many children of one command, for as many threads; each request takes one that is free."""

    def __init__(self, command: list[str], timeout: float, at_once: int = 1, env: dict[str, str] | None = None):
        self.free: queue.SimpleQueue[Child] = queue.SimpleQueue()
        self.all = [Child(command, timeout, env) for _ in range(at_once)]
        for c in self.all:
            self.free.put(c)

    def ask(self, request: dict):
        child = self.free.get()
        try:
            return child.ask(request)
        finally:
            self.free.put(child)

    def __enter__(self) -> Children:
        return self

    def __exit__(self, *_) -> None:
        for c in self.all:
            c.kill()


def answered(
    df: DataFrame, request: Column, command: list[str], timeout: float = 60.0, at_once: int = 1, env: dict[str, str] | None = None
) -> DataFrame:
    """``df`` with answer, the JSON that a child of ``command`` gave to each row's ``request``, a struct; and error, why there is none.

    Rows keep their order. A null request is not asked, and has neither. Every task has ``at_once`` children.
    """
    schema = T.StructType([T.StructField("__row", df.schema), *T._parse_datatype_string("answer string, error string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with Children(command, timeout, at_once, env) as children:
            for b in batches:
                said = list(side_by_side(b.column(1).to_pylist(), lambda r: None if r is None else children.ask(json.loads(r)), at_once))
                answers = [None if x is None else json.dumps(x, ensure_ascii=False) for x, _ in said]
                errors = [why for _, why in said]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(answers, pa.string()), pa.array(errors, pa.string())], names=["__row", "answer", "error"])

    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("__row"), F.to_json(request, {"ignoreNullFields": "false"}).alias("request"))
    found = rows.mapInArrow(run, schema)
    return found.select(*(F.col("__row").getField(c).alias(c) for c in df.columns), "answer", "error")


def serve(answer: Callable[[dict], object], lines: Iterable[str], out) -> None:
    """The child's side: answer every line until the input ends. A request that fails is answered with its error."""
    for line in lines:
        try:
            request = json.loads(line)
            said = answer(request)
            said = said if isinstance(said, dict) else {"result": said}
            said |= {"id": request["id"]} if "id" in request else {}
        except Exception as e:
            said = {"error": f"{type(e).__name__}: {e}"[:SAID]}
        out.write(json.dumps(said, ensure_ascii=False) + "\n")
        out.flush()
