"""Label sources. Prompts and answers are expressions; a chat client runs inside mapInPandas, one for each task."""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.pool import answered

SYSTEM = "You sort short texts into categories. Answer with one JSON object that has predicted_category and rationale."
USER = "Categories: {labels}\nText: {text}\nWhich category fits best?"
ANSWER = "predicted_category STRING, augmented_description STRING, rationale STRING"
ANSWER_WITH_CODE = "predicted_category_name STRING, predicted_category_code INT, rationale STRING"
#: The field of each kind of answer that holds the category.
CATEGORY = {ANSWER: "predicted_category", ANSWER_WITH_CODE: "predicted_category_name"}


def label_list(labels: Column) -> Column:
    """'a', 'b' of an array."""
    return F.array_join(F.transform(labels, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", ")


def prompt(text: Column, labels: Column, template: str = USER, **fields) -> Column:
    """The template with {text}, {labels} and the given fields (columns or values) filled in, wherever each is named.

    $text and ${text} are other spellings. Unknown names, and braces and dollars in what is filled in, stay as they are.
    """
    known = {"text": F.coalesce(text, F.lit("")), "labels": label_list(labels)}
    known |= {k: F.coalesce((v if isinstance(v, Column) else F.lit(v)).cast("string"), F.lit("")) for k, v in fields.items()}
    parts, at = [], 0
    for m in re.finditer(r"\{(\w+)\}|\$\{(\w+)\}|\$(\w+)", template):
        name = m[1] or m[2] or m[3]
        if name in known:
            parts += [F.lit(template[at : m.start()]), known[name]]
            at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def messages(text: Column, labels: Column, system: str = SYSTEM, user: str = USER, **fields) -> Column:
    role = lambda r, c: F.struct(F.lit(r).alias("role"), c.alias("content"))
    return F.array(role("system", prompt(text, labels, system, **fields)), role("user", prompt(text, labels, user, **fields)))


def valid_answer(answer: Column, allowed: Column, field: str = "predicted_category", schema: str = ANSWER) -> Column:
    """The answer's category; null for broken JSON and for categories that are not allowed."""
    found = F.from_json(answer, schema)[field]
    return F.when(F.array_contains(allowed, found), found)


class SimulatedOracle:
    def __init__(self, truth: DataFrame):
        self.truth = truth

    def query(self, chosen: DataFrame) -> DataFrame:
        return answered(chosen.drop("label"), self.truth)


class ApiError(Exception):
    """What a client raises for a failed call; these, and unexpected errors, are tried again."""


class ChatOracle:
    """Labels from a chat model. `client` makes, in each task, a function from messages to the answer's text.

    It is called with the settings that are given: `model`, `api_key`, and `schema`, the answer's fields. Templates may name
    text, labels, and the keys of `fields`, columns of the rows asked for. With ANSWER_WITH_CODE the category is a name.
    ledger: a folder of answers (see Ledger), by which no prompt is asked again, not even by a task that runs once more.
    per_second, burst: how many calls a task may make (see TokenBucket).
    """

    def __init__(self, labels: list[str], client: Callable[..., Callable[[list[dict]], str]], text: str = "text", max_retries: int = 3, retry_delay: float = 5.0, model: str | None = None, api_key: str | None = None, system: str = SYSTEM, user: str = USER, schema: str = ANSWER, fields: tuple[str, ...] = (), ledger: str | None = None, per_second: float | None = None, burst: int = 1):
        if schema not in CATEGORY:
            raise ValueError("schema is ANSWER or ANSWER_WITH_CODE")
        self.labels, self.client, self.text, self.max_retries, self.retry_delay = sorted(set(labels)), client, text, max_retries, retry_delay
        given = {"model": model, "api_key": api_key} | ({} if schema == ANSWER else {"schema": schema})
        self.settings = {k: v for k, v in given.items() if v is not None}
        self.system, self.user, self.schema, self.fields = system, user, schema, fields
        self.ledger, self.per_second, self.burst = ledger, per_second, burst

    def query(self, chosen: DataFrame) -> DataFrame:
        labels, client, settings, tries, delay, field = self.labels, self.client, self.settings, self.max_retries, self.retry_delay, CATEGORY[self.schema]
        ledger, rate, burst = self.ledger, self.per_second, self.burst
        helper, key = _free(chosen, "_messages"), _free(chosen, "_digest")
        asked = messages(F.col(self.text), F.array(*[F.lit(x) for x in labels]), self.system, self.user, **{f: F.col(f) for f in self.fields})
        rows = chosen.drop("label").withColumn(helper, F.to_json(asked))
        # what makes another answer is part of the name: the prompt, the model, the answer's fields
        rows = rows.withColumn(key, F.sha2(F.concat_ws("\x1f", F.col(helper), F.lit(self.schema), F.lit(settings.get("model", ""))), 256))
        if ledger is not None:
            # equal prompts meet in one task, so that none is asked twice at once
            rows = rows.repartition(max(1, chosen.sparkSession.sparkContext.defaultParallelism), key)

        def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            from pyspark import TaskContext

            book = None if ledger is None else Ledger(ledger)
            wait = TokenBucket(rate, burst) if rate else None
            call = None
            for frame in frames:
                out = []
                for m, name in zip(frame.pop(helper), frame.pop(key)):
                    answer = None if book is None else book.get(name)
                    if answer is None:
                        call = client(**settings) if call is None else call
                        answer = _answer(call, json.loads(m), tries, delay, wait)
                        if answer is not None and book is not None:
                            book.put(name, answer, TaskContext.get().taskAttemptId() if TaskContext.get() else 0)
                    out.append(_category(answer, labels, field))
                frame["label"] = out
                yield frame

        fields = ", ".join(f"`{c}` {t}" for c, t in chosen.drop("label").dtypes)
        return rows.mapInPandas(ask, f"{fields}, label string")


def _free(df: DataFrame, name: str) -> str:
    """name, longer as long as df has a column called so."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def _answer(call, request: list[dict], tries: int, delay: float, wait: TokenBucket | None) -> str | None:
    """The answer's text; None if every call failed."""
    for attempt in range(tries):
        if wait is not None:
            wait.take()
        try:
            return call(request)
        except Exception:  # any failed call
            if attempt + 1 < tries:
                time.sleep(delay)
    return None


def _category(answer: str | None, labels: list[str], field: str) -> str | None:
    """What an answer says, if that is a label; an answer that says nothing is not asked for again."""
    try:
        found = json.loads(answer or "").get(field)
    except (ValueError, AttributeError, TypeError):
        return None
    return found if found in labels else None


class TokenBucket:
    """Lets `rate` calls a second pass, and up to `burst` of them at once after a pause."""

    def __init__(self, rate: float, burst: int = 1, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        if rate <= 0 or burst < 1:
            raise ValueError("rate is above 0 and burst 1 or more")
        self.rate, self.burst, self.clock, self.sleep = rate, burst, clock, sleep
        self.tokens, self.at = float(burst), clock()

    def take(self) -> None:
        now = self.clock()
        self.tokens, self.at = min(self.burst, self.tokens + (now - self.at) * self.rate), now
        if self.tokens < 1:
            pause = (1 - self.tokens) / self.rate
            self.sleep(pause)
            self.tokens, self.at = 1.0, now + pause
        self.tokens -= 1


class Ledger:
    """Answers by the digest of what was asked, a file each, written by tasks as answers come.

    A task that is run again, on whatever executor, finds what the first one was told. folder: a URI that every executor
    can write, of any file system that pyarrow knows. A file is complete when it has its name.
    """

    def __init__(self, folder: str):
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(folder)

    def _at(self, name: str) -> str:
        return f"{self.root}/{name[:3]}/{name}.json"

    def get(self, name: str) -> str | None:
        try:
            with self.fs.open_input_stream(self._at(name)) as f:
                return json.loads(f.read())["answer"]
        except FileNotFoundError:
            return None

    def put(self, name: str, answer: str, attempt: int = 0) -> None:
        path = self._at(name)
        self.fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        draft = f"{path}.{attempt}.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(draft) as f:
            f.write(json.dumps({"answer": answer}, ensure_ascii=False).encode())
        self.fs.move(draft, path)


def get_oracle(config: dict, truth: DataFrame | None = None, labels: list[str] | None = None):
    kind, params = config.get("type", "simulated"), dict(config.get("params") or {})
    if kind == "simulated":
        if truth is None:
            raise ValueError("a simulated oracle needs the truth")
        return SimulatedOracle(truth)
    if kind == "chat":
        return ChatOracle(labels or [], **params)
    raise ValueError(f"unknown oracle {kind!r}; known: simulated, chat")
