"""Model backends: text generation as a batch operator over distinct prompts.

A backend takes a batch of prompts and gives (text, confidence, status) for each.
generate() sends every distinct prompt once and joins the answers back by prompt,
so a lost or reordered answer can't land on another row.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
import time
import urllib.request
import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .tables import exists, listed

#: Own wording of the tasks.
TEMPLATES = {
    "infill": "Passages:\n<<evidence>>\n\nReplace the blank in this text by a short phrase: <<query>>\nBlank:",
    "verify": "Passages:\n<<evidence>>\n\nDo the passages support this statement? Answer true or false.\n<<claim>>",
    "answer": "Passages:\n<<evidence>>\n\nAnswer briefly: <<question>>",
    "question": "Ask for the missing part of: <<triple>>",
    "latent": "Name the unknown entities of the question, one per line, as (ENTn) [SEP] is [SEP] description.\n# Question: <<question>>",
    "triples": "Unknown entities:\n<<latent>>\nGive the facts that the question states, one per line, as subject [SEP] relation [SEP] object.\n# Question: <<question>>",
    "single_step": "Give the unknown entities, then the facts of the question.\n# Question: <<question>>",
    "cot_with_triples": "Reason step by step after '# Reasoning:', then list the unknown entities after '# Latent Entities:' and the facts after '# Triples:'.\n# Question: <<question>>",
    "cot": "Think step by step, then answer.\n# Question: <<question>>\n# Reasoning:",
    "cot_triples": "Give the facts of this reasoning, one per line.\n<<reasoning>>",
    "document_triples": "Give the facts of this passage, one per line.\n<<document>>",
    "agent": "Reason inside <think>, ask for passages by <search> query </search>, end by <answer>.\n# Question: <<question>>",
    "nudge": "Say in one line what to find out first.\n# Question: <<question>>",
}
SCHEMA = "prompt string, text string, confidence double, status string"


@dataclass(frozen=True)
class Backend:
    """Anything with generate(prompts) -> [(text, confidence, status)]; made once per worker."""

    max_new_tokens: int = 256

    def generate(self, prompts: list[str]) -> list[tuple[str | None, float | None, str]]:
        raise NotImplementedError


_WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class StubBackend(Backend):
    """Deterministic, from the prompt alone. A statement is true if at least `threshold` of its
    words are in the passages; a blank is the first capitalised run of the passages whose words
    the query lacks; an answer likewise. Confidence: the share of query words in the passages."""

    threshold: float = 0.6

    def generate(self, prompts):
        return [self._one(p) for p in prompts]

    def _one(self, prompt: str):
        passages, _, task = prompt.partition("\n\n")
        task = task or passages
        known = {w.lower() for w in _WORD.findall(passages)}
        words = [w.lower() for w in _WORD.findall(task.split(":", 1)[-1].split("\n", 1)[-1] if "true or false" in task else task)]
        share = sum(w in known for w in words) / len(words) if words else 0.0
        if "true or false" in task:
            return ("true" if share >= self.threshold else "false"), share, "ok"
        asked = set(words)
        for run in re.findall(r"[A-Z]\w+(?: [A-Z]\w+)*", passages.partition("\n")[2] or passages):
            if not {w.lower() for w in run.split()} & asked:
                return run, share, "ok"
        return "", share, "ok"


@dataclass(frozen=True)
class LineBackend(Backend):
    """Deterministic, for tests and demonstrations: the prompt's line at `line` (from the end if negative) after
    `drop`; as_triples: all lines but the first as triples of their words. Confidence: 1 / words of the answer."""

    line: int = -1
    drop: str = ""
    as_triples: bool = False

    def generate(self, prompts):
        return [self._one(p) for p in prompts]

    def _one(self, prompt: str):
        lines = prompt.split("\n")
        if self.as_triples:
            words = [x.split(" ") for x in lines[1:]]
            text = "\n".join(f"{w[0]} [SEP] {w[1]} [SEP] {' '.join(w[2:])}" for w in words if len(w) > 2)
        else:
            text = lines[self.line].removeprefix(self.drop) if -len(lines) <= self.line < len(lines) else ""
        return text, 1 / max(1, len(text.split(" "))), "ok"


@dataclass(frozen=True)
class HttpBackend(Backend):
    """A chat-completions endpoint of the user's; there is no default address. Failures and timeouts (K7) become a status."""

    url: str = ""
    model: str = ""
    key: str = ""
    temperature: float = 0.0
    top_p: float = 1.0
    system: str | None = None
    timeout_s: float = 300.0

    def generate(self, prompts):
        return [self._one(p) for p in prompts]

    def _body(self, prompt: str) -> dict:
        messages = ([{"role": "system", "content": self.system}] if self.system else []) + [{"role": "user", "content": prompt}]
        return {"model": self.model, "messages": messages, "max_tokens": self.max_new_tokens, "temperature": self.temperature, "top_p": self.top_p}

    def _headers(self) -> dict:
        return {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"}

    def _text(self, answer: dict) -> str:
        return answer["choices"][0]["message"]["content"]

    def _one(self, prompt):
        try:
            return self._text(_call(self.url, self._body(prompt), self._headers(), self.timeout_s)), None, "ok"
        except Exception as e:  # noqa: BLE001
            return None, None, f"error: {e}"[:200]


@dataclass(frozen=True)
class MessagesBackend(HttpBackend):
    """An endpoint of the messages format: the system prompt stands beside the messages, the answer is a list of blocks."""

    version: str = "2023-06-01"
    system: str | None = "Answer exactly in the format that is asked for, without further words."

    def _body(self, prompt):
        return {"model": self.model, "system": self.system or "", "messages": [{"role": "user", "content": prompt}], "max_tokens": self.max_new_tokens, "temperature": self.temperature}

    def _headers(self):
        return {"Content-Type": "application/json", "x-api-key": self.key, "anthropic-version": self.version}

    def _text(self, answer):
        return answer["content"][0]["text"]


@dataclass(frozen=True)
class BatchBackend(HttpBackend):
    """Prompts of a batch as one file of requests, sent to `url` (the API's root), polled until it ends, answers
    joined by request id (Q16). Requests that the error file names, or that are missing, get its status."""

    poll_s: float = 30.0
    endpoint: str = "/v1/chat/completions"

    def generate(self, prompts):
        lines = [json.dumps({"custom_id": f"request-{i}", "method": "POST", "url": self.endpoint, "body": self._body(p)}) for i, p in enumerate(prompts)]
        try:
            done = self._run("\n".join(lines).encode())
        except Exception as e:  # noqa: BLE001
            return [(None, None, f"error: {e}"[:200])] * len(prompts)
        return [done.get(f"request-{i}", (None, None, "error: no answer")) for i in range(len(prompts))]

    def _run(self, content: bytes) -> dict:
        edge = uuid.uuid4().hex
        parts = f'--{edge}\r\nContent-Disposition: form-data; name="purpose"\r\n\r\nbatch\r\n--{edge}\r\nContent-Disposition: form-data; name="file"; filename="requests.jsonl"\r\nContent-Type: application/jsonl\r\n\r\n'
        head = self._headers()
        file = _call(f"{self.url}/v1/files", parts.encode() + content + f"\r\n--{edge}--\r\n".encode(), head | {"Content-Type": f"multipart/form-data; boundary={edge}"}, self.timeout_s)
        job = _call(f"{self.url}/v1/batches", {"input_file_id": file["id"], "endpoint": self.endpoint, "completion_window": "24h"}, head, self.timeout_s)
        end = time.monotonic() + self.timeout_s
        while job["status"] not in ("completed", "failed", "expired", "cancelled"):
            if time.monotonic() > end:
                raise TimeoutError(f"batch {job['id']} is {job['status']}")
            time.sleep(self.poll_s)
            job = _call(f"{self.url}/v1/batches/{job['id']}", None, head, self.timeout_s)
        if job["status"] != "completed":
            raise RuntimeError(f"batch {job['id']} is {job['status']}")
        out = {}
        for which in ("error_file_id", "output_file_id"):
            raw = _call(f"{self.url}/v1/files/{job[which]}/content", None, head, self.timeout_s, raw=True) if job.get(which) else b""
            for x in map(json.loads, filter(None, raw.decode().split("\n"))):
                good = which == "output_file_id" and x.get("response", {}).get("status_code", 200) == 200
                out[x["custom_id"]] = (self._text(x["response"]["body"]), None, "ok") if good else (None, None, f"error: {x.get('error') or x.get('response')}"[:200])
        return out


def _call(url: str, body, headers: dict, timeout: float, raw: bool = False):
    data = json.dumps(body).encode() if isinstance(body, dict) else body
    with urllib.request.urlopen(urllib.request.Request(url, data, headers), timeout=timeout) as answer:
        return answer.read() if raw else json.load(answer)


@lru_cache(maxsize=2)
def _local(kind: str, path: str):
    """Tokenizer and model of a local folder, loaded once a worker. Needs torch and transformers."""
    import torch
    import transformers

    tokenizer = transformers.AutoTokenizer.from_pretrained(path)
    model = getattr(transformers, kind).from_pretrained(path, torch_dtype="auto", device_map="auto")
    return torch, tokenizer, model


@dataclass(frozen=True)
class CausalBackend(Backend):
    """A local causal model; greedy unless a temperature is given. stop: R11, generation is cut at these."""

    path: str = ""
    temperature: float = 0.0
    top_p: float = 1.0
    system: str | None = None
    stop: tuple[str, ...] = ()

    def generate(self, prompts):
        try:
            _, tokenizer, model = _local("AutoModelForCausalLM", self.path)
        except Exception as e:  # noqa: BLE001
            return [(None, None, f"error: {e}"[:200])] * len(prompts)
        return [self._one(tokenizer, model, p) for p in prompts]

    def _one(self, tokenizer, model, prompt):
        messages = ([{"role": "system", "content": self.system}] if self.system else []) + [{"role": "user", "content": prompt}]
        try:
            text = tokenizer.apply_chat_template(messages, tokenize=False, add_generation_prompt=True)
            given = tokenizer([text], return_tensors="pt").to(model.device)
            how = {"do_sample": True, "temperature": self.temperature, "top_p": self.top_p} if self.temperature > 0 else {"do_sample": False}
            out = model.generate(**given, max_new_tokens=self.max_new_tokens, **how)
            return cut_text(tokenizer.batch_decode(out[:, given["input_ids"].shape[1] :], skip_special_tokens=True)[0], self.stop), None, "ok"
        except Exception as e:  # noqa: BLE001
            return None, None, f"error: {e}"[:200]


@dataclass(frozen=True)
class Seq2SeqBackend(Backend):
    """A local sequence-to-sequence model; confidence is the mean probability of the tokens that it picked."""

    path: str = ""

    def generate(self, prompts):
        try:
            torch, tokenizer, model = _local("AutoModelForSeq2SeqLM", self.path)
        except Exception as e:  # noqa: BLE001
            return [(None, None, f"error: {e}"[:200])] * len(prompts)
        out = []
        for p in prompts:
            given = tokenizer(p, return_tensors="pt").to(model.device)
            got = model.generate(**given, max_new_tokens=self.max_new_tokens, return_dict_in_generate=True, output_scores=True)
            picked = [int(x) for x in got.sequences[0][1:]]
            shares = [softmax_pick(row[0].tolist(), k) for row, k in zip(got.scores, picked, strict=False)]
            out.append((tokenizer.decode(got.sequences[0], skip_special_tokens=True), sum(shares) / len(shares) if shares else None, "ok"))
        return out


def softmax_pick(logits: list[float], k: int) -> float:
    """the probability of the k-th of a token's logits."""
    top = max(logits)
    return math.exp(logits[k] - top) / sum(math.exp(x - top) for x in logits)


def token_confidence(tokens: DataFrame, key: str = "id") -> DataFrame:
    """A10, F20 on a table (key, pos, logits array): a token's probability is the softmax of its largest logit; the mean by key."""
    top = F.array_max("logits")
    share = 1 / F.aggregate("logits", F.lit(0.0), lambda a, x: a + F.exp(x.cast("double") - top.cast("double")))
    return tokens.groupBy(key).agg(F.avg(share).alias("confidence"), F.count("*").alias("n_tokens"))


def cut_text(text: str, stops: tuple[str, ...]) -> str:
    """Up to and with the stop sequence that ends first."""
    ends = [text.find(x) + len(x) for x in stops if x in text]
    return text[: min(ends)] if ends else text


#: Name prefix -> backend
REGISTRY: dict[str, Callable[..., Backend]] = {"stub": StubBackend, "line": LineBackend, "gpt": HttpBackend, "batch": BatchBackend, "claude": MessagesBackend, "qwen": CausalBackend, "seq2seq": Seq2SeqBackend}


def backend(name: str, **options) -> Backend:
    """Options that a backend doesn't know are left out, so that one configuration fits all; `model` is the name by default."""
    for prefix, make in REGISTRY.items():
        if name.lower().startswith(prefix):
            return make(**{k: v for k, v in ({"model": name} | options).items() if k in make.__dataclass_fields__})
    raise ValueError(f"no backend for {name}")


def _called(prompts: DataFrame, model: Backend, batch: int) -> DataFrame:
    """prompts (prompt) -> SCHEMA."""

    def run(batches):
        for b in batches:
            prompts = b.column(0).to_pylist()
            for i in range(0, len(prompts), batch):
                part = prompts[i : i + batch]
                got = model.generate(part)
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *(pa.array([g[k] for g in got], t) for k, t in enumerate((pa.string(), pa.float64(), pa.string())))], names=["prompt", "text", "confidence", "status"])

    return prompts.mapInArrow(run, SCHEMA)


def generate(rows: DataFrame, model: Backend, prompt: str = "prompt", batch: int = 256) -> DataFrame:
    """rows and text, confidence, status. Put the result in a table before using it twice."""
    prompts = rows.select(F.col(prompt).alias("prompt")).where("prompt is not null").distinct()
    answers = model.answers(prompts, batch) if isinstance(model, Stored) else _called(prompts, model, batch)
    return rows.join(answers.withColumnRenamed("prompt", prompt), prompt, "left")


@dataclass(frozen=True)
class Stored(Backend):
    """Another backend's answers, kept by prompt under a folder, so that a run that dies repeats at most a part of its calls.

    Prompts are dealt to `parts` by their hash; a part's answers are a table that is written whole or not at all, and only prompts that no table has
    are asked. Failed calls aren't kept. Answers lie under the fingerprint of the backend and its options, keys aside, so those of
    another model are never taken for this one's."""

    inner: Backend | None = None
    path: str = ""
    parts: int = 16

    def folder(self) -> str:
        options = {k: v for k, v in sorted(vars(replace(self.inner, max_new_tokens=self.max_new_tokens)).items()) if k != "key"}
        return f"{self.path.rstrip('/')}/{hashlib.sha256(repr((type(self.inner).__name__, options)).encode()).hexdigest()[:16]}"

    def _known(self, spark: SparkSession) -> DataFrame:
        folder = self.folder()
        done = [f"{folder}/{n}" for n in listed(spark, folder) if exists(spark, f"{folder}/{n}/_SUCCESS")]
        return spark.read.schema(SCHEMA).parquet(*done) if done else spark.createDataFrame([], SCHEMA)

    def answers(self, prompts: DataFrame, batch: int) -> DataFrame:
        """prompts (prompt), each once -> SCHEMA."""
        spark, model = prompts.sparkSession, replace(self.inner, max_new_tokens=self.max_new_tokens)
        known = self._known(spark).where("status = 'ok'")
        part = F.pmod(F.xxhash64("prompt"), F.lit(self.parts))
        left = prompts.join(known.select("prompt"), "prompt", "left_anti").withColumn("part", part)
        failed = None
        for k in [r[0] for r in left.select("part").distinct().orderBy("part").collect()]:  # at most `parts`
            path = f"{self.folder()}/{k:04d}-{uuid.uuid4().hex}"
            _called(left.where(F.col("part") == k).select("prompt"), model, batch).write.parquet(path)
            bad = spark.read.schema(SCHEMA).parquet(path).where("status <> 'ok'")
            failed = bad if failed is None else failed.unionByName(bad)
        good = self._known(spark).where("status = 'ok'").join(prompts, "prompt", "left_semi")
        return good if failed is None else good.unionByName(failed)


def _prompted(task: str, **values) -> Column:
    """the task's template; without evidence the part up to the empty line goes."""
    full = T.prompt(TEMPLATES[task], **values)
    if "evidence" not in values:
        return full
    bare = T.prompt(TEMPLATES[task].split("\n\n", 1)[1], **{k: v for k, v in values.items() if k != "evidence"})
    return F.when(F.coalesce(values["evidence"], F.lit("")) == "", bare).otherwise(full)


def infill(rows: DataFrame, model: Backend) -> DataFrame:
    """M1: rows (query, evidence, fallback) -> infilled, confidence, status."""
    asked = rows.withColumn("prompt", _prompted("infill", evidence=F.col("evidence"), query=F.col("query")))
    return generate(asked, replace(model, max_new_tokens=32)).withColumn("infilled", T.infill_text(F.col("text"), F.col("fallback"))).drop("prompt", "text")


def verify(rows: DataFrame, model: Backend) -> DataFrame:
    """M2: rows (claim, evidence) -> supported, confidence, status."""
    asked = rows.withColumn("prompt", _prompted("verify", evidence=F.col("evidence"), claim=F.col("claim")))
    return generate(asked, replace(model, max_new_tokens=8)).withColumn("supported", F.when(F.col("status") == "ok", T.boolean_answer(F.col("text"), F.col("prompt")))).drop("prompt", "text")


def answer(rows: DataFrame, model: Backend, limit: int = 40_000) -> DataFrame:
    """M3, M6: rows (question, evidence) -> predicted_answer, confidence, status."""
    asked = rows.withColumn("prompt", _prompted("answer", evidence=F.substring("evidence", 1, limit), question=F.col("question")))
    return generate(asked, model).withColumn("predicted_answer", F.coalesce(T.strip(F.col("text")), F.lit(""))).drop("prompt", "text")


def ask(rows: DataFrame, model: Backend) -> DataFrame:
    """M4: a question for each triple."""
    asked = rows.withColumn("prompt", _prompted("question", triple=T.sentence(F.col("triple"))))
    return generate(asked, model).withColumn("generated_question", T.question_mark(F.coalesce(F.col("text"), F.lit("")))).drop("prompt", "text")


@dataclass(frozen=True)
class HttpRetriever:
    """A search service of the user's: POST {queries, topk, return_scores}, an answer {result: [[{document: {contents}, score}]]}."""

    url: str
    timeout_s: float = 30.0

    def search(self, queries: list[str], top_k: int) -> list[list[tuple[str, float]]]:
        got = _call(self.url, {"queries": queries, "topk": top_k, "return_scores": True}, {"Content-Type": "application/json"}, self.timeout_s)
        return [[(x["document"]["contents"], float(x.get("score", 0.0))) for x in hits] for hits in got["result"]]


def retrieve(queries: DataFrame, retriever: HttpRetriever, top_k: int = 5, batch: int = 32) -> DataFrame:
    """Queries (qid, query) -> (qid, rank, contents, score, status); each distinct query is asked once. A failed
    batch gives a row of null contents and its status for each of its queries."""

    def run(batches):
        for b in batches:
            texts = b.column(0).to_pylist()
            for i in range(0, len(texts), batch):
                part, rows = texts[i : i + batch], []
                try:
                    for q, hits in zip(part, retriever.search(part, top_k), strict=True):
                        rows += [(q, k, c, x, "ok") for k, (c, x) in enumerate(hits[:top_k])]
                except Exception as e:  # noqa: BLE001
                    rows = [(q, 0, None, None, f"error: {e}"[:200]) for q in part]
                kinds = (pa.string(), pa.int32(), pa.string(), pa.float64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["query", "rank", "contents", "score", "status"])

    found = queries.select("query").where("query is not null").distinct().mapInArrow(run, "query string, rank int, contents string, score double, status string")
    return queries.select("qid", "query").join(found, "query").select("qid", "rank", "contents", "score", "status")
