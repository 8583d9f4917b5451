import io
import json
import shutil
from dataclasses import dataclass
from pathlib import Path
from typing import ClassVar
from urllib.error import HTTPError, URLError

import pytest

import lettermill
from lettermill.config import StudyConfig, api_key
from lettermill.operators.model import PARAMETER_GRID
from lettermill.plans import study
from lettermill.sources import transport
from lettermill.sources.files import Files
from lettermill.sources.transport import HttpTransport
from lettermill.streaming import ledger_stream


def message(i, body, kind="text/plain"):
    return f"From: s{i}@example.org\nTo: r@example.com\nSubject: note {i}\nContent-Type: {kind}\n\n{body}\n".encode()


TOPICS = {
    "enron": "please find the quarterly gas trading schedule attached and confirm the storage volumes with the desk before friday number {i}",
    "spamassassin": "the mailing list discussed kernel patches and a new release of the compiler with many small fixes in version {i}",
    "nazario": "your account was limited verify your password at the secure page at once or lose access to the bank case {i}",
    "phishingpot": "urgent invoice payment failed update the billing details now to avoid suspension of the mailbox ticket {i}",
}


@pytest.fixture(scope="module")
def config(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("study")
    config = StudyConfig(root, source_cap=12, reserve_per_source=2, bootstrap_replicates=20)
    with pytest.raises(FileNotFoundError, match="Enron"):
        config.validate_raw_layout(spark)
    for path in config.raw_layout().values():
        Path(path).mkdir(parents=True)
    words = "alpha bravo carol delta eagle fancy giant hotel india joker kilo lemon mango north oscar papa quest romeo sugar tango uncle victor whisky xray yankee zulu".split()
    extra = lambda i: " ".join(words[(i * 7 + k * k * 3) % 26] + str(i * k) for k in range(20))
    body = lambda s, i: TOPICS[s].format(i=i) + " " + extra(i)
    layout = {name: Path(path) for name, path in config.raw_layout().items()}
    for i in range(15):
        own = layout["Enron"] / f"user{i % 3}" / "inbox"
        own.mkdir(parents=True, exist_ok=True)
        (own / f"{i}.").write_bytes(message(i, body("enron", i if i < 14 else 3)))
        (layout["SpamAssassin easy_ham"] / f"{i:05}.{i:032x}").write_bytes(message(i, body("spamassassin", i)))
        (layout["PhishingPot"] / f"sample-{i}.eml").write_bytes(message(i, f"<p>{body('phishingpot', i)}</p><a href='http://x.example/verify'>go</a>", "text/html"))
    (layout["SpamAssassin hard_ham"] / "cmds").write_bytes(b"no mail")
    (layout["Nazario"] / "README.txt").write_bytes(b"no mail")
    (layout["Nazario"] / "box.mbox").write_bytes(b"".join(b"From x@y Mon\n" + message(i, body("nazario", i)) + b"\n" for i in range(15)))
    Path(config.prompt_path).parent.mkdir()
    Path(config.prompt_path).write_text("You classify mail.\n")
    return config


@pytest.fixture(scope="module")
def prepared(spark, config):
    return lettermill.prepare_data(spark, config, full_raw_audit=True)


@pytest.fixture(scope="module")
def nlp(spark, config, prepared):
    return lettermill.run_nlp_study(spark, config, PARAMETER_GRID[:2])


def test_paths(spark, tmp_path):
    config = StudyConfig(f"file://{tmp_path}/")
    assert (config.seed, config.source_cap, config.reserve_per_source, config.bootstrap_replicates) == (20260808, 4000, 500, 10000)
    config.ensure_directories(spark)
    assert (tmp_path / "artifacts" / "data").is_dir() and config.zero_shot_dir != config.retrieval_dir
    files = Files(spark)
    for text in ("one é", "two"):
        files.write_json(config.at("a", "b.json"), {"t": text})
        assert files.read_json(config.at("a", "b.json")) == {"t": text}
    assert [x.name for x in (tmp_path / "a").iterdir() if not x.name.startswith(".")] == ["b.json"]
    with pytest.raises(FileNotFoundError):
        files.read_text(config.at("none"))


def test_key_lookup(tmp_path, monkeypatch):
    monkeypatch.delenv("OPENAI_API_KEY", raising=False)
    with pytest.raises(RuntimeError, match="not configured"):
        api_key(tmp_path / ".env")
    (tmp_path / ".env").write_text("OTHER=x\nOPENAI_API_KEY= from-file \n")
    assert api_key(tmp_path / ".env") == "from-file"
    monkeypatch.setenv("OPENAI_API_KEY", "from-environment")
    assert api_key(tmp_path / ".env") == "from-environment"


class Opened(io.BytesIO):
    """A response that notes what was asked."""

    asked: ClassVar[list] = []

    @classmethod
    def saying(cls, body):
        def opener(request, timeout):
            cls.asked.append((request, timeout))
            if isinstance(body, Exception):
                raise body
            return cls(body)

        return opener


def refusal(code, body=b""):
    return HTTPError("u", code, "m", {}, io.BytesIO(body))


def test_transport_without_a_network():
    whole = {"id": "i", "model": "gpt-5-nano-1", "choices": [{"message": {"content": "{}"}}], "usage": {"prompt_tokens": 9, "completion_tokens": 2, "prompt_tokens_details": {"cached_tokens": 4}}}
    answer = HttpTransport("k", Opened.saying(json.dumps(whole).encode())).complete_chat({"é": 1}, request_key="key")
    assert answer == transport.Answer("i", "gpt-5-nano-1", "{}", 9, 4, 2)
    request, seconds = Opened.asked[-1]
    assert (request.get_method(), request.get_header("Idempotency-key"), request.get_header("Authorization"), seconds, request.data) == ("POST", "key", "Bearer k", 60, '{"é": 1}'.encode())
    send = lambda body: HttpTransport("k", Opened.saying(body)).complete_chat({}, request_key="x")
    told = json.dumps({"error": {"type": "rate <limit>", "code": "c" * 100, "message": "secret text"}}).encode()
    for error in (refusal(429, told), refusal(503), URLError("down"), TimeoutError()):
        with pytest.raises(transport.RetryableTransportError) as found:
            send(error)
        assert "secret" not in str(found.value)
    with pytest.raises(transport.RequestError, match=r"HTTP 400 \(type=ratelimit, code=c{80}\)"):
        send(refusal(400, told))
    for body in (b"[]", b"not json", json.dumps(whole | {"choices": []}).encode(), json.dumps(whole | {"choices": [{"message": {"content": None}}]}).encode(), b'"x"'):
        with pytest.raises(RuntimeError, match="envelope"):
            send(body)
    with pytest.raises(ValueError, match="empty"):
        HttpTransport(" ")


def test_data_set(spark, config, prepared):
    assert prepared["status"] == "rebuilt" and prepared["pool"]["selected_per_source"] == 12
    assert prepared["raw_audit"]["sources"]["enron"]["files"] == 15 and len(prepared["raw_audit"]["sources"]["nazario"]["manifest_sha256"]) == 64
    split = spark.read.parquet(config.table("split-manifest"))
    assert split.count() == 48 == split.select("sample_id").distinct().count()
    assert split.groupBy("similarity_group_id").agg({"split": "count"}).count() == split.select("similarity_group_id", "split").distinct().count()
    for name, version in (("detector-input-v1", "v1"), ("detector-input-v2", "v2")):
        rows = spark.read.parquet(config.table(name))
        assert rows.count() == 48 and rows.where(f"representation_version like '%{version}%'").count() == 48
    assert spark.read.parquet(config.table("detector-input-v2")).where("detector_input_text like '%HTML link count: 1%PATH_VERIFY%'").count() == 12
    assert lettermill.prepare_data(spark, config)["status"] == "reused"


def test_nlp_study(spark, config, nlp):
    assert nlp["selected_representation"] == "v1.0" and nlp["test_metrics"]["n"] == 8
    assert set(nlp["paired_validation_bootstrap"]["paired_difference"]) == {"v2.0_minus_v1.0"}
    assert json.loads(Path(config.nlp_dir, "top-features.json").read_text())["phishing"]


@dataclass
class Answer:
    content: str
    resolved_model: str = "gpt-5-nano-x"
    provider_request_id: str = "id"
    input_tokens: int = 20
    cached_input_tokens: int = 5
    output_tokens: int = 3


class Fake:
    def __init__(self, *script):
        self.script, self.sent = list(script), []

    def complete_chat(self, request, *, request_key):
        self.sent.append((request, request_key))
        got = self.script.pop(0) if self.script else valid(request)
        if isinstance(got, Exception):
            raise got
        return got


def valid(request):
    bad = "account" in request["messages"][-1]["content"].rsplit("<email>", 1)[1] or "invoice" in request["messages"][-1]["content"].rsplit("<email>", 1)[1]
    value = {"label": "phishing" if bad else "legitimate", "phishing_probability": 0.9 if bad else 0.1, "indicators": [{"type": "other", "evidence": "e"}], "reason": "r", "warning": "w" if bad else ""}
    return Answer(json.dumps(value))


def test_batches(spark, config, nlp, tmp_path):
    run = lambda t, **k: lettermill.run_zero_shot_batch(spark, config, t, **({"authorised": True, "max_new_cases": 3} | k))
    with pytest.raises(PermissionError):
        run(Fake(), authorised=False)
    with pytest.raises(ValueError, match="positive"):
        run(Fake(), max_new_cases=0)
    first = run(Fake(Answer("{}"), study.RetryableTransportError("down")), max_new_cases=1)
    assert (first["status"], first["accepted_samples"]) == ("transport_error", 0)
    assert (second := run(Fake()))["status"] == "batch_limit" and second["accepted_samples"] == 3
    spent = run(Fake(Answer("not json"), Answer("{}")), max_new_cases=1)
    assert spent["exhausted_samples"] == 1
    done = run(Fake(), max_new_cases=100, retry_exhausted=True)
    assert done["status"] == "complete" and done["metrics"]["n"] == 8 and done["bootstrap"]["replicates"] == 20
    silent = Fake()
    assert run(silent)["status"] == "complete" and not silent.sent
    lines = [json.loads(x.read_text()) for x in Path(config.zero_shot_dir, "ledger.jsonl").glob("*.json")]
    assert len({x["request_key"] for x in lines}) >= len(lines) - 1
    assert any(x["retry_round"] == 2 and x["authorised_retry"] for x in lines)
    with pytest.raises((FileNotFoundError, ValueError), match="retrieved"):
        lettermill.load_complete_test_comparison(spark, config)
    wrong = lettermill.run_retrieval_four_shot_batch(spark, config, Fake(Answer("x", resolved_model="other")), authorised=True)
    assert (wrong["status"], wrong["new_cases_this_invocation"]) == ("model_mismatch", 1)
    shutil.rmtree(Path(config.retrieval_dir, "ledger.jsonl"))
    whole = lettermill.run_retrieval_four_shot_batch(spark, config, Fake(), authorised=True)
    assert whole["status"] == "complete" and whole["retrieval"]["targets"] == 8 and whole["retrieval"]["examples"] == 32
    assert len(lettermill.load_complete_test_comparison(spark, config)) == 3
    request = lettermill.preview_retrieval_four_shot_request(spark, config)
    shown = request["messages"][1]["content"]
    assert shown.count("<example index=") == 4 and "enron" not in shown
    with pytest.raises(KeyError):
        lettermill.preview_retrieval_four_shot_request(spark, config, "nobody")
    with pytest.raises(ValueError, match="another|different"):
        study.read_ledger(spark, f"{config.zero_shot_dir}/ledger.jsonl", "p")
    Path(config.zero_shot_dir, "ledger.jsonl", "z.json").write_text("{oops\n")
    with pytest.raises(ValueError, match="invalid ledger"):
        study.read_ledger(spark, f"{config.zero_shot_dir}/ledger.jsonl", "p").count()


def test_batches_refuse_wrong_token_counts(spark, config, nlp):
    """The retrieved run, started anew: answers with impossible token counts stop it and leave no record."""
    shutil.rmtree(Path(config.retrieval_dir, "ledger.jsonl"), ignore_errors=True)
    for answer, why in ((Answer("{}", input_tokens=-1), "negative"), (Answer("{}", cached_input_tokens=21), "cached")):
        with pytest.raises(ValueError, match=why):
            lettermill.run_retrieval_four_shot_batch(spark, config, Fake(answer), authorised=True)
    assert not list(Path(config.retrieval_dir).glob("ledger.jsonl/*.json"))


def test_a_long_prompt_is_an_error(spark, config, nlp, monkeypatch):
    from lettermill.functions import prompts

    lettermill.build_retrieval_manifest(spark, config)
    monkeypatch.setattr(prompts, "MAX_PROMPT_CHARACTERS", 900)
    with pytest.raises(ValueError, match="900-character limit"):
        lettermill.preview_retrieval_four_shot_request(spark, config)


def test_failing_mails_are_listed(spark, config, prepared, tmp_path):
    """A mail that can't be parsed is a line in the file of failures, and the build goes on."""
    root = tmp_path / "copy"
    shutil.copytree(Path(config.root) / "data", root / "data")
    for i in range(3):
        (root / "data" / "raw" / "PhishingPot" / "PhishingPot" / f"bad{i}.eml").write_bytes(b"Content-Type: text/plain; charset=nonsense\n\nabc")
    again = StudyConfig(root, source_cap=12, reserve_per_source=6, bootstrap_replicates=20)
    assert lettermill.prepare_data(spark, again)["pool"]["failures"] == 3
    rows = spark.read.json(f"{again.data_dir}/processing-failures.jsonl").collect()
    assert {r.error_type for r in rows} == {"LookupError"} and len(rows) == 3


def test_streamed_ledger(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put = lambda n, *rows: (tmp_path / "in" / f"{n}.json").write_text("".join(json.dumps({"sample_id": s, "status": t}) + "\n" for s, t in rows))
    put(1, ("a", "rejected"), ("a", "transport_error"), ("b", "accepted"))
    for _ in range(2):
        states = ledger_stream.attempts(ledger_stream.read(spark, str(tmp_path / "in"), 1))
        ledger_stream.write_states(states, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
        put(2, ("a", "accepted"))
    got = {r.sample_id: (r.used, r.accepted) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"a": (2, 1), "b": (1, 1)}
