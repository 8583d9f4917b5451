"""The study from raw mail to compared classifiers, step by step.

Every step reads and writes tables in the study's folders, on any store that Spark reaches, and can be run again; finished
tables are used as they are. Tables are made by Spark; the driver holds summaries, and the messages of a batch
where it sends them one by one.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.config import LABEL_NAMES, SOURCES, StudyConfig
from lettermill.functions import mail, prompts, text
from lettermill.functions.language import detect
from lettermill.operators import bootstrap, compare, ledger, metrics, model, pool, simhash, split, tfidf
from lettermill.session import materialize
from lettermill.sources import raw
from lettermill.sources.files import Files
from lettermill.sources.transport import ChatTransport, HttpTransport, RetryableTransportError

TABLES = ("canonical", "candidate-pool", "similarity-edges", "split-manifest", "detector-input-v1", "detector-input-v2")
REPRESENTATIONS = {"v1.0": "detector-input-v1", "v2.0": "detector-input-v2"}
#: Position, source and label of the examples of a four-shot prompt.
SOURCE_PLAN = [(1, "enron", 0), (2, "nazario", 1), (3, "spamassassin", 0), (4, "phishingpot", 1)]
RETRIEVAL_SETTINGS = {
    "lowercase": True, "strip_accents": "unicode", "sublinear_tf": True, "ngram_range": [1, 1], "min_df": 1, "similarity": "cosine", "candidate_split": "train",
    "examples_per_target": 4, "tie_break": "lowest sample_id",
}


def _read(spark: SparkSession, config: StudyConfig, name: str) -> DataFrame:
    return spark.read.parquet(config.table(name))


def _write(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def _digest(df: DataFrame) -> str:
    """A digest of a table's rows, in whatever order and files they lie."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring(row, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")) for i in range(8)]
    got = df.agg(F.count(F.lit(1)), *parts).first()
    return hashlib.sha256(":".join(map(str, got)).encode()).hexdigest()


def audit_raw(spark: SparkSession, config: StudyConfig, full: bool = False) -> dict:
    """Files and bytes of each source; with full, digests of all paths and contents."""
    config.validate_raw_layout(spark)
    parts = [raw.files(spark, config.raw_root, s).withColumn("source", F.lit(s)) for s in SOURCES]
    rows = reduce(DataFrame.unionByName, parts)
    found = {r.source: {"files": r.files, "bytes": r.bytes} for r in raw.audit(rows).collect()}
    if full:
        for r in raw.manifest_digest(rows.select("source", "source_path", F.sha2("content", 256).alias("sha"))).collect():
            found[r.source]["manifest_sha256"] = r.manifest_sha256
    return {"generated_at_utc": datetime.now(UTC).isoformat(), "full": full, "sources": found}


def prepare_data(spark: SparkSession, config: StudyConfig, *, force: bool = False, full_raw_audit: bool = False, names: mail.Recogniser = mail.no_names, language: mail.Detector | None = detect) -> dict:
    """Make all data tables in order, or use those that are there."""
    config.ensure_directories(spark)
    raw_audit = audit_raw(spark, config, full_raw_audit)
    files = Files(spark)
    files.write_json(f"{config.data_dir}/raw-audit.json", raw_audit)
    if not force and all(files.exists(config.table(t)) for t in TABLES):
        return {
            "status": "reused", "raw_audit": raw_audit, "split": files.read_json(f"{config.data_dir}/split-manifest.audit.json"),
            "representations": {"rows": _read(spark, config, "detector-input-v2").count()},
        }
    audit = {"status": "rebuilt", "raw_audit": raw_audit, "pool": _pool(spark, config, names, language), "similarity": _similarity(spark, config), "split": _split(spark, config), "representations": _represent(spark, config)}
    files.write_json(f"{config.data_dir}/data-audit.json", audit)
    return audit


def _pool(spark: SparkSession, config: StudyConfig, names: mail.Recogniser, language: mail.Detector | None) -> dict:
    parts = [raw.messages(spark, config.raw_root, s, config.seed) for s in SOURCES]
    rows = reduce(DataFrame.unionByName, parts).withColumn("raw_sha256", F.sha2("raw_email", 256))
    rows = rows.withColumn("sample_id", text.sample_id(F.col("source"), F.col("source_path"), F.col("source_message_index"), F.col("raw_sha256")))
    parsed = materialize(mail.parse_messages(rows, names, language).withColumn("content_sha256", text.content_digest(F.col("subject"), F.col("body_text"))), "parsed")
    rejected = pool.rejection(F.col("body_source") == "missing", F.col("language_cohort") == "english_main", F.col("error_type").isNotNull())
    slim = parsed.select("sample_id", "source", F.col("corpus_label").alias("label"), F.col("content_sha256").alias("content"), "ord", rejected.alias("rejected"))
    found = pool.candidates(slim, list(SOURCES), config.source_cap + config.reserve_per_source)
    ranked = materialize(pool.balanced(found.accepted, list(SOURCES), config.source_cap), "ranked")
    group = text.duplicate_group_id(F.col("content"))
    manifest = ranked.select("sample_id", "source", F.col("label").alias("corpus_label"), group.alias("duplicate_group_id"), "candidate_rank_within_source", "pool_status", F.lit(config.seed).alias("selection_seed"))
    kept = parsed.join(ranked.select("sample_id"), "sample_id", "left_semi").drop("ord", "error_type", "error")
    detector = {"language_detector_name": F.lit("none" if language is None else "function-words" if language is detect else "injected"), "language_detector_version": F.lit("1"), "parse_status": F.lit("ok"), "duplicate_group_id": text.duplicate_group_id(F.col("content_sha256"))}
    _write(kept.withColumns(detector), config.table("canonical"))
    _write(manifest, config.table("candidate-pool"))
    reasons = materialize(found.reasons, "reasons")
    failed = parsed.where("error_type is not null").join(reasons.where("reason = 'processing_failure'").select("source", "ord"), ["source", "ord"], "left_semi")
    failed.select("source", "source_path", "error_type", "error").write.mode("overwrite").json(f"{config.data_dir}/processing-failures.jsonl")
    counts = reasons.groupBy("source", "reason").count().collect()
    skipped: dict[str, int] = {}
    scanned: dict[str, int] = {}
    for r in counts:
        scanned[r.source] = scanned.get(r.source, 0) + r["count"]
        if r.reason != "kept":
            skipped[r.reason] = skipped.get(r.reason, 0) + r["count"]
    primary = manifest.where("pool_status = 'primary'").count()
    return {"selected_per_source": primary // len(SOURCES), "primary_total": primary, "pool_total": manifest.count(), "scanned": scanned, "skipped": skipped, "failures": skipped.get("processing_failure", 0)}


def _similarity(spark: SparkSession, config: StudyConfig) -> dict:
    rows = _read(spark, config, "canonical").select("sample_id", "source", "duplicate_group_id", F.concat_ws("\n", "subject", "body_text").alias("text"))
    prints = simhash.fingerprints(rows, "sample_id", F.col("text"))
    place = _read(spark, config, "candidate-pool").select("sample_id", "candidate_rank_within_source", "duplicate_group_id", F.array_position(F.array(*(F.lit(s) for s in SOURCES)), F.col("source")).alias("nth_source"))
    prints = materialize(prints.join(place, "sample_id"), "prints")
    banded = materialize(simhash.bands(prints, "sample_id", F.struct("nth_source", "candidate_rank_within_source")), "banded")
    edges = simhash.edges(banded, "sample_id", "duplicate_group_id")
    _write(edges, config.table("similarity-edges"))
    over = simhash.overflow(prints).first()
    audit = {"method": "token-bigram-simhash64", "candidate_pairs": _read(spark, config, "similarity-edges").count(), **over.asDict()}
    Files(spark).write_json(f"{config.data_dir}/similarity-edges.audit.json", audit)
    return audit


def _split(spark: SparkSession, config: StudyConfig) -> dict:
    members = _read(spark, config, "candidate-pool")
    ids = materialize(simhash.group_ids(members, "sample_id", _read(spark, config, "similarity-edges")), "groups")
    names = _read(spark, config, "canonical").select("sample_id", "corpus_label_name")
    primary = members.where("pool_status = 'primary'").join(ids, "sample_id").join(names, "sample_id")
    primary = materialize(primary, "primary")
    if not simhash.crossing(primary, "source", "corpus_label").isEmpty():
        raise ValueError("a similarity component crosses source or label")
    total = primary.count()
    each = total // len(SOURCES)
    groups = primary.groupBy("source", "similarity_group_id").agg(F.count(F.lit(1)).alias("members"))
    chosen = split.assign(groups, split.apportion(each, config.train_ratio, config.validation_ratio), config.seed)
    name = hashlib.sha256(f"{config.seed}:{each}:{config.train_ratio}:{config.validation_ratio}".encode()).hexdigest()[:16]
    rows = primary.join(groups.select("similarity_group_id", F.col("members").alias("similarity_group_size")), "similarity_group_id").join(chosen, "similarity_group_id")
    rows = rows.select(
        "sample_id", "source", "corpus_label", "corpus_label_name", "duplicate_group_id", "similarity_group_id", "similarity_group_size", "split", F.lit(config.seed).alias("selection_seed"),
        F.lit(name).alias("selection_manifest_id"),
    )
    _write(rows.orderBy("source", "split", "similarity_group_id", "sample_id"), config.table("split-manifest"))
    counts = {r.split: r["count"] for r in _read(spark, config, "split-manifest").groupBy("split").count().collect()}
    audit = {"selected_total": total, "counts": counts, "selected_per_source": each, "selection_manifest_id": name, "similarity_groups": groups.count()}
    Files(spark).write_json(f"{config.data_dir}/split-manifest.audit.json", audit)
    return audit


def _represent(spark: SparkSession, config: StudyConfig) -> dict:
    chosen = _read(spark, config, "split-manifest").select("sample_id")
    rows = _read(spark, config, "canonical").join(chosen, "sample_id", "left_semi")
    v1 = rows.select("sample_id", F.col("detector_input_v1").alias("detector_input_text"), F.lit(mail.V1_VERSION).alias("representation_version"))
    _write(v1, config.table("detector-input-v1"))
    # Raw bytes are read again by where they lie, and not kept in the canonical table.
    mails = reduce(DataFrame.unionByName, (raw.messages(spark, config.raw_root, s, config.seed) for s in SOURCES)).select("source", "source_path", "source_message_index", "raw_email")
    same = (mails["source"] == rows["source"]) & (mails["source_path"] == rows["source_path"]) & mails["source_message_index"].eqNullSafe(rows["source_message_index"])
    made = materialize(mail.enriched(rows.join(mails, same).select("sample_id", "detector_input_v1", "raw_email", "attachment_extensions")), "enriched")
    bad = made.where("error is not null").select("sample_id", "error").orderBy("sample_id").limit(1).collect()
    if bad:
        raise ValueError(f"sample {bad[0].sample_id} can't be enriched: {bad[0].error}")
    _write(made.drop("error"), config.table("detector-input-v2"))
    return {"rows": v1.count(), "v1": mail.V1_VERSION, "v2": mail.V2_VERSION}


def study_rows(spark: SparkSession, config: StudyConfig, representation: str) -> DataFrame:
    """The split manifest with texts; every sample must have one."""
    rows = _read(spark, config, "split-manifest").select("sample_id", "source", "corpus_label", "similarity_group_id", "split")
    texts = _read(spark, config, REPRESENTATIONS[representation]).select("sample_id", F.col("detector_input_text").alias("text"))
    missing = rows.join(texts, "sample_id", "left_anti").count()
    if missing:
        raise ValueError(f"representation is missing {missing} split samples")
    return rows.join(texts, "sample_id")


def _report(predictions: DataFrame) -> dict:
    """Metrics of predictions, with a nested confusion matrix."""
    rows = predictions.select(F.lit("all").alias("run"), F.col("corpus_label").alias("label"), F.col("predicted_label").alias("predicted"), F.col("phishing_probability").alias("score"))
    row = metrics.classification_metrics(rows, ["run"]).first().asDict()
    row.pop("run")
    return {"confusion_matrix": {c: row.pop(c) for c in ("tn", "fp", "fn", "tp")}, **row}


def _run(predictions: DataFrame) -> DataFrame:
    """Predictions with the columns of a run (see compare and bootstrap)."""
    return predictions.select(
        "sample_id", "source", F.col("corpus_label").cast("int").alias("label"), "similarity_group_id", F.col("predicted_label").cast("int").alias("predicted"), F.col("phishing_probability").alias("score")
    )


def run_nlp_study(spark: SparkSession, config: StudyConfig, grid: list[dict] | None = None) -> dict:
    """Choose parameters and representation on the validation split, refit, and score the test split once."""
    files = Files(spark)
    missing = [t for t in ("split-manifest", *REPRESENTATIONS.values()) if not files.exists(config.table(t))]
    if missing:
        raise FileNotFoundError("missing data tables: " + ", ".join(missing))
    config.ensure_directories(spark)
    grid = model.PARAMETER_GRID if grid is None else grid
    best: dict[str, dict] = {}
    predicted: dict[str, DataFrame] = {}
    for name in REPRESENTATIONS:
        rows = materialize(study_rows(spark, config, name), "study")
        scored = materialize(model.grid_predictions(rows, "text", grid), "grid")
        as_metric = scored.select("candidate", F.col("corpus_label").alias("label"), F.col("predicted_label").alias("predicted"), F.col("phishing_probability").alias("score"))
        best[name] = model.best_candidate(metrics.classification_metrics(as_metric, ["candidate"])).first().asDict()
        predicted[name] = scored.where(F.col("candidate") == best[name]["candidate"]).drop("candidate").withColumn("representation", F.lit(name))
    order = list(REPRESENTATIONS)
    chosen = max(order, key=lambda n: (best[n]["balanced_accuracy"], best[n]["f1"], -order.index(n)))  # of two
    mark = (F.col("corpus_label") == F.col("predicted_label")).alias("correct")
    _write(reduce(DataFrame.unionByName, predicted.values()).select("*", mark), f"{config.nlp_dir}/validation-predictions.parquet")
    validation = spark.read.parquet(f"{config.nlp_dir}/validation-predictions.parquet")
    runs = {n: _run(validation.where(F.col("representation") == n)) for n in order}
    paired = bootstrap.report(runs, seed=config.seed, replicates=config.bootstrap_replicates)
    parameters = grid[best[chosen]["candidate"]]
    test, weights = model.test_predictions(study_rows(spark, config, chosen), "text", parameters)
    _write(test.drop("candidate").select("*", F.lit(chosen).alias("representation"), mark), f"{config.nlp_dir}/test-predictions.parquet")
    test = spark.read.parquet(f"{config.nlp_dir}/test-predictions.parquet")
    top = [r.asDict() for r in model.top_features(weights).orderBy("side", "rank").collect()]
    summary = {
        "generated_at_utc": datetime.now(UTC).isoformat(), "selected_representation": chosen, "selected_parameters": parameters, "validation": best, "paired_validation_bootstrap": paired,
        "test_metrics": _report(test), "test_bootstrap": bootstrap.report({chosen: _run(test)}, seed=config.seed, replicates=config.bootstrap_replicates),
    }
    files.write_json(f"{config.nlp_dir}/top-features.json", {side: [r for r in top if r["side"] == side] for side in ("phishing", "legitimate")})
    files.write_json(f"{config.nlp_dir}/summary.json", summary)
    return summary


def selected_representation(spark: SparkSession, config: StudyConfig) -> str:
    files, path = Files(spark), f"{config.nlp_dir}/summary.json"
    if not files.exists(path):
        raise FileNotFoundError("run the NLP study before the comparison of prompts")
    name = files.read_json(path)["selected_representation"]
    if name not in REPRESENTATIONS:
        raise ValueError("the NLP summary names an unknown representation")
    return name


def load_prompt(spark: SparkSession, config: StudyConfig) -> str:
    value = Files(spark).read_text(config.prompt_path).strip()
    if not value:
        raise ValueError("the system prompt is empty")
    return value


def _frozen(spark: SparkSession, config: StudyConfig, version: str, **more: object) -> str:
    name = selected_representation(spark, config)
    return prompts.protocol_digest({"version": version, "representation": _digest(_read(spark, config, REPRESENTATIONS[name])), "split": _digest(_read(spark, config, "split-manifest")), **more})


def build_retrieval_manifest(spark: SparkSession, config: StudyConfig) -> dict:
    """Retrieve an example from each pool for every test sample, once; check the result, also when it is there."""
    config.ensure_directories(spark)
    protocol = _frozen(spark, config, "tfidf-source-balanced-retrieval-v1.0", settings=RETRIEVAL_SETTINGS, plan=SOURCE_PLAN)
    files = Files(spark)
    path, side = f"{config.retrieval_dir}/retrieval-manifest.parquet", f"{config.retrieval_dir}/retrieval-manifest.json"
    rows = materialize(study_rows(spark, config, selected_representation(spark, config)), "study")
    as_split = rows.select("sample_id", "source", F.col("corpus_label").alias("label"), "split", "similarity_group_id")
    if files.exists(path):
        if not files.exists(side) or files.read_json(side)["retrieval_protocol_id"] != protocol:
            raise ValueError("retrieval manifest belongs to a different frozen protocol")
    else:
        train, test = as_split.where("split = 'train'"), as_split.where("split = 'test'")
        have = {(r.source, r.label) for r in train.select("source", "label").distinct().collect()}
        for _, source, label in SOURCE_PLAN:
            if (source, label) not in have:
                raise ValueError(f"no train candidates for {source}/{label}")
        tf = materialize(tfidf.counts(rows, "sample_id", F.col("text")), "tf")
        weights = materialize(model.features(tf, rows.select("sample_id", "split"), 1, "split = 'train'")[0], "weights")
        own = lambda s: weights.join(s.select("sample_id"), "sample_id", "left_semi")
        found = tfidf.best_examples(test, train, own(test), own(train), SOURCE_PLAN)
        _write(found.orderBy("target_sample_id", "position"), path)
        files.write_json(side, {"retrieval_protocol_id": protocol, "representation": selected_representation(spark, config), "selection_rule": "highest cosine similarity within each frozen source/label train pool"})
    manifest = spark.read.parquet(path)
    for r in tfidf.audit(manifest, as_split, SOURCE_PLAN).orderBy("nth").collect():
        if r.violations:
            raise ValueError(f"retrieval manifest breaks the rule {r.rule} in {r.violations} cases")
    c = F.col("cosine_similarity")
    total = manifest.agg(F.countDistinct("target_sample_id").alias("targets"), F.count(F.lit(1)).alias("examples"), F.min(c).alias("minimum"), F.avg(c).alias("mean"), F.max(c).alias("maximum")).first()
    return {
        "status": "ready", "retrieval_protocol_id": protocol, "targets": total.targets, "examples": total.examples, "examples_per_target": 4, "candidate_split": "train",
        "similarity": {k: total[k] for k in ("minimum", "mean", "maximum")}, "manifest_sha256": _digest(manifest),
    }


def _messages(spark: SparkSession, config: StudyConfig, targets: DataFrame, system: str, shots: bool) -> DataFrame:
    """(sample_id, message, too_long): what is asked about targets, after four labelled examples in order if asked for."""
    rows = study_rows(spark, config, selected_representation(spark, config))
    own = rows.select("sample_id", "text").join(targets, "sample_id", "left_semi")
    message = prompts.target_message(F.col("text"))
    if shots:
        manifest = spark.read.parquet(f"{config.retrieval_dir}/retrieval-manifest.parquet").withColumnRenamed("target_sample_id", "sample_id").join(targets, "sample_id", "left_semi")
        shown = rows.select(F.col("sample_id").alias("example_sample_id"), F.col("text").alias("shown"))
        example = F.struct("position", F.col("shown").alias("text"), F.col("example_label").cast("int").alias("label"))
        own = own.join(manifest.join(shown, "example_sample_id").groupBy("sample_id").agg(F.array_sort(F.collect_list(example)).alias("x")), "sample_id")
        message = prompts.four_shot_message(F.col("x"), F.col("text"))
    return own.select("sample_id", message.alias("message")).withColumn("too_long", prompts.too_long(F.lit(system), F.col("message")))


def _requests(messages: DataFrame, system: str) -> dict[str, dict]:
    """The requests of a batch by sample. Too long a prompt is an error, never cut."""
    rows = messages.collect()
    if any(r.too_long for r in rows):
        raise ValueError(f"the prompt exceeds the {prompts.MAX_PROMPT_CHARACTERS:,}-character limit; its examples were not truncated or sent")
    return {r.sample_id: prompts.classification_request(system, r.message) for r in rows}


def preview_retrieval_four_shot_request(spark: SparkSession, config: StudyConfig, target_sample_id: str | None = None) -> dict:
    """One whole request, which is not sent."""
    build_retrieval_manifest(spark, config)
    manifest = spark.read.parquet(f"{config.retrieval_dir}/retrieval-manifest.parquet")
    chosen = target_sample_id or manifest.agg(F.min("target_sample_id")).first()[0]
    system = load_prompt(spark, config)
    found = _requests(_messages(spark, config, spark.createDataFrame([(chosen,)], "sample_id string"), system, shots=True), system)
    if not found:
        raise KeyError(f"unknown test sample {chosen}")
    return found[chosen]


def read_ledger(spark: SparkSession, path: str, protocol: str) -> DataFrame:
    """The ledger's records, one file each; a broken line or another protocol is an error."""
    if not Files(spark).exists(path):
        return spark.createDataFrame([], ledger.RECORD)
    rows = spark.read.schema(ledger.RECORD + ", broken string").option("columnNameOfCorruptRecord", "broken").json(path)
    bad = rows.agg(F.count_if(F.col("broken").isNotNull()).alias("lines"), F.count_if(F.col("broken").isNull() & ~F.col("protocol_id").eqNullSafe(F.lit(protocol))).alias("others")).first()
    if bad.lines:
        raise ValueError(f"invalid ledger JSON on {bad.lines} lines")
    if bad.others:
        raise ValueError("ledger belongs to a different frozen protocol")
    return rows.drop("broken")


def _send(spark: SparkSession, transport: ChatTransport, request: dict, key: str, pinned: str | None) -> tuple[dict, str | None]:
    """What a request gave as fields of a record, and the model that answered if it may be pinned."""
    answer = transport.complete_chat(request, request_key=key)
    used = (answer.input_tokens, answer.cached_input_tokens, answer.output_tokens)
    if min(used) < 0:
        raise ValueError("token usage cannot be negative")
    if used[1] > used[0]:
        raise ValueError("cached input tokens exceed input tokens")
    fields = {"provider_request_id": answer.provider_request_id, "requested_model": ledger.MODEL, "resolved_model": answer.resolved_model, **dict(zip(("input_tokens", "cached_input_tokens", "output_tokens"), used, strict=True))}
    refused = {"response_sha256": hashlib.sha256(answer.content.encode()).hexdigest()}
    if not answer.resolved_model.startswith(ledger.MODEL) or (pinned and answer.resolved_model != pinned):
        return fields | refused | {"status": "model_mismatch", "validation_error": "the resolved model does not match the frozen run"}, pinned
    verdict = prompts.judged(spark.createDataFrame([(answer.content,)], "answer string")).first()
    if verdict.error is None:
        return fields | {"status": "accepted", "output": verdict.output.asDict(recursive=True)}, answer.resolved_model
    return fields | refused | {"status": "rejected", "validation_error": verdict.error}, answer.resolved_model


def run_protocol_batch(spark: SparkSession, config: StudyConfig, transport: ChatTransport, *, authorised: bool, max_new_cases: int, method: str, zero_shot: bool, directory: str, protocol: str, requests: Callable[[DataFrame], dict[str, dict]], retry_exhausted: bool = False) -> dict:
    """Send the next samples, record every answer, and sum up; resumes from the ledger.

    requests makes the requests of a table of sample ids, which has max_new_cases rows at most.
    """
    if not authorised:
        raise PermissionError("set authorised=True only after approving external processing")
    if max_new_cases < 1:
        raise ValueError("max_new_cases must be positive")
    files, path, representation = Files(spark), f"{directory}/ledger.jsonl", selected_representation(spark, config)
    records = read_ledger(spark, path, protocol)
    tests = _read(spark, config, "split-manifest").where("split = 'test'").select("sample_id", "source", "corpus_label", "similarity_group_id")
    if not ledger.strangers(tests, records).isEmpty():
        raise ValueError("ledger contains samples outside the current test split")
    models = [r.resolved_model for r in records.select("resolved_model").where("resolved_model is not null").distinct().limit(2).collect()]
    if len(models) > 1:
        raise ValueError("ledger contains more than one resolved model")
    pinned, paused, new = next(iter(models), None), None, 0
    states = ledger.state(tests, records)
    todo = ledger.with_keys(ledger.pending(states, max_new_cases + 1, retry_exhausted), protocol)
    batch = [r.asDict() for r in todo.join(tests, "sample_id").orderBy("sample_id").collect()]
    built = requests(spark.createDataFrame([(r["sample_id"],) for r in batch[:max_new_cases]], "sample_id string")) if batch else {}
    for row in batch[:max_new_cases]:
        new += 1
        for attempt, key in enumerate(row["request_keys"], row["attempt"]):
            record = {"protocol_id": protocol, "sample_id": row["sample_id"], "retry_round": row["retry_round"], "authorised_retry": row["retry_round"] > 1, "attempt": attempt, "request_key": key}
            try:
                got, pinned = _send(spark, transport, built[row["sample_id"]], key, pinned)
                record |= {k: row[k] for k in ("source", "corpus_label", "similarity_group_id")} | got
            except RetryableTransportError as error:
                record |= {"status": "transport_error", "error": str(error)[:300]}
            when = datetime.now(UTC).isoformat()
            files.append(path, f"{when.replace(':', '')}-{uuid.uuid4().hex}", {"recorded_at_utc": when} | record)
            if record["status"] in ("transport_error", "model_mismatch"):
                paused = record["status"]
            if record["status"] != "rejected":
                break
        if paused:
            break
    if not paused and len(batch) > max_new_cases:
        paused = "batch_limit"
    return _summarise(spark, config, tests, read_ledger(spark, path, protocol), directory, representation, paused, {"protocol_id": protocol, "method": method, "zero_shot": zero_shot, "resolved_model": pinned, "new_cases_this_invocation": new, "retry_exhausted": retry_exhausted})


def _summarise(spark, config, tests, records, directory: str, representation: str, paused: str | None, more: dict) -> dict:
    predictions = ledger.predictions(records, representation)
    done = predictions.count()
    if done:
        _write(predictions, f"{directory}/predictions.parquet")
        predictions = spark.read.parquet(f"{directory}/predictions.parquet")
    state = ledger.batch_status(ledger.state(tests, records), F.lit(paused)).first()
    used = ledger.usage(records).first()
    whole = state.status == "complete"
    summary = {
        "generated_at_utc": datetime.now(UTC).isoformat(), "status": state.status, "requested_model": ledger.MODEL, "representation": representation, "test_samples": state.samples, "accepted_samples": state.accepted,
        "remaining_samples": state.remaining, "exhausted_samples": state.exhausted, "retry_policy": {"attempts_per_round": ledger.MAX_ATTEMPTS, "retry_exhausted_authorised": more.pop("retry_exhausted")},
        "token_usage": {"input": used.input_tokens, "cached_input": used.cached_input_tokens, "output": used.output_tokens}, "metrics": _report(predictions) if whole else None,
        "bootstrap": bootstrap.report({more["method"]: _run(predictions)}, seed=config.seed, replicates=config.bootstrap_replicates) if whole else None, **more,
    }
    Files(spark).write_json(f"{directory}/summary.json", summary)
    return summary


def _contract(system: str) -> dict:
    return {"model": prompts.MODEL, "max_completion_tokens": prompts.MAX_COMPLETION_TOKENS, "schema": prompts.OUTPUT_SCHEMA, "prompt": system, "threshold": 0.5}


def run_zero_shot_batch(spark: SparkSession, config: StudyConfig, transport: ChatTransport, *, authorised: bool, max_new_cases: int = 100, retry_exhausted: bool = False) -> dict:
    """A bounded batch without examples. A finished run is returned as it is; one of another protocol is an error."""
    system = load_prompt(spark, config)
    protocol = _frozen(spark, config, "zero-shot-v1.0", contract=_contract(system))
    files, done = Files(spark), f"{config.zero_shot_dir}/summary.json"
    if files.exists(done) and (old := files.read_json(done))["status"] == "complete":
        if old["protocol_id"] != protocol:
            raise ValueError("the complete zero-shot run belongs to a different frozen protocol")
        return old
    requests = lambda ids: _requests(_messages(spark, config, ids, system, shots=False), system)
    return run_protocol_batch(spark, config, transport, authorised=authorised, max_new_cases=max_new_cases, method="zero-shot", zero_shot=True, directory=config.zero_shot_dir, protocol=protocol, requests=requests, retry_exhausted=retry_exhausted)


def run_retrieval_four_shot_batch(spark: SparkSession, config: StudyConfig, transport: ChatTransport, *, authorised: bool, max_new_cases: int = 100, retry_exhausted: bool = False) -> dict:
    """A bounded batch with four retrieved examples."""
    audit = build_retrieval_manifest(spark, config)
    system = load_prompt(spark, config)
    protocol = _frozen(spark, config, "retrieval-four-shot-v1.0", contract=_contract(system), manifest=audit["manifest_sha256"], most=prompts.MAX_PROMPT_CHARACTERS)
    requests = lambda ids: _requests(_messages(spark, config, ids, system, shots=True), system)
    summary = run_protocol_batch(spark, config, transport, authorised=authorised, max_new_cases=max_new_cases, method="retrieval-four-shot", zero_shot=False, directory=config.retrieval_dir, protocol=protocol, requests=requests, retry_exhausted=retry_exhausted)
    Files(spark).write_json(f"{config.retrieval_dir}/summary.json", summary | {"retrieval": audit})
    return summary | {"retrieval": audit}


def load_complete_test_comparison(spark: SparkSession, config: StudyConfig) -> dict[str, dict]:
    """Metrics of the three methods, if each covers the test split exactly."""
    expected = _read(spark, config, "split-manifest").where("split = 'test'").withColumnRenamed("corpus_label", "label")
    n = expected.count()
    if not n:
        raise ValueError("the split manifest has no test samples")
    methods = {
        "TF–IDF logistic regression": (config.nlp_dir, "test-predictions.parquet", "test_metrics"), "GPT-5 Nano zero-shot": (config.zero_shot_dir, "predictions.parquet", "metrics"),
        "GPT-5 Nano retrieved four-shot": (config.retrieval_dir, "predictions.parquet", "metrics"),
    }
    out, files = {}, Files(spark)
    for name, (directory, predictions, key) in methods.items():
        missing = [p for p in (f"{directory}/{predictions}", f"{directory}/summary.json") if not files.exists(p)]
        if missing:
            raise FileNotFoundError(f"{name} is missing {', '.join(missing)}")
        summary = files.read_json(f"{directory}/summary.json")
        if key == "metrics" and summary.get("status") != "complete":
            raise ValueError(f"{name} is not complete")
        rows = spark.read.parquet(f"{directory}/{predictions}").withColumnRenamed("corpus_label", "label")
        if compare.status(expected, {name: rows}).first().status != "ready":
            raise ValueError(f"{name} does not cover the frozen held-out test set")
        if (summary.get(key) or {}).get("n") != n:
            raise ValueError(f"{name} metrics do not match the frozen held-out test set")
        out[name] = summary[key]
    return out


__all__ = ["LABEL_NAMES", "ChatTransport", "HttpTransport", "RetryableTransportError", "build_retrieval_manifest", "load_complete_test_comparison", "prepare_data", "preview_retrieval_four_shot_request", "run_nlp_study", "run_retrieval_four_shot_batch", "run_zero_shot_batch"]
