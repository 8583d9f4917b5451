"""Queries over the fixture tables, one or more for each operator.

The tables hold no mail, so documents stand in for messages: lang is the source, the first line the subject,
and a label by source (or, for classification, labels.quality) the class. events stand in for a ledger:
user_id is the sample, event_type the status.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lettermill.config import StudyConfig
from lettermill.functions import mail, prompts, text
from lettermill.functions.language import detect, gazetteer
from lettermill.operators import bootstrap, compare, graph, ledger, metrics, model, pool, report, simhash, split, tfidf
from lettermill.session import count, materialize, release, scratch_mark
from lettermill.sources import raw
from lettermill.sources.tables import read_table as table

STUDY = StudyConfig("")
SEED = STUDY.seed
#: Sources of the study's label 1; every other language is one of label 0.
PHISHING = ("fr", "es")
PLAN = [(1, "en", 0), (2, "fr", 1), (3, "de", 0), (4, "es", 1)]
STATUS = {"purchase": "accepted", "error": "rejected", "signup": "model_mismatch", "click": "transport_error"}


def label_of(source: Column) -> Column:
    return F.when(source.isin(*PHISHING), 1).otherwise(0)


def sources_of(rows: DataFrame) -> list[str]:
    """The sources of a table, by name."""
    return sorted(r.source for r in rows.select("source").where("source is not null").distinct().collect())  # languages


def docs(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, source, label, path, subject, body, content."""
    rows = table(spark, d, "documents")
    first = F.split_part("text", F.lit("\n"), F.lit(1))
    rest = F.substring("text", F.length(first) + 2, F.length("text"))
    return rows.select(
        "doc_id", F.col("lang").alias("source"), label_of(F.col("lang")).alias("label"), F.concat(F.col("lang"), F.lit("/"), F.col("doc_id").cast("string")).alias("path"),
        first.alias("subject"), rest.alias("body"), text.content_digest(first, rest).alias("content"), "text",
    )


def raw_audit(spark, d):
    return raw.audit(table(spark, d, "documents").select(F.col("lang").alias("source"), F.octet_length("text").alias("length")))


def manifest_digest(spark, d):
    return raw.manifest_digest(docs(spark, d).select("source", F.col("path").alias("source_path"), F.sha2("text", 256).alias("sha")))


def seeded_order_rank(spark, d):
    rows = docs(spark, d).select("source", "doc_id", text.seeded(SEED, F.col("path")).alias("ord"))
    return rows.select("source", "doc_id", F.row_number().over(W.partitionBy("source").orderBy("ord")).alias("rank"))


def sample_identity(spark, d):
    rows = docs(spark, d)
    sid = text.sample_id(F.col("source"), F.col("path"), F.lit(None), F.sha2("text", 256))
    return rows.select("doc_id", sid.alias("sample_id"), "content", text.duplicate_group_id(F.col("content")).alias("duplicate_group_id"))


def _pool(spark, d) -> tuple[pool.Pool, list[str]]:
    """A pool with the study's quotas. Documents without a body are rejected, as are those that a detector takes for another language's."""
    rows = docs(spark, d)
    rejected = pool.rejection(F.col("body") == "", F.col("doc_id") % 11 != 0, F.col("doc_id") % 13 == 0)
    rows = rows.select("doc_id", "source", "label", "content", text.seeded(SEED, F.col("path")).alias("ord"), rejected.alias("rejected"))
    rows = materialize(rows, "messages")
    return pool.candidates(rows, sources_of(rows), STUDY.source_cap + STUDY.reserve_per_source), sources_of(rows)


def source_quota_pool(spark, d):
    found, sources = _pool(spark, d)
    rows = pool.balanced(found.accepted, sources, STUDY.source_cap)
    return rows.select("doc_id", "source", "label", "candidate_rank_within_source", "pool_status")


def skip_reasons(spark, d):
    return _pool(spark, d)[0].reasons.groupBy("source", "reason").agg(F.count(F.lit(1)).alias("n"))


def exact_duplicates(spark, d):
    """Contents of several documents: how many, the first, and whether their labels differ."""
    rows = docs(spark, d).groupBy("content").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"), (F.min("label") != F.max("label")).alias("conflict"))
    return rows.where("n > 1")


def token_stats(spark, d):
    rows = table(spark, d, "documents").select("doc_id", text.tokens(F.col("text")).alias("w"))
    return rows.select("doc_id", F.size("w").alias("n_tokens"), F.size(F.array_distinct("w")).alias("n_distinct"), (F.size("w") >= simhash.LEAST_TOKENS).alias("long_enough"))


def bigram_features(spark, d):
    rows = table(spark, d, "documents").select("doc_id", text.pairs(text.tokens(F.col("text"))).alias("p"))
    return rows.select("doc_id", F.size("p").alias("n"), F.size(F.array_distinct("p")).alias("n_distinct"), F.sha2(F.array_join("p", "\n"), 256).alias("digest"))


def _prints(spark, d) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "text")
    prints = simhash.fingerprints(rows, "doc_id", F.col("text"))
    return materialize(prints.join(docs(spark, d).select("doc_id", "content"), "doc_id"), "prints")


def simhash_fingerprint(spark, d):
    return simhash.fingerprints(table(spark, d, "documents").select("doc_id", "text"), "doc_id", F.col("text"))


def band_buckets(spark, d):
    rows = simhash.bands(_prints(spark, d), "doc_id", F.col("doc_id"))
    return rows.select("doc_id", "band", "byte", "nth")


def bucket_overflow(spark, d):
    return simhash.overflow(_prints(spark, d), cap=5)


def _edges(spark, d) -> DataFrame:
    return materialize(simhash.edges(simhash.bands(_prints(spark, d), "doc_id", F.col("doc_id")), "doc_id", "content"), "near")


def near_dup_edges(spark, d):
    return _edges(spark, d).withColumn("hamming_distance", F.col("hamming_distance").cast("int")).withColumn("token_count_ratio", F.round("token_count_ratio", 9))


def near_dup_edges_exact(spark, d):
    """near_dup_edges without the cap on buckets."""
    found = simhash.exact_edges(_prints(spark, d), "doc_id", "content")
    return found.withColumn("hamming_distance", F.col("hamming_distance").cast("int")).withColumn("token_count_ratio", F.round("token_count_ratio", 9))


def similarity_components(spark, d):
    return graph.connected_components(_edges(spark, d), "left_sample_id", "right_sample_id")


def similarity_group_ids(spark, d):
    found = simhash.group_ids(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id")), "doc_id", _edges(spark, d).select(F.col("left_sample_id").cast("string").alias("left_sample_id"), F.col("right_sample_id").cast("string").alias("right_sample_id")))
    return found.select("doc_id", "root", "similarity_group_id")


def group_crossings(spark, d):
    """Groups of similar documents that lie in several sources. Every fifth document is said to come from elsewhere, so that some do."""
    moved = F.when(F.col("doc_id") % 5 == 0, "elsewhere").otherwise(F.col("source"))
    own = docs(spark, d).select(F.col("doc_id").cast("string").alias("doc_id"), moved.alias("source"), "label")
    return simhash.crossing(similarity_group_ids(spark, d).join(own, "doc_id"), "source", "label")


def _targets(spark, d) -> dict[str, int]:
    n = table(spark, d, "documents").where("lang is not null").groupBy("lang").count().agg(F.min("count")).first()[0] or 0
    return split.apportion(n, STUDY.train_ratio, STUDY.validation_ratio)


def apportion_targets(spark, d):
    return spark.createDataFrame(list(_targets(spark, d).items()), "split string, target long")


def _sliced(spark, d) -> DataFrame:
    rows = docs(spark, d)
    gid = F.concat(F.col("source"), F.lit(":"), F.col("content"))
    return rows.withColumn("similarity_group_id", gid)


def greedy_split(spark, d):
    groups = _sliced(spark, d).groupBy("source", "similarity_group_id").agg(F.count(F.lit(1)).alias("members"))
    return split.assign(groups, _targets(spark, d), SEED)


def _split(spark, d) -> DataFrame:
    """Messages with a split, by a hash of their content rather than the fold, so that SQL can follow."""
    bucket = F.conv(F.substring("content", 1, 8), 16, 10).cast("long") % 100
    return _sliced(spark, d).withColumn("split", F.when(bucket < 70, "train").when(bucket < 85, "validation").otherwise("test"))


def split_pivot(spark, d):
    return split.pivot(_split(spark, d)).select("source", *(F.col(s).cast("long").alias(s) for s in split.SPLITS))


def split_leaks(spark, d):
    """Groups in several splits, where every seventh document was put into another one."""
    rows = _split(spark, d)
    return split.leaking(rows.withColumn("split", F.when(F.col("doc_id") % 7 == 0, "test").otherwise(F.col("split"))).withColumn("similarity_group_id", F.substring("content", 1, 2)))


def url_components(spark, d):
    part = lambda what: F.coalesce(F.try_parse_url("url", F.lit(what)), F.lit(""))
    return table(spark, d, "pages").select("page_id", F.upper(part("PROTOCOL")).alias("scheme"), F.lower(part("HOST")).alias("host"), part("PATH").alias("path"), (part("QUERY") != "").alias("has_query"), (part("REF") != "").alias("has_fragment"))


_shape = mail.column(lambda url: mail.Numbers().url(url))
_intent = mail.column(lambda url: mail.path_intent(mail.urlsplit(url).path))


def url_shapes(spark, d):
    return table(spark, d, "pages").select("page_id", _shape("url").alias("shape"))


def path_intents(spark, d):
    named = F.replace(F.replace("url", F.lit("/en/"), F.lit("/Verify-login/")), F.lit("/de/"), F.lit("/invoice/"))
    return table(spark, d, "pages").select("page_id", _intent(named).alias("intent"))


def pii_presence(spark, d):
    has = lambda p: F.regexp_like("text", F.lit(p))
    return table(spark, d, "documents").select("doc_id", has(text.EMAIL).alias("has_email"), has(text.PHONE).alias("has_phone"), has(text.LONG_NUMBER).alias("has_long_number"), has(text.ACTIVE_URL).alias("has_url"))


def attachment_tokens(spark, d):
    ext = F.array(F.concat(F.lit("."), "event_type"), F.lit(".PDF"), F.concat(F.lit(".x-"), (F.col("user_id") % 7).cast("string")), F.lit(""))
    return table(spark, d, "events").select("event_id", F.array_join(mail.attachment_marks_column(ext), " ").alias("tokens"))


def html_links(spark, d):
    links = mail.links_column(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.size(links).alias("n_links"), F.array_join(links, " ").alias("targets"))


def html_visible_text(spark, d):
    shown = mail.visible_text_column(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.length(shown).alias("n_chars"), F.sha2(shown, 256).alias("digest"))


_message_id, _domain = mail.column(mail.message_id), mail.column(mail.domain)


def message_ids(spark, d):
    return table(spark, d, "pages").select("page_id", _message_id(F.concat(F.lit(" \t<"), F.substring_index("url", "/", -1), F.lit(">\n"))).alias("message_id"), _domain(F.concat(F.lit("User@"), F.upper(F.substring("url", 9, 12)))).alias("domain"), text.safe_diagnostic(F.col("url")).alias("safe"))


def _joined(*parts) -> Column:
    """Parts of a mail: columns, texts, and numbers of documents."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _mails(spark, d) -> DataFrame:
    """Documents as mails of four kinds, by number: plain text; several parts with an attachment; a page alone; nothing to show."""
    n = F.col("doc_id").cast("string")
    day = F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0")
    date = F.when(F.col("doc_id") % 6 == 0, "Date: no date\n").when(F.col("doc_id") % 6 == 1, "").otherwise(_joined("Date: ", day, " Mar 2021 10:20:30 +0530\n"))
    head = _joined('From: "S" <Sender@', F.upper("lang"), ".Example>\nTo: a@x.org, B@Y.org, nobody\nSubject:  doc ", n, " \nMessage-ID: <m", n, "@x>\nMIME-Version: 1.0\n", date)
    kind = lambda t: f"Content-Type: {t}; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n"
    attached = 'Content-Type: application/pdf; name="x"\nContent-Disposition: attachment; filename="Invoice.PDF"\nContent-Transfer-Encoding: base64\n\nAAAA\n'
    page = _joined("<html><head><title>t</title></head><body><p>Shown ", n, "</p><div>line &amp; more</div><script>hid</script></body></html>\n")
    several = _joined('Content-Type: multipart/mixed; boundary="bb"\n\n--bb\n', kind("text/html"), page, "--bb\n", kind("text/plain"), F.col("text"), "\n--bb\n", kind("text/plain"), "second\n--bb\n", attached, "--bb--\n")
    which = F.col("doc_id") % 4
    body = F.when(which == 0, _joined(kind("text/plain"), F.col("text"))).when(which == 1, several).when(which == 2, _joined(kind("text/html"), page)).otherwise(_joined('Content-Type: multipart/mixed; boundary="bb"\n\n--bb\n', attached, "--bb--\n"))
    return table(spark, d, "documents").select("doc_id", F.concat(head, body).cast("binary").alias("raw_email"))


def parsed_messages(spark, d):
    rows = mail.parse_messages(_mails(spark, d))
    return rows.select(
        "doc_id", "subject", F.sha2("body_text", 256).alias("body_sha256"), "body_source", "has_plain_part", "has_html_part", "from_address", "from_domain", F.array_join("to_domains", ",").alias("to_domains"), "recipient_count",
        "message_id", "date_utc", "date_parse_status", F.array_join("parse_warnings", ",").alias("warnings"), "mime_type", "attachment_count", F.array_join("attachment_extensions", ",").alias("extensions"), "error",
    )


def deidentified_messages(spark, d):
    """Mails made of addresses, links, numbers and names, some of them twice, and the marks that stand for them."""
    n = F.col("doc_id").cast("string")
    subject = _joined("Ann Lee, account ", F.lpad(n, 9, "1"))
    body = _joined(
        "Write to Ann.", n, "@Example.org or ANN.", n, "@example.org (b@c.de), call +44 20 7946 ", F.lpad(n, 6, "0"), " or 555-1234-", F.lpad(n, 4, "0"), "; ref ", F.lpad(n, 9, "1"), " and ", F.lpad(n, 8, "2"), ".\n",
        "See https://Shop", n, ".example.com/Login/x?y=1#z, www.x.net and http://shop", n, ".example.com/. ann lee of Acme Corp; Anna Lee.",
    )
    raw = table(spark, d, "documents").select("doc_id", _joined("Subject: ", subject, "\nContent-Type: text/plain; charset=utf-8\n\n", body, "\n").cast("binary").alias("raw_email"))
    rows = mail.parse_messages(raw, names=gazetteer(["Ann Lee"], ["Acme Corp"]))
    return rows.select("doc_id", "deidentified_subject", "deidentified_body_text", F.sha2("detector_input_v1", 256).alias("input_sha256"), "error")


def language_cohorts(spark, d):
    """What the detector says of documents' first 400 characters, in English and in other languages' words."""
    words = F.when(F.col("doc_id") % 3 == 0, "this is what they have said about all of it and you will be there with us when it was not").when(
        F.col("doc_id") % 3 == 1, "das ist nicht die Frage und wir werden sehen was man aus einer so guten Sache noch machen kann, oder auch nicht"
    )
    raw = table(spark, d, "documents").select("doc_id", _joined("Subject: s\nContent-Type: text/plain; charset=utf-8\n\n", F.coalesce(words, F.lit("xx yy 12"))).cast("binary").alias("raw_email"))
    return mail.parse_messages(raw, language=detect).select("doc_id", "language", "language_cohort", F.array_join("language_warnings", ",").alias("warnings"))


def enriched_pages(spark, d):
    """Pages as HTML mails, with the structure of their links; every tenth has a malformed one."""
    html = F.concat(F.lit("MIME-Version: 1.0\nContent-Type: text/html; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n"), F.replace("html", F.lit('href="/'), F.lit('href="http://H.example/login/')))
    html = F.concat(html, F.when(F.col("page_id") % 10 == 0, '<a href="http://[">x</a>').otherwise(""))
    rows = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("sample_id"), F.lit("v1").alias("detector_input_v1"), html.cast("binary").alias("raw_email"), F.array(F.lit(".pdf"), F.lit(".tar.gz")).alias("attachment_extensions"))
    return mail.enriched(rows).select(F.col("sample_id").cast("long").alias("page_id"), "detector_input_text", "representation_version", F.col("error").isNotNull().alias("failed"))


def _tf(spark, d) -> DataFrame:
    return tfidf.counts(table(spark, d, "documents").select("doc_id", "text"), "doc_id", F.col("text"))


def idf_table(spark, d):
    vocab = tfidf.vocabulary(_tf(spark, d), count(table(spark, d, "documents")))
    return vocab.select("term", "df", F.round("idf", 9).alias("idf"))


def min_df_vocab(spark, d):
    tf = tfidf.counts(table(spark, d, "documents").select("doc_id", "text"), "doc_id", F.col("text"), longest=2)
    return tfidf.vocabulary(tf, 1, least=3).select("term", "df")


def tfidf_weights(spark, d):
    tf = materialize(_tf(spark, d), "tf")
    vocab = materialize(tfidf.vocabulary(tf, count(table(spark, d, "documents"))), "vocabulary")
    return tfidf.weights(tf, "doc_id", vocab).select("doc_id", "term", F.round("weight", 9).alias("weight"))


def _manifest(spark, d) -> tuple[DataFrame, DataFrame]:
    rows = materialize(_split(spark, d).select(F.col("doc_id").alias("sample_id"), "source", "label", "split", "similarity_group_id", "text"), "rows")
    return tfidf.retrieved(rows, F.col("text"), PLAN), rows


def retrieve_top1_per_pool(spark, d):
    found, _ = _manifest(spark, d)
    return found.select("target_sample_id", F.col("position").cast("int").alias("position"), "example_sample_id", "example_source", F.col("example_label").cast("int").alias("example_label"), F.round("cosine_similarity", 6).alias("cosine_similarity"))


def retrieval_audit(spark, d):
    found, rows = _manifest(spark, d)
    return tfidf.audit(materialize(found, "manifest"), rows, PLAN).select("rule", "violations")


def retrieval_scores(spark, d):
    """Least, mean and largest cosine of the retrieved examples."""
    found, _ = _manifest(spark, d)
    c = F.col("cosine_similarity")
    return found.groupBy("position").agg(F.round(F.min(c), 6).alias("minimum"), F.round(F.avg(c), 6).alias("mean"), F.round(F.max(c), 6).alias("maximum")).withColumn("position", F.col("position").cast("int"))


def scored(spark, d) -> DataFrame:
    """Labelled documents with a score of two digits from a digest, leaning to the label, and a prediction."""
    rows = docs(spark, d).drop("label").join(table(spark, d, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")
    draw = F.conv(F.substring(F.sha2(F.concat(F.lit("score:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("long") % 71
    score = (draw + 30 * F.col("label")) / 100.0
    return rows.select(F.col("doc_id").alias("sample_id"), "source", "label", F.concat("source", F.col("label").cast("string"), F.lit(":"), "content").alias("similarity_group_id"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


def _second(rows: DataFrame) -> DataFrame:
    """Another run over the same samples."""
    shift = F.when(F.col("sample_id") % 3 == 0, 0.2).otherwise(0.0)
    score = F.round(F.least(F.col("score") + shift, F.lit(1.0)), 2)
    return rows.withColumn("score", score).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def _all(rows: DataFrame) -> DataFrame:
    return rows.withColumn("method", F.lit("first")).unionByName(_second(rows).withColumn("method", F.lit("second")))


def _rounded(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*(F.col(c) if c in keep or t not in ("double", "float") else F.round(c, 9).alias(c) for c, t in df.dtypes))


def confusion(spark, d):
    return metrics.confusion(_all(scored(spark, d)), ["method"])


def classification_metrics(spark, d):
    return _rounded(metrics.classification_metrics(_all(scored(spark, d)), ["method"]))


def metrics_by_source(spark, d):
    return _rounded(metrics.classification_metrics(scored(spark, d), ["source"]))


def roc_auc(spark, d):
    return _rounded(metrics.ranking(_all(scored(spark, d)), ["method"]).select("method", "roc_auc"))


def average_precision(spark, d):
    return _rounded(metrics.ranking(_all(scored(spark, d)), ["method"]).select("method", "pr_auc"))


def _samples(spark, d) -> DataFrame:
    return materialize(bootstrap.replicate_metrics(_all(materialize(scored(spark, d), "scored")), STUDY.bootstrap_replicates, SEED, "method"), "replicates")


def bootstrap_interval(spark, d):
    return _rounded(bootstrap.intervals(_samples(spark, d), ["method"]))


def paired_difference(spark, d):
    return _rounded(bootstrap.intervals(bootstrap.differences(_samples(spark, d), "method", "first", "second"), ["difference"]))


def core_report(spark, d):
    return report.core(metrics.classification_metrics(_all(scored(spark, d)), ["method"]), "method")


def ranking_report(spark, d):
    return report.ranking(metrics.classification_metrics(_all(scored(spark, d)), ["method"]), "method")


def confusion_report(spark, d):
    return report.confusion(metrics.classification_metrics(_all(scored(spark, d)), ["method"]), "method")


def split_report(spark, d):
    return report.split_bars(split.pivot(_split(spark, d)))


def run_identity_check(spark, d):
    rows = scored(spark, d)
    return compare.identity(rows, {"first": rows, "second": _second(rows), "short": rows.where("sample_id % 10 <> 0")})


def comparison_gate(spark, d):
    rows = scored(spark, d)
    return _rounded(compare.gate(rows, {"first": rows, "second": _second(rows), "short": rows.where("sample_id % 10 <> 0")}))


def strategy_status(spark, d):
    rows = scored(spark, d)
    return compare.status(rows, {"first": rows, "short": rows.where("sample_id % 10 <> 0")})


def _records(spark, d) -> DataFrame:
    status = F.create_map(*(F.lit(x) for kv in STATUS.items() for x in kv))[F.col("event_type")]
    rows = table(spark, d, "events").select(F.col("user_id").cast("string").alias("sample_id"), status.alias("status"), (F.when(F.col("event_id") % 5 == 0, 2).otherwise(1)).alias("retry_round"), F.floor("value").cast("long").alias("input_tokens"), F.lit(None).cast("long").alias("cached_input_tokens"), F.when(F.col("event_type") == "purchase", F.floor(F.col("value") / 2).cast("long")).alias("output_tokens"), F.lit("m").alias("resolved_model"))
    return rows.where("status is not null")


def _ledger_samples(spark, d) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("sample_id"))


def ledger_rounds(spark, d):
    return ledger.rounds(_records(spark, d))


def ledger_state(spark, d):
    return ledger.state(_ledger_samples(spark, d), _records(spark, d))


def pending_batch(spark, d):
    return ledger.pending(ledger.state(_ledger_samples(spark, d), _records(spark, d)), 25, retry_exhausted=True)


def ledger_strangers(spark, d):
    return ledger.strangers(_ledger_samples(spark, d).where("cast(sample_id as int) % 4 <> 0"), _records(spark, d))


def token_usage(spark, d):
    return ledger.usage(_records(spark, d))


def batch_status(spark, d):
    return ledger.batch_status(ledger.state(_ledger_samples(spark, d), _records(spark, d)))


def request_keys(spark, d):
    rows = ledger.pending(ledger.state(_ledger_samples(spark, d), _records(spark, d)), None, retry_exhausted=True)
    return rows.select("sample_id", ledger.request_key(F.lit("protocol"), F.col("sample_id"), F.col("retry_round"), F.col("attempt")).alias("request_key"))


def ledger_predictions(spark, d):
    """The last accepted record of each sample, by time, as a prediction."""
    event = table(spark, d, "events")
    output = F.struct(F.when(F.col("event_id") % 2 == 0, "phishing").otherwise("legitimate").alias("label"), ((F.col("event_id") % 100) / 100.0).alias("phishing_probability"))
    when, key = F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lpad(F.col("event_id").cast("string"), 12, "0")
    rows = event.select(
        F.col("user_id").cast("string").alias("sample_id"), F.when(F.col("event_type") == "purchase", "accepted").otherwise("rejected").alias("status"), F.lit("s").alias("source"), F.lit(1).alias("corpus_label"),
        F.lit("g").alias("similarity_group_id"), output.alias("output"), when.alias("recorded_at_utc"), key.alias("request_key"),
    )
    return ledger.predictions(rows, "v1.0")


def attempt_keys(spark, d):
    """The keys of the next attempt of each sample and of those that may follow it."""
    rows = ledger.pending(ledger.state(_ledger_samples(spark, d), _records(spark, d)), None, retry_exhausted=True)
    return ledger.with_keys(rows, "protocol").select("sample_id", F.array_join("request_keys", ",").alias("request_keys"))


def canonical_protocol(spark, d):
    """Digests of small settings, as protocols are named by them."""
    rows = [(i, prompts.canonical_json(v), prompts.protocol_digest(v)) for i, v in enumerate(({"b": [1, 2.5, None], "a": "é", "c": {"z": True}}, [], {"plan": [[1, "enron", 0]], "n": "10"}))]
    return spark.createDataFrame(rows, "i int, canonical string, digest string")


def four_shot_prompt(spark, d):
    mark = scratch_mark(spark)
    found, rows = _manifest(spark, d)
    found = materialize(found, "manifest")
    release(spark, mark, keep=[found, rows])
    shown = rows.select(F.col("sample_id").alias("example_sample_id"), F.col("text").alias("shown"))
    packed = found.join(shown, "example_sample_id").groupBy("target_sample_id").agg(F.array_sort(F.collect_list(F.struct("position", F.col("shown").alias("text"), F.col("example_label").alias("label")))).alias("x"))
    both = packed.join(rows.select(F.col("sample_id").alias("target_sample_id"), "text"), "target_sample_id")
    message = prompts.four_shot_message(F.col("x"), F.col("text"))
    return both.select("target_sample_id", F.length(message).alias("n_chars"), F.sha2(message, 256).alias("digest"), prompts.too_long(F.lit("system"), message).alias("too_long"))


def model_output_errors(spark, d):
    """Answers made from events, some of them broken, and the first rule that each breaks."""
    p = F.format_string("%.2f", (F.col("event_id") % 100) / 100.0)
    label = F.when(F.col("event_id") % 100 >= 50, "phishing").otherwise("legitimate")
    warn = F.when((label == "phishing") != (F.col("event_id") % 11 == 0), "take care").otherwise("")
    kind = F.when(F.col("event_id") % 13 == 0, "colour").otherwise("other")
    shown = F.when(F.col("event_id") % 17 == 0, "[]").otherwise(F.concat(F.lit('[{"type":"'), kind, F.lit('","evidence":"e"}]')))
    value = F.when(F.col("event_id") % 7 == 0, F.lit("true")).when(F.col("event_id") % 19 == 0, F.lit("1.5")).otherwise(p)
    more = F.when(F.col("event_id") % 23 == 0, ',"extra":1').otherwise("")
    whole = F.concat(F.lit('{"label":"'), label, F.lit('","phishing_probability":'), value, F.lit(',"indicators":'), shown, F.lit(',"reason":"r","warning":"'), warn, F.lit('"'), more, F.lit("}"))
    answer = F.when(F.col("event_id") % 29 == 0, "[1]").when(F.col("event_id") % 31 == 0, "{oops").otherwise(whole)
    return prompts.judged(table(spark, d, "events").select("event_id", answer.alias("answer"))).select("event_id", "error", F.col("output.phishing_probability").alias("p"), F.col("output.indicators")[0]["evidence"].alias("evidence"))


def _study(spark, d) -> DataFrame:
    rows = _split(spark, d).drop("label").join(table(spark, d, "labels").select("doc_id", F.col("quality").alias("corpus_label")), "doc_id")
    return materialize(rows.select(F.col("doc_id").cast("string").alias("sample_id"), "source", "corpus_label", "similarity_group_id", "split", "text"), "study")


def model_scores(spark, d):
    return _rounded(model.test_predictions(_study(spark, d), "text", {"C": 1.0, "ngram": 1, "min_df": 2})[0].drop("candidate"))


def grid_metrics(spark, d):
    rows = model.grid_predictions(_study(spark, d), "text")
    rows = rows.select("candidate", F.col("corpus_label").alias("label"), F.col("predicted_label").alias("predicted"), F.col("phishing_probability").alias("score"))
    return _rounded(metrics.classification_metrics(rows, ["candidate"]))


def top_features(spark, d):
    _, weights = model.test_predictions(_study(spark, d), "text", {"C": 1.0, "ngram": 1, "min_df": 2})
    return _rounded(model.top_features(weights))


def feature_report(spark, d):
    _, weights = model.test_predictions(_study(spark, d), "text", {"C": 1.0, "ngram": 1, "min_df": 2})
    return model.two_sided_features(model.top_features(weights))


QUERIES = {
    f.__name__: f
    for f in (
        raw_audit, manifest_digest, seeded_order_rank, sample_identity, exact_duplicates, source_quota_pool, skip_reasons, token_stats, bigram_features, simhash_fingerprint, band_buckets,
        bucket_overflow, near_dup_edges, near_dup_edges_exact, similarity_components, similarity_group_ids, group_crossings, apportion_targets, greedy_split, split_pivot, split_leaks, url_components, url_shapes,
        path_intents, pii_presence, attachment_tokens, html_links, html_visible_text, message_ids, parsed_messages, deidentified_messages, enriched_pages, idf_table, min_df_vocab, tfidf_weights, retrieve_top1_per_pool, retrieval_audit, retrieval_scores,
        confusion, classification_metrics, metrics_by_source, roc_auc, average_precision, bootstrap_interval, paired_difference, run_identity_check, comparison_gate, strategy_status,
        core_report, ranking_report, confusion_report, split_report, language_cohorts, ledger_predictions, attempt_keys, canonical_protocol, feature_report,
        ledger_rounds, ledger_state, pending_batch, ledger_strangers, token_usage, batch_status, request_keys, four_shot_prompt, model_output_errors, model_scores, grid_metrics, top_features,
    )
}
