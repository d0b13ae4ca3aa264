"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from codegauge.functions import lang as L, ngrams as N, replies as R, score as S, text as T
from codegauge.operators import (
    corpus, corrections as C, evaluation, fixes, history, models, scan, scoring, structure, textvec, usage)
from codegauge.plans import training
from codegauge.plans.analyze import analyze_corpus
from codegauge.plans.reports import report_by_lang, report_by_rule
from codegauge.session import scratch_path
from codegauge.sources import corpus as corpus_io, dims, files, submissions
from codegauge.streaming import jobs
from workload import inputs as I

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def register(fn: Query) -> Query:
    """Under the function's name; a trailing underscore keeps it apart from the operator it calls."""
    QUERIES[fn.__name__.rstrip("_")] = fn
    return fn


# ---- rule scanning -------------------------------------------------------------------------

@register
def explode_lines(spark, sf):
    return scan.explode_lines(I.snippets(spark, sf).select("doc_id", "code"))


@register
def line_findings(spark, sf):
    return scan.line_findings(I.snippets(spark, sf)).drop("ord")


@register
def table_rule_findings(spark, sf):
    found = scan.line_findings_from_table(I.snippets(spark, sf), dims.rules_df(spark))
    return found.select("doc_id", "line_no", "rule_id", "severity")


@register
def wide_pack_findings(spark, sf):
    """A pack of hundreds of rules, one for each long word of the benchmark, over the lines of all documents."""
    words = I.table(spark, sf, "benchmark").select(
        F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z]{9,}"), F.lit(0))).alias("word")).distinct()
    langs = F.explode(F.array(*[F.lit(x) for x in ("en", "de", "fr", "es")])).alias("lang")
    rules = words.select(F.col("word").alias("rule_id"), langs, F.ascii("word").alias("ord"),
                         F.concat(F.lit(r"\b"), "word", F.lit(r"\b")).alias("pattern"),
                         F.lit(1).alias("severity"), F.lit("benchmark word").alias("message"))
    return scan.line_findings_from_table(I.documents(spark, sf), rules).select("doc_id", "line_no", "rule_id")


@register
def doc_rule_hits(spark, sf):
    return scan.doc_rule_hits(I.snippets(spark, sf))


@register
def fault_report(spark, sf):
    return scan.fault_report(I.snippets(spark, sf))


@register
def page_script_findings(spark, sf):
    return scan.line_findings(I.page_scripts(spark, sf)).drop("ord")


@register
def mutable_defaults(spark, sf):
    return structure.mutable_default_findings(I.snippets(spark, sf))


@register
def unbounded_recursion(spark, sf):
    return structure.unbounded_recursion_findings(I.snippets(spark, sf))


@register
def zero_division(spark, sf):
    return structure.literal_zero_division_findings(I.snippets(spark, sf))


@register
def lint_log_findings(spark, sf):
    return structure.lint_log_findings(I.lint_log(spark, sf))


@register
def all_findings(spark, sf):
    return scoring.all_findings(I.snippets(spark, sf), I.lint_log(spark, sf)).drop("pos")


# ---- scores and reports --------------------------------------------------------------------

@register
def base_score(spark, sf):
    return scoring.base_score(I.snippets(spark, sf))


@register
def base_score_with_lint(spark, sf):
    return scoring.base_score(I.snippets(spark, sf), I.lint_log(spark, sf))


@register
def blend_score(spark, sf):
    snips = I.snippets(spark, sf)
    chances = evaluation.rule_probability(snips, ("doc_id", "code", "lang"))
    hits = scan.with_hits(structure.with_structure(chances))
    base = scoring.score_of(scoring.points_lost(), F.lit(0))
    # one document in seven has no model answer
    p_bug = F.when(F.col("doc_id") % 7 != 0, F.round("p_bug", 2))
    return hits.select("doc_id", base.alias("base"), p_bug.alias("p")).select(
        "doc_id", S.blend(F.col("base"), F.col("p")).alias("score"))


@register
def score_message(spark, sf):
    return scoring.base_score(I.snippets(spark, sf)).select(
        "doc_id", S.score_message(F.col("base_score")).alias("msg"),
        S.confidence(F.col("base_score")).alias("confidence"))


@register
def health_band(spark, sf):
    return scoring.base_score(I.snippets(spark, sf)).select(
        "doc_id", S.health_band(F.col("base_score")).alias("band"),
        S.file_health_band(F.col("base_score")).alias("file_band"))


@register
def severity_icon(spark, sf):
    return scan.line_findings(I.snippets(spark, sf)).groupBy(
        S.severity_icon(F.col("severity")).alias("icon")).agg(F.count(F.lit(1)).alias("lines"))


@register
def severity_counts(spark, sf):
    return scoring.severity_counts(I.snippets(spark, sf), I.lint_log(spark, sf))


@register
def security_count(spark, sf):
    return scan.fault_report(I.snippets(spark, sf)).select(
        "doc_id", S.security_lines(F.col("report")).alias("security_count"))


@register
def analyze_corpus_(spark, sf):
    return analyze_corpus(I.snippets(spark, sf), I.lint_log(spark, sf))


@register
def analyze_pages(spark, sf):
    return analyze_corpus(I.page_scripts(spark, sf))


@register
def report_by_lang_(spark, sf):
    return report_by_lang(analyze_corpus(I.snippets(spark, sf)))


@register
def report_by_rule_(spark, sf):
    return report_by_rule(I.snippets(spark, sf))


# ---- fixes ---------------------------------------------------------------------------------

@register
def apply_fixes(spark, sf):
    return fixes.apply_fixes(I.snippets(spark, sf))


@register
def fix_summary(spark, sf):
    return fixes.fix_summary(I.snippets(spark, sf))


# ---- text, languages, paths ----------------------------------------------------------------

@register
def text_metrics(spark, sf):
    code = F.col("code")
    return I.documents(spark, sf).select(
        "doc_id", T.line_count(code).alias("line_count"), T.char_count(code).alias("char_count"),
        T.newline_count(code).alias("newline_count"), T.is_blank(code).cast("int").alias("is_blank"))


@register
def previews(spark, sf):
    code = F.col("code")
    return I.documents(spark, sf).select(
        "doc_id", T.history_preview(code).alias("history"), T.prompt_preview(code).alias("prompt"))


def _paths(spark, sf):
    """One source path per event, over known, unknown, upper-case and missing suffixes."""
    suffix = F.element_at(F.array(*[F.lit(s) for s in (".py", ".TS", ".java", ".js", ".c", ".tar.gz", "")]),
                          (F.col("event_id") % 7 + 1).cast("int"))
    events = I.table(spark, sf, "events").select("event_id", "event_type")
    return events.select("event_id", F.concat(
        F.lit("src.d/"), F.col("event_type"), F.lit("/f"), F.col("event_id").cast("string"), suffix).alias("path"))


@register
def path_languages(spark, sf):
    lang = L.lang_of_path(F.col("path"))
    return _paths(spark, sf).select(
        "event_id", lang.alias("lang"), L.ext_of_lang(lang).alias("ext"),
        L.fixed_path(F.col("path"), lang).alias("out_path"))


@register
def normalise_lang(spark, sf):
    names = F.array(*[F.lit(n) for n in ("typescript", "cpp", "go", "java", "c", "ruby")])
    events = I.table(spark, sf, "events").select("event_id")
    return events.select("event_id", L.normalise_lang(
        F.element_at(names, (F.col("event_id") % 6 + 1).cast("int"))).alias("lang"))


# ---- corpus --------------------------------------------------------------------------------

@register
def expand_corpus(spark, sf):
    extra = I.snippets(spark, sf).select(
        F.col("doc_id").alias("row_no"), "code", F.col("lang").alias("language"), "bug_type", "has_bug",
        "corrected_code", "description")
    return corpus.expand_corpus(I.labelled_corpus(spark, sf), extra)


@register
def ordered_corpus_lookup(spark, sf):
    """A corpus of several files read with its row numbers, expanded by the snippets, and looked up: the last row of a code wins."""
    path = scratch_path(spark, "ordered")
    corpus_io.write_corpus(I.labelled_corpus(spark, sf).repartitionByRange(5, "row_no").sortWithinPartitions("row_no"), path)
    snips = I.snippets(spark, sf)
    extra = snips.select(F.col("doc_id").alias("row_no"), "code", F.col("lang").alias("language"), "bug_type", "has_bug",
                         "corrected_code", "description")
    known = corpus.expand_ordered(corpus_io.read_ordered_corpus(spark, path), extra)
    return C.exact_lookup(snips, C.corrections(known))


@register
def non_blank(spark, sf):
    return corpus.non_blank(I.snippets(spark, sf)).select("doc_id", "lang")


@register
def corpus_summary(spark, sf):
    return corpus.corpus_summary(I.labelled_corpus(spark, sf))


@register
def stratified_split(spark, sf):
    return corpus.stratified_split(I.snippets(spark, sf)).select(
        "doc_id", "has_bug", F.col("is_test").cast("int").alias("is_test"))


@register
def corpus_file_summary(spark, sf):
    """The corpus written as CSV and read back."""
    path = scratch_path(spark, "corpus")
    corpus_io.write_corpus(I.labelled_corpus(spark, sf), path)
    return corpus_io.read_corpus(spark, path)


@register
def submission_defaults(spark, sf):
    """Submissions written as JSON lines with missing fields, read back with defaults."""
    path = scratch_path(spark, "submissions")
    snips = I.snippets(spark, sf)
    snips.select("doc_id", "user_id", "ts", F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("lang"),
                 F.when(F.col("doc_id") % 4 != 0, F.col("code")).alias("code")).write.json(path)
    return submissions.read_submissions(spark, path).select("doc_id", "user_id", "lang", "code")


@register
def source_file_review(spark, sf):
    """Page scripts stored as text files, read as a tree, fixed and written with their target paths."""
    root = scratch_path(spark, "files")
    src, out = f"{root}/src", f"{root}/fixed"
    files.write_sources(I.page_scripts(spark, sf).select(
        F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("name"), F.col("code").alias("value")), src)
    read = files.read_source_files(spark, src, "javascript")
    files.write_fixed(fixes.with_fixed(read), out)
    done = spark.read.parquet(out)
    return done.select("lang", F.regexp_extract("out_path", r"name=(s[\d-]+)/", 1).alias("name"),
                       F.regexp_extract("out_path", r"(_fixed\.\w+)$", 1).alias("suffix"), "fixed_code")


# ---- corrections ---------------------------------------------------------------------------

def _corr(spark, sf):
    return C.corrections(I.labelled_corpus(spark, sf))


@register
def corrections(spark, sf):
    return _corr(spark, sf).select("row_no", "code", "bug_type", "corrected_code")


@register
def exact_lookup(spark, sf):
    return C.exact_lookup(I.snippets(spark, sf), _corr(spark, sf))


@register
def prefix_similarity(spark, sf):
    """Each document against the one numbered before it."""
    docs = I.table(spark, sf, "documents").select("doc_id", "text")
    other = docs.select((F.col("doc_id") + 1).alias("doc_id"), F.col("text").alias("other"))
    return docs.join(other, "doc_id").select(
        "doc_id", C.prefix_similarity(F.col("text"), F.col("other")).alias("similarity"))


@register
def best_by_type(spark, sf):
    return C.best_by_type(I.snippets(spark, sf), _corr(spark, sf))


@register
def suggest_correction(spark, sf):
    return C.suggest_correction(I.snippets(spark, sf), _corr(spark, sf))


@register
def correction_stats(spark, sf):
    return C.correction_stats(_corr(spark, sf))


@register
def corrections_by_type(spark, sf):
    return C.corrections_by_type(_corr(spark, sf))


# ---- features and models -------------------------------------------------------------------

@register
def extract_features(spark, sf):
    return evaluation.extract_features(I.snippets(spark, sf))


@register
def rule_probability(spark, sf):
    return evaluation.rule_probability(I.snippets(spark, sf)).select(
        "doc_id", F.round("p_bug", 6).alias("p_bug"), "prediction")


@register
def rule_accuracy(spark, sf):
    return evaluation.rule_accuracy(I.snippets(spark, sf)).select(F.round("accuracy", 6).alias("accuracy"))


def _rounded_report(report):
    return report.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in report.dtypes])


@register
def classification_report(spark, sf):
    scored = evaluation.rule_probability(I.snippets(spark, sf), ("has_bug",))
    return _rounded_report(evaluation.classification_report(scored, "has_bug"))


@register
def balanced_weights(spark, sf):
    return evaluation.balanced_weights(I.snippets(spark, sf).select("doc_id", "has_bug")).select(
        "doc_id", "has_bug", F.round("weight", 6).alias("weight"))


@register
def char_wb_ngrams(spark, sf):
    text = N.model_text(F.col("code"), F.col("lang"))
    return I.snippets(spark, sf).select("doc_id", F.array_join(N.char_wb_ngrams(text, 2, 5), "|").alias("grams"))


@register
def top_vocabulary(spark, sf):
    texts = I.documents(spark, sf).select(F.col("code").alias("text"))
    return textvec.top_vocabulary(texts, *textvec.BASIC)


@register
def tfidf_sublinear(spark, sf):
    docs = models.with_text(I.snippets(spark, sf))
    return textvec.tfidf_sublinear(docs, *textvec.BASIC).select(
        "doc_id", "term", "tf", F.round("weight", 6).alias("weight"))


def _labelled(spark, sf):
    return I.snippets(spark, sf).select("doc_id", "lang", "code", "has_bug")


@register
def train_basic_metrics(spark, sf):
    train, test = models.holdout(_labelled(spark, sf))
    return models.evaluate(models.train_basic(train), test)


@register
def train_advanced_metrics(spark, sf):
    train, test = models.holdout(_labelled(spark, sf))
    return models.evaluate(models.train_advanced(train), test)


@register
def training_report(spark, sf):
    """A corpus file read in order, expanded by the snippets, split, both models fitted, stored, loaded and held against the rest."""
    path = scratch_path(spark, "training")
    corpus_io.write_corpus(I.labelled_corpus(spark, sf).repartitionByRange(5, "row_no").sortWithinPartitions("row_no"), f"{path}/corpus")
    extra = I.snippets(spark, sf).select(F.col("doc_id").alias("row_no"), "code", F.col("lang").alias("language"), "bug_type", "has_bug",
                                         "corrected_code", "description")
    report = training.training_report(corpus_io.read_ordered_corpus(spark, f"{path}/corpus"), extra, path)
    return report.select("model", "class", "support", "in_range", "beats_majority")


@register
def predict_stored_model(spark, sf):
    """Trains the basic model, stores it, loads both names back and scores every snippet."""
    snips = _labelled(spark, sf)
    path = scratch_path(spark, "models")
    models.save_models(path, basic=models.train_basic(models.with_text(snips)))
    scored = models.predict_proba(snips, models.load_model(path, "advanced"), models.load_model(path, "basic"))
    return scored.select("doc_id", F.round("p_bug", 6).alias("p_bug"))


# ---- requests and replies ------------------------------------------------------------------

@register
def strip_fence_edges(spark, sf):
    return I.responses(spark, sf).select(
        "request_id", "rank", R.strip_fence_edges(F.col("result")).alias("result"))


@register
def strip_fences_all(spark, sf):
    target = F.when(F.floor(F.col("rank") / 2) % 2 == 0, "c").otherwise("python")
    return I.responses(spark, sf).select(
        "request_id", "rank", R.strip_fences_all(F.col("result"), target).alias("converted"),
        R.strip_fences_all(F.col("result")).alias("answered"))


@register
def accept_response(spark, sf):
    return usage.accept_response(I.responses(spark, sf)).select("request_id", "rank", "result")


@register
def first_success(spark, sf):
    return usage.first_success(I.requests(spark, sf), I.responses(spark, sf))


@register
def context_usage(spark, sf):
    return usage.with_usage(usage.first_success(I.requests(spark, sf), I.responses(spark, sf))).select(
        "request_id", "limit", "limit_pct", "band", "bar")


@register
def usage_by_model(spark, sf):
    return usage.usage_by_model(I.responses(spark, sf))


def _request_rows(spark, sf):
    """Requests over snippets: conversions, reviews, fixes and assistant calls, some incomplete."""
    n = F.col("doc_id")
    task = F.element_at(F.array(*[F.lit(t) for t in ("convert", "assistant", "review", "fix", "assistant")]),
                        (n % 5 + 1).cast("int"))
    to_lang = F.element_at(F.array(F.lit("java"), F.lit("python"), F.lit("go")), (n % 3 + 1).cast("int"))
    prompt = F.when(n % 11 == 0, F.lit("  ")).when(n % 13 != 0, F.concat(
        F.lit("make it faster "), n.cast("string")))
    return I.snippets(spark, sf).select("doc_id", task.alias("task"), "lang", to_lang.alias("to_lang"),
                                        prompt.alias("prompt"), "code")


@register
def validate_request(spark, sf):
    some = _request_rows(spark, sf).withColumn("code", F.when(F.col("doc_id") % 4 != 0, F.col("code")))
    return usage.validate_request(some).select(
        "doc_id", F.coalesce("error", F.lit("")).alias("error"))


@register
def build_prompts(spark, sf):
    valid = usage.validate_request(_request_rows(spark, sf)).filter("error is null")
    return usage.build_prompts(valid).select("doc_id", "kind", "system", "user")


@register
def fallback_to_rules(spark, sf):
    results = analyze_corpus(I.snippets(spark, sf)).select("doc_id", "old_line", "full_code")
    replies = usage.first_success(I.requests(spark, sf), I.responses(spark, sf))
    return usage.fallback_to_rules(results, replies, replies)


# ---- history and streams -------------------------------------------------------------------

def _stamped(df):
    return df.withColumn("ts", F.date_format("ts", STAMP))


@register
def recent_history(spark, sf):
    return _stamped(history.recent_history(I.snippets(spark, sf)))


@register
def recent_outputs(spark, sf):
    return history.recent_outputs(I.snippets(spark, sf).withColumnRenamed("code", "prompt"))


def _event_stream(spark, sf):
    schema = I.table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf)


@register
def analyze_stream(spark, sf):
    root = scratch_path(spark, "stream")
    jobs.write_analysis(I.snippets_of(_event_stream(spark, sf)), f"{root}/out", f"{root}/cp").awaitTermination()
    return spark.read.parquet(f"{root}/out")


@register
def recent_history_stream(spark, sf):
    root = scratch_path(spark, "history")
    jobs.write_recent_history(
        I.snippets_of(_event_stream(spark, sf)), f"{root}/out", f"{root}/cp").awaitTermination()
    return _stamped(jobs.read_recent_history(spark, f"{root}/out"))
