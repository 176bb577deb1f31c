"""Registered queries: every operator over whole test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultscope.functions import dates, rules, text as tx
from faultscope.functions.keywords import keywords_to_json
from faultscope.operators import case_index, evaluation, learning, prepare, quality, ranking, similarity, text_keywords, tfidf, trends
from faultscope.plans import ingest, scoring
from faultscope.plans.dashboard import enrich, selection
from faultscope.plans.stand_ins import (
    EQUIPMENT, dated_reports, device_reports, labelled_documents, nested_events, pick, prediction_rows,
    scored_documents, table, texts, trouble_reports, uploaded_files,
)
from faultscope.session import scratch_path
from faultscope.sources import documents, history, tables
from faultscope.streaming import jobs

COLLECTION = dict(keywords=["blue bolt", "widget", "economy"], start="1996-01-01", end="1999-12-31", max_records=150, page=100)


# ---- text and rules

def low_quality_by_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = texts(spark, sf).select("doc_id", tx.guess_language(F.col("text")).alias("guessed"))
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    return docs.join(labels, "doc_id").groupBy("guessed").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.count_if(F.col("quality") == 0).alias("n_low"),
        F.round(F.avg((F.col("quality") == 0).cast("int")), 6).alias("low_share"))


def clean_text_profile(spark, sf):
    return texts(spark, sf).select("doc_id", tx.clean_text(F.col("text")).alias("cleaned"))


def plain_lower(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.plain_lower(F.col("text")).alias("lowered"))


def lang_guess_matrix(spark, sf):
    return texts(spark, sf).groupBy("lang", tx.guess_language(F.col("text")).alias("guessed")).agg(
        F.count(F.lit(1)).alias("n"))


def _glossary(texts: list[str]) -> list[str]:
    return [t.replace(" the ", " le ") for t in texts]


def translation_policy(spark, sf):
    docs = texts(spark, sf).select("doc_id", "text")
    return scoring.translate_if_needed(docs, "text", translator=_glossary).select("doc_id", "src_lang", "translated", "model_text")


def clipped_text(spark, sf):
    docs = texts(spark, sf)
    padded = F.concat(F.lit(" \n"), "text", F.lit("\x00\t "))
    return docs.select("doc_id", tx.clip_text(padded, 2000).alias("clipped"))


def device_type_first(spark, sf):
    reports = device_reports(spark, sf)
    return reports.select("p_partkey", F.coalesce(rules.device_type(F.col("event_text"), "first"), F.lit(rules.OTHER_TYPE)).alias("device_type"))


def device_type_last(spark, sf):
    return rules.add_detected_type(device_reports(spark, sf), "event_text").select("p_partkey", F.col("TypeDetecte").alias("device_type"))


def device_type_counts(spark, sf):
    return trends.value_counts(rules.add_detected_type(device_reports(spark, sf), "event_text"), "TypeDetecte")


def critical_word_label(spark, sf):
    cleaned = tx.clean_text(F.col("event_text"))
    return trouble_reports(spark, sf).select(
        "p_partkey", rules.critical_by_words(cleaned).alias("label"), rules.critical_by_words(cleaned, folded=True).alias("label_folded"))


def fallback_word_label(spark, sf):
    return trouble_reports(spark, sf).select("p_partkey", rules.critical_by_fallback(F.col("event_text")).alias("label"))


def event_type_label(spark, sf):
    events = table(spark, sf, "events").select(F.concat(F.lit(" "), F.upper("event_type")).alias("event_type"))
    return events.groupBy("event_type", rules.critical_by_event_type(F.col("event_type"), ["error"]).alias("label")).agg(
        F.count(F.lit(1)).alias("n"))


def recommendation(spark, sf):
    level = F.when(F.col("o_orderpriority").startswith("1"), "Critique ").when(
        F.col("o_orderpriority").startswith("2"), "Modérée ").when(F.col("o_orderpriority").startswith("3"), "Faible ")
    alerts = table(spark, sf, "orders").select(F.concat(level, "o_orderpriority").alias("Alerte"))
    return alerts.groupBy("Alerte", rules.recommendation(F.col("Alerte")).alias("Recommandation")).agg(F.count(F.lit(1)).alias("n"))


def maintenance_interval(spark, sf):
    return table(spark, sf, "part").select("p_partkey", pick(EQUIPMENT, F.col("p_partkey")).alias("equipment")).withColumn(
        "hours", rules.maintenance_hours(F.col("equipment")))


# ---- preparation

def _mixed_columns(spark, sf):
    docs = texts(spark, sf)
    return docs.select(
        "doc_id",
        F.when(F.col("lang") == "en", F.col("text")).alias("EVENT_TEXT"),
        F.when(F.col("lang") == "fr", F.concat(F.lit(" \n"), "text", F.lit("\t"))).alias("Narrative"),
        F.lit("  ").alias("Summary"),
        "source", "lang",
        F.when(~F.col("lang").isin("en", "fr"), F.concat(F.lit("\n "), "text")).alias("Remarks"),
        F.when(F.col("source") == "src0", " Death").when(F.col("source") == "src1", "INJURY ").when(
            F.col("source") == "src2", "Malfunction").alias("EVENT_TYPE"),
        F.col("n_chars").cast("string").alias("Report_Date"),
    )


def first_non_blank(spark, sf):
    df = prepare.lower_names(_mixed_columns(spark, sf))
    return df.select("doc_id", prepare.first_text(df).alias("event_text"))


def processed_table(spark, sf):
    return prepare.processed_table(_mixed_columns(spark, sf))


def legacy_table(spark, sf):
    raw = texts(spark, sf).select(
        F.lit("20240101").alias("date_received"), F.col("lang").alias("event_type"), F.col("source").alias("brand_name"),
        F.col("text").alias("event_text"))
    return prepare.legacy_table(raw)


def flatten_events(spark, sf):
    return prepare.flatten_events(nested_events(spark, sf), extra=["o_orderkey"])


def keyword_hits(spark, sf):
    events = nested_events(spark, sf)
    found = prepare.search_events(events, COLLECTION["keywords"], COLLECTION["start"], COLLECTION["end"])
    return found.groupBy("keyword", "event_type").agg(F.count(F.lit(1)).alias("n"))


def keyword_capped(spark, sf):
    found = prepare.search_events(nested_events(spark, sf), COLLECTION["keywords"], COLLECTION["start"], COLLECTION["end"])
    return prepare.cap_per_keyword(found, "o_orderkey", COLLECTION["max_records"], COLLECTION["page"]).select("keyword", "o_orderkey")


def incident_collection(spark, sf):
    return ingest.collect_incidents(nested_events(spark, sf), "o_orderkey", **COLLECTION)


def dedup_first(spark, sf):
    docs = table(spark, sf, "documents").select(
        "doc_id", F.col("lang").alias("date_received"), F.lit("").alias("brand_name"), F.lit(None).cast("string").alias("generic_name"),
        F.col("text").alias("event_text"), "source")
    return prepare.dedup_first(docs, ["doc_id"]).select("doc_id", "date_received", "source", F.char_length("event_text").alias("chars"))


def enriched_table(spark, sf):
    lines = device_reports(spark, sf).withColumn("Date", F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), F.col("p_partkey").cast("int") % 700), "yyyyMMdd"))
    alerts = lines.withColumn("Alerte", F.when(F.col("brand_name").endswith("1"), "Critique").otherwise("Faible"))
    return enrich(alerts).select("p_partkey", "TypeDetecte", "Recommandation", F.to_date("date_dt").alias("date_dt"))


# ---- quality

def _quality_frame(spark, sf):
    return labelled_documents(spark, sf, "left").drop("n_chars", "doc_id")


def quality_counts(spark, sf):
    return quality.quality_counts(_quality_frame(spark, sf))


def class_balance(spark, sf):
    return quality.class_balance(_quality_frame(spark, sf))


def quality_report(spark, sf):
    return quality.quality_report(_quality_frame(spark, sf))


def dataset_fingerprint(spark, sf):
    return quality.fingerprint(table(spark, sf, "documents"))


def file_checksums(spark, sf):
    return tables.file_checksums(spark, f"{sf}/documents.parquet").select("length", "file_md5")


def dataset_gate(spark, sf):
    return _gate_columns(quality.dataset_gate(_quality_frame(spark, sf)))


def dataset_gate_labelled(spark, sf):
    return _gate_columns(quality.dataset_gate(labelled_documents(spark, sf)))


def _gate_columns(gate):
    return gate.withColumn("failed_checks", F.array_join("failed_checks", "; ")).withColumn("label_ratio", F.round("label_ratio", 6))


def length_stats(spark, sf):
    return quality.length_stats(labelled_documents(spark, sf, "left")).withColumn("label_ratio", F.round("label_ratio", 6))


# ---- dashboard

def monthly_counts(spark, sf):
    return trends.monthly_counts(dated_reports(spark, sf), groups=["event_type"])


def monthly_counts_of_type(spark, sf):
    return trends.monthly_counts(selection(dated_reports(spark, sf), "1-URGENT"))


def severity_filter(spark, sf):
    reports = dated_reports(spark, sf)
    kinds = {"default": None, "none": [], "open": ["O"]}
    return prepare.union_all([
        trends.kpis(trends.filter_severity(reports, chosen)).select(F.lit(kind).alias("kind"), "n_reports", "last_date")
        for kind, chosen in kinds.items()])


def _gappy_events(spark, sf):
    return table(spark, sf, "events").select(F.when(F.col("event_type") != "signup", F.col("event_type")).alias("event_type"))


def top_values_with_missing(spark, sf):
    return trends.value_counts(_gappy_events(spark, sf), "event_type", 12)


def top_values_present(spark, sf):
    return trends.value_counts(_gappy_events(spark, sf), "event_type", 3, nulls="drop")


def facet_values(spark, sf):
    return trends.distinct_values(dated_reports(spark, sf), "event_type")


def kpis(spark, sf):
    return trends.kpis(dated_reports(spark, sf), groups=["TypeDetecte"])


def forecast_by_status(spark, sf):
    counts = trends.monthly_counts(dated_reports(spark, sf), groups=["event_type"])
    return trends.forecast(counts, ["event_type"]).withColumn("incidents", F.round("incidents", 4))


def forecast_total(spark, sf):
    return trends.forecast(trends.monthly_counts(dated_reports(spark, sf))).withColumn("incidents", F.round("incidents", 4))


def date_parse(spark, sf):
    day = F.col("o_orderdate")
    spelled = F.get(F.array(
        F.date_format(day, "yyyyMMdd"), F.date_format(day, "yyyy-MM-dd"), F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss"),
        F.date_format(day, "MM/dd/yyyy"), F.date_format(day, "MMM d, yyyy"), F.lit("20209999"), F.lit("unknown"), F.lit(None).cast("string"),
    ), F.pmod(F.col("o_orderkey"), F.lit(8)).cast("int"))
    orders = table(spark, sf, "orders").select("o_orderkey", spelled.alias("date_received"))
    return dates.add_parsed_date(orders).select("o_orderkey", F.to_date("date_dt").alias("parsed"))


def preview(spark, sf):
    return trends.preview(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderkey"], 1000)


# ---- splits and samples

def stratified_split(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    return ranking.split_rows(labels, "doc_id", "quality").select("doc_id", F.col("is_test").cast("int").alias("is_test"))


def plain_split(spark, sf):
    return ranking.split_rows(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey").select(
        "o_orderkey", F.col("is_test").cast("int").alias("is_test"))


def training_sample(spark, sf):
    return ranking.sample_rows(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", 4000)


# ---- TF-IDF and similarity

def _vocabulary(spark, sf, ngrams=(1, 2), min_df=1, max_features=None):
    docs = texts(spark, sf).select("doc_id", "text")
    return tfidf.fit_vocabulary(tfidf.text_postings(docs, "text", "doc_id", ngrams), docs.count(), min_df=min_df, max_features=max_features)


def _hash_vocabulary(docs):
    """Postings and vocabulary by hashes of terms, which are narrower than terms."""
    postings = tfidf.hash_postings(docs, "text", "doc_id")
    return postings, tfidf.fit_vocabulary(postings, docs.count(), key="hash")


def term_vocabulary(spark, sf):
    """The vocabulary of a preset; ``whole_vocabulary`` has no limit."""
    return _vocabulary(spark, sf, min_df=learning.FULL.min_df, max_features=learning.FULL.max_features).withColumn(
        "idf", F.round("idf", 6))


def whole_vocabulary(spark, sf):
    return _vocabulary(spark, sf).withColumn("idf", F.round("idf", 6))


def document_norms(spark, sf):
    postings, vocabulary = _hash_vocabulary(texts(spark, sf).select("doc_id", "text"))
    return tfidf.document_norms(postings, vocabulary, "doc_id", key="hash").withColumn("norm", F.round("norm", 5))


def tfidf_keywords(spark, sf):
    return text_keywords.text_keywords(texts(spark, sf), "text", "doc_id", 15)


def similar_cases(spark, sf):
    return similarity.similar_cases(texts(spark, sf), table(spark, sf, "benchmark")).select(
        "item_id", "rank", "doc_id", F.round("similarity", 5).alias("similarity"))


def kept_case_search(spark, sf):
    """An index of English texts that grows by the others, searched without reading texts again."""
    docs = texts(spark, sf).select("doc_id", "text", F.coalesce("lang", F.lit("")).alias("lang"))
    index = case_index.build_index(docs.where("lang = 'en'"), scratch_path(spark, "kept-cases"))
    index = case_index.append_cases(spark, index, docs.where("lang <> 'en'"))
    found = case_index.search(index, table(spark, sf, "benchmark")).cases
    return found.select("item_id", "rank", "doc_id", F.round("similarity", 5).alias("similarity"))


def case_fill(spark, sf):
    """Queries with fewer hits than asked for, filled by cases of similarity 0; the others have none at all."""
    parts = table(spark, sf, "part")
    asked = parts.select(F.col("p_type").alias("kind")).distinct().withColumn("text", F.col("kind"))
    found = similarity.similar_cases(parts, asked, None, "p_partkey", "p_name", "kind", "text", k=400)
    return found.withColumn("similarity", F.round("similarity", 5))


def similar_case_view(spark, sf):
    docs = texts(spark, sf).select("doc_id", "text", F.col("lang").alias("TypeDetecte"), F.col("source").alias("date_received"))
    cases = similarity.similar_cases(docs, table(spark, sf, "benchmark"), k=5)
    return similarity.similar_case_view(cases, docs, "doc_id", "item_id", "text")


# ---- models

def _split_documents(spark, sf):
    df = ranking.split_rows(labelled_documents(spark, sf), "doc_id", "label")
    return df.filter(~F.col("is_test")).drop("is_test"), df.filter("is_test").drop("is_test")


def _rounded(metrics):
    return metrics.select(*[F.round(c, 4).alias(c) for c in ("accuracy", "f1", "roc_auc")], "n_samples")


def train_eval_logreg(spark, sf):
    train, test = _split_documents(spark, sf)
    model = learning.train_text_classifier(train, "event_text", "label", "doc_id", learning.MINIMAL)
    return _rounded(evaluation.binary_metrics(learning.score_texts(test, model, "event_text")))


def train_eval_forest(spark, sf):
    train, test = _split_documents(spark, sf)
    model = learning.train_text_classifier(train, "event_text", "label", "doc_id", learning.FULL_FOREST)
    return evaluation.class_report(learning.score_texts(test, model, "event_text")).select(
        "class", *[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1")], "support")


def embedding_classifier(spark, sf):
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding", (F.col("label") < 5).cast("int").alias("label"))
    df = ranking.split_rows(vectors, "vec_id", "label")
    model = learning.train_embedding_classifier(df.filter(~F.col("is_test")), "embedding", "label")
    return _rounded(evaluation.binary_metrics(learning.score_embeddings(df.filter("is_test"), model, "embedding")))


_MODELS = {}


def _quick_model(spark, sf):
    """One model for all queries of an application over the same tables."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _MODELS:
        _MODELS[key] = _trained(spark, sf)
    return _MODELS[key]


def _trained(spark, sf):
    return learning.train_text_classifier(labelled_documents(spark, sf), "event_text", "label", "doc_id", learning.MINIMAL)


def predict_texts(spark, sf):
    path = scratch_path(spark, "model")
    learning.save_model(_quick_model(spark, sf), path)
    return scoring.predict(table(spark, sf, "benchmark"), learning.load_model(spark, path), "text", "item_id").withColumn(
        "keywords", keywords_to_json(F.col("keywords")))


# ---- evaluation

def score_metrics(spark, sf):
    return _metrics(evaluation.binary_metrics(scored_documents(spark, sf)))


def _metrics(df):
    return df.select(*[F.round(c, 6).alias(c) for c in ("accuracy", "f1", "roc_auc")], "n_samples")


def decision_and_confidence(spark, sf):
    proba = F.col("proba")
    return scored_documents(spark, sf).select(
        "doc_id", tx.decision_label(proba).alias("decision"), tx.decision_label(proba, 0.25).alias("strict_decision"),
        tx.confidence_percent(proba).alias("confidence"))


def metrics_record(spark, sf):
    path = scratch_path(spark, "metrics")
    tables.write_metrics(evaluation.binary_metrics(scored_documents(spark, sf)), path)
    return _metrics(tables.read_metrics(spark, path))


def confusion(spark, sf):
    return evaluation.confusion(scored_documents(spark, sf))


def _curve(points):
    """Rounded points; the start above every score has a null threshold."""
    threshold = F.when(F.col("threshold") < float("inf"), F.round("threshold", 6)).alias("threshold")
    return points.select(threshold, F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


def roc_points(spark, sf):
    points = evaluation.roc_points(scored_documents(spark, sf), drop_intermediate=False)
    return _curve(points)


def roc_points_plotted(spark, sf):
    points = evaluation.roc_points(scored_documents(spark, sf))
    return _curve(points)


def pr_points(spark, sf):
    return evaluation.pr_points(scored_documents(spark, sf)).select(
        F.round("threshold", 6).alias("threshold"), F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


def class_report(spark, sf):
    return evaluation.class_report(scored_documents(spark, sf)).select(
        "class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


# ---- documents

def _one_line(c):
    return F.trim(F.regexp_replace(c, r"[ \t\r\n]+", " "))


def html_text(spark, sf):
    return texts(spark, sf, "pages").select("page_id", _one_line(documents.html_to_text(F.col("html"))).alias("text"))


def file_text(spark, sf):
    read = documents.extract_text(uploaded_files(spark, sf), "name", "content")
    return read.select("name", F.when(F.col("name").endswith(".HTML"), _one_line(F.col("text"))).otherwise(F.col("text")).alias("text"))


def unreadable_trace(spark, sf):
    digits = F.regexp_replace(F.hex("event_id"), "(.)", "F$1")
    content = F.when(F.col("event_type") == "click", F.col("props").cast("binary")).otherwise(F.unhex(digits))
    return table(spark, sf, "events").select("event_id", documents.text_or_trace(content).alias("text"))


def document_scoring(spark, sf):
    model = _quick_model(spark, sf)
    files = documents.extract_text(uploaded_files(spark, sf), "name", "content")
    scored = scoring.score_documents(files, model, "name", "text", max_chars=None)
    path = scratch_path(spark, "history")
    history.append_history(history.history_rows(scored, "docs", F.lit("2024-01-01 00:00:00").cast("timestamp"), ["file_name"]), path)
    stored = history.read_history(spark, path)
    return stored.select("file_name", "ts", "label", F.round("proba", 6).alias("proba"), "detected_type", "src_lang", "translated", "top_keywords")


def keyword_export(spark, sf):
    model = _quick_model(spark, sf)
    notes = texts(spark, sf).select(F.col("doc_id").cast("string").alias("name"), "text")
    return scoring.keyword_export(scoring.score_documents(notes, model, "name", "text", max_chars=None))


# ---- history

def _stored_history(spark, sf):
    path = scratch_path(spark, "history")
    rows = prediction_rows(spark, sf)
    history.append_history(history.history_rows(rows, "import", F.col("at"), ["conv_id", "turn"]), path)
    return history.read_history(spark, path)


def _listed(df):
    return df.select(*history.LISTED[1:-1], keywords_to_json(F.col("top_keywords")).alias("top_keywords"))


def history_recent(spark, sf):
    return _listed(history.recent_predictions(_stored_history(spark, sf), 200))


def history_search(spark, sf):
    return _listed(history.search_predictions(_stored_history(spark, sf), "CASE_1%_1", 1000))


def history_view(spark, sf):
    return history.history_view(history.recent_predictions(_stored_history(spark, sf), 1000)).drop("id")


# ---- sources and sinks

def csv_round_trip(spark, sf):
    path = scratch_path(spark, "documents") + ".csv"
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    tables.write_csv(docs, path)
    return tables.load_main_dataset(spark, [path + "-missing"], [path]).select(
        F.col("doc_id").try_cast("bigint").alias("doc_id"), "text", "lang", "source", F.col("n_chars").try_cast("bigint").alias("n_chars"))


def kept_table(spark, sf):
    path = scratch_path(spark, "kept")
    tables.write_table(table(spark, sf, "part").select("p_partkey", "p_name"), path)
    tables.write_table(table(spark, sf, "part").select("p_partkey").limit(0), path, force=False)
    return spark.read.parquet(path)


def report_documents(spark, sf):
    json_path, markdown_path = scratch_path(spark, "quality-json"), scratch_path(spark, "quality-md")
    ingest.write_quality_report(_quality_frame(spark, sf), json_path, markdown_path)
    doc = spark.read.schema("rows bigint, cols bigint, dup_rows bigint").json(json_path, multiLine=True)
    return doc.select(F.col("rows").alias("n_rows"), F.col("cols").alias("n_cols"), "dup_rows")


def event_archive_round_trip(spark, sf):
    path = scratch_path(spark, "events")
    tables.write_event_archive(nested_events(spark, sf).drop("o_orderkey"), path)
    events = tables.read_events(spark, path)
    return prepare.flatten_events(events).groupBy("date_received", "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.char_length("event_text")).alias("chars"), F.sum(F.char_length("brand_name")).alias("brand_chars"))


# ---- streaming

def _stream(spark, sf, name):
    source = table(spark, sf, name)
    return jobs.read_stream(spark, f"{sf}/{name}.parque[t]", source.schema)  # a pattern, as a stream reads folders


def stream_scoring(spark, sf):
    model = _quick_model(spark, sf)
    target, checkpoint = scratch_path(spark, "history"), scratch_path(spark, "checkpoint")
    turns = _stream(spark, sf, "conversations").select(
        F.concat_ws("_", "conv_id", "turn").alias("name"), "text", F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id")).alias("ts"))
    jobs.score_stream(turns, model, "name", "text", "ts", target, checkpoint, max_chars=None).awaitTermination()
    return history.read_history(spark, target).select("file_name", "ts", "label", F.round("proba", 6).alias("proba"), "src_lang", "top_keywords")


def stream_dedup(spark, sf):
    target, checkpoint = scratch_path(spark, "events"), scratch_path(spark, "checkpoint")
    events = _stream(spark, sf, "events")
    doubled = events.unionByName(events)
    jobs.dedup_stream(doubled, ["event_id"], "ts", "40 days", target, checkpoint).awaitTermination()
    return spark.read.parquet(target).select("event_id", "user_id", "event_type")


def stream_daily_counts(spark, sf):
    target, checkpoint = scratch_path(spark, "counts"), scratch_path(spark, "checkpoint")
    counts = jobs.daily_counts(_stream(spark, sf, "events"), "ts", ["event_type"])
    jobs.publish_counts(counts, target, checkpoint).awaitTermination()
    return spark.read.parquet(target)


def stream_monthly_counts(spark, sf):
    target, checkpoint = scratch_path(spark, "counts"), scratch_path(spark, "checkpoint")
    orders = _stream(spark, sf, "orders").select("o_orderdate", "o_orderstatus")
    jobs.publish_counts(jobs.monthly_counts(orders, "o_orderdate", ["o_orderstatus"]), target, checkpoint).awaitTermination()
    return spark.read.parquet(target)


QUERIES = {
    f.__name__: f for f in (
        low_quality_by_language, clean_text_profile, plain_lower, lang_guess_matrix, translation_policy, clipped_text,
        device_type_first, device_type_last, device_type_counts, critical_word_label, fallback_word_label, event_type_label,
        recommendation, maintenance_interval, first_non_blank, processed_table, legacy_table, flatten_events, keyword_hits,
        keyword_capped, incident_collection, dedup_first, enriched_table, quality_counts, class_balance, quality_report,
        dataset_fingerprint, file_checksums, dataset_gate, dataset_gate_labelled, length_stats, monthly_counts,
        monthly_counts_of_type, severity_filter, top_values_with_missing, top_values_present, facet_values, kpis,
        forecast_by_status, forecast_total, date_parse, preview, stratified_split, plain_split, training_sample,
        term_vocabulary, whole_vocabulary, document_norms, tfidf_keywords, similar_cases, similar_case_view, kept_case_search, case_fill, train_eval_logreg,
        train_eval_forest, embedding_classifier, predict_texts, score_metrics, decision_and_confidence, metrics_record, confusion, roc_points,
        roc_points_plotted, pr_points, class_report, html_text, file_text, unreadable_trace, document_scoring,
        keyword_export, history_recent, history_search, history_view, csv_round_trip, kept_table, report_documents, event_archive_round_trip,
        stream_scoring, stream_dedup, stream_daily_counts, stream_monthly_counts,
    )
}
