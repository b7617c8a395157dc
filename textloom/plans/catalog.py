"""All queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import notetext, numbers
from textloom.functions.icd import POOL
from textloom.operators import agreement, audit, codes, cohort, corpus, demographics, evaluation, features, mentions, preprocessing, sections, synthetic, textmetrics, tokens
from textloom.plans import oracles as sql
from textloom.plans.lens import lens, tables
from textloom.streaming import incremental

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return add


# --- the input corpus ---------------------------------------------------------------------------------------------


def _selection(s: SparkSession, d: str) -> DataFrame:
    return corpus.input_corpus_selection(lens(s, d, "discharge"), lens(s, d, "diagnoses_icd"))


def _corpus(s: SparkSession, d: str) -> DataFrame:
    return corpus.input_corpus(lens(s, d, "discharge"), lens(s, d, "diagnoses_icd"))


def _codes(s: SparkSession, d: str) -> DataFrame:
    return codes.diagnosis_codes(_corpus(s, d), lens(s, d, "diagnoses_icd"))


def _order_codes(s: SparkSession, d: str) -> DataFrame:
    return codes.diagnosis_codes(lens(s, d, "order_notes"), lens(s, d, "order_codes"))


query("input_corpus_selection", sql.SELECTION)(_selection)
query("corpus_funnel", sql.FUNNEL)(lambda s, d: corpus.corpus_funnel(_selection(s, d)))
query("corpus_comparison", sql.COMPARISON)(lambda s, d: corpus.corpus_comparison({"discharge": lens(s, d, "discharge"), "radiology": lens(s, d, "radiology")}))
query("patient_summary", sql.PATIENT_SUMMARY)(lambda s, d: corpus.patient_summary(lens(s, d, "order_notes")))
query("notes_per_patient", sql.per("subject_id", 10))(lambda s, d: corpus.notes_per_patient(lens(s, d, "order_notes")))
query("notes_per_admission", sql.per("hadm_id", 3))(lambda s, d: corpus.notes_per_admission(lens(s, d, "order_notes")))
query("hadm_coverage", sql.COVERAGE)(lambda s, d: corpus.hadm_coverage({"discharge": lens(s, d, "discharge"), "radiology": lens(s, d, "radiology")},
    lens(s, d, "diagnoses_icd")))


def _era(s, d):
    return corpus.icd_era(lens(s, d, "order_notes"), lens(s, d, "order_codes"))


query("icd_era", sql.ERA)(_era)
query("icd_era_by_group", sql.ERA_BY_GROUP)(lambda s, d: corpus.icd_era_by_group(_era(s, d), lens(s, d, "patients")))
query("era_transition", sql.ERA_TRANSITION)(lambda s, d: corpus.era_transition(corpus.icd_era_by_group(_era(s, d), lens(s, d, "patients"))))


def _demographics(s, d):
    return demographics.demographic_notes(lens(s, d, "order_notes"), lens(s, d, "patients"), lens(s, d, "admissions"))


query("demographic_notes", sql.DEMOGRAPHIC_NOTES)(_demographics)
query("demographic_summary", sql.DEMOGRAPHIC_SUMMARY)(lambda s, d: demographics.demographic_summary(_demographics(s, d)))
query("attribute_counts", sql.ATTRIBUTE_COUNTS)(lambda s, d: demographics.attribute_counts(_demographics(s, d)))
query("attribute_table", sql.ATTRIBUTE_TABLE)(lambda s, d: demographics.attribute_table(demographics.attribute_counts(_demographics(s, d))))
query("age_gender_counts", sql.AGE_GENDER)(lambda s, d: demographics.age_gender_counts(_demographics(s, d)))
query("majority_gender", sql.majority("gender"))(lambda s, d: demographics.majority(demographics.attribute_counts(_demographics(s, d)), "gender"))
query("largest_race", sql.majority("race"))(lambda s, d: demographics.majority(demographics.attribute_counts(_demographics(s, d)), "race"))

# --- text metrics -------------------------------------------------------------------------------------------------


def _marked_notes(s, d):
    """Notes with marks of all kinds."""
    tables(s, d)
    return s.sql(sql.MARKED_NOTES)


def _metrics(s, d):
    return textmetrics.note_metrics(_marked_notes(s, d))


query("note_metrics", sql.NOTE_METRICS)(lambda s, d: _metrics(s, d))
query("length_percentiles", sql.LENGTH_PERCENTILES)(lambda s, d: textmetrics.length_percentiles(_metrics(s, d)))
query("length_histogram", sql.LENGTH_HISTOGRAM)(lambda s, d: textmetrics.length_histogram(_metrics(s, d)))
query("histogram_shares", sql.HISTOGRAM_SHARES)(lambda s, d: textmetrics.histogram_shares(textmetrics.length_histogram(_metrics(s, d))))
query("marker_summary", sql.MARKER_SUMMARY)(lambda s, d: textmetrics.marker_summary(_metrics(s, d)))
query("residual_masks", sql.RESIDUAL_MASKS)(lambda s, d: textmetrics.residual_masks(_metrics(s, d)))
query("note_quality", sql.NOTE_QUALITY)(lambda s, d: textmetrics.note_quality(_metrics(s, d)))
query("age_masks", sql.AGE_MASKS)(lambda s, d: textmetrics.age_masks(_metrics(s, d)))
query("marker_means", sql.MARKER_MEANS)(lambda s, d: textmetrics.marker_means(_metrics(s, d)))
query("share_table", sql.SHARE_TABLE)(lambda s, d: numbers.share_table(textmetrics.length_histogram(_metrics(s, d))))
query("exact_duplicates", sql.EXACT_DUPLICATES)(lambda s, d: textmetrics.exact_duplicates(lens(s, d, "discharge")))

# --- tokens -------------------------------------------------------------------------------------------------------


def _tokens(s, d):
    return tokens.note_tokens(lens(s, d, "discharge"))


query("note_tokens", sql.NOTE_TOKENS)(_tokens)
query("token_percentiles", sql.TOKEN_PERCENTILES)(lambda s, d: tokens.token_percentiles(_tokens(s, d)))
query("token_histogram", sql.TOKEN_HISTOGRAM)(lambda s, d: tokens.token_histogram(_tokens(s, d)))
query("window_summary", sql.WINDOW_SUMMARY)(lambda s, d: tokens.window_summary(_tokens(s, d)))
query("hash_sample", sql.HASH_SAMPLE)(lambda s, d: tokens.hash_sample(lens(s, d, "discharge"), 100).select("note_id", F.length("text").cast("long").alias("chars")))
query("parallel_ratio", sql.PARALLEL_RATIO)(lambda s, d: tokens.parallel_ratio(_tokens(s, d).select((F.col("words") - 2).alias("a"), (F.col("pieces") - 2).alias("b"))))
query("note_parts")(lambda s, d: tokens.note_parts(lens(s, d, "discharge"), capacity=200))
query("split_sample")(lambda s, d: tokens.split_sample(tokens.note_parts(tokens.hash_sample(lens(s, d, "discharge")), capacity=200),
    _tokens(s, d).select("note_id", (F.col("words") - 2)), 200))
query("token_windows", sql.TOKEN_WINDOWS)(lambda s, d: lens(s, d, "discharge").select("note_id", tokens.token_windows(F.regexp_extract_all(F.coalesce("text", F.lit("")),
    F.lit(r"\S+"), F.lit(0)), ["<s>"], ["</s>"], 128).alias("w")).select("note_id", F.size("w").cast("long").alias("windows"),
    F.aggregate("w", F.lit(0), lambda t, x: t + F.size(x) - 2).cast("long").alias("tokens")))

# --- codes --------------------------------------------------------------------------------------------------------

query("diagnosis_codes", sql.DIAGNOSIS_CODES)(_codes)
query("era_summary", sql.ERA_SUMMARY)(lambda s, d: codes.era_summary(_corpus(s, d), _codes(s, d)))
query("comorbidity_counts", sql.comorbidities(codes.COMORBIDITIES))(lambda s, d: codes.group_counts(_codes(s, d), codes.COMORBIDITIES))
query("code_ranking", sql.CODE_RANKING)(lambda s, d: codes.code_ranking(_order_codes(s, d), lens(s, d, "code_titles")))
query("candidate_notes", sql.CANDIDATE_NOTES)(lambda s, d: codes.candidate_notes(_codes(s, d)))
query("candidate_prevalence", sql.PREVALENCE)(lambda s, d: codes.candidate_prevalence(_corpus(s, d), _codes(s, d)))
query("cooccurrence", sql.COOCCURRENCE)(lambda s, d: codes.cooccurrence(_codes(s, d)))
query("preselection", sql.PRESELECTION)(lambda s, d: codes.preselection(codes.candidate_prevalence(_corpus(s, d), _codes(s, d))))
query("uncovered_groups", sql.uncovered_groups(codes.COMORBIDITIES))(lambda s,
    d: codes.uncovered_groups(codes.group_counts(_codes(s, d), codes.COMORBIDITIES), _corpus(s, d)))
query("era_gaps", sql.ERA_GAPS)(lambda s, d: codes.era_gaps(codes.candidate_prevalence(_corpus(s, d), _codes(s, d))))
query("redundant_pairs", sql.REDUNDANT_PAIRS)(lambda s, d: codes.redundant_pairs(codes.cooccurrence(_codes(s, d))))
query("label_codes", sql.LABEL_CODES)(lambda s, d: codes.label_codes(lens(s, d, "diagnoses_icd")))

# --- mentions -----------------------------------------------------------------------------------------------------


def _corpus_notes(s, d):
    ids = _corpus(s, d).select(F.col("note_id").alias("cn"))
    notes = lens(s, d, "discharge")
    return notes.join(ids, F.col("note_id") == F.col("cn"), "left_semi").select("note_id", "subject_id", "hadm_id", "text")


def _agreement(s, d):
    return mentions.mention_agreement(mentions.mention_flags(_corpus_notes(s, d)), _codes(s, d))


query("mention_flags", sql.mention_flags())(lambda s, d: mentions.mention_flags(_corpus_notes(s, d)))
query("mention_agreement", sql.mention_agreement())(_agreement)
query("symptom_mentions", sql.symptom_mentions())(lambda s, d: mentions.symptom_mentions(_corpus_notes(s, d)))
query("rubric", sql.rubric())(lambda s, d: mentions.rubric(_agreement(s, d)))
query("select_five", sql.select_five())(lambda s, d: mentions.select_five(mentions.rubric(_agreement(s, d))))
query("synthetic_parameters", sql.synthetic_parameters())(lambda s, d: mentions.synthetic_parameters(_agreement(s, d), codes.cooccurrence(_codes(s, d))))

# --- sections -----------------------------------------------------------------------------------------------------


def _sectioned(s, d):
    return lens(s, d, "sectioned").drop("doc_id")


def _headers(s, d):
    return sections.note_headers(_sectioned(s, d))


def _spans(s, d):
    return sections.section_spans(_sectioned(s, d))


def _skeleton(s, d):
    return sections.section_skeleton(_sectioned(s, d), _spans(s, d))


query("note_headers", sql.NOTE_HEADERS)(_headers)
query("header_ranking", sql.HEADER_RANKING)(lambda s, d: sections.header_ranking(_sectioned(s, d), _headers(s, d)))
query("header_candidates", sql.HEADER_CANDIDATES)(lambda s, d: sections.header_candidates(sections.header_ranking(_sectioned(s, d), _headers(s, d))))
query("header_totals", sql.HEADER_TOTALS)(lambda s, d: sections.header_totals(_sectioned(s, d), _headers(s, d)))
query("lexicon_coverage", sql.coverage_by("section"))(lambda s, d: sections.lexicon_coverage(_headers(s, d)))
query("synonym_coverage", sql.coverage_by("synonym"))(lambda s, d: sections.lexicon_coverage(_headers(s, d), "synonym"))
query("section_spans", sql.SPANS)(_spans)
query("section_skeleton", sql.SKELETON)(_skeleton)
query("order_consistency", sql.ORDER_CONSISTENCY)(lambda s, d: sections.order_consistency(_spans(s, d), _skeleton(s, d)))
query("section_precedence", sql.PRECEDENCE)(lambda s, d: sections.section_precedence(_spans(s, d), _skeleton(s, d)))
query("sections_per_note", sql.SECTIONS_PER_NOTE)(lambda s, d: sections.sections_per_note(_sectioned(s, d), _spans(s, d)))
query("section_count_percentiles", sql.SECTION_COUNTS)(lambda s, d: sections.section_count_percentiles(_sectioned(s, d), _spans(s, d)))
query("body_lengths", sql.BODY_LENGTHS)(lambda s, d: sections.body_lengths(_spans(s, d)))
query("strip_share", sql.STRIP_SHARE)(lambda s, d: sections.strip_share(_spans(s, d)))
query("strip_residue", sql.STRIP_RESIDUE)(lambda s, d: sections.strip_residue(_sectioned(s, d), _spans(s, d)))
query("headerless_notes", sql.HEADERLESS)(lambda s, d: sections.headerless_notes(_spans(s, d)))
query("headerless_histogram", sql.HEADERLESS_HISTOGRAM)(lambda s, d: sections.headerless_histogram(_spans(s, d)))
query("literal_sections", sql.LITERAL)(lambda s, d: sections.literal_sections(_sectioned(s, d), sql.LITERAL_HEADERS).withColumn("body", F.sha2("body", 256)))
query("strip_diagnostic_sections", sql.STRIPPED)(lambda s, d: sections.strip_diagnostic_sections(_sectioned(s, d)))

# --- agreement with a reference extract ---------------------------------------------------------------------------


def _pairs(s, d):
    return agreement.paired(_sectioned(s, d), _spans(s, d), lens(s, d, "extract"))


query("check_extract", sql.CHECK_EXTRACT)(lambda s, d: agreement.check_extract(lens(s, d, "extract")))
query("bhc_pairs", sql.PAIRS)(_pairs)
query("bhc_agreement", sql.AGREEMENT)(lambda s, d: agreement.bhc_agreement(_pairs(s, d)))
query("bhc_unpaired", sql.UNPAIRED)(lambda s, d: agreement.unpaired(_sectioned(s, d), lens(s, d, "extract")))
query("bhc_cut_sections", sql.CUT_SECTIONS)(lambda s, d: agreement.bhc_cut_sections(_pairs(s, d)))
query("bhc_cut_causes", sql.CUT_CAUSES)(lambda s, d: agreement.bhc_cut_causes(_pairs(s, d)))

# --- vocabularies, n-grams, spelling ------------------------------------------------------------------------------


def _acronym_notes(s, d):
    """Notes with acronyms, variants, marks and numbers."""
    tables(s, d)
    return s.sql(sql.ACRONYM_NOTES)


def _vocabulary(s, d):
    return preprocessing.note_preprocessing(_acronym_notes(s, d))


query("normalized_text", sql.NORMALIZED)(lambda s, d: preprocessing.normalized(_acronym_notes(s, d)))
query("classifier_text", sql.CLASSIFIER_TEXT)(lambda s, d: _acronym_notes(s, d).select("note_id", notetext.classifier_text(F.col("text")).alias("text")))
query("note_preprocessing", sql.NOTE_PREPROCESSING)(lambda s, d: _vocabulary(s, d).select("note_id", "tokens_raw",
    F.size("vocabulary_raw").cast("long").alias("vocabulary"), F.sha2(F.array_join("vocabulary_raw", " "), 256).alias("digest")))
query("preprocessing_summary", sql.PREPROCESSING_SUMMARY)(lambda s, d: preprocessing.preprocessing_summary(_vocabulary(s, d)))
query("acronym_occurrences", sql.acronym_occurrences())(lambda s, d: preprocessing.occurrences(_acronym_notes(s, d)))
query("variant_occurrences", sql.variant_occurrences())(lambda s, d: preprocessing.occurrences(_acronym_notes(s, d), "variant"))
query("term_cells", sql.term_cells())(lambda s, d: preprocessing.term_cells(preprocessing.occurrences(_acronym_notes(s, d)), _codes(s, d)))
query("acronym_summary", sql.term_summary())(lambda s, d: preprocessing.term_summary(preprocessing.term_cells(preprocessing.occurrences(_acronym_notes(s, d)),
    _codes(s, d))))
query("variant_cells", sql.variant_cells())(lambda s, d: preprocessing.term_cells(preprocessing.occurrences(_acronym_notes(s, d), "variant"), _codes(s, d)))
query("variant_summary", sql.variant_summary())(lambda s, d: preprocessing.term_summary(preprocessing.term_cells(preprocessing.occurrences(_acronym_notes(s, d),
    "variant"), _codes(s, d))))
query("ngram_counts", sql.ngrams(False))(lambda s, d: preprocessing.ngram_counts(_sectioned(s, d)))
query("ngram_counts_by_section", sql.ngrams(True))(lambda s, d: preprocessing.ngram_counts(_sectioned(s, d), by_section=True))
query("ngram_ranking", sql.ngram_ranking())(lambda s, d: preprocessing.ngram_ranking(preprocessing.ngram_counts(_sectioned(s, d))))
query("token_frequency", sql.TOKEN_FREQUENCY)(lambda s, d: preprocessing.token_frequency(_vocabulary(s, d)))

KEYWORDS = {"a": ("theand other", "outhe"), "b": ("therethe", "other thanthe"), "c": ("withthe",)}


def _frequency(s, d):
    rows = lens(s, d, "discharge").select("note_id", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{2,}"), F.lit(0))).alias("vocabulary_raw"))
    return preprocessing.token_frequency(rows)


query("spelling_targets", sql.spelling_targets(KEYWORDS))(lambda s, d: preprocessing.spelling_targets(s, KEYWORDS))
query("near_miss_forms", sql.NEAR_MISS)(lambda s, d: preprocessing.near_miss_forms(_frequency(s, d), _targets(s, d), floor=2))
query("typo_estimate", sql.TYPO)(lambda s, d: preprocessing.typo_estimate(_frequency(s, d)))


def _targets(s, d):
    """The most frequent long words stand in for keywords: a list of fixed length."""
    top = _frequency(s, d).where("length(token) >= 6").orderBy(F.desc("df"), "token").limit(20)
    return top.select(F.col("token").alias("target"), F.lit("x").alias("diagnosis"))


# --- cohort and split ---------------------------------------------------------------------------------------------

LABELS = [c.key for c in POOL]


def _cohort(s, d):
    return cohort.cohort(lens(s, d, "discharge"), _corpus(s, d), lens(s, d, "diagnoses_icd"))


def _strata(s, d):
    return cohort.strata(_cohort(s, d), LABELS)


def _split(s, d):
    return cohort.partition(_strata(s, d))


query("cohort", sql.cohort())(lambda s, d: _cohort(s, d).withColumn("text", F.sha2("text", 256)))
query("positives", sql.positives())(lambda s, d: cohort.positives(_cohort(s, d)))
query("note_identity", sql.NOTE_IDENTITY)(lambda s, d: cohort.note_identity(lens(s, d, "discharge")))
query("strata", sql.strata())(_strata)
query("partition", sql.partition())(_split)
query("holdouts", sql.holdouts())(lambda s, d: cohort.holdouts(_split(s, d)))
query("split_fingerprint", sql.split_fingerprint())(lambda s, d: cohort.split_fingerprint(_split(s, d)))
query("fold_coverage", sql.fold_coverage())(lambda s, d: cohort.fold_coverage(_cohort(s, d), _split(s, d), LABELS))

# --- evaluation ---------------------------------------------------------------------------------------------------


def _predictions(s, d):
    return lens(s, d, "predictions")


query("binary_metrics", sql.METRICS)(lambda s, d: evaluation.binary_metrics(_predictions(s, d)))
query("roc_auc", sql.AUC)(lambda s, d: evaluation.roc_auc(_predictions(s, d)))
query("average_precision", sql.AP)(lambda s, d: evaluation.average_precision(_predictions(s, d)))
query("max_f1", sql.MAX_F1)(lambda s, d: evaluation.max_f1(_predictions(s, d)))
query("macro_max_f1", sql.MACRO_MAX_F1)(lambda s, d: evaluation.macro_max_f1(_predictions(s, d)))
query("model_evaluation", sql.MODEL_EVALUATION)(lambda s, d: evaluation.model_evaluation(_predictions(s, d)))
query("evaluation_faults", sql.FAULTS)(lambda s, d: evaluation.evaluation_faults(_predictions(s, d), lens(s, d,
    "discharge").select((F.col("hadm_id").cast("long") - 1).alias("note_id"))))
query("fold_gaps", sql.FOLD_GAPS)(lambda s, d: evaluation.fold_gaps(_predictions(s, d)))
query("publishable_metrics", sql.PUBLISHABLE)(lambda s, d: evaluation.publishable_metrics(evaluation.binary_metrics(_predictions(s, d), ("row_id", "diagnosis")), 90))
query("latency_percentiles", sql.LATENCY)(lambda s, d: (tables(s, d), evaluation.latency_summary(s.table("events").select("value"), "value"))[1])
query("same_predictions", sql.SAME)(lambda s, d: evaluation.same_predictions(_predictions(s, d).where("row_id = 'r1'"), _predictions(s, d).where("row_id = 'r2'")))
query("pair_phi", sql.PHI)(lambda s, d: evaluation.pair_phi(_predictions(s, d), "r1", "r2"))
query("error_correlation", sql.ERROR_CORRELATION)(lambda s, d: evaluation.error_correlation(evaluation.pair_phi(_predictions(s, d), "r1", "r2")))
query("cluster_bootstrap")(lambda s, d: evaluation.cluster_bootstrap(_predictions(s, d), "r1", "r2"))


def _screening(s, d):
    """Results of a grid of cells, made from orders."""
    tables(s, d)
    return s.sql(sql.SCREENING)


query("screening_summary", sql.SCREENING_SUMMARY)(lambda s, d: evaluation.screening_summary(_screening(s, d)))
query("screening_grid_faults", sql.GRID_FAULTS)(lambda s, d: evaluation.screening_grid_faults(_screening(s, d),
    {"fold": [0, 1, 2, 3, 4, 5], "family": ["F", "O", "P", "X"], "vectorizer": ["1", "2", "3", "4", "5"]}))
query("best_trial", sql.BEST_TRIAL)(lambda s, d: evaluation.best_trial(_screening(s, d).select(F.col("family").alias("diagnosis"), F.col("fold").alias("trial"),
    F.round("f1", 2).alias("value")).groupBy("diagnosis", "trial").agg(F.max("value").alias("value"))))

# --- features and classifiers -------------------------------------------------------------------------------------


def _grams(s, d):
    tables(s, d)
    return s.sql(sql.LABELLED).select("id", "fold", "label", F.filter(notetext.tokens(F.col("text")), lambda w: w.rlike(r"\A[a-z]+\z")).alias("grams"))


query("tfidf_weights", sql.TFIDF)(lambda s, d: features.tfidf(_grams(s, d)).groupBy("id").agg(F.count(F.lit(1)).alias("grams"),
    F.round(F.sum("weight"), 6).alias("total"), F.round(F.max("weight"), 6).alias("most")))
query("nb_log_ratio", sql.NB_RATIO)(lambda s, d: features.nb_log_ratio(_grams(s, d)).select("gram", F.round("r", 6).alias("r")))
query("complement_nb", sql.COMPLEMENT_NB)(lambda s, d: features.linear_scores(_grams(s, d), features.complement_nb(_grams(s, d)), "log_odds").select("id",
    F.round("score", 4).alias("score")))
query("char_wb", sql.CHAR_WB)(lambda s, d: (tables(s, d), s.sql(sql.LABELLED).select("id", features.char_wb(F.col("text"), 3, 4).alias("g")).select("id",
    F.size("g").cast("long").alias("grams"), F.size(F.array_distinct("g")).cast("long").alias("distinct_grams")))[1])
query("standard_scaler", sql.SCALER)(lambda s, d: (tables(s, d), features.standard_scale(s.table("embeddings").select(F.col("vec_id").alias("id"),
    F.transform("embedding", lambda x: x.cast("double")).alias("x")), "x").select("id", "position", F.round("value", 5).alias("value")))[1])
query("mean_pool", sql.MEAN_POOL)(lambda s, d: (tables(s, d), features.mean_pool(s.table("embeddings").select("label",
    F.transform("embedding", lambda x: x.cast("double")).alias("x")), "x", "label").select("label", "position", F.round("mean", 6).alias("mean")))[1])


#: Outer folds of the classifiers, and what their grid is made of.
FOLDS = list(range(5))
VECTORIZERS = {"word-1-2": lambda t: features.word_grams(t, 1, 2), "char_wb-3-5": lambda t: features.char_wb(t, 3, 5)}
SCREENED = ["logistic", "svm", "nb_svm", "complement_nb"]


def _folded(s, d):
    return _grams(s, d).withColumn("fold", F.pmod("id", F.lit(len(FOLDS))).cast("int"))


def _classifier(name: str):
    return lambda s, d: features.cross_validated(_folded(s, d), name, FOLDS)


def _screening_results(s, d):
    tables(s, d)
    rows = s.sql(sql.LABELLED_BOTH).withColumn("fold", F.pmod("id", F.lit(len(FOLDS))).cast("int"))
    return features.screening(rows, VECTORIZERS, SCREENED, ["quality", "toxic"], FOLDS)


query("logistic_regression")(_classifier("logistic"))
query("linear_svm")(_classifier("svm"))
query("nb_svm")(_classifier("nb_svm"))
query("naive_bayes")(_classifier("complement_nb"))
query("boosted_trees_on_components")(_classifier("gbt"))
query("tuned_threshold")(lambda s, d: features.tuned_threshold(_folded(s, d), "logistic", FOLDS))
query("screening_results")(_screening_results)

# --- audits and synthetic corpora ---------------------------------------------------------------------------------


def _audit_sides(s, d):
    tables(s, d)
    return s.table("documents").select(F.col("doc_id").alias("note_id"), "text"), s.table("benchmark").select(F.col("item_id").alias("ref_id"), "text")


def _ascii(df, column="text"):
    return df.withColumn(column, F.regexp_replace(column, r"[^\x00-\x7F]", " "))


query("overlap_audit", sql.OVERLAP)(lambda s, d: audit.overlap_audit(*[_ascii(x) for x in _audit_sides(s, d)]))
query("overlap_audit_nfkc")(lambda s, d: audit.overlap_audit(*[audit.nfkc(x) for x in _audit_sides(s, d)]))
query("audit_gate", sql.GATE)(lambda s, d: audit.audit_gate(audit.overlap_audit(*[_ascii(x) for x in _audit_sides(s, d)]),
    audit.subject_collisions(lens(s, d, "discharge"), lens(s, d, "radiology"))))
query("subject_collisions", sql.COLLISIONS)(lambda s, d: audit.subject_collisions(lens(s, d, "discharge"), lens(s, d, "radiology")))
query("reference_difference", sql.REFERENCE_DIFFERENCE)(lambda s, d: (tables(s, d), audit.reference_difference(s.table("documents").select("lang", "source"),
    s.table("documents").where("doc_id % 3 <> 0").select("lang", "source")))[1])
query("corpus_statistics", sql.STATISTICS)(lambda s, d: audit.corpus_statistics(_marked_notes(s, d)))
query("statistics_violations", sql.STATISTICS_VIOLATIONS)(lambda s, d: audit.statistics_violations(audit.corpus_statistics(_marked_notes(s, d)),
    {"median_words": 180.0, "log_deviation": 1.0, "marks_per_thousand": 1000.0}))


def _translations(s, d):
    tables(s, d)
    return s.sql(sql.TRANSLATION_SOURCE), s.sql(sql.TRANSLATION_TARGET)


query("translation_checks", sql.TRANSLATION_CHECKS)(lambda s, d: audit.translation_checks(*_translations(s, d)))
query("binding_violations", sql.BINDING)(lambda s, d: (tables(s, d), audit.binding(s.sql(sql.BINDING_PARTS), s.sql(sql.BINDING_WHOLE)))[1])
query("masked_markers", sql.MASKED)(lambda s, d: _marked_notes(s, d).select("note_id", audit.mask_markers(F.coalesce("text",
    F.lit(""))).alias("masked")).select("note_id", F.sha2("masked", 256).alias("masked"), F.sha2(audit.restore_markers(F.col("masked")), 256).alias("restored")))
query("placeholder_problems", sql.PLACEHOLDERS)(lambda s, d: (tables(s, d), s.sql(sql.PLACEHOLDER_ROWS).select("pair_id",
    F.array_join(audit.placeholder_problems(F.col("a"), F.col("b")), ", ").alias("problems")))[1])
query("collect_requests", sql.REQUESTS)(lambda s, d: (tables(s, d), audit.collect_requests(s.sql("SELECT doc_id AS key FROM documents"), s.sql(sql.ANSWERS)))[1])
query("demo_examples", sql.DEMO)(lambda s, d: audit.demo_examples(_predictions(s, d)))
query("label_shares", sql.label_shares())(lambda s, d: synthetic.label_shares(_cohort(s, d), LABELS))
query("prevalence_outliers", sql.prevalence_outliers())(lambda s, d: synthetic.prevalence_outliers(synthetic.label_shares(_cohort(s, d), LABELS),
    {x: 0.2 for x in LABELS}))
query("allocation", sql.ALLOCATION)(lambda s, d: (tables(s, d), synthetic.allocate_rows(s.sql(sql.ALLOCATION_ROWS)))[1])


def _sampled(s, d):
    return synthetic.sample_patients(s, 300, synthetic.max_entropy_joint([0.3, 0.2, 0.25, 0.1, 0.2], {(0, 2): 0.12}))


query("sampled_patients")(_sampled)
query("synthetic_tables")(lambda s, d: synthetic.corpus_tables(_sampled(s, d))["diagnoses_icd"])
query("synthetic_funnel")(lambda s, d: corpus.corpus_funnel(corpus.input_corpus_selection(synthetic.corpus_tables(_sampled(s, d))["discharge"],
    synthetic.corpus_tables(_sampled(s, d))["diagnoses_icd"])))
query("sentinel_tables", sql.SENTINEL)(lambda s, d: (tables(s, d), synthetic.sentinel_tables(s.table("nation").select("n_nationkey", "n_name"), "nation",
    ["n_nationkey"]))[1])
query("note_violations", sql.NOTE_VIOLATIONS)(lambda s, d: synthetic.note_violations(lens(s, d, "sectioned").select("note_id", "text"),
    (tables(s, d), s.sql(sql.PLANS))[1]))

# --- tables that grow ---------------------------------------------------------------------------------------------

query("windowed_counts", sql.WINDOWED)(lambda s, d: (tables(s, d), incremental.windowed_counts(s.table("events")))[1])
query("session_counts", sql.SESSIONS)(lambda s, d: (tables(s, d), incremental.session_counts(s.table("events")))[1])

