"""The queries over whole tables, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T
from ..operators import entities, lines, markdown, profile, repeats, rewrite, scores, select, sequences, spelling, voice, windows
from ..operators import measure as M
from ..sources.stored import stored
from . import sql, sql_entities, sql_lines, sql_profiles, sql_repeats, sql_sequences, sql_spelling, sql_voice

Query = Callable[[SparkSession, str], DataFrame]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as profile, doc_id, text; its sources are the authors."""
    return read(spark, sf_dir, "documents").select(F.col("source").alias("profile"), "doc_id", "text")


def grouped_corpus(spark: SparkSession, sf_dir: str, size: int = 10) -> DataFrame:
    """Texts of several paragraphs: the documents of each source whose ids share all but the last digit, one below the other."""
    texts = F.array_sort(F.collect_list(F.struct("doc_id", "text")))  # `size` documents
    x = corpus(spark, sf_dir).groupBy("profile", F.floor(F.col("doc_id") / size).alias("g")).agg(F.min("doc_id").alias("doc_id"), texts.alias("t"))
    return x.select("profile", "doc_id", F.array_join(F.transform("t", lambda r: r["text"]), "\n\n").alias("text"))


def over_groups(fn: Callable[..., DataFrame], *args) -> Query:
    return lambda spark, sf_dir: fn(grouped_corpus(spark, sf_dir), *args)


def over_corpus(fn: Callable[..., DataFrame], *args) -> Query:
    return lambda spark, sf_dir: fn(corpus(spark, sf_dir), *args)


def source_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, rhythm and comma density of each source in one scan of the sentences and one of the documents."""
    docs = corpus(spark, sf_dir)
    n = F.count("*")
    shares = [M.r6(F.count_if((F.col("words") >= a) & (F.lit(True) if b is None else F.col("words") <= b)) / n).alias(f"h{i}") for i, (a, b) in enumerate(L.SENTENCE_BINS)]
    rhythm = M.sentence_rows(docs).groupBy("profile").agg(n.alias("sentences"), M.r6(F.avg("words")).alias("mean"), M.r6(F.stddev_pop("words")).alias("stdev"), *shares)
    size = docs.groupBy("profile").agg(n.alias("documents"), F.sum(T.word_count("text")).alias("words"), F.sum(T.occurrences("text", ",")).alias("commas"))
    return size.join(rhythm, "profile").select("profile", "documents", "words", "sentences", "mean", "stdev", *[f"h{i}" for i in range(5)], M.r6(F.col("commas") / F.greatest(F.lit(1), "words") * 100).alias("comma_density"))


def normalised_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("doc_id", F.md5(rewrite.straight_quotes(rewrite.plain_dashes("text"))).alias("text_md5"))


def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", T.title("html").alias("title"))


def voice_filtered_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = lines.voice_filter(read(spark, sf_dir, "pages").select("page_id", F.col("html").alias("text")), "page_id")
    return x.select("page_id", T.word_count("text").cast("long").alias("words"), F.length("text").cast("long").alias("chars"), F.md5("text").alias("text_md5"))


def markdown_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: the documents dressed as Markdown, each sentence as one of twelve kinds of lines, in turn."""

    def dressed(x: Column, i: Column) -> Column:
        kinds = [
            F.concat(F.repeat(F.lit("#"), F.lit(1) + F.floor(i / 12).cast("int") % 3), F.lit(" "), x), x, F.concat(F.lit("```\n"), x, F.lit("\n```")), F.concat(F.lit("> "), x), F.concat(F.lit("- "), x), F.concat(F.lit("- "), x),
            F.concat(F.lit("\n"), x), F.concat(F.lit("[^"), (i + 1).cast("string"), F.lit("]: "), x, F.lit("\n    "), x), F.concat(F.lit("## References\n"), x), F.concat(x, F.lit("\n\n~~~\n```\n"), x, F.lit("\n~~~")), F.concat(x, F.lit("\n---")), F.concat(F.lit("  - "), x),
        ]
        out = F.when(i % 12 == 0, kinds[0])
        for k, e in enumerate(kinds[1:], 1):
            out = out.when(i % 12 == k, e)
        return out

    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(T.sentences("text"), dressed), "\n").alias("text"))


def _digest(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("chars"))


def markdown_unfenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(markdown_corpus(spark, sf_dir).select("doc_id", lines.without_fences("text").alias("text")))


def markdown_apparatus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(lines.without_apparatus(markdown_corpus(spark, sf_dir).select("doc_id", lines.without_fences("text").alias("text"))))


def markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.blocks(markdown_corpus(spark, sf_dir)).select("doc_id", F.col("block_no").cast("int").alias("block_no"), "code", F.md5("text").alias("text_md5"))


def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.sections(markdown_corpus(spark, sf_dir)).withColumn("block_md5", F.md5("block")).drop("block")


def markdown_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.group_lists(markdown_corpus(spark, sf_dir), run=2).select("doc_id", F.md5("text").alias("text_md5"), "merged")


def prose_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences as paragraphs, some of which come again, with a word or a mark more; without those."""

    def said(s: Column) -> Column:
        def here(x: Column, i: Column) -> Column:
            n = i + 1
            return F.when(n % 3 == 0, F.array(x, F.concat(F.get(s, i - 2), F.lit(" so.")))).when(n % 5 == 0, F.array(x, F.concat(x, F.lit(" !")))).otherwise(F.array(x))

        return F.flatten(F.transform(s, here))

    # sentences have no white space but single spaces
    x = read(spark, sf_dir, "documents").select("doc_id", T.sentences("text").alias("s")).select("doc_id", F.array_join(said(F.col("s")), "\n\n").alias("text"))
    return repeats.drop_repeated_blocks(x, **sql_repeats.RULE).select("doc_id", F.md5("text").alias("text_md5"), "dropped")


def clauses(docs: DataFrame, text: str) -> DataFrame:
    """docs with `clause`: what stands between marks and ends of lines."""
    return docs.withColumn("clause", F.explode(F.split(text, r"[.,;:!?\n]+"))).withColumn("clause", F.trim("clause")).where("clause <> ''")


def unnamed_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses of each source, without those that look like names or dates or hold a clause of a page's title."""
    docs = corpus(spark, sf_dir)
    names = stored(entities.listed_names(clauses(page_titles(spark, sf_dir), "title"), "clause"))
    # most clauses hold a name of few tokens: they go before the others are counted
    phrases, rest = entities.without_held(clauses(docs, "text").select("profile", F.lower("clause").alias("phrase")), names)
    phrases = phrases.groupBy("profile", "phrase").agg(F.count("*").alias("n"))
    return entities.drop_names(phrases, M.capitalisation(docs), rest)


def named_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses of all documents that hold a clause of a page's title."""
    names = stored(entities.listed_names(clauses(page_titles(spark, sf_dir), "title"), "clause"))
    return entities.naming(clauses(corpus(spark, sf_dir), "text").select(F.lower("clause").alias("phrase")), names)


def stripped_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of the voice filter that is a chain of expressions: mathematics, tags and entities."""
    x = read(spark, sf_dir, "pages").select("page_id", T.strip_entities(T.strip_html(T.strip_latex(T.strip_inline_code("html")))).alias("text"))
    return x.select("page_id", F.length("text").cast("long").alias("chars"), F.md5("text").alias("text_md5"))


def conversation_role_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = read(spark, sf_dir, "conversations").select(F.col("role").alias("profile"), F.col("conv_id").alias("doc_id"), "text")
    return M.totals(x).join(M.comma_density(x), "profile").join(M.sentence_lengths(x).select("profile", "mean", "stdev"), "profile")


def spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, text: the turns, a phrase with pronouns after each sentence, in turn."""
    phrases = F.array(*map(F.lit, sql_voice.PHRASES))
    said = F.transform(T.sentences("text"), lambda x, i: F.concat_ws(" ", x, F.element_at(phrases, i % len(sql_voice.PHRASES) + 1)))
    return read(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("at"), F.array_join(said, " ").alias("text"))


def turn_voices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pronouns of the third person and subjects of others in each turn, with marks seen and unseen."""
    both = [voice.voice(spoken(spark, sf_dir), "third", "at", marks).withColumn("marks", F.lit(marks)) for marks in (False, True)]
    return both[0].union(both[1]).select("at.conv_id", "at.turn", "marks", "allowed", "violations", "other")


def voice_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voice.repaired(spoken(spark, sf_dir), "third", "at").select("at.conv_id", "at.turn", F.md5("text").alias("text_md5"), "repairs")


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.measurements(corpus(spark, sf_dir))


def compliance(spark: SparkSession, sf_dir: str, stop: list[str] | None = None, without: dict[str, list[str]] | None = None) -> DataFrame:
    """Each document against the profile of its source."""
    docs, each = corpus(spark, sf_dir), F.col("doc_id").cast("string")
    counted = stored(profile.counts(docs, "doc_id"))
    alone = docs.select(each.alias("profile"), "doc_id", "text")
    own = profile.measurements(alone, function_words=False, single=True, stop=stop, counted=counted.withColumn("profile", each)).withColumnRenamed("profile", "id")
    own = own.join(counted.select(each.alias("id"), "profile"), "id")
    return profile.compliance(own, profile.measurements(docs, function_words=False, counted=counted), without=without)


def compliance_rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the marks and the list of words that a text is rated by."""
    x = compliance(spark, sf_dir, L.RATED_STOP_WORDS, L.UNRATED)
    return x.select(F.col("id").cast("long").alias("doc_id"), "profile", M.r6("score").alias("score"), F.size("deltas").alias("deltas"))


def compliance_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to change about each document, the metrics that are most off first; of a histogram, its first bin."""
    first = [M.r6(F.col(c)[0]).alias(c) for c in ("actual", "target")]
    return profile.feedback(compliance(spark, sf_dir)).select(F.col("id").cast("long").alias("doc_id"), "profile", "rank", "metric", "path", M.r6("diff").alias("diff"), *first, "change", "advice")


def compliance_doc_vs_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = compliance(spark, sf_dir)
    return x.select(F.col("id").cast("long").alias("doc_id"), "profile", M.r6("score").alias("score"), F.size("deltas").alias("deltas"))


def match_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.match_probability(compliance(spark, sf_dir))


def similarity_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.similarity(profiles(spark, sf_dir)).drop("coverage")


def partial_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of sources of which some lack sections, by their numbers."""
    no, x = F.substring("profile", 4, 9).cast("int"), profiles(spark, sf_dir)
    for section, every in sql_profiles.LACKING.items():
        x = x.withColumn(section, F.when(no % every != 0, F.col(section)))
    return profile.similarity(x)


def profile_similarity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_components(spark, sf_dir).select("a", "b", "similarity", "confidence")


def worst_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.worst(similarity_components(spark, sf_dir))


def kl_function_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each source's function words from those of the whole corpus."""
    counted = profile.word_use(corpus(spark, sf_dir))
    x = with_whole(profile.use_vectors(counted), profile.use_vectors(profile.whole(counted)).select(F.col("function_words").alias("q")))
    return x.select("profile", M.r6(profile.kl_divergence(F.col("function_words"), F.col("q"))).alias("kl"))


def with_whole(own: DataFrame, whole: DataFrame) -> DataFrame:
    """Each row of `own` beside the single row of `whole`."""
    return own.withColumn("one", F.lit(1)).join(F.broadcast(whole.withColumn("one", F.lit(1))), "one")


def cosine_function_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each source's function words and those of the whole corpus; and the divergence of its sentence lengths."""
    counted = profile.word_use(corpus(spark, sf_dir), sentences=True)
    own, whole = profile.use_vectors(counted), profile.use_vectors(profile.whole(counted)).select(F.col("function_words").alias("q"), F.col("sentence").alias("s"))
    return with_whole(own, whole).select(
        "profile", M.r6(profile.cosine(F.col("function_words"), F.col("q"))).alias("cosine"), M.r6(profile.raw_js_divergence(F.col("sentence"), F.col("s"))).alias("sentence_js"),
    )


def function_word_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of its twenty most frequent function words a source shares with the whole corpus."""
    docs = corpus(spark, sf_dir)
    listed = lambda d, name: M.function_word_top(d).groupBy("profile").agg(F.collect_set("word").alias(name))
    whole = listed(docs.withColumn("profile", F.lit("all")), "b").select("b")
    return with_whole(listed(docs, "a"), whole).select("profile", M.r6(profile.jaccard(F.col("a"), F.col("b"))).alias("overlap"))


def document_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document against its first four fifths."""
    docs = corpus(spark, sf_dir)
    x = scores.changes(docs, docs.withColumn("text", F.expr("substring(text, 1, cast(floor(length(text) * 0.8) as int))")))
    return x.withColumn("warnings", F.array_join("warnings", ","))


#: Quantiles of the draw of targets: one on a knot, the others on the lines between knots and beyond the last.
DRAWN = (0.2, 0.5, 0.85, 0.95)


def baseline_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each measure of each of a source's windows a quantile drawn from all its windows, with the band around it."""
    return targets(stored(windows.metrics(windows.window_texts(corpus(spark, sf_dir)))))


def targets(rows: DataFrame) -> DataFrame:
    chunks = rows.select("profile", F.col("window_no").alias("chunk_no"))
    x = windows.overlay(windows.quantiles(rows), chunks, quantiles=DRAWN)
    return x.select("profile", "chunk_no", "metric", *[F.round(c, 9).alias(c) for c in ("q", "target", "low", "high")])


def windows_out_of_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of a source's windows that miss the drawn band; the windows are measured once."""
    rows = stored(windows.metrics(windows.window_texts(corpus(spark, sf_dir))))
    x = windows.rounded(rows).withColumnRenamed("window_no", "chunk_no")
    observed = x.unpivot(["profile", "chunk_no"], x.columns[2:], "metric", "value")
    return windows.out_of_band(observed, targets(rows).drop("q", "target"), keys=("profile", "chunk_no", "metric"))


def same_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose prose is the same but for marks and case, with the least id that has it."""
    x = corpus(spark, sf_dir).select("doc_id", F.md5(T.prose_key("text")).alias("key"))
    groups = x.groupBy("key").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n")).where("n > 1")
    return x.join(groups, "key").select("doc_id", "first_doc", "n")


def chunk_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = markdown.chunk_plan(corpus(spark, sf_dir), tokens=256, roster=3)
    return x.select("doc_id", "chunk_no", "est_tokens", "model_no", F.md5("text").alias("text_md5"))


def mask_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages masked and restored: how many masks, and whether nothing changed."""
    x = read(spark, sf_dir, "pages").select("page_id", "html", markdown.mask("html").alias("m"))
    return x.select("page_id", F.size("m.originals").alias("masks"), (markdown.restore("m.text", "m.originals") == F.col("html")).alias("same"))


def chunk_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.chunk_bounds(markdown_corpus(spark, sf_dir), tokens=64)


def english_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: documents with an English phrase after each sentence, in turn."""
    phrases = F.array(*map(F.lit, sql_spelling.PHRASES))
    said = F.transform(T.sentences("text"), lambda x, i: F.concat_ws(" ", x, F.element_at(phrases, i % len(sql_spelling.PHRASES) + 1)))
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(said, " ").alias("text"))


def local_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = spelling.localise(english_corpus(spark, sf_dir), spelling.rule_rows(spark, sql_spelling.RULES), sql_spelling.LOCALE)
    return x.select("doc_id", F.md5("text").alias("text_md5"), "replaced")


def british_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    swap = markdown.rows(lambda t: rewrite.guarded_spelling(t, "british"))
    return corpus(spark, sf_dir).select("doc_id", F.md5(swap("text")).alias("text_md5"))


PRESENT = {"articles": ["the", "a", "la", "der"], "prepositions": ["of", "in", "de", "en"]}
#: Openers that the tables' invented prose has, for the query on transitions to find some.
OPENERS = ["the", "and", "in", "to", "i", "el", "la", "de", "der", "le"]
QUERIES: dict[str, Query] = {
    "source_profile": source_profile,
    "doc_size_stats": over_corpus(M.document_sizes),
    "source_totals": over_corpus(M.totals),
    "sentence_len_stats": over_corpus(M.sentence_lengths),
    "sentence_hist": over_corpus(M.sentence_histogram),
    "paragraph_hist": over_corpus(M.paragraph_histogram),
    "one_sentence_rate": over_corpus(M.one_sentence_rate),
    "punct_rates": over_corpus(M.punctuation_rates),
    "comma_density": over_corpus(M.comma_density),
    "contraction_rate": over_corpus(M.contraction_rate),
    "oxford_signal": over_corpus(M.oxford_signal),
    "spelling_variant": over_corpus(M.spelling_variant),
    "function_word_rates": over_corpus(M.function_words),
    "function_word_top20": over_corpus(M.function_word_top),
    "stance_rates": over_corpus(M.category_rates, L.STANCE),
    "epistemic_rates": over_corpus(M.category_rates, L.EPISTEMIC),
    "avoidance_rates": over_corpus(M.category_rates, L.AVOIDANCE),
    "lexicon_rates_present": over_corpus(M.category_rates, PRESENT),
    "syntax_texture": over_corpus(M.syntax_texture),
    "rhetoric_moves": over_corpus(M.rhetoric_moves),
    "transition_openers": over_corpus(M.transition_openers),
    "discourse_positions": over_corpus(M.discourse_positions),
    "sentence_openers_top20": over_corpus(M.sentence_openers),
    "paragraph_cadence": over_corpus(M.paragraph_cadence),
    "bigrams_top30": over_corpus(M.top_ngrams, 2),
    "trigrams_top30": over_corpus(M.top_ngrams, 3),
    "repetition_rates": over_corpus(M.repetition_rates),
    "lexical_diversity": over_corpus(M.lexical_diversity),
    "burstiness": over_corpus(M.burstiness),
    "punct_entropy": over_corpus(M.punctuation_entropy),
    "function_word_entropy": over_corpus(M.function_word_entropy),
    "char_trigram_entropy": over_corpus(M.char_trigram_entropy),
    "cap_ratio": over_corpus(M.capitalisation),
    "absent_common_words": over_corpus(M.absent_common_words),
    "rare_words": over_corpus(M.rare_words),
    "fiction_flags": over_corpus(M.fiction_flags),
    "emdash_quote_normalised": normalised_marks,
    "page_titles": page_titles,
    "voice_filtered_pages": voice_filtered_pages,
    "stripped_pages": stripped_pages,
    "conversation_role_profiles": conversation_role_profiles,
    "baseline_windows": over_corpus(windows.baseline_windows),
    "baseline_quantiles": over_corpus(windows.baseline_quantiles),
    "excerpts": over_corpus(select.excerpts),
    "extractive_summary": over_corpus(select.extractive_summary),
    "sampled_sentences": over_corpus(select.sampled_sentences),
    "compliance_doc_vs_source": compliance_doc_vs_source,
    "match_probability": match_probability,
    "profile_similarity_pairs": profile_similarity_pairs,
    "similarity_components": similarity_components,
    "worst_components": worst_components,
    "kl_function_words": kl_function_words,
    "near_duplicate_docs": same_prose,
    "grouped_paragraph_hist": over_groups(M.paragraph_histogram),
    "grouped_one_sentence_rate": over_groups(M.one_sentence_rate),
    "grouped_paragraph_cadence": over_groups(M.paragraph_cadence),
    "grouped_baseline_windows": over_groups(windows.baseline_windows),
    "word_openers": over_corpus(M.transition_openers, 15, OPENERS),
    "naturalness": over_corpus(scores.naturalness),
    "cosine_function_words": cosine_function_words,
    "function_word_overlap": function_word_overlap,
    "document_changes": document_changes,
    "document_diagnostics": over_corpus(scores.diagnostics),
    "baseline_targets": baseline_targets,
    "windows_out_of_band": windows_out_of_band,
    "markdown_unfenced": markdown_unfenced,
    "markdown_apparatus": markdown_apparatus,
    "markdown_blocks": markdown_blocks,
    "markdown_sections": markdown_sections,
    "markdown_lists": markdown_lists,
    "prose_repeats": prose_repeats,
    "named_phrases": named_phrases,
    "unnamed_phrases": unnamed_phrases,
    "compliance_rated": compliance_rated,
    "compliance_feedback": compliance_feedback,
    "partial_similarity": partial_similarity,
    "turn_voices": turn_voices,
    "voice_repairs": voice_repairs,
    "bigrams_corpus": over_corpus(sequences.top_corpus_ngrams, 2),
    "trigrams_corpus": over_corpus(sequences.top_corpus_ngrams, 3),
    "repetition_corpus": over_corpus(sequences.corpus_repetition),
    "openers_corpus": over_corpus(sequences.top_openers),
    "document_batches": over_corpus(select.batches, 4096, 512),
    "chunk_bounds": chunk_bounds,
    "chunk_plan": chunk_plan,
    "mask_round_trip": mask_round_trip,
    "british_spelling": british_spelling,
    "local_spelling": local_spelling,
}
ORACLES: dict[str, str] = sql.MEASURES | sql_lines.LINES | sql_sequences.SEQUENCES | sql_repeats.REPEATS | sql_entities.ENTITIES | sql_profiles.PROFILES | sql_voice.VOICE | {"local_spelling": sql_spelling.SPELLING}
