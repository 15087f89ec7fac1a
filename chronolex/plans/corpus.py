"""The whole pipeline as frames: documents in, fingerprints, comparisons and phrases out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolex.functions.ontology import DEFAULT, Ontology
from chronolex.functions.text import sentences
from chronolex.operators.artifacts import latest_documents
from chronolex.operators.compare import comparison_results, theme_changes
from chronolex.operators.fingerprint import theme_assessments, tone
from chronolex.operators.phrases import phrase_signals
from chronolex.plans.materialize import materialize


@dataclass
class Corpus:
    """Frames of one corpus; nothing runs before an action."""

    docs: DataFrame
    themes: DataFrame
    documents: DataFrame
    ontology: Ontology = DEFAULT

    @staticmethod
    def of(documents: DataFrame, ontology: Ontology = DEFAULT, keep_themes: bool = False) -> Corpus:
        """From ``doc_id, document_key, speaker_name, title, speech_date, document_type, created_at, normalized_text``.

        ``keep_themes`` writes the theme rows once, for queries that read them several times.
        """
        themes = theme_assessments(documents, ontology=ontology)
        if keep_themes:
            themes = materialize(themes, "themes")
        columns = ["doc_id", "document_key", "speaker_name", "title", "speech_date", "document_type", "created_at"]
        said = tone(sentences(F.coalesce("normalized_text", F.lit(""))), ontology)
        docs = documents.select(*columns, said.alias("overall_tone"))
        return Corpus(docs, themes, documents, ontology)

    @staticmethod
    def latest(documents: DataFrame, limit: int, ontology: Ontology = DEFAULT, keep_themes: bool = False) -> Corpus:
        """Of each speaker's latest ``limit`` documents only, chosen by narrow columns before any text is read.

        Queries with this limit or a lower one give what they give on the whole corpus.
        """
        chosen = latest_documents(documents.select("doc_id", "document_key", "speaker_name", "speech_date"), limit).select("doc_id").distinct()
        return Corpus.of(documents.filter("speaker_name is not null").join(chosen, "doc_id", "left_semi"), ontology, keep_themes)

    def comparisons(self, phrases: DataFrame | None = None) -> DataFrame:
        """All comparisons, each with its document's rarest phrases (``phrases``: their signals, else computed)."""
        about = self.docs.select("doc_id", "speaker_name", "created_at")
        if phrases is None:  # documents without a speaker are neither compared nor anyone's history
            phrases = phrase_signals(self.documents.filter("speaker_name is not null"), ontology=self.ontology)
        return comparison_results(self.docs, self.themes, phrases).join(about, "doc_id")


def phrases_of(documents: DataFrame, ontology: Ontology = DEFAULT) -> DataFrame:
    signals = phrase_signals(documents, ontology=ontology)
    return signals.join(documents.select("doc_id", F.col("speaker_name")), "doc_id")


def compare_adhoc(target: DataFrame, base: DataFrame, history: DataFrame | None = None, ontology: Ontology = DEFAULT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Compare two documents outside any store: ``(changes, new themes, orphaned themes)``.

    ``target`` and ``base`` hold one document each (``doc_id, normalized_text``); ``history`` any number.
    """
    now = theme_assessments(target, ontology=ontology)
    before = theme_assessments(base, ontology=ontology)
    fields = ["stance", "trajectory", "emphasis_score", "hedging_level", "uncertainty"]
    pairs = now.select("theme", F.struct(*fields).alias("after"), F.slice("evidence", 1, 2).alias("evidence_after")).join(
        before.select("theme", F.struct(*fields).alias("before"), F.slice("evidence", 1, 2).alias("evidence_before")), "theme"
    )
    past = theme_assessments(history if history is not None else base, ontology=ontology).filter("emphasis_score >= 3").select("theme").distinct()
    names = now.select("theme")
    return theme_changes(pairs), names.join(before.select("theme"), "theme", "left_anti"), past.join(names, "theme", "left_anti")
