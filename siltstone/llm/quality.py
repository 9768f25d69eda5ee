"""Per-document text quality statistics and a learned split of prose from the rest."""

from __future__ import annotations

import json
import os

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rules as R

#: Common words of English, German, Spanish and French.
COMMON = {
    "en": "the a an of to in on for and or but is are was were be been it its this that these those with by from as at not no so if when then than we you they our your their has have had do does did will would can could may must there here what which who how why where because after before until into about over under only very more most just also",
    "de": "der die das den dem des ein eine einen einem einer und oder aber ist sind war wird werden wurde nicht kein keine mit von zu im am auf aus bei nach für durch über unter wenn dann als auch nur noch schon sich es er sie wir ihr man wie dass weil ob hat haben jetzt",
    "es": "el la los las un una unos unas y o pero es son fue ser no se que de del en con por para como más menos muy ya su sus lo al si cuando antes después sin también este esta esto hay hemos",
    "fr": "le les une du et ou mais est sont était être ne pas qui dans avec pour par sur sous plus moins très déjà son sa ses leur ce cette ces il elle nous vous si quand avant après sans aussi aux",
}
_COMMON = sorted({w for words in COMMON.values() for w in words.split()})

#: Features of a block, in terms of its counts.
FEATURES = {
    "common": "n_common / greatest(1, n_words)",
    "letters": "n_letters / greatest(1, n_chars)",
    "symbols": "(n_chars - n_letters - n_digits - n_punct) / greatest(1, n_chars)",
    "digits": "n_digits / greatest(1, n_chars)",
    "words": "CAST(n_words AS DOUBLE)",
    "word_length": "n_letters / greatest(1, n_words)",
    "distinct": "n_distinct / greatest(1, n_words)",
    "line_words": "n_words / greatest(1, n_lines)",
    "stops": "n_stops / greatest(1, n_lines)",
    "code_lines": "n_code / greatest(1, n_lines)",
    "indented": "n_indented / greatest(1, n_lines)",
}
#: Lines that end a sentence, lines of code, indented lines; each at most once a line.
_STOP = "(?m)[.!?…][\"'»”)*`]*[ \\t]*$"
_CODE = (r"(?m)^(?:[ \t]*(?:[}\])|+#@]|(?:def|class|func|fn|pub|import|from|return|let|var|const)\b|//|/\*|\*/|:param|\"\"\").*"
         r"|.*[;{}=(\[|\\+][ \t]*)$")
_INDENTED = r"(?m)^(?:\t|  )"


def _words(text):
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")


def counts(text, words) -> dict:
    """Columns of a text's counts: characters, letters, digits, punctuation, words, lines and such.

    ``words`` is a column of a projection below, so that it is made once.
    """
    body = F.btrim(text, F.lit("\n\r\t "))
    solid = text
    for blank in " \n\t\r\u00a0\u3000":
        solid = F.replace(solid, F.lit(blank), F.lit(""))
    return {
        "n_chars": F.length(solid),
        "n_letters": F.length(F.array_join(words, "")),
        "n_digits": F.length(text) - F.length(F.translate(text, "0123456789", "")),
        "n_punct": F.length(text) - F.length(F.translate(text, ".,;:!?'\"()-", "")),
        "n_words": F.size(words),
        "n_common": F.size(F.filter(words, lambda w: w.isin(_COMMON))),
        "n_distinct": F.size(F.array_distinct(words)),
        "n_lines": F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit(""))) + 1,
        "n_stops": F.regexp_count(body, F.lit(_STOP)),
        "n_code": F.regexp_count(body, F.lit(_CODE)),
        "n_indented": F.regexp_count(F.btrim(text, F.lit("\n\r")), F.lit(_INDENTED)),
    }


def statistics(documents: DataFrame) -> DataFrame:
    """Statistics of each document's whole text, all by native expressions, without a shuffle.

    ``(doc_id, words, mean_word_length, symbol_ratio, digit_ratio, stop_line_share,
    common_word_share, distinct_word_share, lines)``; null texts are left out,
    an empty text has no words and ratios 0.
    """
    parts = documents.where("text is not null").select("doc_id", "text", _words(F.col("text")).alias("words_"))
    rows = parts.select("doc_id", *(v.alias(k) for k, v in counts(F.col("text"), F.col("words_")).items()))
    return rows.select(
        "doc_id",
        F.col("n_words").alias("words"),
        F.expr("round(n_letters / greatest(1, n_words), 6)").alias("mean_word_length"),
        F.expr(f"round({FEATURES['symbols']}, 6)").alias("symbol_ratio"),
        F.expr(f"round({FEATURES['digits']}, 6)").alias("digit_ratio"),
        F.expr(f"round({FEATURES['stops']}, 6)").alias("stop_line_share"),
        F.expr(f"round({FEATURES['common']}, 6)").alias("common_word_share"),
        F.expr(f"round({FEATURES['distinct']}, 6)").alias("distinct_word_share"),
        F.col("n_lines").alias("lines"),
    )


def blocks(documents: DataFrame) -> DataFrame:
    """``(doc_id, block)``: paragraphs between blank lines, without quote marks, emphasis, tags and invisible characters."""
    text = F.translate(F.replace(F.col("text"), F.lit("\r\n"), F.lit("\n")), "\r\u200b\u200c\u200d\u2060\ufeff\u00ad*", "\n")
    text = F.regexp_replace(text, r"(?m)^[ \t]*(?:>|#+)[ \t]?", "")
    text = F.regexp_replace(text, r"</?(?:p|br|b|i|em|strong|a|li|ul|ol|div|span|h[1-6]|blockquote)\b[^<>]*>", " ")
    rows = documents.where("text is not null").select("doc_id", F.explode(F.split(text, r"\n[ \t\u00a0]*(?:\n[ \t\u00a0]*)*\n")).alias("block"))
    return rows.where(F.col("block").rlike(r"\S"))


def features(rows: DataFrame) -> DataFrame:
    """Adds the counts and features of ``block``."""
    parts = rows.select("*", _words(F.col("block")).alias("words_"))
    counted = parts.select("*", *(v.alias(k) for k, v in counts(F.col("block"), F.col("words_")).items()))
    return counted.drop("words_").select("*", *(F.expr(f"round({e}, 6)").alias(k) for k, e in FEATURES.items()))


# -- the learned rules ---------------------------------------------------------

#: Paragraphs read and labelled by hand (running sentences or not), with the doc_id they come from.
LABELLED = os.path.join(os.path.dirname(os.path.abspath(__file__)), "labelled.jsonl")


def labelled(spark: SparkSession, path: str = LABELLED) -> DataFrame:
    """``(doc_id, block, sentences)`` of a file of labelled paragraphs, a JSON object per line."""
    with open(path, encoding="utf-8") as f:
        rows = [json.loads(line) for line in f]
    return spark.createDataFrame([(r["doc_id"], r["block"], r["sentences"]) for r in rows], "doc_id long, block string, sentences boolean")


def learn(labels: DataFrame, seeds=range(11, 20)) -> list[R.Rule]:
    """Rule list induced on labelled paragraphs ``(block, sentences)``, some hundreds of rows.

    Longer paragraphs weigh more, as they do in a document's share.  Which rows
    grow a rule and which prune it is drawn anew for each seed; the list that fits the labels best holds.
    """
    rows = features(labels.select("block", "sentences").where("block is not null and sentences is not null")).select("sentences", "n_chars", *FEATURES).toPandas()
    if not len(rows):
        return []
    table, label, weight = {k: rows[k].to_numpy(float) for k in FEATURES}, rows["sentences"].to_numpy(bool), np.log1p(rows["n_chars"].to_numpy(float))
    lists = [R.induce(table, label, weight, seed=s) for s in seeds]
    return max(lists, key=lambda x: weight[R.classify(x, table) == label].sum())


def prose_share(documents: DataFrame, rule_list: list[R.Rule] | None = None) -> DataFrame:
    """``(doc_id, chars, prose_chars, prose_share)`` over non-blank characters.

    Each paragraph is classified by the rule list as one SQL CASE expression;
    texts never leave the JVM, and per document only two sums are shuffled.
    The rules are learned from the labelled paragraphs of :data:`LABELLED` unless
    given, so the documents are read once.  Null texts are left out; a text without non-blank characters has no row.
    """
    rule_list = learn(labelled(documents.sparkSession)) if rule_list is None else rule_list
    rows = features(blocks(documents.select("doc_id", "text"))).select("doc_id", "n_chars", F.expr(R.to_case(rule_list)).alias("prose"))
    sums = rows.groupBy("doc_id").agg(F.sum("n_chars").alias("chars"), F.sum(F.expr("n_chars * prose")).alias("prose_chars"))
    return sums.where("chars > 0").withColumn("prose_share", F.round(F.col("prose_chars") / F.col("chars"), 6))


def not_prose(documents: DataFrame, rule_list: list[R.Rule] | None = None) -> DataFrame:
    """Documents of whose non-blank characters fewer than half stand in running sentences."""
    return prose_share(documents, rule_list).where("prose_chars * 2 < chars")
