"""Several configurations side by side: parameters as rows, mean scores, fixed-width tables and records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scoring import ACCURACIES

#: The columns of transcription_score() that a comparison shows, and all that are averaged.
COMPARED = (*ACCURACIES, "octave_errors", "key_right", "form_right", "auc")
AVERAGED = (*COMPARED, "meter_right", "tempo_error", "flag_precision", "flag_recall", "n_wrong", "n_flagged")


def with_configurations(df: DataFrame, configurations: dict[str, dict[str, float]]) -> DataFrame:
    """Every row once for each configuration, with its name as config and its parameters as columns of doubles, null where it sets none: what comes after reads parameters from columns, and one job runs them all. Columns of these names are replaced."""
    names = sorted({name for values in configurations.values() for name in values})
    number = lambda x: F.lit(None if x is None else float(x)).cast("double")
    rows = F.array(*(F.struct(F.lit(c).alias("config"), *(number(values.get(n)).alias(n) for n in names)) for c, values in configurations.items()))
    kept = [c for c in df.columns if c not in ("config", *names)]
    return df.select(*kept, F.explode(rows).alias("_c")).select(*kept, "_c.*")


def _means(scores: DataFrame) -> DataFrame:
    return scores.groupBy("config").agg(*(F.avg(F.col(c).cast("double")).alias(c) for c in AVERAGED))


def summary(scores: DataFrame) -> DataFrame:
    """scores(config, and the columns of transcription_score()) as config, metric, value: the means over recordings. What no recording has, such as the confidence of no notes, is null."""
    return _means(scores).unpivot(["config"], list(AVERAGED), "metric", "value")


def comparison(scores: DataFrame, configurations: list[str]) -> DataFrame:
    """A row for each compared metric and a column for each configuration."""
    return summary(scores).where(F.col("metric").isin(*COMPARED)).groupBy("metric").pivot("config", configurations).agg(F.first("value"))


def fixed(value: Column, digits: int, width: int) -> Column:
    """A number with so many digits, ties away from zero, set to the right; a dash for null."""
    said = value.cast("double").cast("decimal(18,9)").cast(f"decimal(18,{digits})").cast("string")
    return F.format_string(f"%{width}s", F.coalesce(said, F.lit("-")))


def comparison_table(scores: DataFrame, configurations: list[str]) -> DataFrame:
    """comparison() as lines of text: line (from 0), text. Metrics go down, configurations across, as listed; one without scores has dashes."""
    held = summary(scores).agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\t", "config", "metric"), "value"))).alias("of"))
    head = f"{'metric':<24}" + "".join(f"{c:>16}" for c in configurations)
    rows = (F.concat(F.lit(f"{m:<24}"), *(fixed(F.try_element_at("of", F.lit(f"{c}\t{m}")), 3, 16) for c in configurations)) for m in COMPARED)
    return held.select(F.posexplode(F.array(F.lit(head), F.lit("-" * len(head)), *rows)).alias("line", "text"))


def score_table(scores: DataFrame) -> DataFrame:
    """scores(config, rec, title, difficulty, and the columns of transcription_score()) as lines of text: config, part, rec, text, to be read in this order.

    Parts: 0 the head, 1 a rule, 2 a line for each recording, 3 a rule, 4 the means, 5 what confidence tells (only where
    a recording has notes to tell of), 6 octave errors. Only part 2 has a rec; it grows with the table and stays distributed. scores is read twice: give a written table where it is costly.
    """
    five = lambda: [fixed(F.col(c), 2, 7) for c in ACCURACIES]
    flag = lambda c, width: F.format_string(f"%{width}s", F.when(c, "Y").otherwise("n"))
    named = F.concat(F.format_string("%-22s", F.coalesce("title", F.lit(""))), F.format_string("%-7s", F.coalesce("difficulty", F.lit(""))))
    each = scores.select("config", F.lit(2).alias("part"), "rec", F.concat(named, *five(), flag(F.col("key_right"), 5), flag(F.col("form_right"), 6), fixed(F.col("tempo_error"), 1, 8)).alias("text"))
    head = f"{'tune':<22}{'diff':<7}{'pitch':>7}{'pclass':>7}{'onset':>7}{'dur':>7}{'seq':>7}{'key':>5}{'form':>6}{'tempo%':>8}"
    mean = F.concat(F.lit(f"{'MEAN':<29}"), *five(), fixed(F.col("key_right"), 2, 5), fixed(F.col("form_right"), 2, 6), fixed(F.col("tempo_error"), 1, 8))
    at = lambda c, digits: fixed(F.col(c), digits, 1)
    told = F.concat(F.lit("confidence: AUC "), at("auc", 3), F.lit("  flag precision "), at("flag_precision", 2), F.lit("  flag recall "), at("flag_recall", 2), F.lit("  ("), at("n_flagged", 1), F.lit(" flagged / "), at("n_wrong", 1), F.lit(" wrong per tune)"))
    octaves = F.concat(F.lit("octave-error rate: "), at("octave_errors", 3))
    rule = F.lit("-" * 89)
    parts = ((0, F.lit(head)), (1, rule), (3, rule), (4, mean), (5, F.when(F.col("auc").isNotNull(), told)), (6, octaves))
    lines = F.explode(F.array(*(F.struct(F.lit(p).alias("part"), text.alias("text")) for p, text in parts)))
    around = _means(scores).select("config", lines.alias("x")).where("x.text is not null")
    return each.unionByName(around.select("config", "x.part", F.lit(None).cast(scores.schema["rec"].dataType).alias("rec"), "x.text"))


def report_records(scores: DataFrame) -> DataFrame:
    """config, kind, json, to be written as text: a record for the means of each configuration ("aggregate") and one for each recording ("score"). Records, not one document, so that a report of any size can be written in parts."""
    each = scores.select("config", F.lit("score").alias("kind"), F.to_json(F.struct(*scores.columns)).alias("json"))
    return each.unionByName(_means(scores).select("config", F.lit("aggregate").alias("kind"), F.to_json(F.struct("config", *AVERAGED)).alias("json")))
