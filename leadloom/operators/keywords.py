"""Keyword rule sets over a text column: those in code inside the row (no join, no shuffle), those kept as tables by join."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions.text import let, sql_string
from leadloom.operators.rows import unnest
from leadloom.session import cut_lineage

@dataclass(frozen=True)
class KeywordRule:
    label: str
    keywords: tuple[str, ...]
    weight: int = 1


def rules_of(table: Mapping[str, Sequence[str]]) -> tuple[KeywordRule, ...]:
    return tuple(KeywordRule(label, tuple(words)) for label, words in table.items())


def rule_table(rules: Sequence[KeywordRule]) -> Column:
    """The rule set as one constant array of structs."""
    rows = []
    for rank, rule in enumerate(rules):
        keywords = ", ".join(sql_string(k) for k in rule.keywords)
        rows.append(
            f"named_struct('label', {sql_string(rule.label)}, 'weight', {rule.weight}, 'rank', {rank}, 'words', array({keywords}))"
        )
    return F.expr("array(" + ", ".join(rows) + ")")


def rule_hits(corpus: Column, rules: Sequence[KeywordRule]) -> Column:
    """Per rule a struct(score, order, label, hits), in rule order. The text is read once per keyword."""

    def score(text: Column) -> Column:
        def row(rule: Column) -> Column:
            hits = F.filter(rule["words"], lambda w: F.contains(text, w))
            return let(
                hits,
                lambda h: F.struct(
                    (F.size(h) * rule["weight"]).alias("score"),
                    (-rule["rank"]).alias("order"),
                    rule["label"].alias("label"),
                    h.alias("hits"),
                ),
            )

        return F.transform(rule_table(rules), row)

    return let(corpus, score)


def best_label(corpus: Column, rules: Sequence[KeywordRule]) -> Column:
    """Rule with the highest score; equal scores keep rule order. Null when nothing hits."""
    return let(F.array_max(rule_hits(corpus, rules)), lambda b: F.when(b["score"] > 0, b))


def label_evidence(best: Column, prefix: str = "") -> Column:
    """``label:keyword`` strings of the winning rule."""
    return F.coalesce(
        F.transform(best["hits"], lambda h: F.concat(F.lit(prefix), best["label"], F.lit(":"), h)),
        F.array().cast("array<string>"),
    )


def classify(df: DataFrame, corpus: str, rule_sets: Mapping[str, Sequence[KeywordRule]]) -> DataFrame:
    """One struct column per rule set."""
    return df.withColumns({name: best_label(F.col(corpus), rules) for name, rules in rule_sets.items()})


GRAM = 3


def grams_of(text: Column, lengths: Sequence[int] = tuple(range(1, GRAM + 1))) -> Column:
    """Distinct pieces of a text with the given numbers of characters, one compiled pass for each."""
    pieces = [F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in lengths]
    return F.array_distinct(F.concat(*pieces))


def anchored_rules(rules: DataFrame) -> DataFrame:
    """Rules (rule_rank, label, keyword_rank, keyword, weight) with the piece of their keyword that the fewest keywords hold."""
    kept = rules.filter(F.col("keyword") != "").select("rule_rank", "label", "keyword_rank", "keyword", "weight")
    size = F.least(F.lit(GRAM), F.length("keyword"))
    pieces = kept.select("keyword").distinct().select("keyword", F.explode(F.filter(grams_of(F.col("keyword")), lambda g: F.length(g) == size)).alias("anchor"))
    common = pieces.groupBy("anchor").agg(F.count("*").alias("_n"))
    rarest = pieces.join(common, "anchor").groupBy("keyword").agg(F.min(F.struct("_n", "anchor")).alias("_a"))
    return kept.join(rarest.select("keyword", F.col("_a.anchor").alias("anchor")), "keyword")


def classify_by_table(docs: DataFrame, text: str, rules: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, label, score, hits: the best rule of each text, as ``best_label`` chooses it, for a rule table of any size.

    An inverted join: every keyword is looked up by one short piece of it among the distinct pieces of each text, and
    only then tested in the text itself. Rules never reach the driver or the plan; a text meets the keywords whose piece
    it holds. ``id_col`` has to be unique. Null texts and texts without a hit have null label, score and hits. Of rules
    with one label the weights add up; equal scores keep the order of rule_rank.
    """
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"))
    # written, so that Spark knows the rules' size: while they are small, pieces are not shuffled to meet them
    anchored = cut_lineage(anchored_rules(rules))
    lengths = sorted(r["n"] for r in anchored.select(F.length("anchor").alias("n")).distinct().collect())  # at most GRAM
    pieces = unnest(texts, grams_of(F.col("_text"), lengths or [1]), "anchor", ["_id"])
    rule = F.struct("rule_rank", "label", "keyword_rank", "keyword", "weight")
    met = pieces.join(anchored, "anchor").groupBy("_id").agg(F.collect_list(rule).alias("_rules"))
    tested = texts.join(met, "_id").select("_id", F.filter("_rules", lambda r: F.contains(F.col("_text"), r["keyword"])).alias("_hits"))
    hits = tested.select("_id", F.explode("_hits").alias("r")).select("_id", "r.*")
    scored = hits.groupBy("_id", "label").agg(
        F.sum("weight").alias("score"), F.min("rule_rank").alias("rule_rank"), F.array_sort(F.collect_list(F.struct("keyword_rank", "keyword"))).alias("_words")
    )
    best = scored.groupBy("_id").agg(F.max_by(F.struct("label", "score", "_words"), F.struct("score", -F.col("rule_rank"))).alias("b"))
    words = F.transform("b._words", lambda w: w["keyword"])
    return docs.join(best.withColumnRenamed("_id", id_col), id_col, "left").select(id_col, "b.label", "b.score", words.alias("hits"))


def tag_patterns(corpus: Column, patterns: Sequence[tuple[str, str]]) -> Column:
    """Labels of the regular expressions found in the text, distinct, in table order."""
    return F.array_distinct(
        F.array_compact(F.array(*[F.when(corpus.rlike(pattern), F.lit(label)) for pattern, label in patterns]))
    )
