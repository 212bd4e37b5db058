"""Keyword classification of pages, uploads, links and catalog rows.

Rule files are small: their keywords become literal arrays and their steps column expressions, and the work stays in
one narrow stage. Tables of keywords of any size are matched by one multi-pattern pass over the texts (``keyword_matches``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorewell.functions import rulesets as R
from lorewell.functions.text import filename_stem, first_lines, nfkc_lower
from lorewell.functions.urls import host, path
from lorewell.scale import in_pieces

SHARD_KEYWORDS = 50_000


def contains_any(text: Column, words: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words], F.lit(False))


def match_signals(text: Column, words: Sequence[str]) -> Column:
    """The keywords found in the text, in rule order."""
    if not words:
        return F.array().cast("array<string>")
    return F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))


def classify_first_match(text: Column, rules: R.RuleSet) -> Column:
    """First category with any keyword in the text, else null."""
    return F.coalesce(*[F.when(contains_any(text, words), F.lit(c)) for c, words in rules],
                      F.lit(None).cast("string"))


def _verdict(category: Column | str | None, page_type: str, confidence: Column | float, signals: Column) -> Column:
    if category is None or isinstance(category, str):
        category = F.lit(category).cast("string")
    confidence = F.lit(confidence) if isinstance(confidence, float) else confidence
    return F.struct(category.alias("category"), F.lit(page_type).alias("page_type"),
                    confidence.cast("double").alias("confidence"), signals.alias("matched_signals"))


def _first_rule(text: Column, rules: R.RuleSet, page_type: str, confidence: float) -> list[Column]:
    return [F.when(contains_any(text, words), _verdict(c, page_type, confidence, match_signals(text, words)))
            for c, words in rules]


def classify_scored(text: Column, rules: R.RuleSet) -> Column:
    """Category with the largest total keyword length; the earlier one wins a tie."""
    scores = [reduce(lambda a, b: a + b,
                     [F.when(text.contains(w), F.lit(len(w))).otherwise(F.lit(0)) for w in words])
              for _, words in rules]
    ranked = [F.struct(score.alias("score"), F.lit(-i).alias("turn"), F.lit(c).alias("category"),
                       match_signals(text, words).alias("signals"))
              for i, (score, (c, words)) in enumerate(zip(scores, rules))]
    best = F.array_max(F.array(*ranked))
    return F.transform(F.array(best), lambda b: F.when(
        b["score"] > 0,
        _verdict(b["category"], "CONTENT_DOCUMENT",
                 F.least(F.lit(0.9), F.lit(0.55) + b["score"] / F.lit(100.0)), b["signals"]),
    ).otherwise(_verdict(None, "UNKNOWN", 0.55, F.array().cast("array<string>"))))[0]


def _all_words(texts: dict[str, Column], wanted: dict, rules: R.Rules, name: str | None) -> Column:
    """Every named text contains a keyword of its list."""
    return reduce(lambda a, b: a & b, [contains_any(texts[t], rules.words(w, name)) for t, w in wanted.items()], F.lit(True))


def _step(step: dict, texts: dict[str, Column], file: dict, rules: R.Rules, name: str | None, flags: dict[str, Column]) -> list[Column]:
    """Verdicts of one step of a rule file, null where it does not fit.

    ``use`` runs another list of steps, ``rules`` takes the first rule set entry found in a text, ``scored`` the one with
    most matching letters. Any other step fits if all texts of ``any`` and ``with`` have a keyword (a flag may stand
    in for ``with``) and those of ``none`` have not.
    """
    if "use" in step:
        return [v for inner in file[step["use"]] for v in _step(inner, texts, file, rules, name, flags)]
    if "rules" in step:
        return _first_rule(texts[step["in"]], rules.rules(step["rules"], name), step["page_type"], step["confidence"])
    if "scored" in step:
        return [classify_scored(texts[step["in"]], rules.rules(step["scored"], name))]
    fits = _all_words(texts, step.get("any", {}), rules, name)
    if "with" in step:
        fits = fits & (_all_words(texts, step["with"], rules, name) | flags.get(step.get("or_flag"), F.lit(False)))
    for text, words in step.get("none", {}).items():
        fits = fits & ~contains_any(texts[text], rules.words(words, name))
    signals = [match_signals(texts[t], rules.words(w, name)) for t, w in step.get("signals", {}).items()]
    if "note" in step:
        signals.append(F.array(F.lit(rules.keywords[step["note"]])))
    found = F.concat(*signals) if signals else F.array().cast("array<string>")
    return [F.when(fits, _verdict(step["category"], step["page_type"], step["confidence"], found))]


def verdict_of(steps: list[dict], texts: dict[str, Column], file: dict, rules: R.Rules, name: str | None = None,
               flags: dict[str, Column] | None = None) -> Column:
    """The verdict of the first step that fits; null when none does."""
    return F.coalesce(*[v for step in steps for v in _step(step, texts, file, rules, name, flags or {})])


def _library_flag(url: Column, library_host: str | None) -> dict[str, Column]:
    return {"library_host": host(url) == library_host} if library_host else {}


def classify_evergreen_page(title: Column, corpus: Column, url: Column, name: str | None = None,
                            library_host: str | None = None, rules: R.Rules = R.SHIPPED) -> Column:
    """Pages that do not age: a title signal together with a context signal; null when none."""
    return verdict_of(rules.page["evergreen"], {"title": title, "corpus": corpus}, rules.page, rules, name, _library_flag(url, library_host))


def classify_page(title: Column, content: Column, url: Column, name: str | None = None,
                  library_host: str | None = None, body_chars: int | None = None, rules: R.Rules = R.SHIPPED) -> Column:
    """Verdict struct of a crawled page. The whole body is read unless ``body_chars`` limits it."""
    body = content if body_chars is None else F.substring(content, 1, body_chars)
    texts = {"title": title, "body": body, "corpus": F.concat(title, F.lit("\n"), body)}
    return verdict_of(rules.page["steps"], texts, rules.page, rules, name, _library_flag(url, library_host))


def static_title_category(title: Column, name: str | None = None, rules: R.Rules = R.SHIPPED) -> Column:
    return classify_first_match(title, rules.rules("page_title_rules", name))


def trusted_evergreen(verdict: Column) -> Column:
    return ((verdict["page_type"] == "EVERGREEN_STATIC") & (verdict["confidence"] >= 0.9)
            & verdict["category"].isNotNull())


def classify_upload(df: DataFrame, filename: str, first_page: str, name: str | None = None,
                    page_chars: int | None = None, out: str = "verdict", rules: R.Rules = R.SHIPPED) -> DataFrame:
    """Add the verdict of an uploaded file from its name and its first page."""
    page = F.coalesce(F.col(first_page), F.lit(""))
    page = page if page_chars is None else F.substring(page, 1, page_chars)
    staged = df.withColumn("__stem", filename_stem(F.col(filename))).withColumn("__page", nfkc_lower(page))
    staged = staged.withColumn("__heading", first_lines(F.col("__page")))
    texts = {"stem": F.col("__stem"), "heading": F.col("__heading"), "corpus": F.concat("__stem", F.lit("\n"), "__page")}
    verdict = verdict_of(rules.upload["steps"], texts, rules.upload, rules, name)
    return staged.withColumn(out, verdict).drop("__stem", "__page", "__heading")


def keyword_score(text: Column, rule_sets: Sequence[R.RuleSet]) -> Column:
    """How many keywords occur; one listed in two sets counts twice."""
    words = [w for rules in rule_sets for _, listed in rules for w in listed]
    return reduce(lambda a, b: a + b, [text.contains(w).cast("int") for w in words], F.lit(0))


def link_priority(anchor: Column, url: Column, name: str | None = None,
                  rule_sets: Sequence[R.RuleSet] | None = None) -> Column:
    """Sort value of a link; the more keywords, the smaller."""
    if rule_sets is None:
        rule_sets = [R.SHIPPED.rules(r, name) for r in ("page_evergreen_rules", "page_title_rules", "page_rules")]
    return -keyword_score(F.concat_ws(" ", anchor, url), rule_sets)


def catalog_label(title: Column, source: Column, category: Column, name: str | None = None, rules: R.Rules = R.SHIPPED) -> Column:
    """Label of a catalog row: scholarship, stored category, title words, default."""
    text, listed = F.concat(title, source), rules.keywords
    first = listed["scholarship_label"]
    result = F.when(contains_any(text, first["any"]), F.lit(first["label"]))
    for code, code_label in listed["category_labels"].items():
        result = result.when(category == code, F.lit(code_label))
    for entry in listed["catalog_labels"]:
        result = result.when(contains_any(text, R.named_words(entry["any"], name)), F.lit(entry["label"]))
    return result.otherwise(F.lit(listed["default_catalog_label"]))


def static_list_page(title: Column, category: Column, url: Column, name: str | None = None) -> Column:
    """An overview list of a static category whose title says the same category."""
    return F.coalesce(
        category.isin(*R.STATIC_CATEGORIES) & (static_title_category(title, name) == category)
        & path(url).rlike(r"(?i)/list\d*\.htm\z"), F.lit(False))


def rules_from_rows(rows: Sequence) -> R.RuleSet:
    """Rows (ord, category, keywords) as an ordered rule set."""
    return [(r["category"], list(r["keywords"])) for r in sorted(rows, key=lambda r: r["ord"])]


def keyword_matches(df: DataFrame, text: str, keywords: DataFrame, out: str, shard: int = SHARD_KEYWORDS) -> DataFrame:
    """Add ``out``: an array with a struct of each row of ``keywords`` whose ``keyword`` occurs in the text.

    Each text is read once per ``shard`` keywords: a shard becomes one broadcast automaton that finds all of its
    words in one pass, so neither side is joined or shuffled and every size of the table takes the same way.
    Null and empty keywords match nothing, a null text has no matches, equal keywords are all reported.
    """
    listed = keywords.where(F.length("keyword") > 0)
    shards = max(1, -(-listed.count() // shard))
    part = F.pmod(F.xxhash64("keyword"), F.lit(shards))
    return df.withColumn(out, _occurring([listed.where(part == i) for i in range(shards)], F.col(text)))


def _finder(rows: list[dict]) -> Callable[[str], list[dict]]:
    numbers: dict[str, list[int]] = {}
    for i, row in enumerate(rows):
        numbers.setdefault(row["keyword"], []).append(i)
    automaton = ahocorasick.Automaton()
    for word, places in numbers.items():
        automaton.add_word(word, places)
    automaton.make_automaton()
    return lambda value: [rows[i] for i in sorted({i for _, places in automaton.iter(value) for i in places})] if numbers else []


def _occurring(shards: list[DataFrame], text: Column) -> Column:
    """The matches of all shards, found in one Python stage: a text reaches one worker, whatever the number of shards."""
    context = shards[0].sparkSession.sparkContext
    shared = [context.broadcast([r.asDict(recursive=True) for r in listed.collect()]) for listed in shards]

    @F.pandas_udf(T.ArrayType(shards[0].schema))
    def occurring(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        finders = [_finder(rows.value) for rows in shared]
        for batch in in_pieces(batches):
            yield batch.map(lambda value: [] if value is None else [hit for find in finders for hit in find(value)], na_action=None)

    # Not deterministic in name only: Spark then neither repeats the pass nor merges it into later expressions.
    return occurring.asNondeterministic()(text)


def keyword_hits(df: DataFrame, key: str, text: str, keywords: DataFrame, shard: int = SHARD_KEYWORDS) -> DataFrame:
    """Rows (key, *keyword columns) for every keyword contained in a text; other keyword columns ride along."""
    found = keyword_matches(df.select(key, text), text, keywords, "__found", shard)
    # The outer explode keeps Spark from testing the array, and so matching every text, a second time.
    rows = found.select(key, F.explode_outer("__found").alias("hit")).where(F.col("hit").isNotNull())
    return rows.select(key, *[F.col("hit")[c].alias(c) for c in keywords.columns])
