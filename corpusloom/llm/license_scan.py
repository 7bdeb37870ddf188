"""License scans with ordered signature rules, in DataFrame functions only.

One pass over the raw texts finds those that hold a keyword of any rule. Only these are cut into words, meet the rules
whose keyword they hold, and give detections (first word, last word, rule). Detections of a document are then sorted;
one that lies within another of the same or a stronger priority is suppressed, the earlier rule winning between equals.
"""

from __future__ import annotations

import operator
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.license_rules import BASE, BASE_SCORE, KEYWORDS, RULES, SCORES, Rule

_UPPER = "".join(map(chr, range(65, 91)))
_CUTS = "".join(map(chr, [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
_WORD = r"[\p{Alnum}[^\p{ASCII}]]+"
_OPEN, _SHUT = "\x01", "\x02"


def _let(value: Column, make: Callable[[Column], Column]) -> Column:
    """make of value, which is computed once, however often make uses it: a plain column would be copied into each use."""
    return F.transform(F.array(value), make)[0]


def spaced(text: Column) -> Column:
    """The text's words, A-Z in lower case, each with one space on either side."""
    plain = F.translate(text, _UPPER + _CUTS, _UPPER.lower() + " " * len(_CUTS))
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(plain, " +", " ")), F.lit(" "))


def _places(norm: Column, pattern: Column) -> Column:
    """(first, last) words, from 0, of all matches in order: marks go round them, and the marked words are counted off."""
    marked = F.regexp_replace(norm, pattern, F.lit(f" {_OPEN}$1{_SHUT}"))
    at = F.transform(F.split(F.trim(marked), " "), lambda w, i: F.struct(i.alias("i"), w.startswith(_OPEN).alias("first"), w.endswith(_SHUT).alias("last")))
    pick = lambda of, which: F.transform(F.filter(of, lambda x: x[which]), lambda x: x["i"])
    return _let(at, lambda a: F.arrays_zip(pick(a, "first").alias("first"), pick(a, "last").alias("last")))


def _may(low: Column, rules: tuple[Rule, ...]) -> Column:
    """Whether any rule or base phrase can match: a lower-cased text holds every word that the text holds, whatever else lower() does beyond ASCII."""
    every = lambda phrase: reduce(operator.and_, [F.contains(low, F.lit(w)) for w in phrase.split()])
    words: dict[str, set[str]] = {"licen": {"licen"}}
    for r in rules:
        words.setdefault(r.keyword, set()).update(r.words)
    # What holds a word that is enough by itself needs no look of its own.
    enough = {k for k, own in words.items() if k in own and " " not in k}
    ways = []
    for keyword, own in sorted(words.items()):
        own = {w for w in own if not any(k in w and (k != w or k != keyword) for k in enough)}
        if not own or any(k in keyword and k != keyword for k in enough):
            continue
        way = every(keyword)
        if KEYWORDS[keyword] not in keyword:
            way = way & low.rlike(KEYWORDS[keyword])
        if keyword not in own:
            way = way & reduce(operator.or_, [every(w) for w in sorted(own)])
        ways.append(way)
    return reduce(operator.or_, ways)


def detections(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with a column found: all matches of base phrases and rules as (base, first, last, priority, rule, label)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    may = _let(F.lower(text), lambda low: _may(low, rules))
    whole = lambda p: f" ({p})(?= )"
    # Rules by keyword and words, so that a text is searched once for what several rules ask for.
    by: dict[str, dict[tuple[str, ...], list[Column]]] = {}
    for base, r in [*((True, Rule(-1 - i, label, 9, "licen", (phrase,), phrase)) for i, (phrase, label) in enumerate(BASE)), *((False, r) for r in rules)]:
        rule = F.struct(F.lit(base).alias("base"), F.lit(r.priority).alias("priority"), F.lit(r.number).alias("rule"), F.lit(r.label).alias("label"), F.lit(whole(r.pattern)).alias("pattern"))
        by.setdefault(r.keyword, {}).setdefault(r.words, []).append(rule)
    table = F.array(*[
        F.struct(F.lit(keyword).alias("keyword"), F.array(*[F.struct(F.array(*map(F.lit, words)).alias("words"), F.array(*own).alias("rules")) for words, own in ways.items()]).alias("ways"))
        for keyword, ways in by.items()
    ])
    held = lambda norm: F.flatten(F.transform(
        F.filter(F.flatten(F.transform(F.filter(table, lambda k: F.contains(norm, k["keyword"])), lambda k: k["ways"])), lambda w: F.exists(w["words"], lambda x: F.contains(norm, x))), lambda w: w["rules"]
    ))
    hits = lambda norm: F.transform(
        F.filter(held(norm), lambda r: F.regexp(norm, r["pattern"])),
        lambda r: F.transform(_places(norm, r["pattern"]), lambda x: F.struct(r["base"].alias("base"), x["first"].alias("first"), x["last"].alias("last"), r["priority"].alias("priority"), r["rule"].alias("rule"), r["label"].alias("label"))),
    )
    return docs.withColumn("found", F.when(may, _let(spaced(text), lambda norm: F.flatten(hits(norm)))))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_detections): one row for each row of docs.

    Words are runs of digits, letters a-z after lower-casing A-Z, and characters beyond ASCII. A null text has none.
    n_base counts all places of base phrases; first_word and last_word are their smallest and largest start, null if
    there are none. labels are those of base phrases and of surviving detections. Without any, score is 0 and the
    labels are empty strings. A repeated row is a row of its own, with or without an id; a text of any length is
    searched whole; other columns of docs, whatever their names, are never read. An empty table gives an empty result.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("n_words", F.regexp_count("text", F.lit(_WORD)).cast("long"))
    found = detections(rows, "text", rules).select("uid", "doc_id", "n_words", F.explode_outer("found").alias("d")).select("uid", "doc_id", "n_words", "d.*")
    before = Window.partitionBy("uid").orderBy("first", F.desc("last"), "priority", "rule").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.lit(False)
    for p in sorted(SCORES):
        reach = F.max(F.when(F.col("priority") <= p, F.col("last"))).over(before)
        covered = covered | ((F.col("priority") == p) & F.coalesce(reach >= F.col("last"), F.lit(False)))
    kept = found.withColumn("stays", F.coalesce(F.col("base"), F.lit(False)) | (F.col("rule").isNotNull() & ~covered))
    base = F.coalesce(F.col("base"), F.lit(False))
    worth = F.when(base, BASE_SCORE)
    for p, s in SCORES.items():
        worth = worth.when(F.col("priority") == p, s)
    names = lambda when: F.array_join(F.array_sort(F.collect_set(F.when(when, F.col("label")))), ",")
    return kept.groupBy("uid").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"), F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
        names(base).alias("base_labels"), names(F.col("stays")).alias("labels"),
        F.coalesce(F.max(F.when(F.col("stays"), worth)), F.lit(0.0)).alias("score"), F.count_if("stays").alias("n_detections"),
    ).drop("uid")
