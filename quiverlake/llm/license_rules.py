"""License scans: an ordered table of signatures, gated by keywords, with overlaps resolved by priority and containment.

A text becomes one string of its words, each with a space before and behind it, so that a
signature can only match whole words. A text without any of a dozen anchor words is passed
over; of the others, only signatures whose keywords all occur are matched. Places come from
the words between matches. A place falls if another place that begins before it in the order
(start, longer first, priority, table order) reaches as far and has the same or a better
priority.

Everything is DataFrame functions. Texts stay in their tasks: one shuffle moves a narrow row
for each document and place. The table of signatures is of fixed size and is broadcast.

Defined results: a null text counts as empty; texts without words have no places; rows that
share an id, null ids included, are separate documents; other columns of the input are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import string
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

TAG, TEXT, NOTICE, NAMED, PLAIN, CLUE = range(1, 7)  # priorities, the best first
RELEVANCE = {TAG: 1.0, TEXT: 1.0, NOTICE: 0.95, NAMED: 0.85, PLAIN: 0.7, CLUE: 0.3}


class Rule(NamedTuple):
    label: str
    priority: int
    relevance: float
    base: bool
    needs: tuple[str, ...]  # words or parts of words that every match contains, an anchor first
    pattern: str  # over words with a space on both sides


#: The base phrases and their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: Licenses known by a long name: label, keywords of the name, the name, versions.
LONG_NAMES = (
    ("gpl", "general  public", "(gnu)? general public licen[sc]e", "1.0 2.0 3.0"),
    ("lgpl", "general  public", "(gnu)? (lesser|library) general public licen[sc]e", "2.0 2.1 3.0"),
    ("agpl", "affero", "(gnu)? affero general public licen[sc]e", "1.0 3.0"),
    ("gfdl", "documentation", "(gnu)? free documentation licen[sc]e", "1.1 1.2 1.3"),
    ("apache", "apache", "apache (software)? licen[sc]e", "1.0 1.1 2.0"),
    ("mpl", "mozilla", "mozilla public licen[sc]e", "1.0 1.1 2.0"),
    ("epl", "eclipse", "eclipse public licen[sc]e", "1.0 2.0"),
    ("eupl", "european", "european union public licen[sc]e", "1.0 1.1 1.2"),
    ("cddl", "distribution", "common development and distribution licen[sc]e", "1.0 1.1"),
    ("cpl", "common", "common public licen[sc]e", "1.0"),
    ("afl", "academic", "academic free licen[sc]e", "1.1 2.0 2.1 3.0"),
    ("osl", "open", "open software licen[sc]e", "1.0 2.0 2.1 3.0"),
    ("artistic", "artistic", "artistic licen[sc]e", "1.0 2.0"),
    ("bsl", "boost", "boost software licen[sc]e", "1.0"),
    ("busl", "business", "business source licen[sc]e", "1.0 1.1"),
    ("ofl", "font", "(sil)? open font licen[sc]e", "1.0 1.1"),
    ("odbl", "database", "open (data commons)? (open)? database licen[sc]e", "1.0"),
    ("ms-pl", "microsoft", "microsoft public licen[sc]e", ""),
    ("ms-rl", "microsoft", "microsoft reciprocal licen[sc]e", ""),
    ("ecl", "educational", "educational community licen[sc]e", "1.0 2.0"),
    ("upl", "universal", "universal permissive licen[sc]e", "1.0"),
    ("sspl", "server", "server side public licen[sc]e", "1.0"),
    ("cecill", "cecill", "cecill (free)? (software)? licen[sc]e", "1.0 2.0 2.1"),
    ("lppl", "latex", "latex project public licen[sc]e", "1.0 1.2 1.3"),
    ("psf", "python", "python software foundation licen[sc]e", "2.0"),
    ("ipl", "ibm", "ibm public licen[sc]e", "1.0"),
    ("zpl", "zope", "zope public licen[sc]e", "1.1 2.0 2.1"),
    ("mit", "mit", "(the)? mit (open)? (source)? licen[sc]e", ""),
    ("bsd-2-clause", "bsd", "(2|two|simplified) (clause)? bsd licen[sc]e", ""),
    ("bsd-3-clause", "bsd", "(3|three|new|revised|modified) (clause)? bsd licen[sc]e", ""),
    ("bsd", "bsd", "bsd (style)? licen[sc]e", ""),
    ("isc", "isc", "isc licen[sc]e", ""),
    ("zlib", "zlib", "zlib (libpng)? licen[sc]e", ""),
    ("x11", "x11", "x11 licen[sc]e", ""),
    ("cc-by", "attribution", "(creative commons)? attribution (international|unported)? licen[sc]e", "1.0 2.0 2.5 3.0 4.0"),
)

#: Licenses known by a short name that stands by itself: label, keyword, the name, versions.
SHORT_NAMES = (
    ("gpl", "gpl", "(gnu)? gpl", "1.0 2.0 3.0"),
    ("lgpl", "gpl", "(gnu)? lgpl", "2.0 2.1 3.0"),
    ("agpl", "gpl", "(gnu)? agpl", "1.0 3.0"),
    ("cc-by-nc-sa", "cc  by  nc  sa", "cc by nc sa", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nc-nd", "cc  by  nc  nd", "cc by nc nd", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nc", "cc  by  nc", "cc by nc", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-sa", "cc  by  sa", "cc by sa", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nd", "cc  by  nd", "cc by nd", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by", "cc  by", "cc by", "1.0 2.0 2.5 3.0 4.0"),
)

#: Words of an SPDX tag after "spdx license identifier", and the label.
TAGS = (
    ("mit", "mit"), ("isc", "isc"), ("zlib", "zlib"), ("unlicense", "unlicense"), ("wtfpl", "wtfpl"), ("0bsd", "0bsd"), ("bsd 2 clause", "bsd-2-clause"),
    ("bsd 3 clause", "bsd-3-clause"), ("apache 2 0", "apache-2.0"), ("mpl 2 0", "mpl-2.0"), ("epl 2 0", "epl-2.0"), ("bsl 1 0", "bsl-1.0"), ("cc0 1 0", "cc0-1.0"),
    ("artistic 2 0", "artistic-2.0"), ("eupl 1 2", "eupl-1.2"), ("ofl 1 1", "ofl-1.1"), ("postgresql", "postgresql"), ("ncsa", "ncsa"), ("python 2 0", "psf-2.0"), ("odbl 1 0", "odbl-1.0"),
)
GNU_TAGS = ("gpl 1 0", "gpl 2 0", "gpl 3 0", "lgpl 2 0", "lgpl 2 1", "lgpl 3 0", "agpl 1 0", "agpl 3 0", "gfdl 1 2", "gfdl 1 3")

#: Sentences that stand for a license or for reserved rights: label, priority, keywords, words.
SENTENCES = (
    ("mit", TEXT, ("permission",), "permission is hereby granted free of charge to any person obtaining a copy"),
    ("bsl-1.0", TEXT, ("permission", "organization"), "permission is hereby granted free of charge to any person or organization obtaining a copy"),
    ("isc", TEXT, ("permission", "purpose"), "permission to use copy modify and (or)? distribute this software for any purpose"),
    ("postgresql", TEXT, ("permission", "documentation"), "permission to use copy modify and distribute this software and its documentation for any purpose"),
    ("bsd", TEXT, ("redistribution", "binary"), "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", TEXT, ("endorse", "neither"), "neither the name of {0,9} may be used to endorse or promote products"),
    ("apache-2.0", TEXT, ("licen", "compliance"), "you may not use this file except in compliance with the licen[sc]e"),
    ("apache-2.0", NOTICE, ("licen", "www  apache  org"), "www apache org licenses licen[sc]e 2 0"),
    ("gpl", TEXT, ("redistribute", "modify"), "you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e as published"),
    ("gpl", CLUE, ("warranty", "merchantability"), "without even the implied warranty of merchantability or fitness"),
    ("zlib", TEXT, ("warranty", "liable"), "without any express or implied warranty in no event will the authors be held liable"),
    ("unlicense", TEXT, ("public  domain", "unencumbered"), "this is free and unencumbered software released into the public domain"),
    ("unlicense", NAMED, ("unlicense",), "the unlicense"),
    ("wtfpl", NAMED, ("public  licen", "fuck"), "do what the fuck you want to public licen[sc]e"),
    ("wtfpl", NAMED, ("wtfpl",), "wtfpl"),
    ("cc0-1.0", NAMED, ("cc0",), "cc0 (1)? (0)? (universal)?"),
    ("cc0-1.0", NOTICE, ("public  domain", "dedication"), "(creative commons)? (cc0)? public domain dedication"),
    ("public-domain", NOTICE, ("public  domain",), "(released|placed|dedicated) (in|into|to) the public domain"),
    ("public-domain", CLUE, ("public  domain",), "public domain"),
    ("cc-by-sa", NAMED, ("share", "attribution"), "attribution share (alike)?"),
    ("cc-by-sa", NAMED, ("sharealike", "attribution"), "attribution sharealike"),
    ("cc-by-nc", NAMED, ("noncommercial", "attribution"), "attribution noncommercial"),
    ("cc-by-nd", NAMED, ("noderivs", "attribution"), "attribution noderivs"),
    ("cc-by", NOTICE, ("creativecommons", "licenses  by"), "creativecommons org licenses by"),
    ("cc-by-sa", NOTICE, ("creativecommons", "licenses  by  sa"), "creativecommons org licenses by sa"),
    ("cc-by-nc", NOTICE, ("creativecommons", "licenses  by  nc"), "creativecommons org licenses by nc"),
    ("proprietary", NOTICE, ("rights  reserved",), "all rights reserved"),
    ("proprietary", NOTICE, ("permission", "reproduced"), "may (not)? be reproduced {0,4} without {0,3} permission"),
    ("proprietary", NOTICE, ("licen", "proprietary"), "proprietary (software)? licen[sc]e"),
    ("proprietary", NOTICE, ("licen", "agreement"), "end user licen[sc]e agreement"),
    ("copyright", CLUE, ("copyright",), "copyright (c)? [0-9]+"),
    ("unknown", CLUE, ("licen", "under"), "(licensed|released|distributed) under (the)? (terms of)? {0,4} licen[sc]e"),
    ("unknown", CLUE, ("spdx", "identifier"), "spdx licen[sc]e identifier"),
)

UNDER = "(is|are)? (licensed|released|distributed|available|provided|published|shared|covered) under (the)? (terms of)? (the)?"
LATER = "or (at your option)? (any)? later (version)?"
#: Every text with a match contains one of these: what a document is first tested for.
ANCHORS = (
    "licen", "gpl", "cc  by", "spdx", "permission", "redistribut", "public  domain", "rights  reserved", "copyright", "cc0", "wtfpl", "attribution", "endorse", "warranty",
)


def signature(words: str) -> str:
    """The regular expression of a signature written as words.

    A word is itself one; (a b|c) is a choice of runs of words, with ? behind it an optional one; {0,n} is up to n words.
    """
    out, rest = [], words
    while rest := rest.lstrip():
        if rest[0] == "(":
            group, rest = rest[1:].split(")", 1)
            out.append("(" + "|".join("".join(f" {w} " for w in run.split()) for run in group.split("|")) + ")")
            if rest.startswith("?"):
                out.append("?")
                rest = rest[1:]
        elif rest[0] == "{":
            most, rest = rest[1:].split("}", 1)
            out.append(f"( [^ ]+ ){{{most}}}?")
        else:
            word, _, rest = rest.partition(" ")
            out.append(f" {word} ")
    return "".join(out)


def version(number: str) -> str:
    """How a version is written: 2.0 as "2 0", "2", "v2" or "version 2"; 2.1 always with its second part."""
    major, minor = number.split(".")
    second = f"( {minor} )?" if minor == "0" else f" {minor} "
    return f"( version |( v ))?( v?{major} ){second}"


def _rule(label: str, priority: int, needs: tuple[str, ...], pattern: str, base: bool = False, relevance: float | None = None) -> Rule:
    anchors = [a for a in ANCHORS if any(a in n for n in needs)]
    return Rule(label, priority, RELEVANCE[priority] if relevance is None else relevance, base, (anchors[0], *(n for n in needs if n != anchors[0])), pattern)


def _names() -> list[Rule]:
    """Five rules for each name and each of its versions, three for a name without one."""
    out = []
    for names, more in ((LONG_NAMES, ("licen",)), (SHORT_NAMES, ())):
        for label, keyword, words, versions in names:
            name, needs = signature(words), (*more, keyword)
            for number in versions.split():
                exact, full = version(number), f"{label}-{number}"
                out.append(_rule(full, NOTICE, (*needs, "under"), signature(UNDER) + name + exact))
                out.append(_rule(full, NAMED, needs, name + exact))
                out.append(_rule(full, NAMED, (*needs, "of"), exact + signature("of (the)?") + name))
                if "gpl" in label:
                    out.append(_rule(f"{full}-or-later", NOTICE, (*needs, "later"), name + exact + signature(LATER)))
                    out.append(_rule(f"{full}-or-later", NOTICE, (*needs, "later"), exact + signature("of (the)?") + name + signature(LATER)))
            out.append(_rule(label, NOTICE if not versions else NAMED, (*needs, "under"), signature(UNDER) + name))
            out.append(_rule(label, NAMED if not versions else PLAIN, needs, name))
    return out


def _tags() -> list[Rule]:
    needs, lead = ("spdx", "identifier"), signature("spdx license identifier")
    out = [_rule(label, TAG, (*needs, words.replace(" ", "  ")), lead + signature(words)) for words, label in TAGS]
    for words in GNU_TAGS:
        stem, major, minor = words.split()
        for end in ("", "only", "or later"):
            label = "-".join([f"{stem}-{major}.{minor}", *end.split()])
            out.append(_rule(label, TAG, (*needs, words.replace(" ", "  ")), lead + signature(f"{words} {end}")))
    return out


RULES: tuple[Rule, ...] = (
    *(_rule(label, PLAIN, tuple(words.split()) if words != "cc by" else ("cc  by",), signature(words), base=True, relevance=RELEVANCE[PLAIN]) for words, label in BASE),
    *_tags(), *(_rule(label, priority, needs, signature(words)) for label, priority, needs, words in SENTENCES), *_names(),
)


def _values(rules: tuple[Rule, ...], array: str) -> str:
    """The rules as rows of SQL VALUES; `array` writes a list of strings."""
    rows = []
    for k, r in enumerate(rules):
        needs = array.format(", ".join(f"'{n}'" for n in r.needs))
        rows.append(f"({k}, '{r.label}', {r.priority}, CAST({r.relevance} AS DOUBLE), {str(r.base).lower()}, '{r.needs[0]}', {needs}, '{r.pattern}')")
    return ",\n".join(rows)


def rule_table(spark: SparkSession, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rules as a local table, and a row without a pattern that every document meets."""
    nothing = "(-1, '', 0, CAST(0 AS DOUBLE), false, '', array(''), CAST(NULL AS STRING))"
    return spark.sql(f"SELECT * FROM VALUES {_values(rules, 'array({})')},\n{nothing} AS r(rule, label, priority, relevance, base, anchor, needs, pattern)")


def spaced_words(text: Column) -> Column:
    """The words of a text, letters as they are, each with a space before and behind it; two spaces if there are none."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), GAP, "  ")), F.lit(" "))


def count_words(spaced: Column) -> Column:
    return F.floor((F.octet_length(spaced) - F.octet_length(F.replace(spaced, F.lit(" "), F.lit("")))) / 2)


def places(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_row, doc_id, n_words, the rule's columns, first (word) and length (words) of each place where a rule matches.

    Each document also has one row of rule -1 without a place. Matches of one rule don't overlap.
    """
    spark = docs.sparkSession
    keywords = sorted({n for r in rules for n in r.needs})
    texts = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).cast("long").alias("doc_id"), spaced_words(F.col(text_col)).alias("_spaced"))
    texts = texts.select("*", F.when(F.col("_spaced") == "  ", 0).otherwise(count_words(F.col("_spaced"))).cast("long").alias("n_words"), F.lower("_spaced").alias("_low"))
    anchored = F.lit(False)
    for anchor in sorted({r.needs[0] for r in rules}):
        anchored = anchored | F.col("_low").contains(anchor)
    present = F.filter(F.array(*map(F.lit, keywords)), lambda k: F.col("_low").contains(k))
    exact = F.translate("_spaced", string.ascii_uppercase, string.ascii_lowercase)
    texts = texts.select(
        "_row", "doc_id", "n_words", F.when(anchored, exact).otherwise("").alias("_words"),
        F.when(anchored, F.concat(F.array(F.lit("")), present)).otherwise(F.array(F.lit(""))).alias("_present"))
    met = texts.select("*", F.explode_outer("_present").alias("anchor")).join(F.broadcast(rule_table(spark, rules)), "anchor").where("size(array_except(needs, _present)) = 0")
    kept = "_row", "doc_id", "n_words", "rule", "label", "priority", "relevance", "base"
    found = met.select(*kept, "_words", "pattern", F.regexp_extract_all("_words", "pattern", F.lit(0)).alias("_found")).where("pattern IS NULL OR size(_found) > 0")
    zipped = F.arrays_zip(F.split("_words", F.col("pattern"), -1).alias("between"), F.col("_found").alias("match"))
    runs = found.select(*kept, F.posexplode_outer(zipped).alias("_k", "_z"))
    runs = runs.select(*kept, "_k", count_words(F.col("_z.between")).alias("_between"), count_words(F.col("_z.match")).alias("length"))
    upto = Window.partitionBy("_row", "rule").orderBy("_k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.sum(F.col("_between") + F.coalesce("length", F.lit(0))).over(upto) - F.col("length")
    return runs.repartition("_row").withColumn("first", start).where("rule < 0 OR length IS NOT NULL").drop("_k", "_between")


def resolved(found: DataFrame) -> DataFrame:
    """Add kept: false for a place that a longer one, or an equal one before it in the table, of the same or a better priority contains."""
    before = Window.partitionBy("_row").orderBy("first", F.desc("length"), "priority", "rule").rowsBetween(Window.unboundedPreceding, -1)
    contained = F.lit(False)
    for level in range(TAG, CLUE + 1):
        reach = F.max(F.when(F.col("priority") <= level, F.col("first") + F.col("length"))).over(before)
        contained = contained | ((F.col("priority") == level) & (reach >= F.col("first") + F.col("length")))
    return found.withColumn("kept", (F.col("rule") >= 0) & ~F.coalesce(contained, F.lit(False)))


def scan_licenses(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document with what was found in it; `detections` are the kept places in their order."""
    found = resolved(places(docs, rules, id_col, text_col))
    base, kept = F.col("base"), F.col("kept")
    place = F.struct("first", "length", "label", "priority", "relevance")
    return found.groupBy("_row").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("first"))).alias("first_word"), F.max(F.when(base, F.col("first"))).alias("last_word"),
        F.sort_array(F.collect_set(F.when(base, F.col("label")))).alias("base_labels"), F.sort_array(F.collect_set(F.when(base | kept, F.col("label")))).alias("labels"),
        F.coalesce(F.max(F.when(kept, F.col("relevance"))), F.lit(0.0)).alias("score"), F.sort_array(F.collect_list(F.when(kept, place))).alias("detections"),
    ).drop("_row")


def op13_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their license labels."""
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


OP13_SQL = rf"""
WITH rules(rule, label, priority, relevance, base, anchor, needs, pattern) AS (
VALUES {_values(RULES, "[{}]")}
), texts AS (
  SELECT row_number() OVER () AS k, doc_id, trim(regexp_replace(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{GAP}', '  ', 'g'), ' ') AS t FROM documents
), docs AS (
  SELECT k, doc_id, CASE WHEN t = '' THEN '' ELSE ' ' || t || ' ' END AS words, CASE WHEN t = '' THEN 0 ELSE len(string_split(t, '  ')) END::BIGINT AS n_words FROM texts
), met AS (
  SELECT k, rules.*, string_split_regex(words, pattern) AS between, regexp_extract_all(words, pattern) AS found
  FROM docs JOIN rules ON contains(words, anchor) AND len(list_filter(needs, lambda n: NOT contains(words, n))) = 0
), runs AS (
  SELECT *, (strlen(between[i]) - strlen(replace(between[i], ' ', ''))) // 2 AS gap, (strlen(found[i]) - strlen(replace(found[i], ' ', ''))) // 2 AS length
  FROM (SELECT k, rule, label, priority, relevance, base, between, found, unnest(range(1, len(found) + 1)) AS i FROM met)
), placed AS (
  SELECT *, sum(gap + length) OVER (PARTITION BY k, rule ORDER BY i) - length AS first FROM runs
), judged AS (
  SELECT *, NOT EXISTS (SELECT 1 FROM placed q WHERE q.k = p.k AND q.first <= p.first AND q.first + q.length >= p.first + p.length AND q.priority <= p.priority
    AND (q.first < p.first OR q.length > p.length OR q.priority < p.priority OR q.rule < p.rule)) AS kept
  FROM placed p
), found AS (
  SELECT k, count(*) FILTER (base) AS n_base, min(first) FILTER (base)::BIGINT AS first_word, max(first) FILTER (base)::BIGINT AS last_word,
    list_sort(list(DISTINCT label) FILTER (base)) AS base_labels, list_sort(list(DISTINCT label) FILTER (base OR kept)) AS labels, max(relevance) FILTER (kept) AS score
  FROM judged GROUP BY k
)
SELECT doc_id, n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(base_labels, ','), '') AS base_labels,
  coalesce(array_to_string(labels, ','), '') AS labels, coalesce(score, 0) AS score
FROM docs LEFT JOIN found USING (k)
"""
